import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import content_store, queries, shared

from .conftest import SCHEMA, edge_rows


@pytest.fixture(scope="module")
def tokenizer_json():
    return queries.byte_bpe()


@pytest.fixture(scope="module")
def encoder(tokenizer_json):
    return content_store.Encoder(tokenizer_json)


@given(st.lists(st.text(alphabet=st.sampled_from("ab Z9.,'!\n\té日 \x00 _s"), max_size=30), max_size=5))
@settings(max_examples=200, deadline=None)
def test_encoder_is_the_library(encoder, texts):
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == want


def test_added_tokens_go_to_the_library(encoder):
    texts = ["a <|endoftext|> b", "<|endoftext|>"]
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.integers(0, 5000), max_size=40), st.integers(0, 9))
@settings(max_examples=50, deadline=None)
def test_checksums_compose(sizes, seed):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(0, 50_000, n).astype("<u4") for n in sizes]
    tail, acc = np.cumsum(sizes[::-1])[::-1] - sizes if sizes else [], 0
    for p, t in zip(parts, tail):
        acc ^= int(content_store.crc_advance([zlib.crc32(p.tobytes())], [t])[0])
    assert acc == zlib.crc32(b"".join(p.tobytes() for p in parts))


def test_chunks_cover_and_resynchronise():
    ids = np.random.default_rng(1).integers(0, 50_000, 20_000).astype("<u2")
    a, b = content_store.cut_points(ids), content_store.cut_points(np.concatenate([ids[:5], ids]))
    assert a[-1] == len(ids) and all(0 < y - x <= content_store.MAX_IDS for x, y in zip([0, *a], a))
    assert len({x + 5 for x in a} & set(b)) > 0.9 * len(a)


def test_store_round_trip(spark, edge_docs, tokenizer_json, encoder):
    path = shared.new_path(spark, "test-store")
    content_store.write_store(edge_docs, path, tokenizer_json, 2)
    rows = sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {r[:2]: [*encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    got = sorted(content_store.read_digests(spark, path).collect(), key=lambda r: r.start)
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((r[0] is not None, r[0] or 0, len(ids[r[:2]]), crc(ids[r[:2]])) for r in rows)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r[0] for r in rows if r[0] is not None)
    whole = content_store.read_documents(spark, path).collect()
    assert {(r.doc_id, crc(r.ids)) for r in whole} == {(r.doc_id, r.ids_crc32) for r in got} and len(whole) == len(rows)
    chunks = content_store._chunks(spark, path)
    assert chunks.count() == chunks.select("key").distinct().count() < sum(len(content_store.cut_points(np.array(x, "<u2"))) for x in (ids[r[:2]] for r in rows))
    content_store.verify_manifest(spark, path)


def test_caches_give_the_library_s_ids(tokenizer_json, monkeypatch):
    import random

    monkeypatch.setattr(content_store, "CACHE_WORDS", 50)
    encoder, rng = content_store.Encoder(tokenizer_json), random.Random(3)
    words = ["".join(rng.choice("aeésßstr'.,!7日€") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    for _ in range(20):
        texts = [None, "", *(rng.choice(["", "\n", " "]) + "".join(rng.choice(words) + rng.choice("    \n") for _ in range(rng.randrange(40))) + rng.choice(words) for _ in range(10))]
        want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == want
    assert len(encoder.words) < 1000


@pytest.mark.parametrize(("table", "change", "says"), [("manifest", "where part <> 0", "as the manifest has it"), ("objects", "where kind = 'r' or n_tokens <> 5", "is not in the store"), ("recipes", "where doc_id <> 2", "does not give its chain")])
def test_losses_are_found(spark, tokenizer_json, table, change, says):
    path, bad = shared.new_path(spark, "test-store"), shared.new_path(spark, "test-bad")
    docs = spark.createDataFrame([(i, " word" * (i + 1), "en", "s", 1, 1, 0.0, "", 1, 1) for i in range(1, 6)], SCHEMA).coalesce(1)
    content_store.write_store(docs, path, tokenizer_json, 2)
    for name in ("objects", "recipes", "manifest", "meta"):
        t = spark.read.parquet(f"{path}/{name}")
        if name == table:
            t.createOrReplaceTempView("t")
            t = spark.sql(f"select * from t {change}")
        (t.write.partitionBy("kind") if name == "objects" else t.write).parquet(f"{bad}/{name}")
    with pytest.raises(Exception, match=says):
        content_store.read_digests(spark, bad).collect()


def test_damage_is_found(spark, tokenizer_json):
    path, bad = shared.new_path(spark, "test-store"), shared.new_path(spark, "test-bad")
    docs = spark.createDataFrame([(1, "some words here", "en", "s", 1, 1, 0.0, "", 1, 1)], SCHEMA)
    content_store.write_store(docs, path, tokenizer_json, 2)
    for name in ("objects", "recipes", "manifest", "meta"):
        t = spark.read.parquet(f"{path}/{name}")
        if name == "objects":
            t = t.selectExpr("key", "doc_id", "n_tokens", "root", "case when kind = 'c' then concat(body, x'0000') else body end as body", "kind")
        (t.write.partitionBy("kind") if name == "objects" else t.write).parquet(f"{bad}/{name}")
    with pytest.raises(Exception, match="does not have its content"):
        content_store.read_digests(spark, bad).collect()


def test_empty_store(spark, no_docs, tokenizer_json):
    path = shared.new_path(spark, "test-store")
    content_store.write_store(no_docs, path, tokenizer_json, 2)
    assert content_store.read_digests(spark, path).count() == 0
