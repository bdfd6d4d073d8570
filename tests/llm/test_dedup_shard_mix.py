import collections
import hashlib
import re
import zlib

import duckdb
import pytest

from chronofold.llm import exact_dedup, mixing, shards

from .conftest import SCHEMA, edge_rows


def view(con, rows):
    import pandas as pd

    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})
    con.register("documents", frame)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup_is_brute_force(edge_docs, keep):
    groups = collections.defaultdict(list)
    for r in edge_rows():
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.exact_dedup(edge_docs, keep=keep).collect()
    assert len(got) == len(edge_rows())
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = collections.Counter()
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        best = (max if keep == "max" else min)(known) if known else None
        assert (r.keep_id, r.group_size) == (best, len(ids))
        assert not r.kept or r.doc_id == best
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_dedup_normalises_and_takes_no_rows(edge_docs, no_docs):
    from pyspark.sql import functions as F

    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.exact_dedup(edge_docs, normalise=lambda c: F.lit("same")).where("kept").count() == 1


def test_shards_are_contiguous_and_balanced(edge_docs, no_docs):
    got = sorted(shards.shard_by_bytes(edge_docs, 5).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in edge_rows())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    total, start, first = sum(r.size for r in got), 0, {}
    for i, r in enumerate(got):
        assert r.shard == min(4, (2 * start + r.size) * 5 // (2 * total))
        assert r.slot == i - first.setdefault(r.shard, i)
        start += r.size
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert len({r.text_group for r in got}) == len({r[1] or "" for r in edge_rows()}) == len({(r.text_group, r.text_crc32) for r in got})
    assert shards.shard_by_bytes(no_docs).count() == 0


def test_mix_is_the_oracle(edge_docs):
    con = duckdb.connect()
    view(con, [r for r in edge_rows()])
    got = sorted(map(str, mixing.mix(edge_docs).select("doc_id", "size", "source", "source_size", "target", "taken").toPandas().astype({"doc_id": "Int64"}).itertuples(index=False, name=None)))
    want = sorted(map(str, con.sql(mixing.ORACLE).df().astype({"doc_id": "Int64"})[["doc_id", "size", "source", "source_size", "target", "taken"]].itertuples(index=False, name=None)))
    same = lambda rows: [x.replace("None", "nan") for x in rows]
    assert same(got) == same(want)


def test_mix_meets_targets_and_repeats_rows(edge_docs, no_docs):
    rows = mixing.mix(edge_docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter(r.size for r in rows) == collections.Counter(words(r[1]) for r in edge_rows())
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
        assert all(r.taken <= 3 * r.size for r in mine) and mine[0].target <= 3 * mine[0].source_size
    out = mixing.take(edge_docs)
    assert out.columns == edge_docs.columns
    assert sum(words(r.text) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.take(no_docs).count() == 0


def test_other_columns_do_not_matter(edge_docs, clashing_docs):
    rows = lambda df: sorted(map(str, df.collect()))
    out = mixing.take(clashing_docs)
    assert out.columns == clashing_docs.columns
    assert rows(out.select(edge_docs.columns)) == rows(mixing.take(edge_docs))
    assert rows(mixing.mix(clashing_docs)) == rows(mixing.mix(edge_docs))
    assert rows(exact_dedup.exact_dedup(clashing_docs)) == rows(exact_dedup.exact_dedup(edge_docs))
    assert rows(shards.shard_by_bytes(clashing_docs, 5)) == rows(shards.shard_by_bytes(edge_docs, 5))


def test_targets_of_many_sources(spark):
    """Water-filling by rounds: sources over their cap are set to it, and the rest is shared again."""
    rows = [(f"s{i:03}" if i else None, i * i % 37 + (i == 5) * 4000) for i in range(200)]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(order)}
    total, want, free = sum(n for _, n in rows), {}, dict(rows)
    while True:
        room, w = total - sum(want.values()), sum(weight[s] for s in free)
        over = {s: 3 * n for s, n in free.items() if room * weight[s] >= 3 * n * w}
        if not over:
            break
        want |= over
        free = {s: n for s, n in free.items() if s not in over}
    want |= {s: room * weight[s] / w for s in free}
    got = mixing.targets(spark.createDataFrame(rows, "source string, source_size long").repartition(7), (5, 2, 1), 1.0, 3).collect()
    assert len(got) == len(rows) and all(abs(r.target - want[r.source]) < 1e-6 for r in got)


def test_few_large_copies_are_split(spark):
    rows = [(i, "x" * 20_000 if i % 50 == 0 else f"text {i}", "en", "s", 1, 1, 0.0, "", 1, 1) for i in range(600)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, 550 if i % 50 == 0 else i, 12 if i % 50 == 0 else 1, i == 550 or i % 50 > 0) for i in range(600)}


def test_oracle_of_exact_dedup(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({exact_dedup.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet")).select(columns).collect()) == want


def test_oracle_of_shards(spark, edge_docs):
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "text_group"]
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    edges = duckdb.connect()
    view(edges, list(edge_rows()))
    for c, docs in ((con, spark.read.parquet(f"{sf}/documents.parquet")), (edges, edge_docs)):
        want = collections.Counter(c.sql(f"SELECT {', '.join(columns)} FROM ({shards.ORACLE})").fetchall())
        assert collections.Counter(tuple(r) for r in shards.shard_by_bytes(docs).select(columns).collect()) == want
