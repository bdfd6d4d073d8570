import math
import random
import zlib

import numpy as np
import pytest
import zstandard

from chronofold.llm import features, language, quality, toxicity

from .conftest import SCHEMA, edge_rows

DATA = "/root/testdata/sf0.01"


def docs_of(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_held_out_accuracy(spark):
    docs = docs_of(spark)
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_quality_held_out_accuracy(spark):
    got = quality.score_quality(docs_of(spark), spark.read.parquet(f"{DATA}/labels.parquet"))
    got = got.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93 and (got.predicted == (got.score >= 0.5)).all()


def test_toxicity_tells_words_apart(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choice(["ka", "to", "mi", "ren", "sol", "vu"]) for _ in range(rng.randrange(1, 5))) for _ in range(500)]
    bad = ["grumblesnout", "wretchface", "dunderblock", "muckraker"]

    def text(toxic):
        return " ".join(rng.choice(bad) if toxic and rng.random() < 0.06 else rng.choice(plain) for _ in range(120))

    rows = [(i, text(i % 3 == 0), "en", "s", 1, 1, 0.0, "", 1, 1) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).where("held_out").toPandas()
    truth = (got.doc_id % 3 == 0).astype(int)
    assert (got.predicted == truth).mean() > 0.95 and (got.predicted == (got.score >= 0.7)).all()


@pytest.mark.parametrize("operator", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers_take_edge_cases(spark, edge_docs, no_docs, operator):
    label = "toxic" if operator is toxicity.score_toxicity else "quality"
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(3, 0, 0), (None, 1, 1), (5, None, None)], schema)
    none = spark.createDataFrame([], schema)
    got = operator(edge_docs, labels).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in operator(edge_docs, none).collect()} == {0.5}
    assert operator(no_docs, labels, label=label).count() == 0


def test_language_takes_edge_cases(edge_docs, no_docs):
    got = language.identify(edge_docs)
    by_id = {r.doc_id: r.lang_pred for r in got.collect()}
    assert {by_id[2000], by_id[2001], by_id[2002], by_id[2005]} == {"und"} and by_id[2004] != "und"
    assert language.identify(no_docs).count() == 0
    model = language.fit(edge_docs)
    assert language.keep_known(edge_docs, model, 0.0).columns == edge_docs.columns
    assert language.keep_known(edge_docs, model, 0.0).where("doc_id in (2000, 2001, 2002, 2005)").count() == 0
    assert {r.lang_pred for r in language.identify(edge_docs.withColumn("lang", edge_docs["lang"].substr(100, 1)).where("lang is null")).collect()} == {"und"}


def test_ftrl_is_the_plain_loop():
    rng, n_cells, n_langs = np.random.default_rng(2), 12, 3
    rows = [(np.sort(rng.choice(n_cells, 4, replace=False)), rng.random(4)) for _ in range(30)]
    y = rng.integers(0, n_langs, 30)
    alpha, beta, l1, l2, epochs = 0.5, 1.0, 0.8, 0.05, 4
    z, n = [[0.0] * n_langs for _ in range(n_cells + 1)], [[0.0] * n_langs for _ in range(n_cells + 1)]

    def weight(i, k):
        pull = 0.0 if i == n_cells else l1
        if abs(z[i][k]) <= pull:
            return 0.0
        return -(z[i][k] - math.copysign(pull, z[i][k])) / ((beta + math.sqrt(n[i][k])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            x = [*zip(rows[r][0].tolist(), rows[r][1].tolist()), (n_cells, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in x for k in range(n_langs)}
            e = [math.exp(sum(v * w[i, k] for i, v in x)) for k in range(n_langs)]
            for i, v in x:
                for k in range(n_langs):
                    g = v * (e[k] / sum(e) - (k == y[r]))
                    step = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / alpha
                    z[i][k] += g - step * w[i, k]
                    n[i][k] += g * g
    w, b = language.train_ftrl(rows, y, n_cells, n_langs, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    assert np.allclose(w, [[weight(i, k) for k in range(n_langs)] for i in range(n_cells)], atol=1e-5)
    assert np.allclose(b, [weight(n_cells, k) for k in range(n_langs)], atol=1e-5) and (w == 0).any()


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(4)
    logits = rng.standard_normal((200, 3)) * 6
    y = (logits + rng.standard_normal((200, 3)) * 5).argmax(axis=1)
    loss = lambda t: np.mean([math.log(sum(math.exp(v / t) for v in r)) - r[k] / t for r, k in zip(logits, y)])
    t = language._temperature(logits, y)
    assert all(loss(t) <= loss(t * f) + 1e-9 for f in (0.7, 0.95, 1.05, 1.4))


def test_votes_are_plain_neighbours(spark, edge_docs):
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    model = quality.fit(edge_docs, labels)
    got = {(r.doc_id, r.text or ""): r.score for r in quality.predict(edge_docs, model, {"doc_id": edge_docs["doc_id"], "text": edge_docs["text"]}).collect()}
    texts = {r[1] for r in edge_rows() if r[1] and not r[1].isspace() and len(r[1]) < 2000}
    for key in [k for k in got if k[1] in texts][:60]:
        x = np.log1p(quality.term_counts(key[1])) * np.append(model.idf[:-1], quality.REPEAT_WEIGHT)
        x = (x / np.linalg.norm(x)) @ model.axes
        near = sorted(((float(x / np.linalg.norm(x) @ v), float(y)) for v, y in zip(model.vectors, model.labels)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(s, 0) ** quality.SHARPNESS for s, _ in near]
        assert abs(got[key] - sum(a * y for a, (_, y) in zip(w, near)) / sum(w)) < 5e-3


def test_document_frequencies_are_of_all_rows(edge_docs):
    texts = [r[1] for r in edge_rows() if r[1] is not None and zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 3 != 1]
    count = lambda t: features.ngram_counts(t, (1, 2), 8)
    seen, n = features.document_frequencies(features.training_texts(edge_docs), count, 256)
    assert n == len(texts) and (seen == sum((count(t) > 0).astype(int) for t in texts)).all()


def test_gains_are_compressed_lengths():
    toxic, ordinary = b" dunderblock muckraker", b" some ordinary words of a plain kind" * 20
    distance = toxicity.Distance(toxic, ordinary)
    params = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_LAZY, min_match=4, search_log=4, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(window, content):
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(window))

    parts = toxicity.windows(b"a plain kind of muckraker and dunderblock, and some ordinary words of no kind " * 3, 5)
    assert distance.gains(parts).tolist() == [length(w, ordinary) - length(w, toxic + ordinary) for w in parts]
    assert distance.gains([b" muckraker dunderblock"])[0] > 0 == distance.gains([b" of a plain kind"])[0]


def test_toxic_dictionary_is_trained_and_pruned():
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    text = lambda bad: " ".join("muckraker" if bad and rng.random() < 0.05 else rng.choice(plain) for _ in range(150)).encode()
    toxic, ordinary = [text(True) for _ in range(120)], [text(False) for _ in range(120)]
    assert b"muckraker" in b" ".join(toxicity._segments(toxic)) and len(toxicity._segments(toxic)) > 50
    kept = toxicity._toxic(toxic, ordinary).split()
    assert kept and all(w in b"muckraker" or b"muckraker" in w for w in kept)
    segments = [b"muckraker", b"rak", b"zzzzzz"]
    assert toxicity._shares(segments, toxic).tolist() == [sum(s in t for t in toxic) / 120 for s in segments]


def test_other_columns_do_not_matter(spark, edge_docs, clashing_docs):
    rows = lambda df: sorted(map(str, df.collect()))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    assert rows(quality.score_quality(clashing_docs, labels)) == rows(quality.score_quality(edge_docs, labels))
    assert rows(toxicity.score_toxicity(clashing_docs, labels)) == rows(toxicity.score_toxicity(edge_docs, labels))
    assert rows(language.identify(clashing_docs)) == rows(language.identify(edge_docs))


def test_repeated_ids_give_one_sample(spark, edge_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(2001, 1, 1)], "doc_id long, quality int, toxic int")
    got = features.labelled_sample(edge_docs.unionByName(edge_docs.withColumn("text", edge_docs["source"])), labels, "quality", 100).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and set(ids) == {i for i in [*range(60), 2001] if zlib.crc32(str(i).encode()) % 3 != 1}


def test_counts_do_not_depend_on_stretches(monkeypatch):
    text = "Hello wörld, " * 50
    whole = features.ngram_counts(text, (1, 2, 3), 10)
    monkeypatch.setattr(features, "STRETCH", 37)
    assert (features.ngram_counts(text, (1, 2, 3), 10) == whole).all() and whole.sum() == 3 * len(text) - 3
