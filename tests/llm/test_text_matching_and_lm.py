import collections
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from chronofold.llm import decontaminate, language_model, shared

from .conftest import SCHEMA, edge_rows

SMALL = st.text(alphabet="abc ", max_size=30)


def distance(p: str, t: str) -> int:
    """Least edit distance of p to a substring of t."""
    row, best = list(range(len(p) + 1)), len(p)
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


@given(SMALL.filter(bool), SMALL)
@settings(max_examples=200, deadline=None)
def test_myers(p, t):
    assert decontaminate.best_match(decontaminate.Item.of(0, p, 0.1), t)[0] == distance(p, t)


@given(st.lists(st.text(alphabet="ab ", min_size=8, max_size=24), max_size=3), st.text(alphabet="ab ", max_size=60))
@settings(max_examples=150, deadline=None)
def test_matcher_loses_nothing(items, text):
    rows = list(enumerate(items))
    found = {(i, d) for i, d, _ in decontaminate.Matcher(rows, 0.2).search(text)} if rows else set()
    assert found == {(i, distance(t, text)) for i, t in rows if distance(t, text) <= int(len(t) * 0.2)}


def test_planted_passages(spark, edge_docs, no_docs):
    item = "The quick brown fox jumps over the lazy dog while seven wizards brew a potion, twice."
    docs = [(1, f"intro {item} end"), (2, "x " + item.upper().replace(" ", "\n ") + " y"), (3, f"a {item.replace('brown', 'browm').replace('lazy ', 'lzy ')} b"), (4, item[:40]), (5, None), (6, ""), (None, item), (7, "nothing of it " * 500)]
    table = spark.createDataFrame([(*d, "en", "s", 1, 1, 0.0, "", 1, 1) for d in docs], SCHEMA)
    benchmark = spark.createDataFrame([(9, item), (10, None), (None, item), (11, "short"), (9, item), (12, " "), (13, "Intro the"), (14, "ro the q")], "item_id long, text string")
    got = decontaminate.contaminated(table, benchmark, words_below=32).collect()
    each = {(1, 0), (2, 0), (3, 2), (None, 0)}
    assert collections.Counter((r.doc_id, r.item_id, r.distance) for r in got) == collections.Counter([(d, i, x) for d, x in each for i in (9, None)] + [(1, 13, 0)])
    assert sorted(r.doc_id for r in decontaminate.decontaminate(table, benchmark).collect()) == [4, 5, 6, 7]
    one_rule = decontaminate.contaminated(table.withColumns({"item_id": F.lit(1), "end": F.lit(2), "distance": F.lit(3)}), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in one_rule} - {(r.doc_id, r.item_id) for r in got} == {(1, 14)}
    assert decontaminate.contaminated(no_docs, benchmark).count() == 0
    assert decontaminate.decontaminate(edge_docs, benchmark.limit(0)).count() == edge_docs.count()


def test_short_items_have_edits_too():
    matcher = decontaminate.Matcher([(1, "twenty characters ok"), (2, "tiny")], 0.08)
    assert [(i, d) for i, d, _ in matcher.search("say twenty charaxters ok now")] == [(1, 1)]
    assert [(i, d) for i, d, _ in matcher.search("destiny, twenty charaxterz ok")] == [(2, 0)]


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    items = [f"item number {i} says something rather unlike the others {i * 7919}" for i in range(4)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"see {t} there", "en", "s", 1, 1, 0.0, "", 1, 1) for i, t in enumerate(items)], SCHEMA)
    assert len(list(decontaminate._blocks(benchmark, "text", "item_id"))) == 4
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).where("distance = 0").collect()}
    assert got == {(i, i) for i in range(4)}
    assert decontaminate.decontaminate(docs, benchmark).count() == 0


def test_language_model(spark, edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr(language_model, "VOCABULARY", 300)  # several vocabularies a task
    rows = edge_rows()
    words = lambda r: (r[1] or "").encode().lower().split()
    held = lambda r: zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2
    count = collections.Counter()
    for r in rows:
        if not held(r):
            count.update([*words(r), b""])
    n, v = sum(count.values()), len(count)
    want = sorted((r[0] is not None, r[0] or 0, held(r), len(words(r)) + 1, sum(count[w] > 0 for w in [*words(r), b""]), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words(r), b""]), 6)) for r in rows)
    got = language_model.score(edge_docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert language_model.score(no_docs).count() == 0


def walk(model, far, near, y, n_outcomes):
    """log10 probability of y, by plain loops."""
    size, vec_near, vec_far, of_class, of_word, class_bias, word_bias = model
    q = [float(a) + float(b) for a, b in zip(vec_near[near], vec_far[far])]
    dot = lambda v: sum(a * float(b) for a, b in zip(q, v))
    c = y // size
    classes = [dot(of_class[i]) + float(class_bias[i]) for i in range(len(of_class))]
    words = [dot(of_word[i]) + float(word_bias[i]) for i in range(c * size, min((c + 1) * size, n_outcomes))]
    total = lambda z: math.log(sum(map(math.exp, z)))
    return (classes[c] - total(classes) + words[y - c * size] - total(words)) / math.log(10)


def test_model_is_normalised_and_learns(monkeypatch):
    monkeypatch.setattr(language_model, "PASSES", 60)
    monkeypatch.setattr(language_model, "BLOCK", 100)
    k, rng = 57, np.random.default_rng(0)
    far, near = rng.integers(0, k, 6000), rng.integers(0, k, 6000)
    model = language_model.train(np.bincount(near, minlength=k), far, near, near).arrays()  # the outcome is the one before
    each = language_model.log_probabilities(model, np.repeat(far[:5], k), np.repeat(near[:5], k), np.tile(np.arange(k), 5))
    assert np.allclose((10 ** each.reshape(5, k)).sum(axis=1), 1, atol=1e-4)
    assert np.allclose(each[:60], [walk(model, far[i // k], near[i // k], i % k, k) for i in range(60)], atol=1e-4)
    assert np.mean(language_model.log_probabilities(model, far, near, near)) > math.log10(10 / k)


@pytest.mark.parametrize("shift", [0, 200, -200])
def test_log_softmax_of_any_size(shift):
    z = np.random.default_rng(1).standard_normal((50, 9)).astype(np.float32) * 3 + np.float32(shift)
    at = np.arange(50) % 9
    want = [float(r[k]) - math.log(sum(math.exp(float(x) - float(max(r))) for x in r)) - float(max(r)) for r, k in zip(z, at)]
    assert np.allclose(language_model._log_softmax_at(z, at), want, atol=1e-4)


def test_scores_are_a_naive_walk(edge_docs, monkeypatch):
    monkeypatch.setattr(language_model, "VOCABULARY", 300)
    monkeypatch.setattr(language_model, "TOKENS", 5000)
    models, train = [], language_model.train
    monkeypatch.setattr(language_model, "train", lambda *a: models.append((a[0], train(*a))) or models[-1][1])
    got = {(r.doc_id, round(r.base_score, 6)): r.score for r in language_model.score(edge_docs).collect()}
    rows = [(r[0], (r[1] or "").encode().lower().split()) for r in edge_rows()]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    count = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
    docs = sum(not held(i) for i, _ in rows)
    n, v = sum(count.values()) + docs, len(count) + 1
    top = sorted((w for w in count if count[w] >= language_model.MIN_COUNT), key=lambda w: (-count[w], w))[: int(language_model.ROOT * n**0.5)]
    number = {w: language_model.RARE + 1 + i for i, w in enumerate(top)}
    rare = lambda w: zlib.crc32(w[:2]) % language_model.RARE + 1
    mass = collections.Counter({i: 1 for i in range(1, language_model.RARE + 1)})
    for w in count:
        if w not in number:
            mass[rare(w)] += count[w] + 1
    (counts, model), seen = models[0], 0
    assert len(models) == 1 and counts[0] == docs and counts.sum() == n and len(number) > 50
    for i, ws in rows:
        if not 0 < len(ws) < 100:
            continue
        outcomes = [number.get(w) or rare(w) for w in ws] + [0]
        want = sum(math.log10((count[w] + 1) / mass[rare(w)]) for w in ws if w not in number)
        want += sum(walk(model.arrays(), a, b, y, len(counts)) for a, b, y in zip([0, 0, *outcomes], [0, *outcomes], outcomes))
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws) + math.log10((docs + 1) / (n + v + 1))
        assert abs(got[i, round(base, 6)] - want) < 1e-3
        seen += 1
        if seen == 40:
            break


def test_training_passes_over_every_position(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10, 200)), "en", "s", 1, 1, 0.0, "", 1, 1) for i in range(300)]  # many positions an outcome
    passed, learn = spark.sparkContext.accumulator(0), language_model._learn

    def counted(m, grown, far, near, y, *rest):
        passed.add(len(y))
        learn(m, grown, far, near, y, *rest)

    monkeypatch.setattr(language_model, "_learn", counted)
    monkeypatch.setattr(language_model, "BLOCK", 3000)
    got = language_model.score(spark.createDataFrame(docs, SCHEMA).repartition(3))
    assert passed.value == got.first().train_tokens > 50_000


def test_words_are_numbered_and_counted_once_a_vocabulary(spark, monkeypatch):
    texts = {1: " \t\n", 2: "", 3: None, 4: "  Ab aB\x0bÄb äb\x85x\x1cy ", 5: "ends \r\n", 6: "\xa0 ab", 7: "日本 \x0cAB"}
    texts |= {i: " ".join(f"w{i}x{j}" for j in range(1000)) for i in range(100, 400)}  # more distinct words than a vocabulary had
    monkeypatch.setattr(language_model, "SLICE", 50_000, raising=False)  # several slices a batch
    rows = language_model.tokenise(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)).collect()
    words = {(r.part, r.number): (bytes(r.word), r.n) for r in rows if r.kind == 1}
    assert len({r.part for r in rows}) == 1 and len(words) == len({w for w, _ in words.values()}) > 290_000
    count = collections.Counter()
    for r in (r for r in rows if r.kind == 0):
        want = (texts[r.doc_id] or "").encode().lower().split()
        assert [words[r.part, k][0] for k in np.frombuffer(r.ids, np.int32)] == want
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        count.update([] if r.held_out else want)
    assert sum(r.kind == 0 for r in rows) == len(texts) and all(n == count[w] for w, n in words.values())


def test_sums_of_runs():
    rng = np.random.default_rng(5)
    for shape in ((1000, 24), (1000, 7), (1000,)):
        x, first = rng.standard_normal(shape).astype(np.float32), np.r_[0, np.sort(rng.choice(np.arange(1, 1000), 99, replace=False))]
        want = [part.sum(axis=0) for part in np.split(x.astype(np.float64), first[1:])]
        assert language_model._sums(x, first).dtype == np.float32 and np.allclose(language_model._sums(x, first), want, atol=1e-4)


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = shared.written(stage(spark, seen[-1], sf), "test-stage")
        if name != "token-output":
            assert out.columns == docs.columns
        seen.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    letters = {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    assert ids[1] <= letters and len(ids[1]) > 0.97 * len(letters)
    found = collections.defaultdict(list)
    for r in seen[1].collect():
        w = (r.text or "").encode().lower().split()
        found[frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))].append(r.doc_id)
    sets, left = list(found), {}
    for i, s in enumerate(sets):  # by all pairs
        left[i] = i
        for j in range(i):
            if 4 * max(len(s), len(sets[j])) <= 5 * min(len(s), len(sets[j])) and 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = sorted((left[i], left[j]))
                left = {x: a if y == b else y for x, y in left.items()}
    groups = collections.defaultdict(list)
    for i, s in enumerate(sets):
        groups[left[i]] += found[s]
    assert ids[2] == {min(g) for g in groups.values()}
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in seen[2].collect() if any(i in decontaminate.normalise(r.text or "") for i in items)}
    assert leaked and not leaked & ids[3] and len(ids[3]) >= len(ids[2]) - len(leaked) - 2
    assert seen[5].count() == seen[4].count() > 0
