import random

import corpus_pipeline
from chronofold.llm import shingle_overlap

from .conftest import SCHEMA


def jaccard_groups(rows):
    """Components of rows whose 5-word shingle sets have similarity of 4/5 or more, by all pairs."""
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 0.5, "yes", 3, 11) for i, t in rows], SCHEMA).repartition(3)


def texts():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    out, line = [], " ".join(word() for _ in range(40))
    for k in range(25):
        base = [word() for _ in range(rng.randrange(20, 200))]
        for _ in range(6):  # up to a fifth of the shingles and beyond
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 25)):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
        out.append(" ".join(base) + " " + line)
    out += ["", " \t", None, "one two", "One  two", "one two three", "a b c d e", "a b c d e f"]
    return out


def test_components_are_brute_force(spark):
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts())]
    label = jaccard_groups(rows)
    groups = {}
    for (i, _), k in zip(rows, label, strict=True):
        groups.setdefault(k, set()).add(i)
    got = {}
    for r in shingle_overlap.near_copies(table(spark, rows)).collect():
        got.setdefault(r.component, set()).add(r.doc_id)
    many = lambda gs: sorted(sorted(g) for g in gs if len(g) > 1)
    assert many(got.values()) == many(groups.values()) and 20 < len(many(groups.values())) < len(groups)
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, table(spark, rows), "").collect()}
    assert kept == {min(g) for g in groups.values()}


def test_no_rows(no_docs):
    assert shingle_overlap.near_copies(no_docs).count() == 0


def test_sets_are_met_exactly(spark):
    rng = random.Random(4)
    edge = [-(1 << 63), -1, 0, 1, (1 << 63) - 1]
    base = sorted({*edge, *(rng.randrange(-(1 << 63), 1 << 63) for _ in range(40))})
    sets = {0: [], 1: base, 2: base[:36], 3: base[9:], 4: base[:35], 5: [7]} | {10 + k: sorted(rng.sample(base, 40)) for k in range(8)}
    sets[99] = list(range(300_000))  # a very long text, and one that has four fifths of it
    sets[98] = list(range(240_000))
    sets[97] = list(range(239_999))
    pairs = [(u, v) for u in sets for v in sets if u > v and (u < 90) == (v < 90)]
    got = shingle_overlap._verified(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(list(sets.items()), "mark long, hashes array<long>"))
    like = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    want = [(u, v) for u, v in pairs if like(set(sets[u]), set(sets[v]))]
    assert sorted(map(tuple, got.collect())) == sorted(want) and (99, 98) in want and (99, 97) not in want and (2, 1) in want and (4, 1) not in want
