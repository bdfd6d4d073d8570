import math

import numpy as np
import pytest

from chronofold.llm import queries, vector_search


def brute(rows, k):
    """(query_id, rank, vec_id, score) by all distances; rows: (vec_id, vector)."""
    good = [(i, v) for i, v in rows if v is not None and any(x for x in v if x) and all(x is not None and math.isfinite(x) for x in v)]
    sizes = sorted({len(v) for _, v in good}, key=lambda s: (sum(len(v) == s for _, v in good), s))
    good = [(i, np.array(v, float)) for i, v in good if len(v) == sizes[-1]]
    out = []
    for at, (q, v) in enumerate(good):
        if q is not None and q % 100 == 0:
            near = sorted((float(np.sqrt(((x - v) ** 2).sum())), i is None, i or 0) for n, (i, x) in enumerate(good) if n != at)[:k]
            out += [(q, r + 1, None if none else i, s) for r, (s, none, i) in enumerate(near)]
    return sorted(out, key=str)


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, d))
    x = rng.standard_normal((n, d)) * 0.7
    x[: n // 3] = centre[0] + 0.02 * rng.standard_normal((n // 3, d))  # a third lie together
    x[n // 3 : n // 2] = centre[rng.integers(12, size=n // 2 - n // 3)] + 0.1 * rng.standard_normal((n // 2 - n // 3, d))
    return rng.permutation(x)


def edge_rows():
    x = vectors(900, 12)
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [(1000 + 100 * i, rows[5][1]) for i in range(12)] + [(2300, rows[7][1])] * 3 + [(None, rows[7][1]), (None, [1.0] * 12)]
    rows += [(2400, None), (2500, []), (2600, [0.0] * 12), (2700, [1.0, None] + [0.0] * 10), (2800, [float("nan")] * 12), (2900, [float("inf")] + [0.0] * 11), (3000, [1.0, 2.0]), (-100, rows[9][1])]
    return rows


def test_small_tables_by_brute_force(spark):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in edge_rows()], "vec_id long, embedding array<float>, row string, v int").repartition(3)
    got = [tuple(r) for r in vector_search.nearest(df, "vec_id % 100 = 0").select("query_id", "rank", "vec_id", "score").collect()]
    want = brute(edge_rows(), 10)
    assert len(got) == len(want)
    found = len({(q, i, s) for q, _, i, s in got} & {(q, i, s) for q, _, i, s in want}) / len({(q, i, s) for q, _, i, s in want})
    assert found > 0.97
    copies = lambda rows: sorted(r for r in rows if r[0] >= 1000 and r[3] == 0)  # noqa: E731  ties go to the smaller id
    assert copies(got) == copies(want)


def test_few_rows_and_none(spark):
    few = [(100, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]
    made = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vector_search.nearest(made(few), "vec_id % 100 = 0").collect())) == sorted(brute(few, 10))
    for rows in ([], [(100, None)], [(100, [0.0])], few[:1], few[1:]):
        assert vector_search.nearest(made(rows), "vec_id % 100 = 0").collect() == []


@pytest.mark.parametrize("radius", [0, 3, 15, 16, 40, 90, 128])
def test_probing_finds_every_code_in_the_radius(radius):
    x = vectors(70_000, 16)
    words = vector_search.learn(x[:2_000])(x)
    index, masks = vector_search.Index(words), vector_search.Index.masks()
    for q in words[:12]:
        at, differ = index.within(q, radius, masks)
        all_differ = vector_search.hamming(words, q)
        assert at.tolist() == np.flatnonzero(all_differ <= radius).tolist() and (differ == all_differ[at]).all()


def test_passes_over_query_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors(3_000, 8))], "vec_id long, embedding array<double>").repartition(4)
    whole = sorted(map(tuple, vector_search.nearest(df, "vec_id % 100 = 0").collect()))
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, vector_search.nearest(df, "vec_id % 100 = 0").collect())) == whole


def test_recall_on_the_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = {tuple(r) for r in queries.op11_nearest(spark, "/root/testdata/sf0.1").collect()}
    want = set(brute(rows, 10))
    assert len(got) == len(want) and len(got & want) >= 0.97 * len(want)
