"""Scans by ranges against windows by key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold import vocabulary as V
from chronofold.operators import metrics, order, validity


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    out = [(k if k < 40 else None, s, rng.choice([None, rng.randrange(9)])) for k in range(41) for s in range(rng.randrange(1, 12))]
    out += [(7_000, s, s % 5 or None) for s in range(30_000)]  # one key has nearly all rows
    return spark.createDataFrame(out, "k long, s long, v int").repartition(5)


def test_scan_is_the_window(rows):
    w = Window.partitionBy("k").orderBy("s")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select("*", (F.row_number().over(w) - 1).cast("long").alias("n"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("t"), F.min("v").over(before).alias("m"), F.lag("v").over(w).alias("l"))
    got = order.scan(rows, ["k"], ["s"], {"n": ("row", None), "t": ("sum", F.col("v")), "m": ("min", F.col("v")), "l": ("lag", F.col("v"))}, "test")
    key = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert key(got) == key(want)


def test_a_long_run_is_spread_over_tasks(spark, rows):
    ranged = rows.repartitionByRange(4, "k", "s").where("k = 7000").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) >= 3 and max(r["count"] for r in ranged) < 15_000


def test_anomalies_by_ranges(spark):
    rng = random.Random(4)
    rows = []
    for run in range(60):
        n = rng.randrange(1, 15) if run else 20_000
        for seq in range(1, n + 1):
            if run and rng.random() < 0.08:
                continue
            kind = rng.choice(["RUN_CREATED", "TASK_STARTED", "RUN_FAILED" if rng.random() < 0.2 else "TASK_LEASED", "nope" if rng.random() < 0.2 else "RUN_STARTED"]) if run else "TASK_STARTED"
            rows += [(run, seq, kind, None, None, rng.choice(['{"v":1}', '{"v":2}', "{}"]) if run else '{"v":1}', None)] * (2 if run and rng.random() < 0.05 else 1)
    rows[15_000] = (*rows[15_000][:2], "RUN_FAILED", *rows[15_000][3:])  # the long run goes on after its end
    j = spark.createDataFrame(rows, V.JOURNAL).repartition(6)
    key = lambda df: sorted(map(str, map(tuple, df.select("run_id", "seq", "kind", "rank", "expected", "found").collect())))
    assert key(validity.anomalies_of_long_runs(j)) == key(validity.anomalies(j))


def test_no_rows(spark):
    none = spark.createDataFrame([], V.JOURNAL)
    assert validity.anomalies_of_long_runs(none).collect() == []


def ranked(values, p):
    values = sorted(v for v in values if v is not None)
    return values[max(1, min(len(values), int(len(values) * p + 0.5))) - 1]


PS = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "most": 1.0}


@pytest.mark.parametrize("kind", ["long", "double"])
def test_percentiles_of_a_hot_group_by_ranges(spark, kind):
    rng = random.Random(5)
    of = {None: [3, 3, 4], "few": [5], "same": [8] * 500, "none": [None, None], "hot": [rng.randrange(-(10**9), 10**9) for _ in range(40_000)] + [7] * 9_000 + [None] * 10}
    of |= {f"g{k}": [rng.randrange(50) for _ in range(rng.randrange(1, 90))] for k in range(30)}
    cast = float if kind == "double" else int
    rows = [(k, k and len(k), None if v is None else cast(v)) for k, vs in of.items() for v in vs]
    df = spark.createDataFrame(rows, f"k string, m int, v {kind}").repartition(7)
    want = sorted(((str(k), *(ranked(vs, p) for p in PS.values())) for k, vs in of.items() if k != "none"), key=str)
    for at in (0, 10**6):
        found = metrics.percentile_by(df, ["k", "m"], "v", PS, values_by_group=at)
        assert sorted(((str(r.k), *(r[n] for n in PS)) for r in found.collect()), key=str) == want


def test_percentiles_by_ranges_leave_no_task_a_group(spark, monkeypatch):
    df = spark.range(60_000).select((F.col("id") % 1).alias("k"), (F.col("id") * 7919 % 60_000).alias("v"))
    found = metrics.percentile_by(df, ["k"], "v", {"x": 0.5}, values_by_group=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(s_part" in plan and "windowspecdefinition(k#" not in plan
    monkeypatch.setattr(metrics, "TOTALS_SENT", 0)  # totals that are too many to send are joined
    assert found.first().x == metrics.percentile_by(df, ["k"], "v", {"x": 0.5}, values_by_group=0).first().x == 29_999


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([], "k long, v long")
    assert all(metrics.percentile_by(none, ["k"], "v", {"x": 0.5}, values_by_group=n).count() == 0 for n in (0, 10))
