"""Figures taken while a stream is written."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronofold.streaming import journal, observed

BOUNDS = [0.5, 1, 10]


def figures():
    return observed.counter("rows") | observed.counter("bad", F.col("kind") == "bad") | observed.histogram("took", F.col("v"), BOUNDS)


def want(rows):
    vs = [v for _, v in rows if v is not None]
    edges = [-math.inf, *BOUNDS, math.inf]
    out = {f"took_bucket:{le}": sum(a < v <= b for v in vs) for le, a, b in zip(["0.5", "1", "10", "+Inf"], edges, edges[1:], strict=False)}
    return out | {"rows": len(rows), "bad": sum(k == "bad" for k, _ in rows), "took_count": len(vs), "took_sum": sum(vs)}


def test_figures_survive_a_broken_stream(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    src, path, check = (f"file://{tmp_path}/{n}" for n in ("src", "out", "check"))
    parts = [[(rng.choice(["ok", "bad", None]), rng.choice([None, 0.5, 1.0, 10.0, rng.randrange(80) / 4])) for _ in range(n)] for n in (40, 1, 300)]
    stream = lambda: journal.tail(spark, src, "kind string, v double", files_per_batch=1)
    real = observed.write_batch
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "kind string, v double").coalesce(1).write.mode("append").parquet(src)
        if k == 1:  # the driver is lost after rows and figures are written, before the micro-batch is committed

            def breaks(*args):
                real(*args)
                raise RuntimeError("lost driver")

            monkeypatch.setattr(observed, "write_batch", breaks)
            with pytest.raises(Exception, match="lost driver"):
                observed.write(stream(), path, check, figures()).awaitTermination()
            monkeypatch.setattr(observed, "write_batch", real)
        observed.write(stream(), path, check, figures()).awaitTermination()
    got = {r.metric: r.value for r in observed.totals(spark, path).collect()}
    assert got == pytest.approx(want([r for rows in parts for r in rows]))
    assert observed.by_batch(spark, path).select("batch").distinct().count() == len(parts)
    assert spark.read.parquet(f"{path}/rows").count() == sum(map(len, parts))


def test_an_empty_batch_has_figures_of_zero(spark, tmp_path):
    none = spark.createDataFrame([], "kind string, v double")
    observed.write_batch(none, 0, f"file://{tmp_path}/none", figures())
    assert {r.value for r in observed.totals(spark, f"file://{tmp_path}/none").collect()} == {0.0}
