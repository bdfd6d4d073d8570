"""Figures of a running stream: counters and histograms that are taken while a micro-batch's rows are written, in the same
pass, and lie beside them, a folder for each micro-batch. One that is run again overwrites its rows and its figures, so
totals count every row once over restarts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

FIGURES = "metric string, value double"


def counter(name: str, where: Column | None = None) -> dict[str, Column]:
    """How many rows there are, or how many where holds for; null is no."""
    return {name: F.count(F.lit(1)) if where is None else F.count_if(where)}


def histogram(name: str, value: Column, bounds: list[float]) -> dict[str, Column]:
    """Counts between bounds, each inclusive above, +Inf beyond the last; the count and the sum of all values. Nulls count
    for nothing."""
    tests = [value <= float(bounds[0]), *[(value > float(a)) & (value <= float(b)) for a, b in zip(bounds, bounds[1:], strict=False)], value > float(bounds[-1])]
    buckets = {f"{name}_bucket:{le}": F.count_if(t) for le, t in zip([*(f"{b:g}" for b in bounds), "+Inf"], tests, strict=True)}
    return buckets | {f"{name}_count": F.count(value), f"{name}_sum": F.coalesce(F.sum(value), F.lit(0.0))}


def write_batch(batch: DataFrame, batch_id: int, path: str, figures: dict[str, Column]) -> None:
    """Write a micro-batch's rows and, after them, its figures (aggregates of its rows by name)."""
    seen = Observation()
    names = list(figures)
    batch.observe(seen, *[figures[n].cast("double").alias(f"f{i}") for i, n in enumerate(names)]).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
    rows = [(n, seen.get.get(f"f{i}") or 0.0) for i, n in enumerate(names)]
    batch.sparkSession.createDataFrame(rows, FIGURES).coalesce(1).write.mode("overwrite").parquet(f"{path}/figures/batch={batch_id}")


def write(stream: DataFrame, path: str, checkpoint: str, figures: dict[str, Column], *, every: str | None = None) -> StreamingQuery:
    """Write a stream's rows with their figures: `every` a period, or all that is there by now."""
    w = stream.writeStream.foreachBatch(lambda batch, n: write_batch(batch, n, path, figures)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def by_batch(spark: SparkSession, path: str) -> DataFrame:
    """metric, value, batch."""
    return spark.read.schema(f"{FIGURES}, batch long").parquet(f"{path}/figures")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """metric, value: over all micro-batches."""
    return by_batch(spark, path).groupBy("metric").agg(F.sum("value").alias("value"))
