"""Run and task state kept as tables and advanced by the journal's tail: a micro-batch reads its new events and the buckets
of the keyed tables that hold their runs, and no event twice."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import partial
from ..sources import keyed
from ..sources.storage import forget, keyed_side, written

TABLES = {
    "tasks": (partial.TASK_KEY, partial.task_spec, partial.task_parts, partial.finished_tasks),
    "runs": (partial.RUN_KEY, partial.run_spec, partial.run_parts, partial.finished_runs),
}


def create(spark: SparkSession, path: str, schema: str, buckets: int = keyed.BUCKETS, names: Iterable[str] = tuple(TABLES)) -> None:
    """Empty state tables under path, for journals of a schema. names: those that are kept, if not all."""
    for name in names:
        keys, _, parts, *_ = TABLES[name]
        keyed.create(parts(spark.createDataFrame([], schema)), f"{path}/{name}", keys, buckets)


def advance_batch(batch: DataFrame, path: str, names: Iterable[str] = tuple(TABLES)) -> None:
    """Fold new events into the tables. A run's events come in order of seq over the batches, so those up to the last seq
    that a row knows have been folded into it: a batch that is run again, or of which only some buckets were written before
    a failure, counts once.

    Events are folded by key first, and these parts meet the rows of their buckets in one shuffle, after which the buckets are
    written. A part whose events are in part known is left out there; such keys are then folded event by event."""
    spark, names = batch.sparkSession, list(names)
    rows = written(batch, "tail") if len(names) > 1 else batch
    for name in names:
        keys, _, parts, _ = TABLES[name]
        table = f"{path}/{name}"
        _, buckets, _ = keyed._meta(spark, table)
        own = rows.where("task_name is not null") if "task_name" in keys else rows
        fresh = written(parts(own, _from=F.min("seq")), "fresh")
        touched = keyed.touched_by(fresh, keys, buckets)
        if touched and _fold(table, name, touched, fresh):
            known = keyed.read(spark, table, touched).select(*keys, F.col("last_seq").alias("_known"))
            new = own.join(keyed_side(known), keys, "left").where("_known is null or seq > _known").drop("_known")
            _fold(table, name, touched, parts(new, _from=F.min("seq")))
        forget(fresh)
    if len(names) > 1:
        forget(rows)


def _fold(table: str, name: str, touched: list[int], fresh: DataFrame) -> int:
    """Write a table's buckets anew, with fresh parts (_from: the first seq of their events) merged into their rows. How many
    parts are left out, since they begin with events that are known and end with others."""
    spark, left = fresh.sparkSession, Observation()
    keys, spec, *_ = TABLES[name]
    _, buckets, _ = keyed._meta(spark, table)
    before = keyed.read(spark, table, touched).withColumn("_from", F.lit(None).cast("long"))
    both = keyed.dealt(before.unionByName(fresh), keys, buckets)
    one = Window.partitionBy(*keys, keyed.BUCKET, keyed.SLICE).orderBy(F.col("_from").asc_nulls_first())
    both = both.withColumns({"_kept": F.lag(F.struct(*spec())).over(one), "_next": F.lead(F.lit(True)).over(one)}).where("_next is null")
    both = both.observe(left, F.count_if(F.expr("_from <= _kept.last_seq and last_seq > _kept.last_seq")).alias("n"))
    keyed.apply(spark, table, both.select(*keys, keyed.BUCKET, *partial.after(F.col("_kept"), F.col("_from"), spec())), whole=touched)
    return left.get["n"]


def advance(tail: DataFrame, path: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Keep the tables under path up to date with a stream of journal events (streaming.journal.tail)."""
    w = tail.writeStream.foreachBatch(lambda batch, _: advance_batch(batch, path)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The state of `tasks` or `runs`, with the columns of operators.fold."""
    return TABLES[name][-1](keyed.read(spark, f"{path}/{name}"))
