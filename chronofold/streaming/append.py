"""Numbered append from a stream: every run's events are numbered without gaps, and each micro-batch counts once.

A log is a folder: `events` and `refused` with a folder for each micro-batch, `state` with each run's last number and whether
it has ended (sources.keyed), and `committed`, a file for each micro-batch that is done. A micro-batch that is run again
after a failure meets a state that holds what the run's state was before that batch, so it numbers its events alike and
overwrites its own folders; one that is committed is left out. Readers see committed batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import ops
from ..sources import keyed
from ..sources.storage import exists, forget, written

STATE = "run_id long, last long, ended boolean, batch long, last_before long, ended_before boolean"


def append_batch(batch: DataFrame, batch_id: int, path: str, buckets: int = keyed.BUCKETS) -> None:
    """Append one micro-batch (run_id, ord, type, ...) to the log at path; again changes nothing."""
    spark = batch.sparkSession
    if not exists(spark, f"{path}/state/_keyed"):
        keyed.create(spark.createDataFrame([], STATE), f"{path}/state", ["run_id"], buckets)
    if exists(spark, f"{path}/committed/batch={batch_id}/_SUCCESS"):
        return
    rows = written(batch, "batch")
    touched = keyed.touched_by(rows, ["run_id"], buckets)
    again = F.col("batch") == batch_id  # the batch has been here: what was before it counts
    state = keyed.read(spark, f"{path}/state", touched).select("run_id", F.when(again, F.col("last_before")).otherwise(F.col("last")).alias("last"), F.when(again, F.col("ended_before")).otherwise(F.col("ended")).alias("ended"))
    placed = written(ops.number_after(rows, state), "numbered")
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
    put(placed.where("not refused").drop("refused", "ord", "last", "ended"), "events")
    put(placed.where("refused").drop("refused", "seq", "last", "ended"), "refused")
    after = placed.groupBy("run_id").agg(F.max(F.when(~F.col("refused"), F.col("seq"))).alias("top"), F.bool_or(ops.is_terminal()).alias("closed"), F.first("last").alias("last_before"), F.first("ended").alias("ended_before"))
    after = after.select("run_id", F.coalesce("top", "last_before").alias("last"), (F.col("ended_before") | F.col("closed")).alias("ended"), F.lit(batch_id).cast("long").alias("batch"), "last_before", "ended_before")
    keyed.apply(spark, f"{path}/state", after, insert=True)
    put(spark.range(1), "committed")
    forget(rows, placed)


def append(stream: DataFrame, path: str, checkpoint: str, *, every: str | None = None, buckets: int = keyed.BUCKETS) -> StreamingQuery:
    """Append a stream to the log at path: `every` a period, or all that is there by now."""
    w = stream.writeStream.foreachBatch(lambda batch, n: append_batch(batch, n, path, buckets)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def _committed(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    done = spark.read.schema("id long, batch long").parquet(f"{path}/committed").select("batch").distinct()
    return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{name}").join(done, "batch", "left_semi").drop("batch")


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log's events; schema with `seq long` for the number."""
    return _committed(spark, path, "events", schema)


def refused(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events that came after the end of their run, as they were offered."""
    return _committed(spark, path, "refused", schema)
