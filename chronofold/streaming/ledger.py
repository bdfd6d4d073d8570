"""The effect ledger fed by a stream: of the effects under one key the first that arrives is recorded with its result, and
every later one is answered with that result instead of running, across micro-batches and restarts.

The ledger is a keyed table (sources.keyed), so nothing is held per key in memory and a micro-batch touches only the buckets
of its keys. A row knows the micro-batch that recorded it: one that is run again finds what it wrote itself and decides as
it did before. Outcomes lie in a folder for each micro-batch, which such a run overwrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import keyed
from ..sources.storage import exists, forget, keyed_side, written

LEDGER = "idempotency_key string, run_id long, task_name string, attempt int, result string, created_at timestamp_ntz, batch long"
ASKED = ["idempotency_key", "run_id", "task_name", "attempt", "result", "created_at"]


def do_batch(asked: DataFrame, batch_id: int, path: str, buckets: int = keyed.BUCKETS) -> None:
    """Decide one micro-batch of ASKED rows, result being what the effect gives if it is the one to run. Within a batch the
    earliest by created_at, then attempt, is first; rows alike in all are in any order."""
    spark = asked.sparkSession
    if not exists(spark, f"{path}/ledger/_keyed"):
        keyed.create(spark.createDataFrame([], LEDGER), f"{path}/ledger", ["idempotency_key"], buckets)
    rows = written(asked.select(*ASKED).withColumns({"batch": F.lit(batch_id).cast("long"), "row": F.monotonically_increasing_id()}), "asked")
    touched = keyed.touched_by(rows, ["idempotency_key"], buckets)
    known = keyed.read(spark, f"{path}/ledger", touched).where(F.col("batch") != batch_id).select("idempotency_key", F.struct("attempt", "result").alias("winner"))
    order = F.struct("created_at", "attempt", "run_id", "task_name", "result", "row")
    first = rows.groupBy("idempotency_key").agg(F.min(order).alias("f"), F.first("batch").alias("batch"))  # combined before it moves
    state = written(first.join(keyed_side(known), "idempotency_key", "left"), "first")
    new = state.where("winner is null").select("idempotency_key", *[F.col("f")[c].alias(c) for c in ("run_id", "task_name", "attempt", "result", "created_at")], "batch")
    keyed.apply(spark, f"{path}/ledger", new, update=False, insert=True)
    # The first of a key's rows in the batch runs if the key was not known; a key that very many rows repeat is joined, not gathered.
    j = rows.join(keyed_side(state.select("idempotency_key", "f", "winner")), "idempotency_key")
    runs = (F.col("row") == F.col("f.row")) & F.col("winner").isNull()
    won = lambda c: F.when(F.col("winner").isNotNull(), F.col("winner")[c]).otherwise(F.col("f")[c])  # noqa: E731  a result may be null
    out = j.select(
        *ASKED[:4], F.when(runs, "recorded").otherwise("skipped").alias("outcome"),
        won("attempt").alias("first_attempt"), won("result").alias("result"), "created_at",
    )
    out.write.mode("overwrite").parquet(f"{path}/outcomes/batch={batch_id}")
    forget(rows, state)


def do(stream: DataFrame, path: str, checkpoint: str, *, every: str | None = None, buckets: int = keyed.BUCKETS) -> StreamingQuery:
    """Decide a stream of effects (ASKED): `every` a period, or all that is there by now."""
    w = stream.writeStream.foreachBatch(lambda batch, n: do_batch(batch, n, path, buckets)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """A row for each effect asked for: recorded, or skipped with the recorded attempt and its result."""
    return spark.read.schema("idempotency_key string, run_id long, task_name string, attempt int, outcome string, first_attempt int, result string, created_at timestamp_ntz, batch long").parquet(f"{path}/outcomes")
