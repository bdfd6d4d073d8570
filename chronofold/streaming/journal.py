"""Incremental journals and timed sweeps with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import vocabulary as V


def tail(spark: SparkSession, path: str, schema: str = V.JOURNAL, *, files_per_batch: int = 100) -> DataFrame:
    """New journal files as a stream, of a folder or a single file; the checkpoint's offsets are the cursor. The path is given
    as a pattern that only it matches, since a plain path must be a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Write all that a stream has by now to Parquet, exactly once, and read it."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def once_by_key(stream: DataFrame, key: str, at: str, within: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are held for as long as late rows are accepted."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def contiguity(stream: DataFrame) -> DataFrame:
    """run_id, expected, found of sequence breaks and of events after the end, across micro-batches: each run's state is its
    last seq and whether it has ended, so nothing of its history is held."""

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended = state.get if state.exists else (0, False)
        out = []
        rows = [r for pdf in batches for r in zip(pdf["seq"].tolist(), pdf["type"].tolist(), strict=True)]
        for seq, kind in sorted(rows):  # all of the run's rows in the micro-batch, however many Arrow batches hold them
            if ended:
                out.append((key[0], "after-terminal", None, seq))
            elif seq != last + 1:
                out.append((key[0], "gap", last + 1, seq))
            last, ended = max(last, seq), ended or kind in V.TERMINAL_TYPES
        state.update((last, ended))
        yield pd.DataFrame(out, columns=["run_id", "kind", "expected", "found"]).astype({"expected": "Int64"})

    return stream.groupBy("run_id").applyInPandasWithState(check, "run_id long, kind string, expected long, found long", "last long, ended boolean", "append", GroupStateTimeout.NoTimeout)


def last_beats(beats: DataFrame) -> DataFrame:
    """id, last_heartbeat of each worker, as beats arrive."""
    return beats.groupBy("id").agg(F.max("at").alias("last_heartbeat"))


def sweep(ticks: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Run step(batch, batch id) for every micro-batch: `every` a period, or once over what is there. A step's three parts are
    leases, then workers, then retries (operators.ops); an error fails the query, which restarts from its checkpoint."""
    w = ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def reap(tasks: DataFrame, runs: DataFrame, workers: DataFrame, now) -> dict[str, DataFrame]:
    """One sweep's outcome in its fixed order. Lost workers' leases end now, so their tasks are among the expired."""
    from ..operators import ops

    changes = ops.liveness(workers, now)
    lost = changes.where("new_status = 'LOST'").select(F.col("id").alias("worker_id"))
    released = tasks.join(lost.withColumn("_lost", F.lit(True)), "worker_id", "left").withColumn("lease_expires_at", F.when(F.col("_lost") & F.col("status").isin(*V.TASK_HOLDS), now).otherwise(F.col("lease_expires_at")))
    return {
        "leases": ops.expired_leases(released.drop("_lost"), runs, now, limit=None), "workers": changes,
        "announced": ops.lost_announcements(tasks, runs, changes.where("new_status = 'LOST'")), "retries": ops.due_retries(tasks, now, limit=None),
    }
