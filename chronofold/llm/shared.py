"""Helpers that several training-data operators need: shared tables, guarded broadcasts, bounded samples, prefix sums."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import forget, new_path, written  # noqa: F401  shared by the operators

#: Rows up to which a counted table is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 50_000


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from df's columns in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few, else df as it is, and the join shuffles. Meant for written
    tables of narrow rows, whose count is read from file footers."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def give_back() -> None:
    """Return freed memory of this Python process to the system; between tasks a worker then holds little."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(run, every_s: float = 10.0):
    """run, an Arrow function over batches, that gives freed memory back every few seconds and at its end."""

    def wrapped(batches: Iterator) -> Iterator:
        last = time.monotonic()
        for out in run(batches):
            yield out
            if time.monotonic() - last > every_s:
                give_back()
                last = time.monotonic()
        give_back()

    return wrapped


def worker_state() -> dict:
    """What a Python worker keeps from one task to the next."""
    import sys
    import types

    return vars(sys.modules.setdefault("_chronofold_worker", types.ModuleType("_chronofold_worker")))


def text_of(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def id_crc(id_col: Column) -> Column:
    """Unsigned crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")))


def bounded_sample(df: DataFrame, key: Column, per_stratum: int, stratum: Column | None = None, total: int | None = None) -> DataFrame:
    """At most per_stratum rows of each stratum, the same ones at every run: rows whose crc32 of the key's digest lies
    under a threshold that is set from the stratum's count, so that no stratum is gathered or sorted whole. A stratum
    has per_stratum rows on average, never over 1.5 times as many; strata within the bound are kept whole. total bounds
    all strata together: where it is less, each has its share of it, one row at least."""
    spread = 1 << 32
    with_key = df.withColumn("_s", stratum.cast("string") if stratum is not None else F.lit("")).withColumn("_h", F.crc32(F.md5(F.coalesce(key.cast("string"), F.lit("")))))
    counts = written(with_key.groupBy("_s").agg(F.count("*").alias("_n")), "strata")
    if total is not None:
        per_stratum = max(1, min(per_stratum, total // max(1, counts.count())))
    near = with_key.join(small(counts), with_key["_s"].eqNullSafe(counts["_s"])).where(F.col("_h") < F.lit(float(spread * per_stratum)) / F.col("_n")).drop(counts["_s"])
    order = Window.partitionBy("_s").orderBy("_h", key)
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= int(per_stratum * 1.5)).drop("_s", "_h", "_n", "_r")


def with_prefix_sums(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df (narrow rows, a written table) in global order with `start` (sum of value over all rows before) and `pos` (rows
    before). Range partitions are sorted and summed each for itself; the partitions' totals then give each its offset.
    The partitioned rows are written before the totals are read, so both see the same cut."""
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, total, rows = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            v = b.column(kept.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(v) + total
            n = len(v)
            cols = [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(ends - v), pa.array(np.arange(rows, rows + n, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "_part", "_at", "_row"])
            total, rows = int(ends[-1]) if n else total, rows + n

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _part int, _at long, _row long"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
    table = written(ranged, name)
    totals = table.groupBy("_part").agg(F.max(F.col("_at") + F.col(value)).alias("_sum"), F.max(F.col("_row") + 1).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum0"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"))
    joined = table.join(small(written(offsets, name + "-offsets")), F.col("_part") == F.col("_p"))
    return joined.select(*kept, (F.col("_at") + F.col("_sum0")).alias("start"), (F.col("_row") + F.col("_rows0")).alias("pos"))
