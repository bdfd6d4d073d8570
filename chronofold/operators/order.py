"""Order by ranges: global positions and running sums without a global window, scans by key without a window by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written


def numbered(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """df with pos (rows before in the order) and, for each column of sums, the sum over the rows before under its name.
    Ranges of the order are sorted and summed each for itself; their totals, a row a range, give each its offset. Rows that
    tie in the order are numbered in any order among themselves."""
    at, part, o_part = ("_".join(["n", x, *df.columns])[:100] for x in ("at", "part", "range"))  # names that no column has
    t = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    t = written(t.withColumn(part, F.shiftright(at, 33)), name)
    inner = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy(o_part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = t.groupBy(F.col(part).alias(o_part)).agg(F.count("*").alias("o_pos"), *[F.sum(c).alias(f"o_{new}") for c, new in sums.items()])
    offsets = totals.select(o_part, *[F.coalesce(F.sum(f"o_{c}").over(before), F.lit(0)).alias(f"o_{c}") for c in ("pos", *sums.values())])
    own = {"pos": F.count(F.lit(1)).over(inner)} | {new: F.coalesce(F.sum(c).over(inner), F.lit(0)) for c, new in sums.items()}
    run = t.withColumns(own).join(F.broadcast(written(offsets, name + "-offsets")), F.col(part) == F.col(o_part))  # as many rows as ranges
    return run.select(*df.columns, *[(F.col(c) + F.col(f"o_{c}")).cast("long").alias(c) for c in own])


#: What a row may be told of the rows of its key before it: within a range, over a range, and over the ranges before.
_SCANS = {
    "row": (lambda c, w: F.row_number().over(w) - 1, lambda c, at: F.count(F.lit(1)), F.sum),
    "sum": (lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), lambda c, at: F.sum(c), F.sum),
    "min": (lambda c, w: F.min(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), lambda c, at: F.min(c), F.min),
    "lag": (lambda c, w: F.lag(c).over(w), lambda c, at: F.max_by(c, at), F.last),
}


def scan(df: DataFrame, key: list[str], order: list[str], told: dict[str, tuple[str, Column | None]], name: str) -> DataFrame:
    """df with a column for each of told, name -> (row, sum, min or lag; value): how many rows of the key lie before, the
    sum or least of a value over them (0, null), or its value in the last of them. The same as windows by key, but rows are
    dealt in ranges of key and order, so that a key with very many rows is scanned by many tasks: each range is scanned by
    itself, and only the key that a range begins with takes something over from the ranges before, a row a range."""
    at, part, first = ("_".join(["s", x, *df.columns])[:100] for x in ("at", "part", "first"))  # names that no column has
    made = {n: (kind, f"_v_{n}") for n, (kind, _) in told.items()}
    values = {v: (F.lit(1) if told[n][1] is None else told[n][1]) for n, (_, v) in made.items()}
    t = df.withColumns(values).repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumn(at, F.monotonically_increasing_id())
    t = written(t.withColumn(part, F.shiftright(at, 33)), name)
    begins = written(t.groupBy(part).agg(F.min_by(F.struct(*key), at).alias("_k")).select(F.col(part).alias("_p"), *[F.col("_k")[k].alias(f"_k_{k}") for k in key]), name + "-begins")
    same = [t[k].eqNullSafe(F.col(f"_k_{k}")) for k in key]
    over = t.join(F.broadcast(begins.select(*[f"_k_{k}" for k in key]).distinct()), _all(same), "left_semi")  # at most a key for each range
    sums = over.groupBy(*key, part).agg(*[_SCANS[kind][1](F.col(v), F.col(at)).alias(f"_o_{n}") for n, (kind, v) in made.items()])
    earlier = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*[F.col(k).alias(f"_c_{k}") for k in key], F.col(part).alias("_p"), *[_SCANS[kind][2](f"_o_{n}").over(earlier).alias(f"_o_{n}") for n, (kind, _) in made.items()])
    carried = written(carried.join(begins, "_p").where(_all([F.col(f"_c_{k}").eqNullSafe(F.col(f"_k_{k}")) for k in key])).drop(*[f"_k_{k}" for k in key]), name + "-carried")
    w = Window.partitionBy(part, *key).orderBy(at)
    inner = {n: _SCANS[kind][0](F.col(v), w) for n, (kind, v) in made.items()} | {first: F.row_number().over(w) == 1}
    j = t.withColumns(inner).join(F.broadcast(carried), _all([F.col(part) == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in key]]), "left")
    take = {
        "row": lambda n: (F.col(n) + F.coalesce(f"_o_{n}", F.lit(0))).cast("long"), "sum": lambda n: F.coalesce(n, F.lit(0)) + F.coalesce(f"_o_{n}", F.lit(0)),
        "min": lambda n: F.least(n, f"_o_{n}"), "lag": lambda n: F.when(F.col(first), F.col(f"_o_{n}")).otherwise(F.col(n)),
    }
    return j.select(*df.columns, *[take[kind](n).alias(n) for n, (kind, _) in made.items()])


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out
