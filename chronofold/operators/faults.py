"""Fault scenarios: matching of trigger points and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V


def matches(points: DataFrame, faults: list[tuple]) -> DataFrame:
    """points (point, task_name, attempt, ...) with each fault (point, task, attempt, kind) that fits, as columns idx and
    kind: an absent point or task and attempt 0 fit all. Scenarios hold a handful of faults, so each is a predicate on the
    row; nothing is joined. Every fitting fault is reported, also after one that does not fit."""
    tests = []
    for i, (at, task, attempt, kind) in enumerate(faults):
        fits: Column = F.lit(True)
        for column, want in (("point", at), ("task_name", task), ("attempt", attempt or None)):
            if want is not None:
                fits = fits & (F.col(column) == F.lit(want))
        tests.append(F.when(fits, F.struct(F.lit(i).alias("idx"), F.lit(kind).alias("kind"))))
    return points.withColumn("_f", F.explode(F.array_compact(F.array(*tests)))).select(*points.columns, "_f.idx", "_f.kind")


def matches_table(points: DataFrame, faults: DataFrame) -> DataFrame:
    """The same with faults as a table of many scenarios (scenario, idx, at, task, target_attempt, kind), joined on the
    scenario first."""
    on = (
        (points["scenario"] == faults["scenario"])
        & (faults["at"].isNull() | (faults["at"] == points["point"]))
        & (faults["task"].isNull() | (faults["task"] == points["task_name"]))
        & ((faults["target_attempt"] == 0) | (faults["target_attempt"] == points["attempt"]))
    )
    return points.join(faults, on).select(*[points[c] for c in points.columns], faults["idx"], faults["kind"])


def fault_problems(faults: DataFrame) -> DataFrame:
    """scenario, idx, problem for each broken rule. faults: scenario, idx (from 1), type, at, probability, attempt."""
    p, at, kind = F.coalesce("probability", F.lit(0.0)), F.coalesce("at", F.lit("")), F.col("type")
    rules = [
        F.when(kind.isin(*V.FAULT_TYPES_PLANNED), F.format_string("%s is not implemented", kind)).when(~kind.isin(*V.FAULT_TYPES), F.format_string("unknown type %s", kind)),
        F.when((at == "") & (p == 0), F.lit("set either a trigger point or a probability"))
        .when((at != "") & (p != 0), F.lit("set a trigger point or a probability, not both"))
        .when((at != "") & ~at.isin(*V.FAULT_POINTS), F.format_string("unknown trigger point %s", at))
        .when((p < 0) | (p > 1), F.lit("probability must be between 0 and 1")),
        F.when(F.col("attempt") < 0, F.lit("target attempt must not be negative")),
    ]
    return faults.select("scenario", "idx", F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def scenario_flags(faults: DataFrame) -> DataFrame:
    """scenario, deterministic (no fault has a probability), separate_workers (a fault kills its worker)."""
    return faults.groupBy("scenario").agg(F.bool_and(F.coalesce("probability", F.lit(0.0)) == 0).alias("deterministic"), F.bool_or(F.col("type") == "worker-crash").alias("separate_workers"))
