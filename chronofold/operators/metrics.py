"""Bench summaries, percentiles, counters and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.time import ms_between
from ..sources.storage import written
from . import fold, order, recovery


def percentile(values: Column, p: float) -> Column:
    """Of an array: the value at rank floor(n * p + 0.5), within 1 and n; 0 for none. This rounds half up where the textbook's
    nearest rank takes the ceiling."""
    n = F.size(values)
    rank = F.greatest(F.lit(1), F.least(n, F.floor(n * F.lit(float(p)) + 0.5).cast("int")))
    return F.when(n > 0, F.element_at(F.array_sort(values), rank)).otherwise(0)


#: Distinct values of all groups up to which a group's are ordered by one task; beyond it they are dealt in ranges.
VALUES_BY_GROUP = 1_000_000
#: Groups up to which their totals are broadcast.
TOTALS_SENT = 50_000


def percentile_by(df: DataFrame, keys: list[str], value: str, ps: dict[str, float], *, values_by_group: int = VALUES_BY_GROUP) -> DataFrame:
    """keys and a percentile a name, exact, without gathering a group: values are counted first, and running counts find
    the rank. Where there are more than values_by_group distinct values, the running counts go by ranges of keys and value
    (order.scan), so that a group of any size is spread over all tasks; the rows are the same either way. A null key is a
    group, null values count for nothing, and a group without values has no row."""
    from pyspark.sql import Window

    counts = written(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")), "values")
    if keys and counts.limit(values_by_group + 1).count() > values_by_group:
        upto = order.scan(counts, keys, [F.col(value)], {"_before": ("sum", F.col("_c"))}, "percentiles").withColumn("_upto", F.col("_before") + F.col("_c"))
        totals = written(counts.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.sum("_c").alias("_n")), "totals")
        few = totals.limit(TOTALS_SENT + 1).count() <= TOTALS_SENT
        run = upto.join(F.broadcast(totals) if few else totals, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys])
    else:
        by = Window.partitionBy(*keys)
        running = F.sum("_c").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        run = counts.withColumns({"_upto": running, "_n": F.sum("_c").over(by)})
    at = lambda p: F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(p) + 0.5)), F.col(value)))
    return run.groupBy(*keys).agg(*[at(p).alias(name) for name, p in ps.items()])


def samples(journal: DataFrame) -> DataFrame:
    """A row per run: status, attempts, retries (summed over tasks), lost, recovery_ms, duration_ms from the first event to
    the end (null while open)."""
    tasks = fold.totals(fold.task_state(journal)).select("run_id", F.col("total_attempts").alias("attempts"), F.col("sum_retries").alias("retries"), "lost")
    first, last = F.min_by("occurred_at", "seq"), F.max_by("occurred_at", F.when(F.col("type").isin("RUN_SUCCEEDED", "RUN_FAILED", "RUN_CANCELLED"), F.col("seq")))
    runs = fold.run_state(journal, recovery_ms=F.coalesce(recovery.recovery_ms(), F.lit(0)), duration_ms=ms_between(first, last))
    out = runs.select("run_id", "status", "recovery_ms", "duration_ms").join(tasks, "run_id", "left")
    return out.fillna(0, ["attempts", "retries", "lost"]).select("run_id", "status", "attempts", "retries", "lost", "recovery_ms", "duration_ms")


def summarise(rows: DataFrame, keys: list[str], wall_s: float) -> DataFrame:
    """Bench figures by matrix point: counts, sums, rates over wall_s, latency percentiles over all runs and recovery
    percentiles over those that had trouble (0 if none had). The samples are written, as they are read three times."""
    rows = written(rows, "samples")
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("runs_completed"), F.count_if(F.col("status") == "SUCCEEDED").alias("runs_succeeded"), F.count_if(F.col("status") != "SUCCEEDED").alias("runs_failed"),
        F.sum("attempts").alias("tasks_executed"), F.sum("retries").alias("retries"), F.sum("lost").alias("lost_tasks"),
        F.round(F.count("*") / F.lit(wall_s), 2).alias("runs_per_second"), F.round(F.sum("attempts") / F.lit(wall_s), 2).alias("tasks_per_second"),
    )
    latency = percentile_by(rows, keys, "duration_ms", {"run_p50_ms": 0.5, "run_p95_ms": 0.95, "run_p99_ms": 0.99, "run_max_ms": 1.0})
    recovered = percentile_by(rows.where("recovery_ms > 0"), keys, "recovery_ms", {"recovery_p50_ms": 0.5, "recovery_p95_ms": 0.95, "recovery_max_ms": 1.0})
    out = base.join(latency, keys, "left").join(recovered, keys, "left")
    return out.fillna(0)


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """keys, bucket (upper bound as text, +Inf beyond the last), n: counts between explicit bounds, each inclusive above."""
    bucket = F.lit("+Inf")
    for b in reversed(bounds):
        bucket = F.when(F.col(value) <= F.lit(float(b)), F.lit(f"{b:g}")).otherwise(bucket)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


# Histogram bounds in seconds.
TASK_BOUNDS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1, 5, 10, 30, 60]
RUN_BOUNDS = [0.01, 0.1, 0.5, 1, 5, 10, 30, 60, 300, 900]
RECOVERY_BOUNDS = [0.1, 0.25, 0.5, 1, 2, 5, 10, 30, 60, 120]
# End of fixed values.


def task_outcomes(journal: DataFrame) -> DataFrame:
    """run_id, task_name, outcome, seconds: a row for each finished attempt."""
    from ..functions import text

    e = journal.where(F.col("type").isin("TASK_SUCCEEDED", "TASK_FAILED"))
    return e.select("run_id", "task_name", F.when(F.col("type") == "TASK_SUCCEEDED", "succeeded").otherwise("failed").alias("outcome"), (text.decode(F.col("payload"))["duration_ms"] / 1000.0).alias("seconds"))


def recoveries(journal: DataFrame) -> DataFrame:
    """run_id, workflow, seconds from the first failure to the end, of runs that had one."""
    from ..functions import text

    named = F.max_by(text.decode(F.col("payload"))["workflow_name"], F.when(F.col("type") == "RUN_CREATED", F.col("seq")))
    found = journal.groupBy("run_id").agg(named.alias("workflow"), recovery.recovery_ms().alias("ms"))
    return found.where("ms > 0").select("run_id", "workflow", (F.col("ms") / 1000.0).alias("seconds"))


# Counter, status label, and whether the workflow and the task label it, by event type.
_COUNTED = {
    "RUN_SUCCEEDED": ("workflow_runs_total", "SUCCEEDED", True, False),
    "RUN_FAILED": ("workflow_runs_total", "FAILED", True, False),
    "RUN_CANCELLED": ("workflow_runs_total", "CANCELLED", True, False),
    "TASK_SUCCEEDED": ("task_executions_total", "succeeded", True, True),
    "TASK_FAILED": ("task_executions_total", "failed", True, True),
    "TASK_RETRY_SCHEDULED": ("task_retries_total", None, True, True),
    "TASK_LEASE_EXPIRED": ("task_lease_expirations_total", None, False, False),
    "SIDE_EFFECT_SKIPPED": ("side_effects_skipped_total", None, False, True),
}


def counters(journal: DataFrame) -> DataFrame:
    """counter, status, workflow, task, n over all runs, what the running system would have counted; a label that a counter
    does not have is null. A worker is lost once, in however many runs that is announced. A duplicate execution is a start
    of an attempt that was started before."""
    rules = F.create_map(*[x for k, (name, status, workflow, task) in _COUNTED.items() for x in (
        F.lit(k), F.struct(F.lit(name).alias("counter"), F.lit(status).cast("string").alias("status"), F.lit(workflow).alias("w"), F.lit(task).alias("t")),
    )])
    read = F.get_json_object("payload", "$.workflow_name")
    workflow = journal.where("type = 'RUN_CREATED'").groupBy("run_id").agg(F.max_by(read, "seq").alias("workflow"))
    e = journal.where(F.col("type").isin(*_COUNTED)).select("run_id", "task_name", rules[F.col("type")].alias("r")).join(workflow, "run_id", "left")
    labelled = e.select("r.counter", "r.status", F.when(F.col("r.w"), F.col("workflow")).alias("workflow"), F.when(F.col("r.t"), F.col("task_name")).alias("task"))
    counted = labelled.groupBy("counter", "status", "workflow", "task").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    lost = journal.where("type = 'WORKER_LOST'").agg(F.count_distinct("worker_id").alias("n")).where("n > 0")
    lost = lost.select(F.lit("worker_lost_total").alias("counter"), none.alias("status"), none.alias("workflow"), none.alias("task"), "n")
    starts = journal.where("type = 'TASK_STARTED'").groupBy("run_id", "task_name", F.get_json_object("payload", "$.attempt")).agg((F.count("*") - 1).alias("more")).where("more > 0")
    twice = starts.groupBy(F.col("task_name").alias("task")).agg(F.sum("more").alias("n"))
    twice = twice.select(F.lit("duplicate_executions_total").alias("counter"), none.alias("status"), none.alias("workflow"), "task", "n")
    return counted.unionByName(lost).unionByName(twice)


# The environment's columns of a bench result.
ENVIRONMENT = ("go_version", "os", "arch", "num_cpu", "postgres_version", "engine_version", "measured_at")


def bench_csv(result: DataFrame, workflow: str, wall_s: float, environment: dict[str, str]) -> DataFrame:
    """The result by workers and fault_rate as text columns in the file's order, with fixed decimals, for a CSV sink.
    environment: the values of ENVIRONMENT; what is not known is empty."""
    fixed = {"fault_rate": "%.3f", "wall_clock_s": "%.3f", "runs_per_second": "%.2f", "tasks_per_second": "%.2f"}
    known = {"runs": F.col("runs_completed"), "workflow": F.lit(workflow), "wall_clock_s": F.lit(wall_s)} | {c: F.lit(environment.get(c, "")) for c in ENVIRONMENT}
    rows = result.withColumns({c: v for c, v in known.items() if c not in result.columns})
    return rows.select(*[F.format_string(fixed[c], F.col(c).cast("double")).alias(c) if c in fixed else F.col(c).cast("string").alias(c) for c in (*V.BENCH_COLUMNS, *ENVIRONMENT)])


def bench_table(result: DataFrame) -> DataFrame:
    """One fixed-width line for each matrix point."""
    rate = F.concat(F.format_string("%.1f", F.col("fault_rate") * 100), F.lit("%"))
    ms = lambda c: F.concat(F.col(c).cast("string"), F.lit("ms"))
    return result.select(F.format_string("%-8d %-11s %-8d %-9.2f %-9.2f %-10s %-10s %d", F.col("workers"), rate, F.col("runs_completed"), F.col("runs_per_second"), F.col("tasks_per_second"), ms("run_p95_ms"), ms("recovery_p95_ms"), F.col("lost_tasks")).alias("line"))
