"""Scenario assertions and row invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.time import ms_between
from . import fold, recovery

BOUNDS = ("lost_tasks", "duplicate_effects", "max_recovery_time_ms", "max_retries_per_task", "min_retries_per_task", "faults_injected")


def observed(journal: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """What assertions are held against: a row per run. duplicates: run_id, duplicate_effects."""
    tasks = fold.totals(fold.task_state(journal)).select("run_id", "max_retries", "lost", "total_attempts", "sum_retries")
    runs = fold.run_state(journal, recovery_ms=F.coalesce(recovery.recovery_ms(), F.lit(0)))
    runs = runs.select("run_id", "status", "scenario", "seed", F.size("faults").alias("faults"), F.size("skipped").alias("skipped"), "recovery_ms")
    out = runs.join(tasks, "run_id", "left")
    out = out.join(duplicates, "run_id", "left") if duplicates is not None else out.withColumn("duplicate_effects", F.lit(0).cast("long"))
    return out.fillna(0, ["max_retries", "lost", "total_attempts", "sum_retries", "duplicate_effects"])


def evaluate(seen: DataFrame, scenarios: DataFrame) -> DataFrame:
    """run_id, scenario, name, passed, expected, actual: a row for each assertion that a run's scenario sets. scenarios:
    scenario, run_status and the bounds (null: not asserted). The table of scenarios is small and is sent
    to where the runs lie; few names would leave all runs to a few tasks."""
    j = seen.join(F.broadcast(scenarios), "scenario")
    most = lambda c, unit="": F.concat(F.lit("at most "), c.cast("string"), F.lit(unit))
    rules = [
        ("run_status", F.col("run_status"), F.col("status") == F.col("run_status"), F.col("run_status"), F.col("status")),
        ("lost_tasks", F.col("lost_tasks"), F.col("lost") <= F.col("lost_tasks"), most(F.col("lost_tasks")), F.col("lost")),
        ("duplicate_effects", F.col("b_duplicate_effects"), F.col("duplicate_effects") <= F.col("b_duplicate_effects"), most(F.col("b_duplicate_effects")), F.col("duplicate_effects")),
        ("max_recovery_time_ms", F.col("max_recovery_time_ms"), F.col("recovery_ms") <= F.col("max_recovery_time_ms"), most(F.col("max_recovery_time_ms"), "ms"), F.concat(F.col("recovery_ms").cast("string"), F.lit("ms"))),
        ("max_retries_per_task", F.col("max_retries_per_task"), F.col("max_retries") <= F.col("max_retries_per_task"), most(F.col("max_retries_per_task")), F.col("max_retries")),
        ("min_retries_per_task", F.col("min_retries_per_task"), F.col("max_retries") >= F.col("min_retries_per_task"), F.concat(F.lit("at least "), F.col("min_retries_per_task").cast("string")), F.col("max_retries")),
        ("faults_injected", F.col("faults_injected"), F.col("faults") == F.col("faults_injected"), F.col("faults_injected"), F.col("faults")),
    ]
    set_ = [F.when(bound.isNotNull(), F.struct(F.lit(n).alias("name"), test.alias("passed"), e.cast("string").alias("expected"), a.cast("string").alias("actual"))) for n, bound, test, e, a in rules]
    return j.select("run_id", "scenario", F.explode(F.array_compact(F.array(*set_))).alias("r")).select("run_id", "scenario", "r.*")


def passed(results: DataFrame) -> DataFrame:
    """run_id, passed, failures: failed assertions by name. A run without assertions passes, having no row here."""
    bad = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    return results.groupBy("run_id", "scenario").agg(F.bool_and("passed").alias("passed"), F.array_join(bad, ",").alias("failures"))


def repeats(results: DataFrame) -> DataFrame:
    """scenario, runs, failed: repeated runs of a scenario must all pass."""
    return passed(results).groupBy("scenario").agg(F.count("*").alias("runs"), F.count_if(~F.col("passed")).alias("failed"))


def duplicate_effects(attempts: DataFrame, recorded: DataFrame, suppressed: DataFrame) -> DataFrame:
    """run_id, duplicate_effects: attempts of tasks that have a recorded effect, less effects recorded, less effects
    suppressed, at least 0. attempts: run_id, task_name a row each; recorded: run_id, task_name a row for each ledger key;
    suppressed: run_id a row each. It counts attempts that no effect accounts for."""
    tried = attempts.join(recorded.select("run_id", "task_name").distinct(), ["run_id", "task_name"], "left_semi").groupBy("run_id").agg(F.count("*").alias("a"))
    had = recorded.groupBy("run_id").agg(F.count("*").alias("r"))
    cut = suppressed.groupBy("run_id").agg(F.count("*").alias("s"))
    j = tried.join(had, "run_id", "left").join(cut, "run_id", "left")
    return j.select("run_id", F.greatest(F.lit(0), F.col("a") - F.coalesce("r", F.lit(0)) - F.coalesce("s", F.lit(0))).alias("duplicate_effects"))


def human_report(seen: DataFrame, verdicts: DataFrame) -> DataFrame:
    """run_id, report: the verdict and the observed figures as a block of text, recovery rounded to 10 ms."""
    j = seen.join(verdicts.select("run_id", "passed"), "run_id")
    rounded = (F.floor((F.col("recovery_ms") + 5) / 10) * 10).cast("long")
    return j.select(
        "run_id",
        F.format_string(
            "%s %s\n  recovery time      %dms\n  retries            %d\n  lost tasks         %d\n  duplicate effects  %d\n  faults injected    %d\n  final state        %s\n",
            F.when(F.col("passed"), "PASS").otherwise("FAIL"), "scenario", rounded, "max_retries", "lost", "duplicate_effects", "faults", "status",
        ).alias("report"),
    )


def run_violations(runs: DataFrame) -> DataFrame:
    """id, rule: runs whose status is unknown, or that are terminal without, or open with, a completion time."""
    terminal = F.col("status").isin(*V.RUN_TERMINAL)
    rules = F.array_compact(F.array(F.when(~F.col("status").isin(*V.RUN_STATUSES), F.lit("status")), F.when(terminal != F.col("completed_at").isNotNull(), F.lit("completed"))))
    return runs.select("id", F.explode(rules).alias("rule"))


def task_violations(tasks: DataFrame) -> DataFrame:
    """id, rule: tasks of unknown status, with a lease but no hold or the reverse, holding without a worker, or that share
    (run_id, task_name)."""
    holds = F.col("status").isin(*V.TASK_HOLDS)
    rules = F.array_compact(F.array(
        F.when(~F.col("status").isin(*V.TASK_STATUSES), F.lit("status")), F.when(holds != F.col("lease_expires_at").isNotNull(), F.lit("lease")), F.when(holds & F.col("worker_id").isNull(), F.lit("worker")),
    ))
    return tasks.select("id", F.explode(rules).alias("rule"))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """key, n: keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose non-null reference is no key of parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def run_seconds(runs: DataFrame) -> DataFrame:
    """id, status, seconds from creation to completion of finished runs."""
    return runs.where("completed_at is not null").select("id", "status", (ms_between(F.col("created_at"), F.col("completed_at")) / 1000.0).alias("seconds"))
