"""What went wrong in a run and how it recovered. Order is always seq; times may run backwards between writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text
from ..functions.time import ms_between


def recovery_ms() -> Column:
    """The aggregate of a run's events behind recovery_time; null if nothing went wrong or the run has not recovered."""
    trouble = F.min_by("occurred_at", F.when(F.col("type").isin(*V.TROUBLE_TYPES), F.col("seq")))
    ended = F.max_by("occurred_at", F.when(F.col("type").isin(*V.TERMINAL_TYPES), F.col("seq")))
    return F.when(ended >= trouble, ms_between(trouble, ended))


def recovery_time(journal: DataFrame) -> DataFrame:
    """run_id, recovery_ms from the first trouble (lease expiry, fault, task failure or lost worker) to the run's end; 0 if
    there was none, the run is open, or the end is stamped earlier."""
    return journal.groupBy("run_id").agg(F.coalesce(recovery_ms(), F.lit(0)).alias("recovery_ms"))


def evidence(journal: DataFrame) -> DataFrame:
    """Counts by run of what its journal shows, the workers it met (sorted, joined by commas) and recovery_ms (null if
    nothing went wrong)."""
    n = lambda kind: F.count_if(F.col("type") == kind)
    kinds = {
        "attempts": "TASK_STARTED", "lease_expiries": "TASK_LEASE_EXPIRED", "requeues": "TASK_REQUEUED", "retries_scheduled": "TASK_RETRY_SCHEDULED", "workers_lost": "WORKER_LOST",
        "faults_injected": "FAULT_INJECTED", "effects_suppressed": "SIDE_EFFECT_SKIPPED", "dead_lettered": "TASK_DEAD_LETTERED",
    }
    # By worker first: counts and times are hashed where they lie, and lists are made of a row a worker instead of an event.
    trouble, ended = (F.when(F.col("type").isin(*t), F.col("seq")) for t in (V.TROUBLE_TYPES, V.TERMINAL_TYPES))
    by_worker = journal.groupBy("run_id", "worker_id").agg(
        *[n(k).alias(c) for c, k in kinds.items()],
        F.min(trouble).alias("_t"), F.min_by("occurred_at", trouble).alias("_t_at"), F.max(ended).alias("_e"), F.max_by("occurred_at", ended).alias("_e_at"),
    )
    first, last = F.min_by("_t_at", "_t"), F.max_by("_e_at", "_e")
    return by_worker.groupBy("run_id").agg(
        *[F.sum(c).alias(c) for c in kinds], F.array_join(F.sort_array(F.collect_set("worker_id")), ",").alias("workers"),
        F.when(last >= first, ms_between(first, last)).alias("recovery_ms"),
    )


def verdict(evidence_rows: DataFrame, status: DataFrame) -> DataFrame:
    """run_id, verdict: null for an undisturbed run, else recovered or not."""
    hurt = F.col("faults_injected") + F.col("lease_expiries") + F.col("workers_lost") > 0
    return evidence_rows.join(status.select("run_id", "status"), "run_id").select(
        "run_id", F.when(hurt, F.when(F.col("status") == "SUCCEEDED", F.lit("recovered")).otherwise(F.lit("not recovered"))).alias("verdict"),
        F.when(hurt, F.concat_ws(", ", text.plural(F.col("faults_injected"), "fault"), text.plural(F.col("attempts"), "attempt"))).alias("what"),
    )


def story(journal: DataFrame) -> DataFrame:
    """The milestones of disturbed runs, run_id, seq, type, task_name: the first start, of each story type its first event at
    or after the first trouble, and the end. One shuffle by run; the numbering by type sorts within it."""
    run = Window.partitionBy("run_id")
    e = journal.withColumn("_break", F.min(F.when(F.col("type").isin(*V.TROUBLE_TYPES), F.col("seq"))).over(run)).where("_break is not null")
    e = e.withColumn("_late", F.col("seq") >= F.col("_break"))
    kind_first = Window.partitionBy("run_id", "type", "_late").orderBy("seq")
    first = F.row_number().over(kind_first) == 1
    ever = F.min("seq").over(Window.partitionBy("run_id", "type")) == F.col("seq")
    picked = (F.col("_late") & first & F.col("type").isin(*V.STORY_TYPES)) | (ever & F.col("type").isin("RUN_STARTED", *V.TERMINAL_TYPES))
    return e.withColumn("_take", picked).where("_take").select("run_id", "seq", "type", "task_name")


# What each milestone means in the narration of a crash after an effect.
MEANING = {
    "FAULT_INJECTED": "the worker holding `charge` was killed, after charging and before acknowledging",
    "WORKER_LOST": "its heartbeats stopped, so it was declared gone and its leases released",
    "TASK_LEASE_EXPIRED": "nobody renewed the hold on the task",
    "TASK_REQUEUED": "the task became claimable again",
    "SIDE_EFFECT_SKIPPED": "the retry asked to charge again; the ledger already had that key, so it did not",
    "RUN_SUCCEEDED": "every task finished",
}


def narrate(journal: DataFrame) -> DataFrame:
    """run_id, seq, type, task_name, line: milestones in plain words; a claim after the first fault is another worker's."""
    so_far = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = F.max(F.when(F.col("type") == "FAULT_INJECTED", 1)).over(so_far).isNotNull()
    claim = F.when(broken, F.lit("another worker claimed it")).otherwise(F.lit("a worker claimed it"))
    said = journal.withColumn("_text", F.when(F.col("type") == "TASK_LEASED", claim).otherwise(text.lookup(F.col("type"), MEANING)))
    line = F.format_string("  #%-3d %-22s %-9s %s", F.col("seq"), F.col("type"), F.coalesce("task_name", F.lit("")), F.col("_text"))
    return said.where("_text is not null").select("run_id", "seq", "type", "task_name", line.alias("line"))


def timeline(journal: DataFrame, group: str | None = None) -> DataFrame:
    """Events with label, summary and groups, of one group if given."""
    out = journal.select("run_id", "seq", "type", "task_name", text.label(F.col("type")).alias("label"), text.summary(F.col("payload")).alias("summary"), text.groups(F.col("type")).alias("groups"))
    return out.where(F.array_contains("groups", group)) if group else out


def group_counts(journal: DataFrame) -> DataFrame:
    """run_id, group, n: events of each group, and of all. Types are counted first, so the fan-out to groups is over a few
    rows a run."""
    kinds = journal.groupBy("run_id", "type").agg(F.count("*").alias("k"))
    each = kinds.select("run_id", F.explode(F.concat(F.array(F.lit("all")), text.groups(F.col("type")))).alias("group"), "k")
    return each.groupBy("run_id", "group").agg(F.sum("k").alias("n"))


def fan_in(journal: DataFrame, join_task: str, branches: list[str]) -> DataFrame:
    """run_id, scheduled (times the joining task was scheduled), after_all (first scheduled after each branch's success)."""
    when = lambda kind, task: F.when((F.col("type") == kind) & (F.col("task_name") == task), F.col("seq"))
    done = F.greatest(*[F.coalesce(F.min(when("TASK_SUCCEEDED", b)), F.lit(1 << 62)) for b in branches]) if len(branches) > 1 else F.coalesce(F.min(when("TASK_SUCCEEDED", branches[0])), F.lit(1 << 62))
    first = F.min(when("TASK_SCHEDULED", join_task))
    return journal.groupBy("run_id").agg(F.count(when("TASK_SCHEDULED", join_task)).alias("scheduled"), F.coalesce(first > done, F.lit(False)).alias("after_all"))
