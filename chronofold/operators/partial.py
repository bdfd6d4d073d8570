"""The fold of a journal as parts that can be merged: what a stretch of events says of a run or a task, so that a state that
is kept needs only the events that are new.

A part is one of: last or first (a value with the seq that gave it), max, sum, all (a list in seq order). Each merges with
its like in any order and grouping, and the finished state is that of operators.fold over all events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text
from .fold import _decoded

LAST, FIRST, MAX, SUM, ALL = "last", "first", "max", "sum", "all"
Spec = dict[str, tuple[str, Column, Column]]


def _is(*names: str) -> Column:
    return F.col("type").isin(*names)


def _always() -> Column:
    return F.lit(True)


def task_spec() -> Spec:
    """name -> (kind, value, events that give it), over events with p, their parsed payload."""
    status = text.lookup(F.col("type"), V.TASK_STATUS_OF)
    one = F.lit(1).cast("long")
    return {
        "status": (LAST, status, status.isNotNull()),
        "handler": (LAST, F.col("p.handler"), _is("TASK_STARTED")),
        "attempts": (MAX, F.col("p.attempt"), _is("TASK_LEASED", "TASK_STARTED")),
        "retries": (SUM, one, _is("TASK_RETRY_SCHEDULED")),
        "requeues": (SUM, one, _is("TASK_REQUEUED")),
        "lease_expiries": (SUM, one, _is("TASK_LEASE_EXPIRED")),
        "last_error": (LAST, F.when(_is("TASK_FAILED"), F.coalesce("p.error", F.lit(""))).otherwise(F.lit("")), _is("TASK_SUCCEEDED", "TASK_FAILED")),
        "dead_reason": (FIRST, F.col("p.reason"), _is("TASK_DEAD_LETTERED")),
        "artifacts": (LAST, F.col("p.artifacts"), _is("TASK_SUCCEEDED")),
        "first_started": (FIRST, F.col("occurred_at"), _is("TASK_STARTED")),
        "completed": (LAST, F.col("occurred_at"), _is("TASK_SUCCEEDED", "TASK_FAILED", "TASK_DEAD_LETTERED")),
        "last_seq": (MAX, F.col("seq"), _always()),
    }


def run_spec() -> Spec:
    kind, created = F.col("type"), _is("RUN_CREATED")
    status = text.lookup(kind, V.RUN_STATUS_OF)
    reason = F.when((kind == "RUN_FAILED") & (F.coalesce(F.col("p.detail"), F.lit("")) != ""), F.concat_ws(": ", "p.reason", "p.detail")).otherwise(F.col("p.reason"))
    fault = F.struct(F.col("p.fault_type").alias("type"), F.col("p.fault_point").alias("point"), F.col("task_name").alias("task"), F.col("p.draw").alias("draw"))
    skipped = F.struct(F.col("p.idempotency_key").alias("key"), F.col("task_name").alias("task"), F.col("p.attempt").alias("attempt"), F.col("p.first_attempt").alias("first_attempt"))
    one = F.lit(1).cast("long")
    return {
        "status": (LAST, status, status.isNotNull()),
        "workflow": (LAST, F.col("p.workflow_name"), created),
        "version": (LAST, F.col("p.workflow_version"), created),
        "definition_hash": (LAST, F.col("p.definition_hash"), created),
        "scenario": (LAST, F.coalesce(F.col("p.scenario_name"), F.lit("")), created),
        "seed": (LAST, F.col("p.seed"), created),
        "failure_reason": (LAST, reason, _is("RUN_FAILED", "RUN_CANCELLED")),
        "workers_lost": (SUM, one, _is("WORKER_LOST")),
        "event_count": (SUM, one, _always()),
        "last_seq": (MAX, F.col("seq"), _always()),
        "faults": (ALL, fault, _is("FAULT_INJECTED")),
        "skipped": (ALL, skipped, _is("SIDE_EFFECT_SKIPPED")),
    }


TASK_READ = (("TASK_LEASED", "TASK_STARTED", "TASK_SUCCEEDED", "TASK_FAILED", "TASK_DEAD_LETTERED"), ("attempt", "handler", "error", "reason", "artifacts"))
RUN_READ = (
    ("RUN_CREATED", "RUN_FAILED", "RUN_CANCELLED", "FAULT_INJECTED", "SIDE_EFFECT_SKIPPED"),
    ("workflow_name", "workflow_version", "definition_hash", "scenario_name", "seed", "reason", "detail", "fault_type", "fault_point", "draw", "idempotency_key", "attempt", "first_attempt"),
)
TASK_KEY, RUN_KEY = ["run_id", "task_name"], ["run_id"]


def _merged(kind: str, c: Column) -> Column:
    return {LAST: F.max, FIRST: F.min, MAX: F.max, SUM: F.sum}[kind](c)


def _parts(events: DataFrame, keys: list[str], spec: Spec, more: dict[str, Column]) -> DataFrame:
    def part(kind: str, value: Column, when: Column) -> Column:
        if kind in (MAX, SUM):
            return F.coalesce(_merged(kind, F.when(when, value)), F.lit(0)) if kind == SUM else F.max(F.when(when, value))
        with_seq = F.when(when, F.struct("seq", value.alias("value")))
        return F.array_sort(F.collect_list(with_seq)) if kind == ALL else _merged(kind, with_seq)

    return events.groupBy(*keys).agg(*[part(*s).alias(n) for n, s in spec.items()], *[c.alias(n) for n, c in more.items()])


def task_parts(journal: DataFrame, **more: Column) -> DataFrame:
    """A row per (run_id, task_name) of a stretch of a journal, with further aggregates."""
    return _parts(_decoded(journal.where("task_name is not null"), *TASK_READ), TASK_KEY, task_spec(), more)


def run_parts(journal: DataFrame, **more: Column) -> DataFrame:
    """A row per run_id of a stretch of a journal, with further aggregates."""
    return _parts(_decoded(journal, *RUN_READ), RUN_KEY, run_spec(), more)


def after(kept: Column, begins: Column, spec: Spec) -> list[Column]:
    """The columns of a part, merged with one that is kept (a struct, or null) if the events of the former begin after the
    last that is known."""
    both = {LAST: F.greatest, FIRST: F.least, MAX: F.greatest, SUM: lambda a, b: a + b, ALL: lambda a, b: F.array_sort(F.concat(a, b))}
    return [F.when(kept.isNull(), F.col(n)).when(begins > kept["last_seq"], both[s[0]](kept[n], F.col(n))).otherwise(kept[n]).alias(n) for n, s in spec.items()]


def finished_tasks(parts: DataFrame) -> DataFrame:
    """The columns of fold.task_state."""
    v = lambda n: F.col(n)["value"]
    error = F.coalesce(F.when(F.coalesce(v("last_error"), F.lit("")) == "", v("dead_reason")).otherwise(v("last_error")), F.lit(""))
    return parts.select(
        *TASK_KEY, F.coalesce(v("status"), F.lit("PENDING")).alias("status"), v("handler").alias("handler"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "retries", "requeues", "lease_expiries",
        error.alias("error"), v("artifacts").alias("artifacts"), v("first_started").alias("first_started"), v("completed").alias("completed"),
    )


def finished_runs(parts: DataFrame) -> DataFrame:
    """The columns of fold.run_state."""
    v = lambda n: F.col(n)["value"].alias(n)
    flat = lambda n, names: F.transform(n, lambda x: F.struct(x["seq"].alias("seq"), *[x["value"][m].alias(m) for m in names])).alias(n)
    return parts.select(
        "run_id", *map(v, ("status", "workflow", "version", "definition_hash", "scenario", "seed")), F.coalesce(F.col("failure_reason")["value"], F.lit("")).alias("failure_reason"), "workers_lost", "event_count", "last_seq",
        flat("faults", ("type", "point", "task", "draw")), flat("skipped", ("key", "task", "attempt", "first_attempt")),
    )
