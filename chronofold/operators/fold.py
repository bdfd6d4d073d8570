"""The fold of a journal into run and task state, as aggregates: "last" is the greatest seq, so map-side combination holds
and no run is gathered in one place. Both give the same state as reading events one by one, for journals without anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as V
from ..functions import text


def _last(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("seq")))


def _decoded(journal: DataFrame, types: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """journal with p, the named payload fields, parsed for the event types that a fold reads them of."""
    schema = T.StructType([f for f in T.StructType.fromDDL(V.PAYLOAD) if f.name in fields])
    return journal.withColumn("p", F.from_json(F.when(F.col("type").isin(*types), F.col("payload")), schema))


def task_state(journal: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row per (run_id, task_name), and per value of `by` before them: status, handler, attempts, retries, requeues, lease_expiries, error, output hash of the
    last success's artifacts, first_started, completed."""
    read = ("TASK_LEASED", "TASK_STARTED", "TASK_SUCCEEDED", "TASK_FAILED", "TASK_DEAD_LETTERED")
    e = _decoded(journal.where("task_name is not null"), read, ("attempt", "handler", "error", "reason", "artifacts"))
    kind = F.col("type")
    is_ = lambda *names: kind.isin(*names)
    status = text.lookup(kind, V.TASK_STATUS_OF)
    outcome = is_("TASK_SUCCEEDED", "TASK_FAILED")
    # A dead letter's reason counts only if the error is empty by then.
    last_error = _last(F.when(is_("TASK_FAILED"), F.coalesce("p.error", F.lit(""))).otherwise(F.lit("")), outcome)
    dead_reason = F.min_by("p.reason", F.when(is_("TASK_DEAD_LETTERED"), F.col("seq")))
    return e.groupBy(*by, "run_id", "task_name").agg(
        F.coalesce(_last(status, status.isNotNull()), F.lit("PENDING")).alias("status"),
        _last(F.col("p.handler"), is_("TASK_STARTED")).alias("handler"),
        F.coalesce(F.max(F.when(is_("TASK_LEASED", "TASK_STARTED"), F.col("p.attempt"))), F.lit(0)).alias("attempts"),
        F.count_if(is_("TASK_RETRY_SCHEDULED")).alias("retries"),
        F.count_if(is_("TASK_REQUEUED")).alias("requeues"),
        F.count_if(is_("TASK_LEASE_EXPIRED")).alias("lease_expiries"),
        F.coalesce(F.when(F.coalesce(last_error, F.lit("")) == "", dead_reason).otherwise(last_error), F.lit("")).alias("error"),
        _last(F.col("p.artifacts"), is_("TASK_SUCCEEDED")).alias("artifacts"),
        F.min_by("occurred_at", F.when(is_("TASK_STARTED"), F.col("seq"))).alias("first_started"),
        _last(F.col("occurred_at"), is_("TASK_SUCCEEDED", "TASK_FAILED", "TASK_DEAD_LETTERED")).alias("completed"),
    )


def run_state(journal: DataFrame, by: tuple[str, ...] = (), **more: Column) -> DataFrame:
    """A row per run_id, and per value of `by` before it: status, workflow, version, definition_hash, scenario, seed, failure_reason, workers_lost,
    event_count, last_seq, faults and skipped (arrays in seq order), and further aggregates of a run's events."""
    read = ("RUN_CREATED", "RUN_FAILED", "RUN_CANCELLED", "FAULT_INJECTED", "SIDE_EFFECT_SKIPPED")
    fields = ("workflow_name", "workflow_version", "definition_hash", "scenario_name", "seed", "reason", "detail", "fault_type", "fault_point", "draw", "idempotency_key", "attempt", "first_attempt")
    e = _decoded(journal, read, fields)
    kind, created = F.col("type"), F.col("type") == "RUN_CREATED"
    status = text.lookup(kind, V.RUN_STATUS_OF)
    reason = F.when(F.coalesce(F.col("p.detail"), F.lit("")) != "", F.concat_ws(": ", "p.reason", "p.detail")).otherwise(F.col("p.reason"))
    fault = F.when(kind == "FAULT_INJECTED", F.struct("seq", F.col("p.fault_type").alias("type"), F.col("p.fault_point").alias("point"), F.col("task_name").alias("task"), F.col("p.draw").alias("draw")))
    skipped = F.when(kind == "SIDE_EFFECT_SKIPPED", F.struct("seq", F.col("p.idempotency_key").alias("key"), F.col("task_name").alias("task"), F.col("p.attempt").alias("attempt"), F.col("p.first_attempt").alias("first_attempt")))
    return e.groupBy(*by, "run_id").agg(
        _last(status, status.isNotNull()).alias("status"),
        _last(F.col("p.workflow_name"), created).alias("workflow"),
        _last(F.col("p.workflow_version"), created).alias("version"),
        _last(F.col("p.definition_hash"), created).alias("definition_hash"),
        _last(F.coalesce(F.col("p.scenario_name"), F.lit("")), created).alias("scenario"),
        _last(F.col("p.seed"), created).alias("seed"),
        F.coalesce(_last(F.when(kind == "RUN_FAILED", reason).otherwise(F.col("p.reason")), kind.isin("RUN_FAILED", "RUN_CANCELLED")), F.lit("")).alias("failure_reason"),
        F.count_if(kind == "WORKER_LOST").alias("workers_lost"),
        F.count("*").alias("event_count"),
        F.max("seq").alias("last_seq"),
        F.array_sort(F.collect_list(fault)).alias("faults"),
        F.array_sort(F.collect_list(skipped)).alias("skipped"),
        *[c.alias(name) for name, c in more.items()],
    )


def totals(tasks: DataFrame) -> DataFrame:
    """Of each run's tasks: total_attempts (sum), max_retries and sum_retries (two different things), lost (dead tasks)."""
    return tasks.groupBy("run_id").agg(
        F.sum("attempts").alias("total_attempts"), F.coalesce(F.max("retries"), F.lit(0)).alias("max_retries"),
        F.sum("retries").alias("sum_retries"), F.count_if(F.col("status") == "DEAD").alias("lost"), F.count("*").alias("tasks"),
    )


def reduce_events(events: list[dict]) -> dict:
    """The strict fold of one run's events, in list order, on the driver: for journals that no set-based rule fits and as
    the yardstick of the aggregates. Raises at the first anomaly."""
    import json

    state: dict = {"status": "", "tasks": {}, "faults": [], "skipped": [], "workers_lost": 0, "event_count": 0, "last_seq": 0}
    for want, e in enumerate(events, 1):
        if e["seq"] != want:
            raise ValueError(f"gap in run: expected seq {want}, found {e['seq']}")
        if e["type"] not in V.EVENT_TYPES:
            raise ValueError(f"unknown type {e['type']}")
        if state["status"] in V.RUN_TERMINAL:
            raise ValueError(f"{e['type']} after the run ended")
        p = json.loads(e["payload"]) if e["payload"] else {}
        if e["type"] != "RUN_STARTED":
            if "v" not in p:
                raise ValueError("payload has no version field")
            if p["v"] != 1 and not (e["type"].startswith("WORKER_") and e["type"] != "WORKER_LOST"):
                raise ValueError(f"payload version {p['v']} is not supported by this build")
        _step(state, e, p)
        state["event_count"], state["last_seq"] = want, e["seq"]
    return state


def _step(state: dict, e: dict, p: dict) -> None:
    kind = e["type"]
    if kind in V.RUN_STATUS_OF:
        state["status"] = V.RUN_STATUS_OF[kind]
    if kind == "RUN_CREATED":
        state |= {"workflow": p.get("workflow_name"), "version": p.get("workflow_version"), "definition_hash": p.get("definition_hash"), "scenario": p.get("scenario_name", ""), "seed": p.get("seed")}
    elif kind in ("RUN_FAILED", "RUN_CANCELLED"):
        detail = p.get("detail") if kind == "RUN_FAILED" else ""
        state["failure_reason"] = f"{p.get('reason')}: {detail}" if detail else p.get("reason", "")
    elif kind == "WORKER_LOST":
        state["workers_lost"] += 1
    elif kind == "FAULT_INJECTED":
        state["faults"].append((p.get("fault_type"), p.get("fault_point"), e["task_name"], p.get("draw")))
    elif kind == "SIDE_EFFECT_SKIPPED":
        state["skipped"].append((p.get("idempotency_key"), e["task_name"], p.get("attempt"), p.get("first_attempt")))
    if not e["task_name"]:
        return
    t = state["tasks"].setdefault(e["task_name"], {"status": "PENDING", "attempts": 0, "retries": 0, "requeues": 0, "lease_expiries": 0, "error": "", "artifacts": None, "handler": None})
    t["status"] = V.TASK_STATUS_OF.get(kind, t["status"])
    if kind in ("TASK_LEASED", "TASK_STARTED"):
        t["attempts"] = max(t["attempts"], p.get("attempt", 0))
    for name, field in (("TASK_RETRY_SCHEDULED", "retries"), ("TASK_REQUEUED", "requeues"), ("TASK_LEASE_EXPIRED", "lease_expiries")):
        t[field] += kind == name
    if kind == "TASK_STARTED":
        t["handler"] = p.get("handler")
    elif kind == "TASK_SUCCEEDED":
        t |= {"error": "", "artifacts": p.get("artifacts")}
    elif kind == "TASK_FAILED":
        t["error"] = p.get("error", "")
    elif kind == "TASK_DEAD_LETTERED":
        t["error"] = t["error"] or p.get("reason", "")
