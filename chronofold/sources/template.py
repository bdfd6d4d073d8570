"""A journal over the orders table: run = order, its class (o_orderkey mod 6) picks one of six literal histories, and
times are the order's date plus the step's offset times 1 + o_orderkey mod 7."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HTTP = "injected http-error fault: upstream returned 503"
_ARTIFACT = {"name": "out.txt", "sha256": "a" * 64, "size": 10, "content_type": "text/plain"}


def _created(scenario: str | None = None, seed: int = 42) -> tuple:
    named = {"scenario_name": scenario} if scenario else {}
    return (0, "RUN_CREATED", None, None, {"workflow_name": "wf", "workflow_version": 1, "definition_hash": "abc123", **named, "seed": seed})


def _opening(task: str, handler: str, tasks: int, scenario: str | None = None, seed: int = 42) -> list[tuple]:
    return [
        _created(scenario, seed),
        (0, "TASK_SCHEDULED", task, None, {"attempt": 0}),
        (0, "RUN_QUEUED", None, None, {"task_count": tasks}),
        *_claimed(10, task, "w1", 1, handler),
        (11, "RUN_STARTED", None, None, {}),
    ]


def _claimed(at: int, task: str, worker: str, attempt: int, handler: str) -> list[tuple]:
    return [(at, "TASK_LEASED", task, worker, {"attempt": attempt}), (at + 1, "TASK_STARTED", task, worker, {"attempt": attempt, "handler": handler})]


def _failed(at: int, task: str, worker: str, attempt: int, retryable: bool = True) -> tuple:
    return (at, "TASK_FAILED", task, worker, {"attempt": attempt, "duration_ms": 4, "error": _HTTP, "retryable": retryable})


def _retry(at: int, task: str, attempt: int, delay: int) -> list[tuple]:
    return [
        (at, "TASK_RETRY_SCHEDULED", task, None, {"attempt": attempt, "next_attempt": attempt + 1, "delay_ms": delay}),
        (at + delay, "TASK_SCHEDULED", task, None, {"attempt": attempt}),
    ]


def _succeeded(at: int, task: str, worker: str, attempt: int, **more) -> tuple:
    return (at, "TASK_SUCCEEDED", task, worker, {"attempt": attempt, "duration_ms": 9, **more})


HISTORIES: dict[int, list[tuple]] = {
    0: [
        *_opening("first", "h", 2),
        _succeeded(20, "first", "w1", 1, artifacts=[_ARTIFACT]),
        (20, "TASK_SCHEDULED", "second", None, {"attempt": 0}),
        *_claimed(30, "second", "w2", 1, "h"),
        _succeeded(40, "second", "w2", 1),
        (40, "RUN_SUCCEEDED", None, None, {"tasks_succeeded": 2}),
    ],
    1: [
        *_opening("task", "h", 1, "worker-crash-after-effect", 1337),
        (2010, "TASK_LEASE_EXPIRED", "task", "w1", {"attempt": 1}),
        (2010, "TASK_REQUEUED", "task", None, {"attempt": 1, "next_attempt": 2, "reason": "lease expired"}),
        (2020, "WORKER_LOST", None, "w1", {"missed_beats": 5, "leases_released": 1}),
        *_claimed(2100, "task", "w2", 2, "h"),
        (2102, "SIDE_EFFECT_SKIPPED", "task", None, {"idempotency_key": "k", "attempt": 2, "first_attempt": 1}),
        _succeeded(2110, "task", "w2", 2),
        (2110, "RUN_SUCCEEDED", None, None, {"tasks_succeeded": 1}),
    ],
    2: [
        *_opening("validate", "validate_rows", 2, "upstream-down-throughout", 7),
        _failed(15, "validate", "w1", 1),
        *_retry(15, "validate", 1, 1000),
        *_claimed(1020, "validate", "w1", 2, "validate_rows"),
        _failed(1025, "validate", "w1", 2),
        *_retry(1025, "validate", 2, 2000),
        *_claimed(3030, "validate", "w1", 3, "validate_rows"),
        _failed(3035, "validate", "w1", 3, retryable=False),
        (3035, "TASK_DEAD_LETTERED", "validate", None, {"attempts": 3, "reason": f"attempts exhausted: {_HTTP}"}),
        (3035, "TASK_DEAD_LETTERED", "report", None, {"attempts": 0, "reason": "upstream task validate did not succeed: "}),
        (3035, "RUN_FAILED", None, None, {"reason": "tasks dead-lettered", "detail": "2 of 2 tasks did not succeed"}),
    ],
    3: [
        *_opening("validate", "validate_rows", 2, "upstream-503-on-validate", 2024),
        (12, "FAULT_INJECTED", "validate", None, {"fault_type": "http-error", "fault_point": "after-task-start", "scenario": "upstream-503-on-validate", "seed": 2024, "draw": 0, "params": {"status": 503}}),
        _failed(15, "validate", "w1", 1),
        *_retry(15, "validate", 1, 1000),
        *_claimed(1020, "validate", "w2", 2, "validate_rows"),
        _succeeded(1030, "validate", "w2", 2),
        (1030, "RUN_SUCCEEDED", None, None, {"tasks_succeeded": 1}),
    ],
    4: [*_opening("first", "h", 1), (50, "RUN_CANCELLED", None, None, {"reason": "cancelled by operator"})],
    5: _opening("first", "h", 1),
}


def rows() -> list[tuple]:
    """(class, seq, offset_ms, type, task, worker, payload) of every step."""
    return [(k, i, at, kind, task, worker, json.dumps({"v": 1, **p}, separators=(",", ":"))) for k, steps in HISTORIES.items() for i, (at, kind, task, worker, p) in enumerate(steps, 1)]


#: Orders of one partition of the journal: what their events take is sorted in a task's memory.
RUNS = 50_000


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, seq, type, task_name, worker_id, payload, occurred_at, the events of a run in one partition. The template has
    under a hundred rows: the orders are dealt out by their key, which are two numbers a run, and expanded in place. What is
    grouped or joined by run then moves no event, and no task sorts more than RUNS runs."""
    steps = spark.createDataFrame(rows(), "class long, seq long, offset_ms long, type string, task_name string, worker_id string, payload string")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    orders = orders.repartition(max(1, -(-orders.count() // RUNS)), "o_orderkey")
    out = orders.join(F.broadcast(steps), F.col("o_orderkey") % 6 == F.col("class"))
    at = F.expr("o_orderdate + make_dt_interval(0, 0, 0, cast(offset_ms * (1 + o_orderkey % 7) as decimal(18, 6)) / 1000)")
    return out.select(F.col("o_orderkey").alias("run_id"), "seq", "type", "task_name", "worker_id", "payload", at.alias("occurred_at"))


def corrupted(clean: DataFrame) -> DataFrame:
    """The journal with damage by run_id mod 1000: 1 loses seq 4, 2 has an unknown type there, 3 a payload without version
    there, 4 a version from the future, 6 one more event after its last."""
    damage, fourth = F.col("run_id") % 1000, F.col("seq") == 4
    kind = F.when((damage == 2) & fourth, F.lit("TASK_TELEPORTED")).otherwise(F.col("type"))
    payload = F.when((damage == 3) & fourth, F.replace("payload", F.lit('"v":1,'), F.lit(""))).when((damage == 4) & fourth, F.replace("payload", F.lit('"v":1,'), F.lit('"v":99,'))).otherwise(F.col("payload"))
    kept = clean.where(~((damage == 1) & fourth)).withColumns({"type": kind, "payload": payload})
    late = clean.where(damage == 6).groupBy("run_id").agg((F.max("seq") + 1).alias("seq"), F.max("occurred_at").alias("occurred_at"))
    late = late.select("run_id", "seq", F.lit("TASK_SCHEDULED").alias("type"), F.lit("late").alias("task_name"), F.lit(None).cast("string").alias("worker_id"), F.lit('{"v":1,"attempt":0}').alias("payload"), "occurred_at")
    return kept.unionByName(late)


def _value(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def journal_sql(name: str = "journal") -> str:
    """Common table expressions that give DuckDB the same journal."""
    values = ",\n".join("(" + ", ".join(map(_value, r)) + ")" for r in rows())
    return f"""steps(class, seq, offset_ms, type, task_name, worker_id, payload) AS (VALUES {values}),
{name} AS (SELECT o_orderkey AS run_id, seq::BIGINT AS seq, type, task_name, worker_id, payload,
  o_orderdate + to_milliseconds(offset_ms * (1 + o_orderkey % 7)) AS occurred_at FROM orders JOIN steps ON class = o_orderkey % 6)"""


def corrupted_sql(clean: str = "journal", name: str = "damaged") -> str:
    return f"""{name} AS (
  SELECT run_id, seq, CASE WHEN run_id % 1000 = 2 AND seq = 4 THEN 'TASK_TELEPORTED' ELSE type END AS type, task_name, worker_id,
    CASE WHEN run_id % 1000 = 3 AND seq = 4 THEN replace(payload, '"v":1,', '') WHEN run_id % 1000 = 4 AND seq = 4 THEN replace(payload, '"v":1,', '"v":99,') ELSE payload END AS payload, occurred_at
  FROM {clean} WHERE NOT (run_id % 1000 = 1 AND seq = 4)
  UNION ALL
  SELECT run_id, max(seq) + 1, 'TASK_SCHEDULED', 'late', NULL, '{{"v":1,"attempt":0}}', max(occurred_at) FROM {clean} WHERE run_id % 1000 = 6 GROUP BY run_id)"""
