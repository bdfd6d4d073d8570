"""A deterministic simulator of the engine: workflow, scenario and seed in, journal out. It replaces live workers, leases
and databases; only what they would have recorded matters. Runs are independent and dealt out to tasks. Where no draw decides
what happens in a run, all runs of a scenario have one history, which is simulated once; a run's draws only move its times."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V

LEASE_MS, REAP_MS = 2_000, 100
#: Runs of one task at most, so long as there are more than cores.
RUNS = 50_000
#: Events that a task makes at a time.
EVENTS = 200_000


class Retry(NamedTuple):
    """A retry that was scheduled: the position of its event, and what its delay depends on beside the run."""

    position: int
    task: str
    attempt: int
    base: float
    jitter: float
    delay: int


class History(NamedTuple):
    events: list[tuple]
    retries: list[Retry]
    #: Whether every run has these events, but for the times after a retry. A draw may then neither have decided on a fault
    #: nor, by its delay, on which of several tasks came first.
    shared: bool


def draw(seed, *parts) -> float:
    """functions.draws.uniform on the driver: the same value for the same names."""
    named = "".join(f"{len(str(p).encode())}#{p}" for p in parts)
    return int(hashlib.md5(f"{seed}|{named}".encode()).hexdigest()[:13], 16) / (1 << 52)


def _delay(seed, run_id, task: str, attempt: int, base: float, jitter: float) -> int:
    return int(max(0, base * (1 + jitter * (2 * draw(seed, run_id, "retry", task, attempt) - 1))))


def run(run_id: int, steps: list[tuple], scenario: dict, *, first_mismatch_stops: bool = False) -> list[tuple]:
    """(run_id, seq, type, task_name, worker_id, payload, at_ms) of one run. A step's handler takes 9 ms. Every fault that
    fits is injected; first_mismatch_stops instead stops at the first that does not, as the live injector did."""
    events = history(run_id, steps, scenario, first_mismatch_stops=first_mismatch_stops).events
    return [(run_id, i, *e) for i, e in enumerate(events, 1)]


def history(run_id: int | str, steps: list[tuple], scenario: dict, *, first_mismatch_stops: bool = False) -> History:
    """What happens in a run: its events (type, task_name, worker_id, payload, at_ms) and its retries."""
    out: list[tuple] = []
    retries: list[Retry] = []
    shared = True
    seed = scenario.get("seed") or 1
    faults = scenario.get("faults") or []

    def emit(at: int, kind: str, task: str | None = None, worker: str | None = None, **p) -> None:
        out.append((kind, task, worker, json.dumps({"v": 1, **{k: v for k, v in p.items() if v is not None}}, separators=(",", ":")), at))

    def fire(at: int, point: str, task: str, attempt: int) -> dict | None:
        nonlocal shared
        hit = None
        for i, f in enumerate(faults):
            fits = (f["at"] or point) == point and f["task"] in (None, task) and f["attempt"] in (0, attempt)
            if drawn := fits and not f["at"]:
                u, shared = draw(seed, run_id, "fault", i, task, attempt), False
            if not fits or drawn and not u < f["probability"]:
                if first_mismatch_stops:
                    break
                continue
            if f["at"] or point == "after-task-start":
                emit(at, "FAULT_INJECTED", task, None, fault_type=f["type"], fault_point=point, scenario=scenario.get("name"), seed=seed, draw=i if f["at"] else int(u * 1e9))
                hit = hit or f
        return hit

    by_name = {s[2]: s for s in steps}
    status = {s[2]: "PENDING" for s in steps}
    due = {s[2]: 0 for s in steps if not s[4]}
    emit(0, "RUN_CREATED", workflow_name=steps[0][0], workflow_version=1, scenario_name=scenario.get("name"), seed=seed)
    for name in due:
        status[name] = "READY"
        emit(0, "TASK_SCHEDULED", name, attempt=0)
    emit(0, "RUN_QUEUED", task_count=len(steps))
    attempts, recorded, started, now, worker = dict.fromkeys(status, 0), {}, False, 0, 1

    def policy(name: str) -> dict:
        s = by_name[name]
        return dict(V.DEFAULT_RETRY) if s[5] is None else {"max_attempts": s[5], "initial_delay_ms": s[6] or 0, "multiplier": s[7] or 1.0, "max_delay_ms": s[8] or 0, "jitter": s[9] or 0.0}

    def abandon(at: int, name: str) -> None:
        below, queue = [], [name]
        while queue:
            parent = queue.pop(0)
            for s in steps:
                if parent in s[4] and s[2] not in below:
                    below.append(s[2])
                    queue.append(s[2])
        for task in below:
            if status[task] not in V.TASK_TERMINAL:
                status[task] = "DEAD"
                emit(at, "TASK_DEAD_LETTERED", task, attempts=attempts[task], reason=f"upstream task {name} did not succeed: ")

    while ready := sorted((due[n], i, n) for i, n in enumerate(status) if status[n] in ("READY", "RETRYING") and n in due):
        at, _, task = ready[0]
        shared = shared and len(ready) == 1
        now = max(now, at)
        if status[task] == "RETRYING":
            emit(now, "TASK_SCHEDULED", task, attempt=attempts[task])
        attempts[task] += 1
        n, w, p = attempts[task], f"w{worker}", policy(task)
        emit(now + 1, "TASK_LEASED", task, w, attempt=n)
        fire(now + 1, "after-task-lease", task, n)
        emit(now + 2, "TASK_STARTED", task, w, attempt=n, handler=by_name[task][3])
        if not started:
            started = True
            emit(now + 2, "RUN_STARTED")
        fault = fire(now + 2, "after-task-start", task, n)
        took = 9 + (2_000 if fault and fault["type"] == "latency" else 0)
        error = None
        if fault and fault["type"] == "http-error":
            error = f"injected http-error fault: upstream returned {fault['params'].get('status', 503)}"
        elif fault and fault["type"] == "db-disconnect":
            error = "injected db-disconnect fault: connection closed"
        crashed = bool(fault and fault["type"] == "worker-crash")
        now += 2 + took
        if not error and not crashed:
            if by_name[task][3] in ("charge_once", "effect_then_die"):
                key = f"{run_id}:{task}:charge"
                if key in recorded:
                    emit(now, "SIDE_EFFECT_SKIPPED", task, None, idempotency_key=key, attempt=n, first_attempt=recorded[key])
                else:
                    recorded[key] = n
            ack = fire(now, "before-task-ack", task, n)
            crashed = bool(ack and ack["type"] == "worker-crash")
        if crashed:
            now += LEASE_MS + REAP_MS
            emit(now, "TASK_LEASE_EXPIRED", task, w, attempt=n)
            if n < p["max_attempts"]:
                status[task], due[task] = "READY", now
                emit(now, "TASK_REQUEUED", task, None, attempt=n, next_attempt=n + 1, reason="lease expired")
            else:
                status[task] = "DEAD"
                emit(now, "TASK_DEAD_LETTERED", task, attempts=n, reason="lease expired with no attempts left")
                abandon(now, task)
            emit(now, "WORKER_LOST", None, w, missed_beats=V.LOST_AFTER, leases_released=1)
            worker += 1
        elif error:
            again = n < p["max_attempts"]
            emit(now, "TASK_FAILED", task, w, attempt=n, duration_ms=took, error=error, retryable=again)
            if again:
                base = p["initial_delay_ms"] * p["multiplier"] ** (n - 1)
                base = min(base, p["max_delay_ms"]) if p["max_delay_ms"] else base
                delay = _delay(seed, run_id, task, n, base, p["jitter"])
                status[task], due[task] = "RETRYING", now + delay
                retries.append(Retry(len(out), task, n, base, p["jitter"], delay))
                emit(now, "TASK_RETRY_SCHEDULED", task, None, attempt=n, next_attempt=n + 1, delay_ms=delay)
            else:
                status[task] = "DEAD"
                emit(now, "TASK_DEAD_LETTERED", task, attempts=n, reason=f"attempts exhausted: {error}")
                abandon(now, task)
        else:
            status[task] = "SUCCEEDED"
            emit(now, "TASK_SUCCEEDED", task, w, attempt=n, duration_ms=took)
            twice = fire(now, "after-task-finish", task, n)
            if twice and twice["type"] == "duplicate-delivery" and (key := f"{run_id}:{task}:charge") in recorded:
                emit(now, "SIDE_EFFECT_SKIPPED", task, None, idempotency_key=key, attempt=n, first_attempt=recorded[key])
            for s in steps:
                if status[s[2]] == "PENDING" and task in s[4] and all(status[d] == "SUCCEEDED" for d in s[4]):
                    status[s[2]], due[s[2]] = "READY", now
                    emit(now, "TASK_SCHEDULED", s[2], attempt=0)
    dead = sum(x == "DEAD" for x in status.values())
    if dead:
        emit(now, "RUN_FAILED", reason="tasks dead-lettered", detail=f"{dead} of {len(steps)} tasks did not succeed")
    else:
        emit(now, "RUN_SUCCEEDED", tasks_succeeded=len(steps))
    return History(out, retries, shared)


def _of_history(ids: np.ndarray, h: History, seed) -> dict:
    """The events of runs that share a history of the run "", run by run: columns of type, task_name, worker_id, payload,
    at_ms."""
    kinds, tasks, workers, payloads, at = zip(*h.events, strict=True)
    each = lambda values: np.tile(np.array(values, dtype=object), (len(ids), 1))
    payload, moved = each(payloads), np.tile(np.array(at, dtype="int64"), (len(ids), 1))
    for r in h.retries:
        if r.jitter:
            delays = [_delay(seed, i, r.task, r.attempt, r.base, r.jitter) for i in ids.tolist()]
            head = payloads[r.position].removesuffix(f"{r.delay}}}")
            payload[:, r.position] = [f"{head}{d}}}" for d in delays]
            moved[:, r.position + 1 :] += (np.array(delays, dtype="int64") - r.delay)[:, None]
    for n, kind in enumerate(kinds):
        if kind == "SIDE_EFFECT_SKIPPED":
            head, key, tail = payloads[n].partition('"idempotency_key":"')
            payload[:, n] = [f"{head}{key}{i}{tail}" for i in ids.tolist()]
    return {"type": each(kinds).ravel(), "task_name": each(tasks).ravel(), "worker_id": each(workers).ravel(), "payload": payload.ravel(), "at_ms": moved.ravel()}


def journal(runs: DataFrame, workflows: dict[str, list[tuple]], scenarios: dict[str, dict]) -> DataFrame:
    """The journals of runs (run_id long, workflow, scenario, started timestamp_ntz)."""
    schema = "run_id long, seq long, type string, task_name string, worker_id string, payload string, at_ms long, started timestamp_ntz"
    columns = [c.split()[0] for c in schema.split(", ")]

    def simulated(batches: Iterator) -> Iterator:
        first = cache(lambda workflow, scenario: history("", workflows[workflow], scenarios[scenario]))
        for pdf in batches:
            for (workflow, scenario), some in pdf.groupby(["workflow", "scenario"], sort=False, dropna=False):
                h = first(workflow, scenario)
                n = len(h.events)
                at_once = max(1, EVENTS // n)
                for low in range(0, len(some), at_once):
                    part = some.iloc[low : low + at_once]
                    ids, started = part["run_id"].to_numpy("int64"), part["started"].to_numpy()
                    if h.shared:
                        made = _of_history(ids, h, scenarios[scenario].get("seed") or 1)
                        yield pd.DataFrame({"run_id": ids.repeat(n), "seq": np.tile(np.arange(1, n + 1), len(ids)), **made, "started": started.repeat(n)})[columns]
                    else:
                        rows = [(*e, at) for i, at in zip(ids.tolist(), started, strict=True) for e in run(i, workflows[workflow], scenarios[scenario])]
                        yield pd.DataFrame(rows, columns=columns)

    # A file of few bytes holds many runs, and would be simulated by one task.
    tasks = max(runs.sparkSession.sparkContext.defaultParallelism, -(-runs.count() // RUNS))
    dealt = runs.select("run_id", "workflow", "scenario", F.col("started").cast("timestamp_ntz").alias("started")).repartition(tasks, "run_id")
    j = dealt.mapInPandas(simulated, schema)
    at = F.expr("started + make_dt_interval(0, 0, 0, cast(at_ms as decimal(18, 6)) / 1000)")
    return j.select("run_id", "seq", "type", "task_name", "worker_id", "payload", at.alias("occurred_at"))
