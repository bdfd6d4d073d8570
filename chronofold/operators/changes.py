"""State changes as sets of rows: what a batch of requests would write, as a dict of tables. Rows of runs, tasks and workers
are the changed ones with the columns that change; events go to ops.append_events, which numbers them by `ord`. A guard that
a request fails is a row of `refused` with the reason, never an error. `now` is a literal. What several of a change's tables
follow from is written once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text
from ..functions.time import instant, plus_ms
from ..sources.storage import keyed_side, written
from . import dag, ops

#: Places of a change's events within a run: its own, then dependents, then the run's end.
OWN, AFTER, LAST = 0, 1_000, 1_000_000


def _events(rows: DataFrame, kind: str, now: Column, *, ord: Column | int = OWN, task: bool = True, worker: str | None = None, **payload: Column) -> DataFrame:  # noqa: A002
    """run_id, ord, type, task_name, worker_id, payload, occurred_at: an event for each row."""
    text_of = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    place = ord if isinstance(ord, Column) else F.lit(ord)
    return rows.select("run_id", place.cast("long").alias("ord"), F.lit(kind).alias("type"), text_of("task_name" if task else None).alias("task_name"), text_of(worker).alias("worker_id"), text.encode(**payload).alias("payload"), now.alias("occurred_at"))


def _union(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _opt(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or nulls where df has none of the name."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _null(tasks: DataFrame, name: str) -> Column:
    """A null of the column's type, whatever kind of ids the tables use."""
    return F.lit(None).cast(tasks.schema[name].dataType if name in tasks.columns else TASK_STATE[name])


#: What a change may set of a task; the rows of `tasks` that a change gives carry all of it, as it is after the change.
TASK_STATE = {"worker_id": "long", "lease_expires_at": "timestamp_ntz", "scheduled_at": "timestamp_ntz", "completed_at": "timestamp_ntz", "error": "string", "output_ref": "string"}


def _task_rows(tasks: DataFrame, fate: DataFrame, now: Column) -> DataFrame:
    """id, status and TASK_STATE of the tasks in fate (id, kind, run_at, said, output). kind: won, again (tried again at
    run_at), dead, behind (a dead step), abandoned (its run is closed), free (its dependencies are met), back (its lease ran
    out). Finished tasks hold no lease; only one that succeeded keeps its worker; an error stays unless there is a newer one,
    and for a lost lease the first stays."""
    old = {c: _opt(tasks, c, kind) for c, kind in TASK_STATE.items()}
    j = fate.join(keyed_side(tasks.select("id", *[c.alias(n) for n, c in old.items()])), "id")
    kind = F.col("kind")
    none = lambda n: _null(tasks, n)
    status = text.lookup(kind, {"won": "SUCCEEDED", "again": "RETRYING", "dead": "DEAD", "behind": "DEAD", "expired": "DEAD", "abandoned": "DEAD", "free": "READY", "back": "READY"})
    return j.select(
        "id", status.alias("status"),
        F.when(kind.isin("won", "free"), F.col("worker_id")).otherwise(none("worker_id")).alias("worker_id"),
        F.when(kind == "free", F.col("lease_expires_at")).otherwise(none("lease_expires_at")).alias("lease_expires_at"),
        F.when(kind == "again", F.col("run_at")).when(kind.isin("free", "back"), now).otherwise(F.col("scheduled_at")).alias("scheduled_at"),
        F.when(kind.isin("won", "dead", "behind", "expired", "abandoned"), now).when(kind == "again", none("completed_at")).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(kind.isin("again", "dead"), F.col("said")).when(kind == "won", none("error")).otherwise(F.coalesce("error", "said")).alias("error"),
        F.when(kind == "won", F.nullif("output", F.lit(""))).otherwise(F.col("output_ref")).alias("output_ref"),
    )


def _fate(rows: DataFrame, kind: str, *, run_at: Column | None = None, said: Column | None = None, output: Column | None = None) -> DataFrame:
    of = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    return rows.select("id", F.lit(kind).alias("kind"), of(run_at, "timestamp_ntz").alias("run_at"), of(said, "string").alias("said"), of(output, "string").alias("output"))


def create_runs(asked: DataFrame, steps: DataFrame, now: Column) -> dict[str, DataFrame]:
    """asked (run_id, workflow_id, workflow, version, definition_hash, registered_hash, scenario_name, seed, and scenario_hash and
    correlation_id if there are any) -> runs, tasks, events, refused. A definition that is not the registered one is refused. Steps without dependencies are ready and
    announced; the others wait."""
    same = F.col("definition_hash").eqNullSafe(F.col("registered_hash"))
    good = asked.where(same)
    given = lambda c: F.nullif(_opt(asked, c, "string"), F.lit(""))
    scenario = given("scenario_name")
    runs = good.select(F.col("run_id").alias("id"), "workflow_id", F.lit("QUEUED").alias("status"), scenario.alias("scenario_name"), "seed", now.alias("created_at"))
    s = dag.with_retry(steps).select("workflow", "position", F.col("name").alias("task_name"), "depends_on", "max_attempts")
    free = F.coalesce(F.size("depends_on"), F.lit(0)) <= 0
    made = good.select("run_id", "workflow").join(s, "workflow").withColumn("status", F.when(free, "READY").otherwise("PENDING"))
    tasks = made.select("run_id", "task_name", F.lit(0).alias("attempt"), "max_attempts", "status", now.alias("scheduled_at"), F.concat_ws(":", F.col("run_id").cast("string"), "task_name").alias("idempotency_key"))
    count = good.join(s.groupBy("workflow").agg(F.count("*").cast("int").alias("n")), "workflow", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n"))
    events = _union(
        _events(good, "RUN_CREATED", now, task=False, workflow_name=F.col("workflow"), workflow_version=F.col("version"), definition_hash=F.col("definition_hash"), scenario_name=scenario, scenario_hash=given("scenario_hash"), seed=F.col("seed"), correlation_id=given("correlation_id")),
        _events(made.where("status = 'READY'"), "TASK_SCHEDULED", now, ord=F.col("position"), attempt=F.lit(0), scheduled_at=instant(now)),
        _events(count, "RUN_QUEUED", now, ord=LAST, task=False, task_count=F.col("n")),
    )
    return {"runs": runs, "tasks": tasks, "events": events, "refused": asked.where(~same).select("run_id", F.lit("definition does not match the registered workflow").alias("reason"))}


def start_tasks(tasks: DataFrame, runs: DataFrame, attempts: DataFrame, asked: DataFrame, now: Column) -> dict[str, DataFrame]:
    """asked (id, worker_id, attempt, handler) -> tasks, attempts, runs, events, refused. The lease must still be held under
    that attempt, and the attempt (attempts: task_id, attempt) not have been started before. A queued run starts with the
    first of its tasks."""
    held = tasks.where("status = 'LEASED'").select("id", "run_id", "task_name", "worker_id", "attempt", F.lit(True).alias("held"))
    tried = attempts.select(F.col("task_id").alias("id"), "attempt").distinct().withColumn("tried", F.lit(True))
    j = asked.join(held, ["id", "worker_id", "attempt"], "left").join(tried, ["id", "attempt"], "left")
    reason = F.when(F.col("held").isNull(), "lease lost").when(F.col("tried"), "attempt is started already")
    j = j.withColumn("reason", reason)
    good = j.where("reason is null")
    queued = runs.where("status = 'QUEUED'").select(F.col("id").alias("run_id")).join(good.select("run_id").distinct(), "run_id", "left_semi")
    return {
        "tasks": good.select("id", F.lit("RUNNING").alias("status"), now.alias("started_at")),
        "attempts": good.select(F.col("id").alias("task_id"), "attempt", "worker_id", now.alias("started_at")),
        "runs": queued.select(F.col("run_id").alias("id"), F.lit("RUNNING").alias("status"), now.alias("started_at")),
        "events": _events(good, "TASK_STARTED", now, worker="worker_id", attempt=F.col("attempt"), handler=F.col("handler")).unionByName(_events(queued, "RUN_STARTED", now, ord=LAST, task=False)),
        "refused": j.where("reason is not null").select("id", "worker_id", "attempt", "reason"),
    }


def _dead(rows: DataFrame, reason: Column, said: Column, now: Column, ord: int) -> dict[str, DataFrame]:  # noqa: A002
    """Dead letters and events of rows (id, run_id, task_name, attempt, worker_id)."""
    return {
        "dead_letters": rows.select(F.col("id").alias("task_id"), "run_id", reason.alias("reason"), F.greatest("attempt", F.lit(1)).alias("attempts"), F.col("worker_id").alias("last_worker"), now.alias("created_at")),
        "events": _events(rows, "TASK_DEAD_LETTERED", now, ord=ord, attempts=F.col("attempt"), reason=said),
    }


def _settled(tasks: DataFrame, changed: DataFrame, runs: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Runs that end once `changed` (id, status) holds, queued or running until then, and their last event."""
    touched = tasks.join(keyed_side(changed.select("id")), "id", "left_semi").select("run_id").distinct()
    new = tasks.select("id", "run_id", "status").join(keyed_side(touched), "run_id", "left_semi").join(keyed_side(changed.select("id", F.col("status").alias("now_"))), "id", "left")
    ended = ops.settle(new.select("run_id", F.coalesce("now_", "status").alias("status")))
    counts = tasks.groupBy("run_id").agg(F.count("*").alias("n"))
    open_ = runs.where("status in ('QUEUED', 'RUNNING')").select(F.col("id").alias("run_id"))
    ended = ended.join(keyed_side(open_), "run_id", "left_semi").join(keyed_side(counts), "run_id")
    failed, well = ended.where("closes_as = 'FAILED'"), ended.where("closes_as = 'SUCCEEDED'")
    detail = F.format_string("%d of %d tasks did not succeed", "dead", "n")
    return {
        "runs": ended.select(F.col("run_id").alias("id"), F.col("closes_as").alias("status"), F.when(F.col("dead") > 0, detail).alias("failure_reason"), now.alias("completed_at")),
        "events": _union(
            _events(failed, "RUN_FAILED", now, ord=LAST, task=False, reason=F.lit("tasks dead-lettered"), detail=detail),
            _events(well, "RUN_SUCCEEDED", now, ord=LAST, task=False, tasks_succeeded=(F.col("n") - F.col("dead")).cast("int")),
        ),
    }


def _abandoned(steps: DataFrame, tasks: DataFrame, finished: DataFrame, workflow: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The unfinished descendants of tasks that have just died, by the graph of their run's workflow (run_id, workflow).
    finished: id, status of the tasks that a batch has ended."""
    dead = finished.where("status = 'DEAD'").select("id")
    state = tasks.join(keyed_side(finished.select("id", F.col("status").alias("_s"))), "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s").join(keyed_side(workflow), "run_id")
    newly = dead.join(keyed_side(tasks.select("id", "run_id", "task_name")), "id").join(keyed_side(workflow), "run_id")
    below = newly.select("run_id", "workflow", F.col("task_name").alias("name")).join(dag.descendants(dag.edges(steps)), ["workflow", "name"])
    first = below.groupBy("run_id", F.col("descendant").alias("task_name")).agg(F.min("name").alias("upstream"))
    hit = written(state.where(~F.col("status").isin(*V.TASK_TERMINAL)).join(keyed_side(first), ["run_id", "task_name"]).select("id", "run_id", "task_name", "attempt", "worker_id", "upstream"), "abandoned")
    reason = F.concat(F.lit("upstream task "), "upstream", F.lit(" did not succeed"))
    return {"tasks": hit.select("id", F.lit("DEAD").alias("status"))} | _dead(hit, reason, F.concat(reason, F.lit(": ")), now, AFTER)


def _policy_of(failed: DataFrame, workflow: DataFrame, steps: DataFrame) -> DataFrame:
    """failed with the retry policy of each task's own step; of a step without one, or that the workflow does not declare,
    the default."""
    own = dag.with_retry(steps).select("workflow", F.col("name").alias("task_name"), *V.DEFAULT_RETRY)
    j = failed.join(keyed_side(workflow), "run_id", "left").join(own, ["workflow", "task_name"], "left")
    there = F.col("max_attempts").isNotNull()
    return j.withColumns({k: F.when(there, F.col(k)).otherwise(F.lit(v)) for k, v in V.DEFAULT_RETRY.items()}).drop("workflow")


def complete_tasks(tasks: DataFrame, runs: DataFrame, workflow: DataFrame, steps: DataFrame, outcomes: DataFrame, now: Column, *, recorded: DataFrame | None = None) -> dict[str, DataFrame]:
    """outcomes (id, worker_id, attempt, output, error, permanent, duration_ms, seed, and artifacts, an array of name, sha256,
    size, content_type, if there are any) -> tasks, runs, dead_letters, artifacts, events, refused. error null is a success,
    which must be of a running task; a failure may be of a leased one too. A failure is retried by the policy of its step or
    is dead, and then so are the steps behind it; a success makes ready the steps that waited for it; a run whose tasks are
    all finished ends. workflow: run_id, workflow. recorded: the dead letters there are (task_id); none is written twice.
    tasks: rows as they are afterwards (id, status, TASK_STATE). artifacts: upserts by (run_id, task_name, name)."""
    held = tasks.where(F.col("status").isin(*V.TASK_HOLDS)).select("id", "worker_id", "attempt", "run_id", "task_name", F.col("status").alias("was"))
    kind = "array<struct<name:string,sha256:string,size:bigint,content_type:string>>"
    j = outcomes.withColumn("artifacts", _opt(outcomes, "artifacts", kind)).join(keyed_side(held), ["id", "worker_id", "attempt"], "left")
    ok = F.coalesce(F.col("error").isNull() & (F.col("was") == "RUNNING") | F.col("error").isNotNull() & F.col("was").isNotNull(), F.lit(False))
    j = written(j.withColumn("ok", ok), "outcomes")
    won, failed = j.where("ok and error is null"), j.where("ok and error is not null")
    fate = ops.after_failure(_policy_of(failed, workflow, steps), now, None).select("id", F.col("status").alias("fate"), "delay_ms", "scheduled_at", F.col("reason").alias("why"))
    failed = written(failed.join(keyed_side(fate), "id").withColumn("said", text.truncate_error(F.col("error"))), "failed")
    again, dead = failed.where("fate = 'RETRYING'"), failed.where("fate = 'DEAD'")
    over = _dead(dead, F.col("why"), F.concat_ws(": ", "why", "said"), now, OWN + 2)
    finished = won.select("id", F.lit("SUCCEEDED").alias("status")).unionByName(dead.select("id", F.lit("DEAD").alias("status")))
    behind = _abandoned(steps, tasks, finished, workflow, now)
    again = again.join(keyed_side(behind["tasks"]), "id", "left_anti")  # what lies behind a dead step is not tried again
    done = finished.unionByName(behind["tasks"])
    state = tasks.select("id", "run_id", "task_name", "status").join(keyed_side(done.select("id", F.col("status").alias("_s"))), "id", "left").withColumn("status", F.coalesce("_s", "status")).join(keyed_side(workflow), "run_id")
    near = dag.edges(steps).join(won.select("run_id", F.col("task_name").alias("parent")).join(keyed_side(workflow), "run_id"), ["workflow", "parent"]).select("run_id", F.col("child").alias("name")).distinct()
    free = dag.unlocked(steps, state).join(keyed_side(near), ["run_id", "name"], "left_semi").select("run_id", F.col("name").alias("task_name"))
    needs = steps.select("workflow", F.col("name").alias("task_name"), F.when(F.size("depends_on") > 0, F.col("depends_on")).alias("depends_on"))
    free = written(free.join(keyed_side(state.select("id", "run_id", "task_name", "workflow")), ["run_id", "task_name"]).join(needs, ["workflow", "task_name"]), "free")
    fates = _union(_fate(won, "won", output=F.col("output")), _fate(again, "again", run_at=F.col("scheduled_at"), said=F.col("said")), _fate(dead, "dead", said=F.col("said")), _fate(behind["tasks"], "behind"), _fate(free, "free"))
    changed = written(_task_rows(tasks, fates, now), "changed")
    end = _settled(tasks, changed, runs, now)
    found = won.select("run_id", "task_name", F.explode("artifacts").alias("a")).select("run_id", "task_name", "a.*")
    events = _union(
        _events(won, "TASK_SUCCEEDED", now, worker="worker_id", attempt=F.col("attempt"), duration_ms=F.col("duration_ms"), output=F.nullif("output", F.lit("")), artifacts=F.when(F.size("artifacts") > 0, F.col("artifacts"))),
        _events(failed, "TASK_FAILED", now, worker="worker_id", attempt=F.col("attempt"), duration_ms=F.col("duration_ms"), error=F.col("said"), retryable=F.col("fate") == "RETRYING"),
        _events(again, "TASK_RETRY_SCHEDULED", now, ord=OWN + 1, attempt=F.col("attempt"), next_attempt=F.col("attempt") + 1, delay_ms=F.col("delay_ms"), run_at=instant(F.col("scheduled_at"))),
        _events(free, "TASK_SCHEDULED", now, ord=AFTER, attempt=F.lit(0), scheduled_at=instant(now), depends_on=F.col("depends_on")),
        over["events"], behind["events"], end["events"],
    )
    letters = over["dead_letters"].unionByName(behind["dead_letters"])
    letters = letters if recorded is None else letters.join(recorded.select("task_id"), "task_id", "left_anti")
    return {"tasks": changed, "runs": end["runs"], "dead_letters": letters, "artifacts": found, "events": events, "refused": j.where("not ok").select("id", "worker_id", "attempt", F.lit("lease lost").alias("reason"))}


def expire_leases(tasks: DataFrame, runs: DataFrame, workflow: DataFrame, steps: DataFrame, now: Column, limit: int | None = 200) -> dict[str, DataFrame]:
    """What a sweep writes for the held tasks whose lease has run out: tasks (rows as they are afterwards), runs, dead_letters,
    events. With attempts left a task is ready again; without, it is dead, and so are the steps behind it. The tasks of a
    closed run die unrecorded."""
    late = ops.expired_leases(tasks, runs, now, limit).join(keyed_side(tasks.select("id", F.col("lease_expires_at").alias("until"))), "id")
    late = written(late, "late")
    told, back, dead = late.where("fate <> 'abandon'"), late.where("fate = 'requeue'"), late.where("fate = 'dead'")
    reason = F.lit("lease expired with no attempts remaining")
    over = _dead(dead, reason, reason, now, OWN + 1)
    behind = _abandoned(steps, tasks, dead.select("id", F.lit("DEAD").alias("status")), workflow, now)
    back = back.join(keyed_side(behind["tasks"]), "id", "left_anti")  # what lies behind a dead step is not tried again
    closed = late.where("fate = 'abandon'").join(keyed_side(behind["tasks"]), "id", "left_anti")
    closed_said = F.lit("run was no longer active when the lease expired")
    changed = written(_task_rows(tasks, _union(_fate(back, "back"), _fate(dead, "expired", said=reason), _fate(closed, "abandoned", said=closed_said), _fate(behind["tasks"], "behind")), now), "changed")
    end = _settled(tasks, changed, runs, now)
    events = _union(
        _events(told, "TASK_LEASE_EXPIRED", now, worker="worker_id", attempt=F.col("attempt"), lease_expired_at=instant(F.coalesce("until", now))),
        _events(back, "TASK_REQUEUED", now, ord=OWN + 1, attempt=F.col("attempt"), next_attempt=F.col("attempt") + 1, reason=F.lit("lease expired")),
        over["events"], behind["events"], end["events"],
    )
    return {"tasks": changed, "runs": end["runs"], "dead_letters": over["dead_letters"].unionByName(behind["dead_letters"]), "events": events}


def claim(tasks: DataFrame, now: Column, worker, limit: int, *, run_id=None, lease_ms: int = V.LEASE_MS) -> dict[str, DataFrame]:
    """The tasks that a worker takes (ops.claim), as rows of tasks and a TASK_LEASED each."""
    taken = written(ops.claim(tasks, now, worker, limit, run_id=run_id, lease_ms=lease_ms), "claimed")
    leased = _events(taken, "TASK_LEASED", now, worker="worker_id", attempt=F.col("attempt"), lease_expires_at=instant(F.col("lease_expires_at")))
    return {"tasks": taken.select("id", "status", "attempt", "worker_id", "lease_expires_at"), "events": leased}


def promote_retries(tasks: DataFrame, now: Column, limit: int | None = 100) -> dict[str, DataFrame]:
    """Retries that are due become ready and are announced under the attempt they had."""
    due = written(ops.due_retries(tasks, now, limit), "due")
    return {"tasks": due.select("id", "status"), "events": _events(due, "TASK_SCHEDULED", now, attempt=F.col("attempt"), scheduled_at=instant(now))}


def cancel_runs(runs: DataFrame, tasks: DataFrame, asked: DataFrame, now: Column) -> dict[str, DataFrame]:
    """asked (run_id, reason) -> runs, tasks, events, refused. Unstarted tasks of an open run die, with `run cancelled` for
    their error unless they have one; leases in flight end now, so that their workers learn of it. A closed run is refused."""
    j = asked.join(runs.select(F.col("id").alias("run_id"), F.col("status").alias("was")), "run_id", "left")
    good, reason = j.where(~F.col("was").isin(*V.RUN_TERMINAL)), F.nullif("reason", F.lit(""))
    mine = tasks.join(good.select("run_id"), "run_id", "left_semi").where(~F.col("status").isin(*V.TASK_TERMINAL, "FAILED"))
    holds = F.col("status").isin(*V.TASK_HOLDS)
    keep = lambda n, new: F.when(holds, _opt(tasks, n, TASK_STATE[n])).otherwise(new).alias(n)
    none = lambda n: _null(tasks, n)
    changed = mine.select(
        "id", F.when(holds, F.col("status")).otherwise("DEAD").alias("status"), keep("worker_id", none("worker_id")), F.when(holds, now).alias("lease_expires_at"),
        keep("completed_at", now), keep("error", F.coalesce(_opt(tasks, "error", "string"), F.lit("run cancelled"))),
    )
    refused = j.where(F.col("was").isNull() | F.col("was").isin(*V.RUN_TERMINAL))
    return {
        "runs": good.select(F.col("run_id").alias("id"), F.lit("CANCELLED").alias("status"), now.alias("completed_at"), reason.alias("failure_reason")),
        "tasks": changed, "events": _events(good, "RUN_CANCELLED", now, ord=LAST, task=False, reason=reason),
        "refused": refused.select("run_id", F.coalesce(F.concat(F.lit("run is finished: "), "was"), F.lit("no such run")).alias("reason")),
    }


def retire_workers(workers: DataFrame, tasks: DataFrame, runs: DataFrame, asked: DataFrame, now: Column) -> dict[str, DataFrame]:
    """asked (id) -> workers, tasks, events. Healthy and suspect workers stop and their leases end now; each open run in which
    one held a lease is told so, with the number of leases it held in all."""
    gone = workers.where("status in ('HEALTHY', 'SUSPECT')").join(asked.select("id").distinct(), "id", "left_semi").select("id", F.lit("STOPPED").alias("status"))
    held = tasks.where(F.col("status").isin(*V.TASK_HOLDS)).join(gone.select(F.col("id").alias("worker_id")), "worker_id", "left_semi")
    released = held.groupBy("worker_id").agg(F.count("*").cast("int").alias("n"))
    open_ = runs.where("completed_at is null").select(F.col("id").alias("run_id"))
    told = held.select("run_id", "worker_id").distinct().join(open_, "run_id", "left_semi").join(released, "worker_id")
    return {
        "workers": gone, "tasks": held.select("id", now.alias("lease_expires_at")),
        "events": _events(told, "WORKER_LOST", now, task=False, worker="worker_id", missed_beats=F.lit(V.LOST_AFTER), leases_released=F.col("n")),
    }


def skip_effects(asked: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """SIDE_EFFECT_SKIPPED events for repeats that the ledger suppressed. asked: task_id, run_id, task_name, attempt, key;
    the first attempt is the least recorded one of the task, 0 if there is none."""
    first = attempts.groupBy("task_id").agg(F.min("attempt").alias("first_attempt"))
    j = asked.join(first, "task_id", "left")
    return _events(j, "SIDE_EFFECT_SKIPPED", now, idempotency_key=F.col("key"), attempt=F.col("attempt"), first_attempt=F.coalesce("first_attempt", F.lit(0)))


def register_workers(asked: DataFrame, now: Column) -> DataFrame:
    """Rows of new workers (asked: id, hostname, version, capacity): healthy and idle; a capacity below 1 is 1."""
    return asked.select("id", "hostname", "version", F.lit("HEALTHY").alias("status"), F.greatest(F.coalesce("capacity", F.lit(1)), F.lit(1)).alias("capacity"), F.lit(0).alias("active_tasks"), now.alias("last_heartbeat"), now.alias("registered_at"))


def hydrate(claimed: DataFrame, workflow: DataFrame, steps: DataFrame, outputs: DataFrame, timeout_ms: int = V.TIMEOUT_MS) -> DataFrame:
    """claimed (id, run_id, task_name, ...) with workflow, handler, timeout_ms and inputs (a map from dependency to output,
    null where it gave none); problem says that the workflow does not declare the step. outputs: run_id, task_name, output."""
    s = steps.select("workflow", F.col("name").alias("task_name"), "handler", "depends_on", F.col("timeout_ms").alias("own_ms"))
    j = claimed.join(workflow, "run_id").join(s, ["workflow", "task_name"], "left")
    needs = j.select("id", "run_id", F.explode("depends_on").alias("d")).join(outputs.select("run_id", F.col("task_name").alias("d"), "output"), ["run_id", "d"], "left")
    inputs = needs.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("d", "output")))).alias("inputs"))
    took = F.when(F.coalesce("own_ms", F.lit(0)) > 0, F.col("own_ms")).otherwise(F.lit(timeout_ms).cast("long"))
    problem = F.when(F.col("handler").isNull(), F.concat(F.lit("the workflow does not declare the step "), "task_name"))
    return j.join(inputs, "id", "left").select(*claimed.columns, "workflow", "handler", took.alias("timeout_ms"), F.coalesce("inputs", F.expr("cast(map() as map<string,string>)")).alias("inputs"), problem.alias("problem"))


def look_up_scenarios(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (name, hash) with found: whether known (name, hash) has the scenario, under that hash if one is asked for."""
    by_hash = known.select("name", "hash").distinct().withColumn("_same", F.lit(True))
    by_name = known.select("name").distinct().withColumn("_there", F.lit(True))
    any_hash = F.coalesce("hash", F.lit("")) == ""
    j = asked.join(by_name, "name", "left").join(by_hash, ["name", "hash"], "left")
    return j.select(*asked.columns, F.coalesce(F.when(any_hash, F.col("_there")).otherwise(F.col("_same")), F.lit(False)).alias("found"))
