"""Operational queries and state changes, as pure functions of a snapshot and a literal `now`. A state change returns the
rows it would write; the caller appends them in one write. Comparisons with now are inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import draws, text
from ..functions.time import micros, ms_between, plus_ms
from ..sources.storage import keyed_side
from .order import numbered


# Lists and pages ----------------------------------------------------------------------------------------------------


def page_limit(asked, fallback: int = V.DEFAULT_PAGE, most: int = V.MAX_PAGE) -> int:
    """A page size from user input: garbage and non-positive give the fallback, large ones the maximum."""
    try:
        n = int(asked)
    except (TypeError, ValueError):
        return fallback
    return min(n, most) if n > 0 else fallback


def int_param(asked, fallback: int = 0) -> int:
    try:
        n = int(asked)
    except (TypeError, ValueError):
        return fallback
    return n if n >= 0 else fallback


def list_runs(runs: DataFrame, workflows: DataFrame, *, status: str = "", workflow: str = "", limit: int = V.DEFAULT_RUNS) -> DataFrame:
    """Newest first, ties by id; absent filters fold away. Top-k is taken before the join unless a workflow is asked for."""
    w = workflows.select(F.col("id").alias("workflow_id"), F.col("name").alias("workflow"), F.col("version").alias("workflow_version"))
    out = runs.where(F.col("status") == status.upper()) if status else runs
    order = [F.desc("created_at"), F.desc("id")]
    if workflow:
        out = out.join(w.where(F.col("workflow") == workflow), "workflow_id")
        return out.orderBy(*order).limit(limit)
    return out.orderBy(*order).limit(limit).join(w, "workflow_id").orderBy(*order)


def run_by_id(runs: DataFrame, workflows: DataFrame, run_id) -> DataFrame:
    return list_runs(runs.where(F.col("id") == run_id), workflows, limit=1)


def keyset_page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The rows after a key, in its order, up to limit, each with has_more: whether a further row exists. One row more is
    read; nothing is counted."""
    some = (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit + 1)
    numbered = some.withColumn("_n", F.row_number().over(Window.orderBy(key)))  # limit + 1 rows
    return numbered.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def latest_version(workflows: DataFrame) -> DataFrame:
    """The highest version of each name."""
    cols = [c for c in workflows.columns if c != "name"]
    return workflows.groupBy("name").agg(F.max_by(F.struct(*cols), "version").alias("w")).select("name", "w.*")


def list_workflows(workflows: DataFrame, limit: int = 100) -> DataFrame:
    return workflows.orderBy("name", F.desc("version")).limit(limit)


def list_workers(workers: DataFrame) -> DataFrame:
    """Most recently seen first, with load as active/capacity."""
    return workers.withColumn("load", F.concat_ws("/", F.col("active_tasks").cast("string"), F.col("capacity").cast("string"))).orderBy(F.desc("last_heartbeat"), "id")


def stats(runs: DataFrame, tasks: DataFrame, workers: DataFrame) -> DataFrame:
    """what, status, n: rows by status of each table, and the depth of the queue."""
    by = lambda df, what: df.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "status", "n")
    depth = tasks.agg(F.count_if(F.col("status").isin("READY", "RETRYING")).alias("n")).select(F.lit("queue").alias("what"), F.lit("depth").alias("status"), "n")
    return by(runs, "runs").unionByName(by(tasks, "tasks")).unionByName(by(workers, "workers")).unionByName(depth)


def progress(tasks: DataFrame, now: Column) -> DataFrame:
    """Counts by run of where its tasks stand, and stalled: some are unfinished and none can move."""
    s, due = F.col("status"), F.col("scheduled_at") <= now
    out = tasks.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if(s == "SUCCEEDED").alias("succeeded"), F.count_if(s == "DEAD").alias("dead"), F.count_if((s == "READY") & due).alias("runnable"),
        F.count_if(s.isin(*V.TASK_HOLDS)).alias("in_flight"), F.count_if((s == "RETRYING") | ((s == "READY") & ~due)).alias("waiting"),
    )
    return out.withColumn("stalled", (F.col("succeeded") + F.col("dead") < F.col("total")) & (F.col("runnable") + F.col("in_flight") + F.col("waiting") == 0))


def settle(tasks: DataFrame) -> DataFrame:
    """run_id, closes_as: runs all of whose tasks are finished; a dead task fails the run."""
    out = tasks.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "SUCCEEDED").alias("ok"), F.count_if(F.col("status") == "DEAD").alias("dead"))
    return out.where("ok + dead = n").select("run_id", F.when(F.col("dead") > 0, "FAILED").otherwise("SUCCEEDED").alias("closes_as"), "dead")


def headline_run(runs: DataFrame) -> DataFrame:
    """The run to show first: one with a scenario that succeeded, else one with a scenario, else the newest."""
    rank = F.when(F.col("scenario_name").isNotNull() & (F.col("status") == "SUCCEEDED"), 0).when(F.col("scenario_name").isNotNull(), 1).otherwise(2)
    return runs.orderBy(rank, F.desc("created_at"), F.desc("id")).limit(1)


def tally(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def succeeded_tasks(tasks: DataFrame) -> DataFrame:
    """run_id, done: sorted names of a run's succeeded tasks, joined by commas."""
    return tasks.where("status = 'SUCCEEDED'").groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_set("task_name")), ",").alias("done"))


# Sweeps ---------------------------------------------------------------------------------------------------------------


def claim(tasks: DataFrame, now: Column, worker, limit: int, *, run_id=None, lease_ms: int = V.LEASE_MS) -> DataFrame:
    """The tasks a worker would take: ready, due, earliest first, one attempt more and leased from now."""
    ready = tasks.where((F.col("status") == "READY") & (F.col("scheduled_at") <= now))
    ready = ready if run_id is None else ready.where(F.col("run_id") == run_id)
    top = ready.orderBy("scheduled_at", "id").limit(limit)
    return top.select("id", "run_id", "task_name", (F.col("attempt") + 1).alias("attempt"), F.lit("LEASED").alias("status"), F.lit(worker).alias("worker_id"), plus_ms(now, lease_ms).alias("lease_expires_at"))


def assign(tasks: DataFrame, workers: DataFrame, now: Column) -> DataFrame:
    """Ready tasks dealt to healthy workers with free slots, earliest task to first slot: both sides are numbered by ranges
    and met by number. Slots are as many as the workers' free capacity."""
    free = workers.where("status = 'HEALTHY' and capacity > active_tasks")
    n_slots = free.agg(F.sum(F.col("capacity") - F.col("active_tasks"))).first()[0] or 0
    slots = free.select(F.col("id").alias("worker_id"), F.explode(F.sequence(F.lit(1), F.col("capacity") - F.col("active_tasks"))).alias("slot"))
    ready = tasks.where((F.col("status") == "READY") & (F.col("scheduled_at") <= now)).select("id", "run_id", "task_name", "scheduled_at")
    ready = numbered(ready, [F.col("scheduled_at"), F.col("id")], {}, "ready").where(F.col("pos") < n_slots)
    return ready.join(numbered(slots, [F.col("slot"), F.col("worker_id")], {}, "slots"), "pos").select("id", "run_id", "task_name", "worker_id")


def expired_leases(tasks: DataFrame, runs: DataFrame, now: Column, limit: int | None = 200) -> DataFrame:
    """Held tasks whose lease has run out and what becomes of each: abandoned (its run is closed), requeue (attempts left)
    or dead. The batch limit is a sweep's; None sweeps all."""
    late = tasks.where(F.col("status").isin(*V.TASK_HOLDS) & (F.col("lease_expires_at") <= now))
    late = late if limit is None else late.orderBy("lease_expires_at", "id").limit(limit)
    closed = runs.where(F.col("status").isin(*V.RUN_TERMINAL)).select(F.col("id").alias("run_id"), F.lit(True).alias("closed"))
    fate = F.when(F.col("closed"), "abandon").when(F.col("attempt") < F.col("max_attempts"), "requeue").otherwise("dead")
    return late.join(keyed_side(closed), "run_id", "left").select("id", "run_id", "task_name", "attempt", "worker_id", fate.alias("fate"))


def liveness(workers: DataFrame, now: Column, *, beat_ms: int = V.BEAT_MS, suspect: int = V.SUSPECT_AFTER, lost: int = V.LOST_AFTER) -> DataFrame:
    """id, status, new_status of workers whose silence changes their status."""
    silent = ms_between(F.col("last_heartbeat"), now)
    new = F.when(F.col("status").isin("HEALTHY", "SUSPECT") & (silent >= beat_ms * lost), "LOST").when((F.col("status") == "HEALTHY") & (silent >= beat_ms * suspect), "SUSPECT")
    return workers.withColumn("new_status", new).where("new_status is not null").select("id", "status", "new_status")


def lost_announcements(tasks: DataFrame, runs: DataFrame, lost: DataFrame) -> DataFrame:
    """run_id, worker_id, leases_released: a WORKER_LOST for each open run in which a lost worker (id) holds a lease."""
    held = tasks.where(F.col("status").isin(*V.TASK_HOLDS)).join(lost.select(F.col("id").alias("worker_id")), "worker_id")
    open_ = runs.where(~F.col("status").isin(*V.RUN_TERMINAL)).select(F.col("id").alias("run_id"))
    return held.join(open_, "run_id").groupBy("run_id", "worker_id").agg(F.count("*").alias("leases_released"))


def due_retries(tasks: DataFrame, now: Column, limit: int | None = 100) -> DataFrame:
    due = tasks.where((F.col("status") == "RETRYING") & (F.col("scheduled_at") <= now))
    due = due if limit is None else due.orderBy("scheduled_at", "id").limit(limit)
    return due.select("id", "run_id", "task_name", "attempt", F.lit("READY").alias("status"))


def renew(tasks: DataFrame, asked: DataFrame, now: Column, lease_ms: int = V.LEASE_MS) -> DataFrame:
    """Of the leases asked for (id, worker_id): those still held by that worker, with their new deadline."""
    held = tasks.where(F.col("status").isin(*V.TASK_HOLDS))
    return held.join(asked, ["id", "worker_id"], "left_semi").select("id", "worker_id", plus_ms(now, lease_ms).alias("lease_expires_at"))


def lost_leases(tasks: DataFrame, asked: DataFrame) -> DataFrame:
    """The leases asked for that are no longer held."""
    return asked.join(tasks.where(F.col("status").isin(*V.TASK_HOLDS)), ["id", "worker_id"], "left_anti")


def compare_and_set(tasks: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id, worker_id, attempt, status) with ok: whether the current row still matches on all of them."""
    now_ = tasks.select("id", "worker_id", "attempt", "status", F.lit(True).alias("ok"))
    return asked.join(now_, ["id", "worker_id", "attempt", "status"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def first_recorded(ledger: DataFrame) -> DataFrame:
    """Of effects under one key the first recorded wins; the others are suppressed: idempotency_key, first_attempt,
    suppressed."""
    order = F.struct("created_at", "attempt")
    return ledger.groupBy("idempotency_key").agg(F.min_by("attempt", order).alias("first_attempt"), (F.count("*") - 1).alias("suppressed"))


# Outcomes and lifecycle -----------------------------------------------------------------------------------------------


def after_failure(failed: DataFrame, now: Column, policy: dict | None = V.DEFAULT_RETRY) -> DataFrame:
    """failed (id, run_id, task_name, attempt, permanent, seed) -> status (RETRYING or DEAD), delay_ms, scheduled_at, reason.
    A permanent failure, or one without attempts left, is dead. policy None: failed has a policy's columns."""
    of = F.col if policy is None else lambda k: F.lit(policy[k])
    again = draws.should_retry(F.col("attempt"), of("max_attempts"), F.col("permanent"))
    u = draws.uniform(F.col("seed"), F.col("run_id"), F.lit("retry"), F.col("task_name"), F.col("attempt"))
    wait = draws.backoff_ms(F.col("attempt"), of("initial_delay_ms"), of("multiplier"), of("max_delay_ms"), of("jitter"), u)
    out = failed.withColumn("delay_ms", F.when(again, wait))
    return out.select("id", "run_id", "task_name", "attempt", F.when(again, "RETRYING").otherwise("DEAD").alias("status"), "delay_ms", F.when(again, plus_ms(now, F.col("delay_ms"))).alias("scheduled_at"),
                      F.when(~again, F.when(F.col("permanent"), "permanent failure").otherwise("attempts exhausted")).alias("reason"))


def dead_letters(dead: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to insert for dead tasks that have none yet; attempts count at least 1."""
    return dead.join(existing.select("task_id"), dead["id"] == existing["task_id"], "left_anti").select(F.col("id").alias("task_id"), "run_id", F.greatest(F.col("attempt"), F.lit(1)).alias("attempts"))


def cancel(runs: DataFrame, tasks: DataFrame, run_ids: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """Open runs become cancelled at now; their unstarted tasks die and leases in flight end now."""
    hit = runs.where(run_ids & ~F.col("status").isin(*V.RUN_TERMINAL))
    closed = hit.select("id", F.lit("CANCELLED").alias("status"), now.alias("completed_at"))
    mine = tasks.join(hit.select(F.col("id").alias("run_id")), "run_id", "left_semi").where(~F.col("status").isin(*V.TASK_TERMINAL))
    holds = F.col("status").isin(*V.TASK_HOLDS)
    return closed, mine.select("id", "run_id", "task_name", F.when(holds, F.col("status")).otherwise("DEAD").alias("status"), F.when(holds, now).alias("lease_expires_at"))


def retire(workers: DataFrame, tasks: DataFrame, worker_ids: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """Workers stop; the leases they hold end now."""
    gone = workers.where(worker_ids).select("id", F.lit("STOPPED").alias("status"))
    held = tasks.where(F.col("status").isin(*V.TASK_HOLDS)).join(gone.select(F.col("id").alias("worker_id")), "worker_id", "left_semi")
    return gone, held.select("id", "worker_id", now.alias("lease_expires_at"))


def heartbeat(workers: DataFrame, beats: DataFrame) -> DataFrame:
    """Last beat of each worker (beats: id, at); lost and stopped workers are refused."""
    last = beats.groupBy("id").agg(F.max("at").alias("at"))
    return workers.join(last, "id").select("id", "status", F.when(F.col("status").isin("LOST", "STOPPED"), F.col("last_heartbeat")).otherwise(F.greatest("last_heartbeat", "at")).alias("last_heartbeat"), (~F.col("status").isin("LOST", "STOPPED")).alias("accepted"))


def register_workflows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (name, version, definition_hash) with outcome: inserted, unchanged, or conflict for another hash."""
    old = existing.select("name", "version", F.col("definition_hash").alias("_h"))
    return incoming.join(old, ["name", "version"], "left").withColumn("outcome", F.when(F.col("_h").isNull(), "inserted").when(F.col("_h") == F.col("definition_hash"), "unchanged").otherwise("conflict")).drop("_h")


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """Upsert by (run_id, task_name, name): the newest row of each key."""
    keys = ["run_id", "task_name", "name"]
    rest = [c for c in artifacts.columns if c not in keys]
    return artifacts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("created_at", "sha256")).alias("v")).select(*keys, "v.*")


def is_terminal() -> Column:
    return F.col("type").isin(*V.TERMINAL_TYPES)


def number_after(new: DataFrame, state: DataFrame) -> DataFrame:
    """new (run_id, ord, type, ...) with seq, numbered on from each run's last (state: run_id, last, ended), and refused: the
    run has ended before, by its state or by an event of new. Events of one ord lie by task, type and payload. What is
    refused comes after all that is not, so no number is lost. Rows without a type end no run. last and ended: the state's."""
    j = new.join(state.select("run_id", "last", "ended"), "run_id", "left").fillna({"last": 0, "ended": False})
    ties = [c for c in ("task_name", "type", "payload") if c in new.columns]
    order = Window.partitionBy("run_id").orderBy("ord", *ties)
    ends = is_terminal() if "type" in new.columns else F.lit(False)
    closed = F.coalesce(F.bool_or(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return j.withColumns({"seq": F.col("last") + F.row_number().over(order), "refused": F.col("ended") | closed})


def append_events(journal: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """new (run_id, ord, type, ...) numbered on from each run's last seq, and those refused because their run has ended.
    One writer only; streaming.append is the form for a stream, and survives being run again."""
    last = journal.groupBy("run_id").agg(F.max("seq").alias("last"), F.bool_or(is_terminal()).alias("ended"))
    j = number_after(new, last)
    return j.where("not refused").drop("last", "ended", "ord", "refused"), j.where("refused").drop("last", "ended", "seq", "refused")


def rate_limited(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """requests (client, at, n) with allowed, by a token bucket of each client: refilled by rate a second up to burst, one
    taken by an allowed request. What is allowed depends on all before, so a client's requests stream through one task in
    order; the level and the time of the last are carried from batch to batch, and nothing else is held."""
    import pyarrow as pa

    def run(batches):
        now, left, last = None, burst, None
        for b in batches:
            ok = []
            for client, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if last is None or client != now:
                    now, left = client, burst
                else:
                    left = min(burst, left + rate * (at - last) / 1e6)
                last = at
                ok.append(left >= 1)
                left -= left >= 1
            yield b.append_column("allowed", pa.array(ok, pa.bool_()))

    timed = requests.select(F.col("client").cast("long").alias("client"), micros(F.col("at")).alias("at"), F.col("n").cast("long").alias("n"))
    return timed.repartition("client").sortWithinPartitions("client", "at", "n").mapInArrow(run, "client long, at long, n long, allowed boolean")


def run_summary(runs: DataFrame) -> DataFrame:
    """id, line: short id, status and duration of a run, as a list shows it."""
    from ..functions.time import human_duration

    return runs.select("id", F.concat_ws(" ", text.short_id(F.col("id").cast("string")), "status", F.coalesce(human_duration(F.col("created_at"), F.col("completed_at")), F.lit("running"))).alias("line"))
