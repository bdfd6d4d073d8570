"""Queries of the state changes: what batches of requests write over the projected tables, and the tables after it. Every run's
workflow is a line of seven steps, each of which needs the one before; the second and the fifth have retry policies of their
own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import at
from ..operators import changes, dag
from ..sources import keyed
from ..sources import projections as P
from ..sources.storage import new_path, written
from . import registry
from .ops_queries import _UR, query

T = f"TIMESTAMP '{P.NOW}'"
NOW_SAID = P.NOW.replace(" ", "T") + "Z"


def _said(ts: str) -> str:
    """DuckDB: a timestamp as a payload writes it."""
    return f"(regexp_replace(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z')"


EVENT = ("run_id", "ord", "type", "task_name", "payload")


def _now():
    return at(P.NOW)


def _t(spark, sf_dir, *names):
    return [P.table(spark, sf_dir, n) for n in names]


def _kept(spark, sf_dir):
    """tasks and runs as the tables that a change reads many times."""
    return [written(t, "table") for t in _t(spark, sf_dir, "tasks", "runs")]


def _steps(spark, most: int = 7):
    own = {2: (2, 500, 3.0, 4_000, 0.5), 5: (1, 100, 1.0, 100, 0.0)}
    rows = [("line", n, f"t{n}", f"h{n}", [f"t{n - 1}"] if n > 1 else [], *own.get(n, (None,) * 5), 0 if n % 2 else 1000 * n) for n in range(1, most + 1)]
    return spark.createDataFrame(rows, dag.STEPS)


def _line(runs):
    return runs.select(F.col("id").alias("run_id"), F.lit("line").alias("workflow"))


@query(
    """SELECT id AS run_id, 0::BIGINT AS ord, 'RUN_CREATED' AS type, NULL::VARCHAR AS task_name, '{"v":1,"workflow_name":"line","workflow_version":1,"definition_hash":"h"' || CASE WHEN scenario_name IS NULL THEN '' ELSE ',"scenario_name":"' || scenario_name || '"' END || ',"scenario_hash":"s' || id || '","seed":' || seed || ',"correlation_id":"c"}' AS payload FROM runs WHERE id % 7 <> 0
UNION ALL SELECT id, 1, 'TASK_SCHEDULED', 't1', '{"v":1,"attempt":0,"scheduled_at":"NOW_SAID"}' FROM runs WHERE id % 7 <> 0 UNION ALL SELECT id, 1000000, 'RUN_QUEUED', NULL, '{"v":1,"task_count":7}' FROM runs WHERE id % 7 <> 0""".replace("NOW_SAID", NOW_SAID),
    "runs",
)
def m02_create_runs(spark, sf_dir):
    (runs,) = _t(spark, sf_dir, "runs")
    asked = runs.select(F.col("id").alias("run_id"), "workflow_id", F.lit("line").alias("workflow"), F.lit(1).alias("version"), F.when(F.col("id") % 7 == 0, "x").otherwise("h").alias("definition_hash"), F.lit("h").alias("registered_hash"), "scenario_name", "seed", F.concat(F.lit("s"), F.col("id").cast("string")).alias("scenario_hash"), F.lit("c").alias("correlation_id"))
    return changes.create_runs(asked, _steps(spark), _now())["events"].select(*EVENT)


_ASKED = "a AS (SELECT id, run_id, task_name, worker_id, attempt, id % 3 = 0 AS lost, id % 5 = 0 AS tried FROM tasks WHERE status = 'LEASED')"


def _started(spark, sf_dir):
    tasks, runs = _t(spark, sf_dir, "tasks", "runs")
    held = tasks.where("status = 'LEASED'")
    asked = held.select("id", "worker_id", (F.col("attempt") + F.when(F.col("id") % 3 == 0, 1).otherwise(0)).alias("attempt"), F.lit("h").alias("handler"))
    return changes.start_tasks(tasks, runs, held.where("id % 5 = 0").select(F.col("id").alias("task_id"), "attempt"), asked, _now())


@query(
    f"""WITH {_ASKED}, g AS (SELECT * FROM a WHERE NOT lost AND NOT tried) SELECT run_id, 0::BIGINT AS ord, 'TASK_STARTED' AS type, task_name, '{{"v":1,"attempt":' || attempt || ',"handler":"h"}}' AS payload FROM g
UNION ALL SELECT DISTINCT run_id, 1000000, 'RUN_STARTED', NULL, '{{"v":1}}' FROM g JOIN runs r ON r.id = g.run_id WHERE r.status = 'QUEUED'""",
    "tasks", "runs",
)
def m04_start_tasks(spark, sf_dir):
    return _started(spark, sf_dir)["events"].select(*EVENT)


@query(f"WITH {_ASKED} SELECT id, CASE WHEN lost THEN 'lease lost' ELSE 'attempt is started already' END AS reason FROM a WHERE lost OR tried", "tasks")
def m04_refused_starts(spark, sf_dir):
    return _started(spark, sf_dir)["refused"].select("id", "reason")


@query("SELECT DISTINCT t.run_id AS id, 'RUNNING' AS status FROM tasks t JOIN runs r ON r.id = t.run_id WHERE t.status = 'LEASED' AND t.id % 3 <> 0 AND t.id % 5 <> 0 AND r.status = 'QUEUED'", "tasks", "runs")
def m05_runs_started(spark, sf_dir):
    return _started(spark, sf_dir)["runs"].select("id", "status")


_LINE = "CAST(substr(task_name, 2) AS INT)"
_DONE = f"""h AS (SELECT *, {_LINE} AS line, id % 4 = 0 AS bad FROM tasks), f AS (SELECT *, CASE WHEN status NOT IN ('LEASED', 'RUNNING') THEN NULL WHEN NOT bad AND status = 'RUNNING' THEN 'won' WHEN NOT bad THEN 'refused' WHEN id % 8 = 0 OR attempt >= CASE line WHEN 2 THEN 2 WHEN 5 THEN 1 ELSE 3 END THEN 'dead' ELSE 'again' END AS fate FROM h),
b AS (SELECT f.id, min(d.task_name) AS upstream FROM f JOIN f d ON d.run_id = f.run_id AND d.line < f.line AND d.fate = 'dead' WHERE f.status NOT IN ('SUCCEEDED', 'DEAD') AND coalesce(f.fate, '') NOT IN ('won', 'dead') GROUP BY f.id),
n AS (SELECT f.*, b.upstream, CASE WHEN fate = 'won' THEN 'SUCCEEDED' WHEN fate = 'dead' OR b.id IS NOT NULL THEN 'DEAD' WHEN fate = 'again' THEN 'RETRYING'
  WHEN status = 'PENDING' AND EXISTS (SELECT 1 FROM f p WHERE p.run_id = f.run_id AND p.line = f.line - 1 AND p.fate = 'won') THEN 'READY' END AS new FROM f LEFT JOIN b ON b.id = f.id)"""


#: The wait of a retry by its step's policy, and of the named table's rows what a batch leaves.
_WAIT = f"""floor(greatest(0.0::DOUBLE, CASE line WHEN 2 THEN least(500.0::DOUBLE * pow(3.0::DOUBLE, greatest(attempt, 1) - 1), 4000.0::DOUBLE) * (1 + 0.5::DOUBLE * (2 * {_UR} - 1))
 ELSE least(1000.0::DOUBLE * pow(2.0::DOUBLE, greatest(attempt, 1) - 1), 30000.0::DOUBLE) * (1 + 0.2::DOUBLE * (2 * {_UR} - 1)) END))::BIGINT"""
_AFTER = f"""w AS (SELECT *, {_WAIT} AS wait FROM n),
after AS (SELECT id, coalesce(new, status) AS status, CASE WHEN new IN ('DEAD', 'RETRYING') THEN NULL ELSE worker_id END AS worker_id, CASE WHEN new IS NULL OR new = 'READY' THEN lease_expires_at END AS lease_expires_at,
 CASE new WHEN 'RETRYING' THEN {T} + to_milliseconds(wait) WHEN 'READY' THEN {T} ELSE scheduled_at END AS scheduled_at, CASE WHEN new IN ('SUCCEEDED', 'DEAD') THEN {T} END AS completed_at,
 CASE WHEN new = 'SUCCEEDED' THEN NULL WHEN upstream IS NULL AND fate IN ('again', 'dead') THEN 'boom' ELSE error END AS error, CASE WHEN new = 'SUCCEEDED' THEN '{{}}' END AS output_ref, new FROM w)"""


def _completed(spark, sf_dir, kept=None):
    tasks, runs = kept or _kept(spark, sf_dir)
    bad = F.col("id") % 4 == 0
    outcomes = tasks.where("status in ('LEASED', 'RUNNING')").select("id", "worker_id", "attempt", F.when(~bad, "{}").alias("output"), F.when(bad, "boom").alias("error"), (F.col("id") % 8 == 0).alias("permanent"), F.lit(9).alias("duration_ms"), (F.col("run_id") % 97).alias("seed"), F.when(F.col("id") % 5 == 0, F.array(F.struct(F.lit("log").alias("name"), F.md5(F.col("id").cast("string")).alias("sha256"), F.lit(3).cast("long").alias("size"), F.lit("text/plain").alias("content_type")))).alias("artifacts"))
    return changes.complete_tasks(tasks, runs, _line(runs), _steps(spark), outcomes, _now())


@query(f"WITH {_DONE}, {_AFTER} SELECT * EXCLUDE (new) FROM after WHERE new IS NOT NULL", "tasks")
def m06_complete_tasks(spark, sf_dir):
    return _completed(spark, sf_dir)["tasks"]


def _applied(spark, df, keys, changes_, **how):
    """df as a table with the changes merged into it, twice, which is as once."""
    path = new_path(spark, "keyed")
    keyed.create(df, path, keys, 16)
    for _ in range(2):
        keyed.apply(spark, path, changes_, **how)
    return keyed.read(spark, path)


@query(f"WITH {_DONE}, {_AFTER} SELECT t.id, t.run_id, t.task_name, t.attempt, a.* EXCLUDE (id, new) FROM tasks t JOIN after a ON a.id = t.id", "tasks")
def m06_tasks_after(spark, sf_dir):
    """The whole table of tasks after the batch of outcomes."""
    tasks, runs = _kept(spark, sf_dir)
    whole = tasks.select("id", "run_id", "task_name", "attempt", "status", "worker_id", "lease_expires_at", "scheduled_at", F.lit(None).cast("timestamp_ntz").alias("completed_at"), "error", F.lit(None).cast("string").alias("output_ref"))
    return _applied(spark, whole, ["id"], _completed(spark, sf_dir, (tasks, runs))["tasks"])


@query(
    f"""WITH {_DONE}, c AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE coalesce(new, status) = 'DEAD') AS dead, count(*) FILTER (WHERE coalesce(new, status) = 'SUCCEEDED') AS ok, bool_or(new IS NOT NULL) AS touched FROM n GROUP BY run_id)
SELECT r.id, CASE WHEN hit THEN CASE WHEN dead > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END ELSE r.status END AS status, CASE WHEN hit THEN {T} ELSE completed_at END AS completed_at, CASE WHEN hit AND dead > 0 THEN dead || ' of ' || n || ' tasks did not succeed' END AS failure_reason
FROM runs r LEFT JOIN (SELECT *, true AS hit FROM c WHERE touched AND ok + dead = n) c ON c.run_id = r.id AND r.status IN ('QUEUED', 'RUNNING')""",
    "tasks", "runs",
)
def m07_runs_after(spark, sf_dir):
    """The whole table of runs after the batch of outcomes."""
    tasks, runs = _kept(spark, sf_dir)
    return _applied(spark, runs.select("id", "status", "completed_at", F.lit(None).cast("string").alias("failure_reason")), ["id"], _completed(spark, sf_dir, (tasks, runs))["runs"])


@query(
    f"""WITH {_DONE} SELECT id AS task_id, CASE WHEN id % 10 = 4 THEN 'known' WHEN fate = 'dead' THEN CASE WHEN id % 8 = 0 THEN 'permanent failure' ELSE 'attempts exhausted' END ELSE 'upstream task ' || upstream || ' did not succeed' END AS reason, greatest(attempt, 1)::INT AS attempts, worker_id AS last_worker FROM n WHERE new = 'DEAD' AND id % 10 <> 4
UNION ALL SELECT id, 'known', 7, NULL FROM tasks WHERE id % 10 = 4""",
    "tasks",
)
def m10_dead_letters_after(spark, sf_dir):
    """Dead letters are written once: those that are there stay."""
    tasks, runs = _kept(spark, sf_dir)
    known = tasks.where("id % 10 = 4").select(F.col("id").alias("task_id"), F.lit("known").alias("reason"), F.lit(7).alias("attempts"), F.lit(None).cast("long").alias("last_worker"))
    new = _completed(spark, sf_dir, (tasks, runs))["dead_letters"].select(*known.columns)
    return _applied(spark, known, ["task_id"], new, update=False, insert=True)


@query(f"WITH {_DONE} SELECT run_id, task_name, 'log' AS name, md5(id::VARCHAR) AS sha256, 3::BIGINT AS size, 'text/plain' AS content_type FROM n WHERE fate = 'won' AND id % 5 = 0 UNION ALL SELECT run_id, task_name, 'log', 'old', 1, 'x' FROM n WHERE NOT (coalesce(fate, '') = 'won' AND id % 5 = 0) AND id % 3 = 0", "tasks")
def m12_artifacts_after(spark, sf_dir):
    """Artifacts of finished tasks, over those there were before."""
    tasks, runs = _kept(spark, sf_dir)
    before = tasks.where("id % 3 = 0").select("run_id", "task_name", F.lit("log").alias("name"), F.lit("old").alias("sha256"), F.lit(1).cast("long").alias("size"), F.lit("x").alias("content_type"))
    return _applied(spark, before, ["run_id", "task_name", "name"], _completed(spark, sf_dir, (tasks, runs))["artifacts"], insert=True)


@query(
    f"""WITH {_DONE}, c AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE coalesce(new, status) = 'DEAD') AS dead, count(*) FILTER (WHERE coalesce(new, status) = 'SUCCEEDED') AS ok, bool_or(new IS NOT NULL) AS touched FROM n GROUP BY run_id)
SELECT run_id AS id, CASE WHEN dead > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, CASE WHEN dead > 0 THEN dead || ' of ' || n || ' tasks did not succeed' END AS failure_reason FROM c JOIN runs r ON r.id = run_id WHERE touched AND ok + dead = n AND r.status IN ('QUEUED', 'RUNNING')""",
    "tasks", "runs",
)
def m07_runs_ended(spark, sf_dir):
    return _completed(spark, sf_dir)["runs"].select("id", "status", "failure_reason")


@query(
    f"""WITH {_DONE} SELECT id AS task_id, run_id, CASE WHEN fate = 'dead' THEN CASE WHEN id % 8 = 0 THEN 'permanent failure' ELSE 'attempts exhausted' END ELSE 'upstream task ' || upstream || ' did not succeed' END AS reason, greatest(attempt, 1) AS attempts FROM n WHERE new = 'DEAD'""",
    "tasks",
)
def m10_dead_letters_of_a_batch(spark, sf_dir):
    return _completed(spark, sf_dir)["dead_letters"].select("task_id", "run_id", "reason", "attempts")


@query(f"""WITH {_DONE}, w AS (SELECT *, {_WAIT} AS wait FROM n), c AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE coalesce(new, status) = 'DEAD') AS dead, count(*) FILTER (WHERE coalesce(new, status) = 'SUCCEEDED') AS ok, bool_or(new IS NOT NULL) AS touched FROM n GROUP BY run_id),
e AS (SELECT c.* FROM c JOIN runs r ON r.id = c.run_id AND r.status IN ('QUEUED', 'RUNNING') WHERE touched AND ok + dead = n)
SELECT run_id, 0::BIGINT AS ord, 'TASK_SUCCEEDED' AS type, task_name, '{{"v":1,"attempt":' || attempt || ',"duration_ms":9,"output":"{{}}"' || CASE WHEN id % 5 = 0 THEN ',"artifacts":[{{"name":"log","sha256":"' || md5(id::VARCHAR) || '","size":3,"content_type":"text/plain"}}]' ELSE '' END || '}}' AS payload FROM n WHERE fate = 'won'
UNION ALL SELECT run_id, 0, 'TASK_FAILED', task_name, '{{"v":1,"attempt":' || attempt || ',"duration_ms":9,"error":"boom","retryable":' || CASE fate WHEN 'again' THEN 'true' ELSE 'false' END || '}}' FROM n WHERE fate IN ('again', 'dead')
UNION ALL SELECT run_id, 1, 'TASK_RETRY_SCHEDULED', task_name, '{{"v":1,"attempt":' || attempt || ',"next_attempt":' || (attempt + 1) || ',"delay_ms":' || wait || ',"run_at":"' || {_said(f"({T} + to_milliseconds(wait))")} || '"}}' FROM w WHERE new = 'RETRYING'
UNION ALL SELECT run_id, 2, 'TASK_DEAD_LETTERED', task_name, '{{"v":1,"attempts":' || attempt || ',"reason":"' || CASE WHEN id % 8 = 0 THEN 'permanent failure' ELSE 'attempts exhausted' END || ': boom"}}' FROM n WHERE fate = 'dead'
UNION ALL SELECT run_id, 1000, 'TASK_DEAD_LETTERED', task_name, '{{"v":1,"attempts":' || attempt || ',"reason":"upstream task ' || upstream || ' did not succeed: "}}' FROM n WHERE upstream IS NOT NULL
UNION ALL SELECT run_id, 1000, 'TASK_SCHEDULED', task_name, '{{"v":1,"attempt":0,"scheduled_at":"{NOW_SAID}","depends_on":["t' || (line - 1) || '"]}}' FROM n WHERE new = 'READY'
UNION ALL SELECT run_id, 1000000, CASE WHEN dead > 0 THEN 'RUN_FAILED' ELSE 'RUN_SUCCEEDED' END, NULL, CASE WHEN dead > 0 THEN '{{"v":1,"reason":"tasks dead-lettered","detail":"' || dead || ' of ' || n || ' tasks did not succeed"}}' ELSE '{{"v":1,"tasks_succeeded":' || ok || '}}' END FROM e""", "tasks", "runs")
def m07_task_events(spark, sf_dir):
    """All events that a batch of outcomes appends."""
    return _completed(spark, sf_dir)["events"].select(*EVENT)


_LATE = f"""l AS (SELECT t.*, {_LINE} AS line, CASE WHEN t.status NOT IN ('LEASED', 'RUNNING') OR lease_expires_at > {T} THEN NULL WHEN r.status IN ('SUCCEEDED', 'FAILED', 'CANCELLED') THEN 'abandon' WHEN attempt < 3 THEN 'requeue' ELSE 'dead' END AS fate, r.status AS run_status FROM tasks t LEFT JOIN runs r ON r.id = t.run_id),
b AS (SELECT l.id, min(d.task_name) AS upstream FROM l JOIN l d ON d.run_id = l.run_id AND d.line < l.line AND d.fate = 'dead' WHERE l.status NOT IN ('SUCCEEDED', 'DEAD') AND coalesce(l.fate, '') <> 'dead' GROUP BY l.id),
n AS (SELECT l.*, b.upstream, CASE WHEN fate IN ('dead', 'abandon') OR b.id IS NOT NULL THEN 'DEAD' WHEN fate = 'requeue' THEN 'READY' END AS new FROM l LEFT JOIN b ON b.id = l.id)"""


@query(
    f"""WITH {_LATE}, c AS (SELECT run_id, any_value(run_status) AS s, count(*) AS n, count(*) FILTER (WHERE coalesce(new, status) = 'DEAD') AS dead, count(*) FILTER (WHERE coalesce(new, status) = 'SUCCEEDED') AS ok, bool_or(new IS NOT NULL) AS touched FROM n GROUP BY run_id)
SELECT run_id, 0::BIGINT AS ord, 'TASK_LEASE_EXPIRED' AS type, task_name, '{{"v":1,"attempt":' || attempt || ',"lease_expired_at":"' || {_said("lease_expires_at")} || '"}}' AS payload FROM n WHERE fate IN ('requeue', 'dead')
UNION ALL SELECT run_id, 1, 'TASK_REQUEUED', task_name, '{{"v":1,"attempt":' || attempt || ',"next_attempt":' || (attempt + 1) || ',"reason":"lease expired"}}' FROM n WHERE new = 'READY'
UNION ALL SELECT run_id, 1, 'TASK_DEAD_LETTERED', task_name, '{{"v":1,"attempts":' || attempt || ',"reason":"lease expired with no attempts remaining"}}' FROM n WHERE fate = 'dead'
UNION ALL SELECT run_id, 1000, 'TASK_DEAD_LETTERED', task_name, '{{"v":1,"attempts":' || attempt || ',"reason":"upstream task ' || upstream || ' did not succeed: "}}' FROM n WHERE upstream IS NOT NULL
UNION ALL SELECT run_id, 1000000, 'RUN_FAILED', NULL, '{{"v":1,"reason":"tasks dead-lettered","detail":"' || dead || ' of ' || n || ' tasks did not succeed"}}' FROM c WHERE touched AND ok + dead = n AND dead > 0 AND s IN ('QUEUED', 'RUNNING')""",
    "tasks", "runs",
)
def m14_expire_leases(spark, sf_dir):
    tasks, runs = _kept(spark, sf_dir)
    return changes.expire_leases(tasks, runs, _line(runs), _steps(spark), _now(), None)["events"].select(*EVENT)


@query(
    f"""WITH {_LATE} SELECT id, new AS status, NULL::BIGINT AS worker_id, NULL::TIMESTAMP AS lease_expires_at, CASE WHEN new = 'READY' THEN {T} ELSE scheduled_at END AS scheduled_at, CASE WHEN new = 'DEAD' THEN {T} END AS completed_at,
 CASE WHEN new = 'READY' THEN error WHEN fate = 'dead' THEN coalesce(error, 'lease expired with no attempts remaining') WHEN fate = 'abandon' AND upstream IS NULL THEN coalesce(error, 'run was no longer active when the lease expired') ELSE error END AS error, NULL::VARCHAR AS output_ref FROM n WHERE new IS NOT NULL""",
    "tasks", "runs",
)
def m15_expired_tasks(spark, sf_dir):
    tasks, runs = _kept(spark, sf_dir)
    return changes.expire_leases(tasks, runs, _line(runs), _steps(spark), _now(), None)["tasks"]


@query(f"""SELECT run_id, 0::BIGINT AS ord, 'TASK_LEASED' AS type, task_name, '{{"v":1,"attempt":' || (attempt + 1) || ',"lease_expires_at":"' || {_said(f"({T} + INTERVAL 30 SECOND)")} || '"}}' AS payload FROM (SELECT * FROM tasks WHERE status = 'READY' AND scheduled_at <= {T} ORDER BY scheduled_at, id LIMIT 25)""", "tasks")
def m03_leases(spark, sf_dir):
    """The events of a claim; its limit is the worker's free slots."""
    (tasks,) = _t(spark, sf_dir, "tasks")
    return changes.claim(tasks, _now(), 42, 25)["events"].select(*EVENT)


@query(f"""SELECT id, run_id, task_name, attempt + (claimed)::INT AS attempt, CASE WHEN claimed THEN 'LEASED' ELSE status END AS status, CASE WHEN claimed THEN 42 ELSE worker_id END AS worker_id, CASE WHEN claimed THEN {T} + INTERVAL 30 SECOND ELSE lease_expires_at END AS lease_expires_at
FROM (SELECT *, id IN (SELECT id FROM tasks WHERE status = 'READY' AND scheduled_at <= {T} ORDER BY scheduled_at, id LIMIT 25) AS claimed FROM tasks)""", "tasks")
def m03_tasks_after(spark, sf_dir):
    """The whole table of tasks after a claim."""
    tasks, _ = _kept(spark, sf_dir)
    whole = tasks.select("id", "run_id", "task_name", "attempt", "status", "worker_id", "lease_expires_at")
    return _applied(spark, whole, ["id"], changes.claim(tasks, _now(), 42, 25)["tasks"])


@query(f"""SELECT run_id, 0::BIGINT AS ord, 'TASK_SCHEDULED' AS type, task_name, '{{"v":1,"attempt":' || attempt || ',"scheduled_at":"{NOW_SAID}"}}' AS payload FROM tasks WHERE status = 'RETRYING' AND scheduled_at <= {T}""", "tasks")
def t05_retries_announced(spark, sf_dir):
    (tasks,) = _t(spark, sf_dir, "tasks")
    return changes.promote_retries(tasks, _now(), None)["events"].select(*EVENT)


def _cancelled(spark, sf_dir):
    runs, tasks = _t(spark, sf_dir, "runs", "tasks")
    asked = runs.where("id % 11 < 2").select(F.col("id").alias("run_id"), F.when(F.col("id") % 2 == 0, "no need").otherwise("").alias("reason"))
    return changes.cancel_runs(runs, tasks, asked, _now())


_ASKED_TO_END = "SELECT id, status, CASE WHEN id % 2 = 0 THEN 'no need' END AS reason, status IN ('SUCCEEDED', 'FAILED', 'CANCELLED') AS closed FROM runs WHERE id % 11 < 2"


@query(f"""SELECT id AS run_id, 1000000::BIGINT AS ord, 'RUN_CANCELLED' AS type, NULL::VARCHAR AS task_name, '{{"v":1' || CASE WHEN reason IS NULL THEN '' ELSE ',"reason":"' || reason || '"' END || '}}' AS payload FROM ({_ASKED_TO_END}) WHERE NOT closed""", "runs")
def m22_cancel_events(spark, sf_dir):
    return _cancelled(spark, sf_dir)["events"].select(*EVENT)


@query(f"SELECT id AS run_id, 'run is finished: ' || status AS reason FROM ({_ASKED_TO_END}) WHERE closed", "runs")
def m22_refused(spark, sf_dir):
    return _cancelled(spark, sf_dir)["refused"]


@query(
    f"""SELECT t.id, CASE WHEN held THEN t.status ELSE 'DEAD' END AS status, CASE WHEN held THEN worker_id END AS worker_id, CASE WHEN held THEN {T} END AS lease_expires_at, CASE WHEN NOT held THEN {T} END AS completed_at, CASE WHEN held THEN error ELSE coalesce(error, 'run cancelled') END AS error
FROM (SELECT *, status IN ('LEASED', 'RUNNING') AS held FROM tasks WHERE status NOT IN ('SUCCEEDED', 'DEAD', 'FAILED')) t JOIN ({_ASKED_TO_END}) r ON r.id = t.run_id AND NOT closed""",
    "tasks", "runs",
)
def m22_cancelled_tasks(spark, sf_dir):
    return _cancelled(spark, sf_dir)["tasks"]


@query(
    """WITH g AS (SELECT id FROM workers WHERE status IN ('HEALTHY', 'SUSPECT') AND id % 3 = 0), h AS (SELECT t.*, count(*) OVER (PARTITION BY worker_id) AS n FROM tasks t JOIN g ON g.id = t.worker_id WHERE t.status IN ('LEASED', 'RUNNING'))
SELECT DISTINCT run_id, worker_id::VARCHAR AS worker_id, 'WORKER_LOST' AS type, '{"v":1,"missed_beats":5,"leases_released":' || n || '}' AS payload FROM h JOIN runs r ON r.id = h.run_id WHERE r.completed_at IS NULL""",
    "tasks", "runs", "workers",
)
def m21_workers_lost(spark, sf_dir):
    workers, tasks, runs = _t(spark, sf_dir, "workers", "tasks", "runs")
    return changes.retire_workers(workers, tasks, runs, workers.where("id % 3 = 0").select("id"), _now())["events"].select("run_id", "worker_id", "type", "payload")


@query(
    """SELECT run_id, 0::BIGINT AS ord, 'SIDE_EFFECT_SKIPPED' AS type, task_name, '{"v":1,"idempotency_key":"' || run_id || ':' || task_name || ':charge","attempt":' || attempt || ',"first_attempt":' || CASE WHEN id % 3 = 0 THEN greatest(attempt - 1, 0) ELSE 0 END || '}' AS payload FROM tasks WHERE status = 'RUNNING'""",
    "tasks",
)
def m13_skipped_effects(spark, sf_dir):
    (tasks,) = _t(spark, sf_dir, "tasks")
    r = tasks.where("status = 'RUNNING'")
    asked = r.select(F.col("id").alias("task_id"), "run_id", "task_name", "attempt", F.concat_ws(":", F.col("run_id").cast("string"), "task_name", F.lit("charge")).alias("key"))
    attempts = r.where("id % 3 = 0").select(F.col("id").alias("task_id"), F.explode(F.array(F.greatest(F.col("attempt") - 1, F.lit(0)), "attempt")).alias("attempt"))
    return changes.skip_effects(asked, attempts, _now()).select(*EVENT)


@registry.query("SELECT s_suppkey AS id, s_name AS hostname, 'HEALTHY' AS status, greatest(s_nationkey - 3, 1)::INT AS capacity, 0 AS active_tasks FROM supplier")
def m20_register_workers(spark, sf_dir):
    s = registry.table(spark, sf_dir, "supplier")
    asked = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("hostname"), F.lit("1").alias("version"), (F.col("s_nationkey") - 3).alias("capacity"))
    return changes.register_workers(asked, _now()).select("id", "hostname", "status", "capacity", "active_tasks")


@query(
    f"""WITH c AS (SELECT *, {_LINE} AS line FROM tasks WHERE status = 'LEASED') SELECT c.id, CASE WHEN c.line < 7 THEN 'h' || c.line END AS handler, CASE WHEN c.line < 7 AND c.line % 2 = 0 THEN c.line * 1000 ELSE 300000 END::BIGINT AS timeout_ms,
 CASE WHEN c.line = 1 OR c.line >= 7 THEN '' ELSE 't' || (c.line - 1) || '=' || coalesce('out' || d.id, '') END AS inputs, CASE WHEN c.line >= 7 THEN 'the workflow does not declare the step ' || c.task_name END AS problem
FROM c LEFT JOIN tasks d ON d.run_id = c.run_id AND d.status = 'SUCCEEDED' AND d.task_name = 't' || (c.line - 1) JOIN runs r ON r.id = c.run_id""",
    "tasks", "runs",
)
def j10_hydrate(spark, sf_dir):
    tasks, runs = _t(spark, sf_dir, "tasks", "runs")
    outputs = tasks.where("status = 'SUCCEEDED'").select("run_id", "task_name", F.concat(F.lit("out"), F.col("id").cast("string")).alias("output"))
    h = changes.hydrate(tasks.where("status = 'LEASED'").select("id", "run_id", "task_name"), _line(runs), _steps(spark, 6), outputs)
    said = F.array_join(F.transform(F.map_entries("inputs"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ",")
    return h.select("id", "handler", "timeout_ms", said.alias("inputs"), "problem")


@query("SELECT id, scenario_name AS name, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'h' ELSE 'x' END AS hash, coalesce(scenario_name IN ('1-URGENT', '2-HIGH') AND id % 3 < 2, false) AS found FROM runs", "runs")
def j14_look_up_scenarios(spark, sf_dir):
    (runs,) = _t(spark, sf_dir, "runs")
    k = F.col("id") % 3
    asked = runs.select("id", F.col("scenario_name").alias("name"), F.when(k == 0, "").when(k == 1, "h").otherwise("x").alias("hash"))
    return changes.look_up_scenarios(asked, spark.createDataFrame([("1-URGENT", "h"), ("2-HIGH", "h")], "name string, hash string"))
