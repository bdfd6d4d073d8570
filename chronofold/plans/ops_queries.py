"""Queries over the operational projections: lists, pages, counts, sweeps, ledger, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import draws, text
from ..functions.time import at, clock, human_duration
from ..operators import checks, metrics, ops
from ..sources import projections as P
from . import registry

T = f"TIMESTAMP '{P.NOW}'"


def _now():
    return at(P.NOW)


def query(oracle: str, *tables: str):
    body = oracle.strip()
    head = "WITH " + P.sql(*tables) if tables else ""
    if head:
        body = head + (",\n" + body[5:] if body[:5].upper() == "WITH " else "\n" + body)
    return registry.query(body)


def _t(spark, sf_dir, *names):
    got = [P.table(spark, sf_dir, n) for n in names]
    return got[0] if len(got) == 1 else got


@query("SELECT r.id, r.workflow_id, r.status, r.created_at, w.name AS workflow, w.version AS workflow_version FROM (SELECT * FROM runs ORDER BY created_at DESC, id DESC LIMIT 50) r JOIN workflows w ON w.id = r.workflow_id", "runs", "workflows")
def o01_list_runs(spark, sf_dir):
    return ops.list_runs(*_t(spark, sf_dir, "runs", "workflows")).select("id", "workflow_id", "status", "created_at", "workflow", "workflow_version")


@query("SELECT r.id, r.status, w.name AS workflow FROM runs r JOIN workflows w ON w.id = r.workflow_id WHERE r.status = 'FAILED' AND w.name = 'BUILDING' ORDER BY created_at DESC, r.id DESC LIMIT 20", "runs", "workflows")
def p03_list_runs_filtered(spark, sf_dir):
    return ops.list_runs(*_t(spark, sf_dir, "runs", "workflows"), status="failed", workflow="BUILDING", limit=20).select("id", "status", "workflow")


@query("SELECT r.id, r.status, w.name AS workflow, w.version AS workflow_version FROM runs r JOIN workflows w ON w.id = r.workflow_id WHERE r.id = 7", "runs", "workflows")
def s08_run_by_id(spark, sf_dir):
    return ops.run_by_id(*_t(spark, sf_dir, "runs", "workflows"), 7).select("id", "status", "workflow", "workflow_version")


@query("SELECT name, max(version) AS version, max_by(id, version) AS id, max_by(definition_hash, version) AS definition_hash FROM workflows GROUP BY name", "workflows")
def s09_latest_workflows(spark, sf_dir):
    return ops.latest_version(_t(spark, sf_dir, "workflows")).select("name", "version", "id", "definition_hash")


@query("SELECT name, version, id FROM workflows ORDER BY name, version DESC LIMIT 100", "workflows")
def o06_list_workflows(spark, sf_dir):
    return ops.list_workflows(_t(spark, sf_dir, "workflows")).select("name", "version", "id")


@query("SELECT id, hostname, status, active_tasks || '/' || capacity AS load, last_heartbeat FROM workers", "workers")
def s17_list_workers(spark, sf_dir):
    return ops.list_workers(_t(spark, sf_dir, "workers")).select("id", "hostname", "status", "load", "last_heartbeat")


@query("SELECT id, task_name, (SELECT count(*) > 3 FROM tasks WHERE run_id = 7 AND task_name > 't1') AS has_more FROM tasks WHERE run_id = 7 AND task_name > 't1' ORDER BY task_name LIMIT 3", "tasks")
def s06_tasks_page(spark, sf_dir):
    t = _t(spark, sf_dir, "tasks").where("run_id = 7")
    return ops.keyset_page(t, "task_name", "t1", 3).select("id", "task_name", "has_more")


@query("SELECT id, status, (SELECT count(*) > 100 FROM runs WHERE id > 1000) AS has_more FROM runs WHERE id > 1000 ORDER BY id LIMIT 100", "runs")
def s05_keyset_page(spark, sf_dir):
    return ops.keyset_page(_t(spark, sf_dir, "runs"), "id", 1000, 100).select("id", "status", "has_more")


@query(
    """SELECT 'runs' AS what, status, count(*) AS n FROM runs GROUP BY status UNION ALL SELECT 'tasks', status, count(*) FROM tasks GROUP BY status UNION ALL SELECT 'workers', status, count(*) FROM workers GROUP BY status
UNION ALL SELECT 'queue', 'depth', count(*) FROM tasks WHERE status IN ('READY', 'RETRYING')""",
    "runs", "tasks", "workers",
)
def a01_stats(spark, sf_dir):
    return ops.stats(*_t(spark, sf_dir, "runs", "tasks", "workers"))


@query(
    f"""WITH c AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'SUCCEEDED') AS succeeded, count(*) FILTER (WHERE status = 'DEAD') AS dead, count(*) FILTER (WHERE status = 'READY' AND scheduled_at <= {T}) AS runnable,
 count(*) FILTER (WHERE status IN ('LEASED', 'RUNNING')) AS in_flight, count(*) FILTER (WHERE status = 'RETRYING' OR (status = 'READY' AND scheduled_at > {T})) AS waiting FROM tasks GROUP BY run_id)
SELECT *, succeeded + dead < total AND runnable + in_flight + waiting = 0 AS stalled FROM c""",
    "tasks",
)
def a03_progress(spark, sf_dir):
    return ops.progress(_t(spark, sf_dir, "tasks"), _now())


@query("SELECT run_id, CASE WHEN count(*) FILTER (WHERE status = 'DEAD') > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS closes_as, count(*) FILTER (WHERE status = 'DEAD') AS dead FROM tasks GROUP BY run_id HAVING count(*) = count(*) FILTER (WHERE status IN ('SUCCEEDED', 'DEAD'))", "tasks")
def a04_settle(spark, sf_dir):
    return ops.settle(_t(spark, sf_dir, "tasks"))


@query("SELECT count(*) AS n FROM tasks WHERE status IN ('READY', 'RETRYING')", "tasks")
def a05_queue_depth(spark, sf_dir):
    return _t(spark, sf_dir, "tasks").agg(F.count_if(F.col("status").isin("READY", "RETRYING")).alias("n"))


@query("SELECT id, status, scenario_name FROM runs ORDER BY CASE WHEN scenario_name IS NOT NULL AND status = 'SUCCEEDED' THEN 0 WHEN scenario_name IS NOT NULL THEN 1 ELSE 2 END, created_at DESC, id DESC LIMIT 1", "runs")
def w08_headline_run(spark, sf_dir):
    return ops.headline_run(_t(spark, sf_dir, "runs")).select("id", "status", "scenario_name")


@query("SELECT status, count(*) AS n FROM runs GROUP BY status", "runs")
def a20_tally(spark, sf_dir):
    return ops.tally(_t(spark, sf_dir, "runs"), "status")


@query("SELECT count(*) FILTER (WHERE status IN ('HEALTHY', 'SUSPECT')) AS live, count(*) FILTER (WHERE status = 'LOST') AS lost FROM workers", "workers")
def a21_live_workers(spark, sf_dir):
    return _t(spark, sf_dir, "workers").agg(F.count_if(F.col("status").isin("HEALTHY", "SUSPECT")).alias("live"), F.count_if(F.col("status") == "LOST").alias("lost"))


@query("SELECT run_id, string_agg(DISTINCT task_name, ',' ORDER BY task_name) AS done FROM tasks WHERE status = 'SUCCEEDED' GROUP BY run_id", "tasks")
def s14_succeeded_tasks(spark, sf_dir):
    return ops.succeeded_tasks(_t(spark, sf_dir, "tasks"))


@query(f"SELECT id, run_id, task_name, attempt + 1 AS attempt, 'LEASED' AS status, 42 AS worker_id, {T} + INTERVAL 30 SECOND AS lease_expires_at FROM tasks WHERE status = 'READY' AND scheduled_at <= {T} ORDER BY scheduled_at, id LIMIT 25", "tasks")
def m03_claim(spark, sf_dir):
    return ops.claim(_t(spark, sf_dir, "tasks"), _now(), 42, 25)


@query(
    f"""WITH s AS (SELECT id AS worker_id, row_number() OVER (ORDER BY slot, id) AS n FROM (SELECT id, unnest(range(1, capacity - active_tasks + 1)) AS slot FROM workers WHERE status = 'HEALTHY' AND capacity > active_tasks)),
r AS (SELECT id, run_id, task_name, row_number() OVER (ORDER BY scheduled_at, id) AS n FROM tasks WHERE status = 'READY' AND scheduled_at <= {T}) SELECT r.id, run_id, task_name, worker_id FROM r JOIN s USING (n)""",
    "tasks", "workers",
)
def o03_assign(spark, sf_dir):
    return ops.assign(*_t(spark, sf_dir, "tasks", "workers"), _now())


@query(
    f"""SELECT t.id, t.run_id, t.task_name, t.attempt, t.worker_id, CASE WHEN r.status IN ('SUCCEEDED', 'FAILED', 'CANCELLED') THEN 'abandon' WHEN t.attempt < 3 THEN 'requeue' ELSE 'dead' END AS fate
FROM tasks t LEFT JOIN runs r ON r.id = t.run_id WHERE t.status IN ('LEASED', 'RUNNING') AND t.lease_expires_at <= {T}""",
    "tasks", "runs",
)
def t03_expired_leases(spark, sf_dir):
    return ops.expired_leases(*_t(spark, sf_dir, "tasks", "runs"), _now(), limit=None)


@query(f"SELECT id, run_id, attempt, worker_id FROM tasks WHERE status IN ('LEASED', 'RUNNING') AND lease_expires_at <= {T} ORDER BY lease_expires_at, id LIMIT 200", "tasks")
def o04_expired_batch(spark, sf_dir):
    return ops.expired_leases(*_t(spark, sf_dir, "tasks", "runs"), _now()).select("id", "run_id", "attempt", "worker_id")


_LIVE = f"""SELECT id, status, CASE WHEN status IN ('HEALTHY', 'SUSPECT') AND last_heartbeat <= {T} - INTERVAL 25 SECOND THEN 'LOST' WHEN status = 'HEALTHY' AND last_heartbeat <= {T} - INTERVAL 15 SECOND THEN 'SUSPECT' END AS new_status FROM workers"""


@query(f"SELECT * FROM ({_LIVE}) WHERE new_status IS NOT NULL", "workers")
def t04_liveness(spark, sf_dir):
    return ops.liveness(_t(spark, sf_dir, "workers"), _now())


@query(f"SELECT t.run_id, t.worker_id, count(*) AS leases_released FROM tasks t JOIN ({_LIVE}) l ON l.id = t.worker_id AND l.new_status = 'LOST' JOIN runs r ON r.id = t.run_id AND r.status NOT IN ('SUCCEEDED', 'FAILED', 'CANCELLED') WHERE t.status IN ('LEASED', 'RUNNING') GROUP BY 1, 2", "tasks", "runs", "workers")
def j02_worker_lost(spark, sf_dir):
    tasks, runs, workers = _t(spark, sf_dir, "tasks", "runs", "workers")
    return ops.lost_announcements(tasks, runs, ops.liveness(workers, _now()).where("new_status = 'LOST'"))


@query(f"SELECT id, run_id, task_name, attempt, 'READY' AS status FROM tasks WHERE status = 'RETRYING' AND scheduled_at <= {T} ORDER BY scheduled_at, id LIMIT 100", "tasks")
def t05_due_retries(spark, sf_dir):
    return ops.due_retries(_t(spark, sf_dir, "tasks"), _now())


def _asked(tasks):
    return tasks.where("part % 5 = 2 and run_id % 3 = 0").select("id", F.when(F.col("run_id") % 2 == 0, F.coalesce("worker_id", F.lit(1))).otherwise(F.lit(1)).cast("long").alias("worker_id"))


_ASKED = "asked AS (SELECT id, CASE WHEN run_id % 2 = 0 THEN coalesce(worker_id, 1) ELSE 1 END AS worker_id FROM tasks WHERE part % 5 = 2 AND run_id % 3 = 0)"


@query(f"WITH {_ASKED} SELECT t.id, t.worker_id, {T} + INTERVAL 30 SECOND AS lease_expires_at FROM tasks t SEMI JOIN asked a ON a.id = t.id AND a.worker_id = t.worker_id WHERE t.status IN ('LEASED', 'RUNNING')", "tasks")
def t06_renew(spark, sf_dir):
    t = _t(spark, sf_dir, "tasks")
    return ops.renew(t, _asked(t), _now())


@query(f"WITH {_ASKED} SELECT * FROM asked a ANTI JOIN (SELECT * FROM tasks WHERE status IN ('LEASED', 'RUNNING')) t ON a.id = t.id AND a.worker_id = t.worker_id", "tasks")
def j11_lost_leases(spark, sf_dir):
    t = _t(spark, sf_dir, "tasks")
    return ops.lost_leases(t, _asked(t))


@query("SELECT id, worker_id, attempt, CASE WHEN part % 2 = 0 THEN status ELSE 'RUNNING' END AS status, status = 'RUNNING' OR part % 2 = 0 AS ok FROM tasks WHERE worker_id IS NOT NULL AND run_id % 3 = 0", "tasks")
def p26_compare_and_set(spark, sf_dir):
    t = _t(spark, sf_dir, "tasks")
    asked = t.where("worker_id is not null and run_id % 3 = 0").select("id", "worker_id", "attempt", F.when(F.col("part") % 2 == 0, F.col("status")).otherwise("RUNNING").alias("status"))
    return ops.compare_and_set(t, asked)


@query("SELECT idempotency_key, min_by(attempt, (created_at, attempt)) AS first_attempt, count(*) - 1 AS suppressed FROM ledger GROUP BY idempotency_key", "ledger")
def t08_first_recorded(spark, sf_dir):
    return ops.first_recorded(_t(spark, sf_dir, "ledger"))


@query("SELECT run_id, count(DISTINCT idempotency_key) AS n FROM ledger GROUP BY run_id", "ledger")
def a08_ledger_by_run(spark, sf_dir):
    return _t(spark, sf_dir, "ledger").groupBy("run_id").agg(F.count_distinct("idempotency_key").alias("n"))


@query("SELECT idempotency_key, attempt FROM ledger WHERE idempotency_key = '7:t1:charge'", "ledger")
def s16_ledger_lookup(spark, sf_dir):
    return _t(spark, sf_dir, "ledger").where("idempotency_key = '7:t1:charge'").select("idempotency_key", "attempt")


_UR = draws.uniform_sql("run_id % 97", "run_id", "'retry'", "task_name", "attempt")


@query(
    f"""WITH f AS (SELECT *, part % 3 = 0 AS permanent, NOT (part % 3 = 0) AND attempt < 3 AS again, floor(greatest(0.0::DOUBLE, least(1000.0::DOUBLE * pow(2.0::DOUBLE, greatest(attempt, 1) - 1), 30000.0::DOUBLE) * (1 + 0.2::DOUBLE * (2 * {_UR} - 1))))::BIGINT AS d FROM tasks WHERE status = 'FAILED')
SELECT id, run_id, task_name, attempt, CASE WHEN again THEN 'RETRYING' ELSE 'DEAD' END AS status, CASE WHEN again THEN d END AS delay_ms, CASE WHEN again THEN {T} + to_milliseconds(d) END AS scheduled_at,
 CASE WHEN NOT again THEN CASE WHEN permanent THEN 'permanent failure' ELSE 'attempts exhausted' END END AS reason FROM f""",
    "tasks",
)
def m08_after_failure(spark, sf_dir):
    f = _t(spark, sf_dir, "tasks").where("status = 'FAILED'").withColumns({"permanent": F.col("part") % 3 == 0, "seed": F.col("run_id") % 97})
    return ops.after_failure(f, _now())


@query("SELECT id AS task_id, run_id, greatest(attempt, 1) AS attempts FROM tasks WHERE status = 'DEAD' AND id % 2 = 1", "tasks")
def m10_dead_letters(spark, sf_dir):
    dead = _t(spark, sf_dir, "tasks").where("status = 'DEAD'")
    return ops.dead_letters(dead, dead.where("id % 2 = 0").select(F.col("id").alias("task_id")))


@query(
    f"""SELECT t.id, t.run_id, t.task_name, CASE WHEN t.status IN ('LEASED', 'RUNNING') THEN t.status ELSE 'DEAD' END AS status, CASE WHEN t.status IN ('LEASED', 'RUNNING') THEN {T} END AS lease_expires_at
FROM tasks t JOIN runs r ON r.id = t.run_id WHERE r.id % 11 = 0 AND r.status NOT IN ('SUCCEEDED', 'FAILED', 'CANCELLED') AND t.status NOT IN ('SUCCEEDED', 'DEAD')""",
    "tasks", "runs",
)
def m22_cancel(spark, sf_dir):
    runs, tasks = _t(spark, sf_dir, "runs", "tasks")
    return ops.cancel(runs, tasks, F.col("id") % 11 == 0, _now())[1]


@query(f"SELECT t.id, t.worker_id, {T} AS lease_expires_at FROM tasks t WHERE t.status IN ('LEASED', 'RUNNING') AND t.worker_id % 9 = 0", "tasks")
def m21_retire(spark, sf_dir):
    workers, tasks = _t(spark, sf_dir, "workers", "tasks")
    return ops.retire(workers, tasks, F.col("id") % 9 == 0, _now())[1]


@query(f"SELECT id, status, CASE WHEN status IN ('LOST', 'STOPPED') THEN last_heartbeat ELSE greatest(last_heartbeat, {T}) END AS last_heartbeat, status NOT IN ('LOST', 'STOPPED') AS accepted FROM workers WHERE id % 2 = 0", "workers")
def t07_heartbeat(spark, sf_dir):
    w = _t(spark, sf_dir, "workers")
    return ops.heartbeat(w, w.where("id % 2 = 0").select("id", _now().alias("at")))


@query("SELECT name, version + id % 2 * 1000000 AS version, CASE WHEN id % 3 = 0 THEN 'x' ELSE definition_hash END AS definition_hash, CASE WHEN id % 2 = 1 THEN 'inserted' WHEN id % 3 = 0 THEN 'conflict' ELSE 'unchanged' END AS outcome FROM workflows", "workflows")
def m01_register(spark, sf_dir):
    w = _t(spark, sf_dir, "workflows")
    new = w.select("name", (F.col("version") + F.col("id") % 2 * 1000000).alias("version"), F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("definition_hash")).alias("definition_hash"))
    return ops.register_workflows(w, new)


@query("SELECT l_orderkey AS run_id, 't' AS task_name, 'a' || l_linenumber AS name, max_by(md5(l_partkey::VARCHAR), (l_shipdate, md5(l_partkey::VARCHAR))) AS sha256, max(l_shipdate) AS created_at FROM lineitem GROUP BY l_orderkey, l_linenumber")
def m12_latest_artifacts(spark, sf_dir):
    a = registry.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.lit("t").alias("task_name"), F.concat(F.lit("a"), F.col("l_linenumber")).alias("name"), F.md5(F.col("l_partkey").cast("string")).alias("sha256"), F.col("l_shipdate").alias("created_at"))
    return ops.latest_artifacts(a)


@query("SELECT id, CASE WHEN status NOT IN (" + V.sql_list(V.RUN_STATUSES) + ") THEN 'status' ELSE 'completed' END AS rule FROM (SELECT id, status, CASE WHEN id % 100 = 7 THEN NULL ELSE completed_at END AS c FROM runs) WHERE (status IN ('SUCCEEDED', 'FAILED', 'CANCELLED')) <> (c IS NOT NULL)", "runs")
def p23_run_violations(spark, sf_dir):
    return checks.run_violations(_t(spark, sf_dir, "runs").withColumn("completed_at", F.when(F.col("id") % 100 != 7, F.col("completed_at"))))


@query("SELECT id, 'lease' AS rule FROM tasks WHERE status IN ('LEASED', 'RUNNING') AND id % 50 = 3 UNION ALL SELECT id, 'worker' FROM tasks WHERE status IN ('LEASED', 'RUNNING') AND id % 50 = 4", "tasks")
def p24_task_violations(spark, sf_dir):
    t = _t(spark, sf_dir, "tasks").withColumns({"lease_expires_at": F.when(F.col("id") % 50 != 3, F.col("lease_expires_at")), "worker_id": F.when(F.col("id") % 50 != 4, F.col("worker_id"))})
    return checks.task_violations(t)


@query("SELECT l_orderkey AS run_id, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def p16_repeated_keys(spark, sf_dir):
    return checks.repeated(registry.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line")), "run_id", "line")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 20 <> 0)")
def j15_orphans(spark, sf_dir):
    orders = registry.table(spark, sf_dir, "orders").where("o_orderkey % 20 <> 0")
    return checks.orphans(registry.table(spark, sf_dir, "lineitem"), "l_orderkey", orders, "o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT id, status, ((epoch_us(completed_at) - epoch_us(created_at)) // 1000) / 1000.0::DOUBLE AS seconds FROM runs WHERE completed_at IS NOT NULL", "runs")
def v21_run_seconds(spark, sf_dir):
    return checks.run_seconds(_t(spark, sf_dir, "runs"))


@query("WITH b AS (SELECT status, CASE " + " ".join(f"WHEN s <= {b} THEN '{b:g}'" for b in metrics.RUN_BOUNDS) + " ELSE '+Inf' END AS bucket, s FROM (SELECT status, ((epoch_us(completed_at) - epoch_us(created_at)) // 1000) / 1000.0::DOUBLE AS s FROM runs WHERE completed_at IS NOT NULL)) SELECT status, bucket, count(*) AS n, round(sum(s), 3) AS total FROM b GROUP BY 1, 2", "runs")
def a23_run_histogram(spark, sf_dir):
    h = metrics.histogram(checks.run_seconds(_t(spark, sf_dir, "runs")), ["status"], "seconds", metrics.RUN_BOUNDS)
    return h.withColumn("total", F.round("total", 3))


@query(
    """WITH v AS (SELECT event_type, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, l[greatest(1, least(len(l), floor(len(l) * 0.5::DOUBLE + 0.5)::BIGINT))] AS p50, l[greatest(1, least(len(l), floor(len(l) * 0.95::DOUBLE + 0.5)::BIGINT))] AS p95, l[len(l)] AS max FROM v"""
)
def a14_percentiles(spark, sf_dir):
    return metrics.percentile_by(registry.table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "max": 1.0})


@query("SELECT id, CASE WHEN ms >= 0 THEN CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.2fs', ms / 1000.0::DOUBLE) ELSE (ms // 60000) || 'm ' || round((ms % 60000) / 1000.0::DOUBLE)::BIGINT || 's' END END AS took, strftime(created_at, '%H:%M:%S') AS started FROM (SELECT *, (epoch_us(completed_at) - epoch_us(created_at)) // 1000 AS ms FROM runs)", "runs")
def f11_durations(spark, sf_dir):
    r = _t(spark, sf_dir, "runs")
    return r.select("id", human_duration(F.col("created_at"), F.col("completed_at")).alias("took"), clock(F.col("created_at")).alias("started"))


@query("SELECT id, status, CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.STATUS_MEANING.items()) + " END AS meaning FROM runs", "runs")
def f40_status_meaning(spark, sf_dir):
    return _t(spark, sf_dir, "runs").select("id", "status", text.lookup(F.col("status"), V.STATUS_MEANING).alias("meaning"))


@query(
    """WITH j AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type, ts FROM events), g AS (SELECT run_id, min_by(ts, seq) FILTER (WHERE event_type = 'error') AS t, max_by(ts, seq) FILTER (WHERE event_type = 'purchase') AS e FROM j GROUP BY run_id)
SELECT run_id, coalesce(CASE WHEN e >= t THEN (epoch_us(e) - epoch_us(t)) // 1000 END, 0)::BIGINT AS recovery_ms FROM g"""
)
def a17_stream_recovery(spark, sf_dir):
    from pyspark.sql import Window

    from ..operators import recovery

    e = registry.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "TASK_FAILED").when(F.col("event_type") == "purchase", "RUN_SUCCEEDED").otherwise("RUN_STARTED")
    j = e.select(F.col("user_id").alias("run_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), kind.alias("type"), F.col("ts").alias("occurred_at"))
    return recovery.recovery_time(j)


@registry.query(
    """WITH RECURSIVE r AS (SELECT user_id AS client, epoch_us(ts) AS us, event_id AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT client, us, n, i, true AS allowed, 2.0::DOUBLE AS level FROM r WHERE i = 1
 UNION ALL SELECT client, us, n, i, level >= 1, CASE WHEN level >= 1 THEN level - 1 ELSE level END FROM (SELECT r.*, least(3.0::DOUBLE, f.level + 0.001::DOUBLE * (r.us - f.us)::DOUBLE / 1e6::DOUBLE) AS level FROM f JOIN r ON r.client = f.client AND r.i = f.i + 1))
SELECT client, us AS at, n, allowed FROM f"""
)
def w09_rate_limited(spark, sf_dir):
    e = registry.table(spark, sf_dir, "events")
    return ops.rate_limited(e.select(F.col("user_id").alias("client"), F.col("ts").alias("at"), F.col("event_id").alias("n")), rate=0.001, burst=3.0)


@query(
    """WITH p AS (SELECT doc_id, text FROM documents) SELECT doc_id, sha256(text) AS sha256, strlen(text)::INT AS size, CASE WHEN length(split_part(text, chr(10), 1)) > 60 THEN substr(split_part(text, chr(10), 1), 1, 57) || '...' ELSE split_part(text, chr(10), 1) END AS line,
 substr(sha256(text), 1, 12) AS short FROM p"""
)
def f22_artifact_digests(spark, sf_dir):
    d = registry.table(spark, sf_dir, "documents")
    h = F.sha2("text", 256)
    return d.select("doc_id", h.alias("sha256"), F.octet_length("text").alias("size"), text.compact(F.col("text")).alias("line"), text.short_hash(h).alias("short"))


@query("SELECT c_custkey, regexp_full_match(replace(c_name, '#', CASE WHEN c_custkey % 2 = 0 THEN '_' ELSE '#' END), '[A-Za-z0-9_-]{1,64}') AS valid FROM customer")
def p21_valid_names(spark, sf_dir):
    c = registry.table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.valid_name(F.when(F.col("c_custkey") % 2 == 0, F.replace("c_name", F.lit("#"), F.lit("_"))).otherwise(F.col("c_name"))).alias("valid"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 'wf' ELSE 'wf@x' END AS name, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 9 + 1 ELSE 0 END::INT AS version FROM orders")
def f15_name_and_version(spark, sf_dir):
    o = registry.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    arg = F.when(k % 4 == 0, F.concat(F.lit("wf@"), k % 9 + 1)).when(k % 3 == 0, F.lit("wf")).otherwise(F.lit("wf@x"))
    return o.select("o_orderkey", text.name_and_version(arg).alias("v")).select("o_orderkey", "v.name", "v.version")


@query(
    """WITH last AS (SELECT conv_id, max(turn) + 1 AS l, bool_or(role = 'system') AS ended FROM conversations GROUP BY conv_id), n AS (SELECT c.conv_id AS run_id, l + row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS seq, text FROM conversations c JOIN last USING (conv_id) WHERE turn < 2 AND NOT ended)
SELECT run_id, seq, md5(text) AS h FROM n"""
)
def k01_append(spark, sf_dir):
    c = registry.table(spark, sf_dir, "conversations")
    j = c.select(F.col("conv_id").alias("run_id"), (F.col("turn") + 1).alias("seq"), F.when(F.col("role") == "system", "RUN_FAILED").otherwise("RUN_STARTED").alias("type"))
    new = c.where("turn < 2").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("ord"), "text")
    return ops.append_events(j, new)[0].select("run_id", "seq", F.md5("text").alias("h"))
