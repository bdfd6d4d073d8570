"""The remaining lookups, projections, set operations and single figures of the inventory, each over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import draws, text
from ..functions.time import at, clock
from ..operators import checks, compare, fold, ops, recovery
from ..sources import projections as P
from ..sources import tables
from ..sources.template import journal
from .journal_queries import _RUN_STATE, _TASK_STATE, RECOVERY_SQL
from .registry import query, table

T = f"TIMESTAMP '{P.NOW}'"


def _p(*names: str) -> str:
    return "WITH " + P.sql(*names) + " "


@query("SELECT run_id, max(seq) AS last_seq, count(*) AS n FROM journal GROUP BY run_id", journal=True)
def s07_last_seq(spark, sf_dir):
    return journal(spark, sf_dir).groupBy("run_id").agg(F.max("seq").alias("last_seq"), F.count("*").alias("n"))


@query(_p("workflows") + "SELECT id, name, version FROM workflows WHERE id = 42")
def s10_workflow_by_id(spark, sf_dir):
    return P.table(spark, sf_dir, "workflows").where("id = 42").select("id", "name", "version")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 = 0")
def s11_definitions_that_changed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    recorded = F.when(F.col("c_custkey") % 10 == 0, F.lit("other")).otherwise(F.sha2("c_name", 256))
    return c.where(F.sha2("c_name", 256) != recorded).select(F.col("c_custkey").alias("id"))


@query(_p("tasks") + "SELECT id, task_name, status, scheduled_at FROM tasks WHERE run_id IN (7, 32, 64)")
def s12_tasks_of_runs(spark, sf_dir):
    return P.table(spark, sf_dir, "tasks").where(F.col("run_id").isin(7, 32, 64)).orderBy("scheduled_at", "task_name").select("id", "task_name", "status", "scheduled_at")


@query("SELECT l_orderkey AS run_id, l_linenumber AS task, string_agg(n, ',' ORDER BY n) AS artifacts FROM (SELECT DISTINCT l_orderkey, l_linenumber, md5(l_partkey::VARCHAR) AS n FROM lineitem) GROUP BY 1, 2")
def s15_stored_artifacts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("task"), F.md5(F.col("l_partkey").cast("string")).alias("n"))
    return li.groupBy("run_id", "task").agg(F.array_join(F.sort_array(F.collect_set("n")), ",").alias("artifacts"))


@query(_p("runs") + "SELECT id, status, coalesce(scenario_name, '') AS scenario_name, seed, event_seq, created_at FROM runs")
def p01_run_columns(spark, sf_dir):
    r = P.table(spark, sf_dir, "runs")
    return r.select("id", "status", F.coalesce("scenario_name", F.lit("")).alias("scenario_name"), "seed", "event_seq", "created_at")


@query(_p("tasks") + "SELECT id, run_id, task_name, attempt, status, coalesce(error, '') AS error FROM tasks")
def p02_task_columns(spark, sf_dir):
    return P.table(spark, sf_dir, "tasks").select("id", "run_id", "task_name", "attempt", "status", F.coalesce("error", F.lit("")).alias("error"))


@query(_p("tasks") + f"SELECT id, 'LEASED' AS status FROM tasks WHERE status = 'READY' AND scheduled_at <= {T} AND run_id = 3 ORDER BY scheduled_at, id LIMIT 5")
def p04_claim_for_run(spark, sf_dir):
    return ops.claim(P.table(spark, sf_dir, "tasks"), at(P.NOW), 1, 5, run_id=3).select("id", "status")


@query(_p("tasks") + "SELECT id, status FROM tasks WHERE status IN ('LEASED', 'RUNNING')")
def p06_held_tasks(spark, sf_dir):
    return P.table(spark, sf_dir, "tasks").where(F.col("status").isin(*V.TASK_HOLDS)).select("id", "status")


@query(_p("tasks") + "SELECT id FROM tasks WHERE status IN ('READY', 'RETRYING') AND id IN (SELECT o_orderkey * 10 + 1 FROM orders WHERE o_orderkey % 50 = 0)")
def p07_any_of(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select((F.col("o_orderkey") * 10 + 1).alias("id"))
    return P.table(spark, sf_dir, "tasks").where("status in ('READY', 'RETRYING')").join(wanted, "id", "left_semi").select("id")


@query(_p("workers") + "SELECT id FROM workers WHERE status NOT IN ('LOST', 'STOPPED')")
def p08_accepting_workers(spark, sf_dir):
    return P.table(spark, sf_dir, "workers").where(~F.col("status").isin("LOST", "STOPPED")).select("id")


@query(_p("runs") + "SELECT id, completed_at IS NULL AS open FROM runs")
def p09_open_runs(spark, sf_dir):
    return P.table(spark, sf_dir, "runs").select("id", F.col("completed_at").isNull().alias("open"))


@query(_p("tasks") + f"SELECT id FROM tasks WHERE scheduled_at <= {T} AND scheduled_at > {T} - INTERVAL 30 DAY")
def p10_time_range(spark, sf_dir):
    t = P.table(spark, sf_dir, "tasks")
    return t.where((F.col("scheduled_at") <= at(P.NOW)) & (F.col("scheduled_at") > at("1996-12-02 00:00:00"))).select("id")


@query(f"SELECT run_id, seq, type IN ({V.sql_list(V.EVENT_TYPES)}) AS known, type IN ({V.sql_list(V.TERMINAL_TYPES)}) AS terminal FROM damaged", damaged=True)
def p11_known_and_terminal_types(spark, sf_dir):
    from ..sources.template import corrupted

    return corrupted(journal(spark, sf_dir)).select("run_id", "seq", F.col("type").isin(*V.EVENT_TYPES).alias("known"), F.col("type").isin(*V.TERMINAL_TYPES).alias("terminal"))


@query("SELECT run_id, bool_or(payload->>'$.fault_type' = 'http-error' AND task_name = 'validate') AS has FROM journal WHERE type = 'FAULT_INJECTED' GROUP BY run_id", journal=True)
def p18_has_fault(spark, sf_dir):
    f = fold.run_state(journal(spark, sf_dir)).where(F.size("faults") > 0)
    return f.select("run_id", F.exists("faults", lambda x: (x["type"] == "http-error") & (x["task"] == "validate")).alias("has"))


@query(f"SELECT g.grp AS \"group\", count(*) AS n FROM journal j JOIN (VALUES {', '.join(f'({k!r}, {g!r})' for k, gs in V.GROUPS_OF.items() for g in gs)}) g(type, grp) ON g.type = j.type GROUP BY 1", journal=True)
def p27_groups(spark, sf_dir):
    return recovery.group_counts(journal(spark, sf_dir)).where("group <> 'all'").groupBy("group").agg(F.sum("n").alias("n"))


@query("SELECT event_id, nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, '') AS task_name FROM events")
def p30_empty_is_null(spark, sf_dir):
    from ..sources.tables import journal as as_journal

    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("task_name"))
    return as_journal(e)


@query(_p("tasks") + "SELECT id, part % 3 <> 0 AND attempt < 3 AS again FROM tasks WHERE status = 'FAILED'")
def p32_should_retry(spark, sf_dir):
    t = P.table(spark, sf_dir, "tasks").where("status = 'FAILED'")
    return t.select("id", draws.should_retry(F.col("attempt"), F.lit(3), F.col("part") % 3 == 0).alias("again"))


@query(_p("runs", "workflows") + "SELECT r.id, w.name, w.definition_hash FROM runs r JOIN workflows w ON w.id = r.workflow_id")
def v24_definition_of_run(spark, sf_dir):
    w = P.table(spark, sf_dir, "workflows").select(F.col("id").alias("workflow_id"), "name", "definition_hash")
    return P.table(spark, sf_dir, "runs").join(w, "workflow_id").select("id", "name", "definition_hash")


@query(_p("ledger", "tasks") + "SELECT t.run_id, count(*) AS n FROM tasks t WHERE (t.run_id, t.task_name) IN (SELECT DISTINCT run_id, task_name FROM ledger WHERE attempt % 2 = 0) GROUP BY t.run_id")
def j03_effect_attempts(spark, sf_dir):
    had = P.table(spark, sf_dir, "ledger").where("attempt % 2 = 0").select("run_id", "task_name").distinct()
    return P.table(spark, sf_dir, "tasks").join(had, ["run_id", "task_name"], "left_semi").groupBy("run_id").agg(F.count("*").alias("n"))


@query(_p("tasks") + "SELECT DISTINCT run_id FROM tasks WHERE status = 'DEAD'")
def a10_distinct_runs(spark, sf_dir):
    return P.table(spark, sf_dir, "tasks").where("status = 'DEAD'").select("run_id").distinct()


@query("SELECT coalesce(max(l_linenumber), 0) AS version FROM lineitem")
def a07_schema_version(spark, sf_dir):
    return tables.schema_version(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("version")))


@query(f"SELECT run_id, max(retries) AS max_retries, count(*) FILTER (WHERE status = 'DEAD') AS lost FROM ({_TASK_STATE}) GROUP BY run_id", journal=True)
def a12_retries_and_losses(spark, sf_dir):
    return fold.totals(fold.task_state(journal(spark, sf_dir))).select("run_id", "max_retries", "lost")


@query(f"SELECT run_id, coalesce(ms::VARCHAR, '-') AS recovery FROM {RECOVERY_SQL}", journal=True)
def a18_recovery_or_dash(spark, sf_dir):
    return recovery.evidence(journal(spark, sf_dir)).select("run_id", F.coalesce(F.col("recovery_ms").cast("string"), F.lit("-")).alias("recovery"))


@query(_p("tasks", "runs") + f"SELECT fate, count(*) AS n FROM (SELECT CASE WHEN r.status IN ('SUCCEEDED', 'FAILED', 'CANCELLED') THEN 'abandon' WHEN t.attempt < 3 THEN 'requeue' ELSE 'dead' END AS fate FROM tasks t LEFT JOIN runs r ON r.id = t.run_id WHERE t.status IN ('LEASED', 'RUNNING') AND t.lease_expires_at <= {T}) GROUP BY fate")
def a25_reap_counts(spark, sf_dir):
    return ops.tally(ops.expired_leases(P.table(spark, sf_dir, "tasks"), P.table(spark, sf_dir, "runs"), at(P.NOW), limit=None), "fate")


@query(f"SELECT run_id, string_agg(task_name, ',' ORDER BY task_name) AS tasks, any_value(s) IN ({V.sql_list(V.RUN_TERMINAL)}) AS terminal FROM ({_TASK_STATE}) t JOIN (SELECT run_id AS r, status AS s FROM ({_RUN_STATE})) ON r = run_id GROUP BY run_id", journal=True)
def r05_task_names(spark, sf_dir):
    j = journal(spark, sf_dir)
    names = fold.task_state(j).groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("task_name")), ",").alias("tasks"))
    return names.join(fold.run_state(j), "run_id").select("run_id", "tasks", F.col("status").isin(*V.RUN_TERMINAL).alias("terminal"))


@query("SELECT run_id, task_name, count(*) AS n FROM (SELECT run_id, task_name, unnest(from_json(payload->'$.artifacts', '[{\"name\":\"VARCHAR\"}]')) AS a FROM journal WHERE type = 'TASK_SUCCEEDED' AND (payload->'$.artifacts') IS NOT NULL) GROUP BY ALL", journal=True)
def r03_artifacts(spark, sf_dir):
    return fold.task_state(journal(spark, sf_dir)).where(F.size("artifacts") > 0).select("run_id", "task_name", F.size("artifacts").cast("long").alias("n"))


@query(_p("workflows") + "SELECT name, max(version) AS version FROM workflows GROUP BY name")
def w07_highest_version(spark, sf_dir):
    return ops.latest_version(P.table(spark, sf_dir, "workflows")).select("name", "version")


@query(_p("runs") + "SELECT id, count(*) OVER () > 19 AS more FROM (SELECT * FROM runs ORDER BY created_at DESC, id DESC LIMIT 20) QUALIFY row_number() OVER (ORDER BY created_at DESC, id DESC) <= 20")
def o10_export_newest(spark, sf_dir):
    r = P.table(spark, sf_dir, "runs").orderBy(F.desc("created_at"), F.desc("id")).limit(20)
    return r.select("id", F.lit(True).alias("more"))


@query("SELECT coalesce(a.n, b.n) AS name, a.n IS NULL AS added, b.n IS NULL AS removed FROM (SELECT DISTINCT p_brand AS n FROM part WHERE p_partkey % 2 = 0 AND p_size < 10) a FULL JOIN (SELECT DISTINCT p_brand AS n FROM part WHERE p_partkey % 2 = 1 AND p_size > 40) b ON a.n = b.n")
def u01_union_and_differences(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.where("p_partkey % 2 = 0 and p_size < 10").select(F.col("p_brand").alias("name")).distinct().withColumn("l", F.lit(True))
    b = p.where("p_partkey % 2 = 1 and p_size > 40").select(F.col("p_brand").alias("name")).distinct().withColumn("r", F.lit(True))
    return a.join(b, "name", "full").select("name", F.col("l").isNull().alias("added"), F.col("r").isNull().alias("removed"))


@query("SELECT run_id, seq FROM journal WHERE type = 'RUN_STARTED' UNION SELECT run_id, seq FROM journal WHERE seq = 6", journal=True)
def u05_distinct_union(spark, sf_dir):
    j = journal(spark, sf_dir)
    return j.where("type = 'RUN_STARTED'").select("run_id", "seq").union(j.where("seq = 6").select("run_id", "seq")).dropDuplicates(["run_id", "seq"])


@query("SELECT DISTINCT payload->>'$.handler' AS handler FROM journal WHERE type = 'TASK_STARTED' AND payload->>'$.handler' NOT IN ('h')", journal=True)
def u06_unregistered_handlers(spark, sf_dir):
    j = journal(spark, sf_dir).where("type = 'TASK_STARTED'").select(text.decode(F.col("payload"))["handler"].alias("handler")).distinct()
    return j.join(spark.createDataFrame([("h",)], "handler string"), "handler", "left_anti")


@query("SELECT run_id, seq, (payload->>'$.v') IS NOT NULL AS versioned, coalesce(payload->>'$.v' = '1', false) AS current FROM damaged", damaged=True)
def f02_payload_versions(spark, sf_dir):
    from ..sources.template import corrupted

    v = F.get_json_object("payload", "$.v")
    return corrupted(journal(spark, sf_dir)).select("run_id", "seq", v.isNotNull().alias("versioned"), F.coalesce(v == "1", F.lit(False)).alias("current"))


@query("""SELECT event_id, '{"v":1,"attempt":' || event_id % 5 || ',"error":"' || event_type || '"}' AS payload FROM events""")
def f01_encode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.encode(attempt=F.col("event_id") % 5, error=F.col("event_type")).alias("payload"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') AS t FROM events")
def f12_precise_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", clock(F.col("ts"), precise=True).alias("t"))


@query(_p("tasks") + f"SELECT id, {T} - to_seconds(attempt * 5) AS threshold, greatest(attempt, 1) AS attempts FROM tasks")
def f30_thresholds(spark, sf_dir):
    from ..functions.time import plus_ms

    t = P.table(spark, sf_dir, "tasks")
    return t.select("id", plus_ms(at(P.NOW), -F.col("attempt") * 5000).alias("threshold"), F.greatest(F.col("attempt"), F.lit(1)).alias("attempts"))


@query("SELECT run_id, printf('%-15s %-20s expected %s, got %s', 'attempt-count', 'run', '1', attempts::VARCHAR) AS line FROM (SELECT run_id, count(*) AS attempts FROM journal WHERE type = 'TASK_STARTED' GROUP BY run_id) WHERE attempts <> 1", journal=True)
def f39_divergence_lines(spark, sf_dir):
    e = recovery.evidence(journal(spark, sf_dir)).where("attempts <> 1 and attempts > 0")
    return e.select("run_id", compare.line(F.lit("attempt-count"), F.lit("run"), F.lit("1"), F.col("attempts").cast("string")).alias("line"))


@query(_p("runs") + "SELECT id, status FROM runs WHERE status NOT IN ('SUCCEEDED', 'FAILED', 'CANCELLED')")
def v23_open_runs(spark, sf_dir):
    return P.table(spark, sf_dir, "runs").where(~F.col("status").isin(*V.RUN_TERMINAL)).select("id", "status")


@query(_p("tasks") + "SELECT id, task_name || ' ' || status || CASE WHEN attempt > 1 THEN ' (attempt ' || attempt || ')' ELSE '' END AS line FROM tasks")
def v15_task_lines(spark, sf_dir):
    t = P.table(spark, sf_dir, "tasks")
    return t.select("id", F.concat(F.concat_ws(" ", "task_name", "status"), F.when(F.col("attempt") > 1, F.format_string(" (attempt %d)", "attempt")).otherwise("")).alias("line"))


@query("SELECT run_id, count(*) AS fired FROM journal WHERE type = 'FAULT_INJECTED' GROUP BY run_id", journal=True)
def v26_fired(spark, sf_dir):
    return recovery.evidence(journal(spark, sf_dir)).where("faults_injected > 0").select("run_id", F.col("faults_injected").alias("fired"))


@query(_p("runs") + "SELECT id, CASE WHEN id % 3 <> 0 THEN id % 3 ELSE seed END AS seed FROM runs")
def v27_seed_override(spark, sf_dir):
    r = P.table(spark, sf_dir, "runs")
    return r.select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 3).otherwise(F.col("seed")).alias("seed"))


@query("SELECT o_orderkey, regexp_full_match(u, '[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}') AS valid FROM (SELECT o_orderkey, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 11 END) AS u FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS m FROM orders))")
def v11_run_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("m"))
    parts = [F.substring("m", 1, 8), F.substring("m", 9, 4), F.substring("m", 13, 4), F.substring("m", 17, 4), F.when(F.col("o_orderkey") % 2 == 0, F.substring("m", 21, 12)).otherwise(F.substring("m", 21, 11))]
    return o.select("o_orderkey", text.valid_uuid(F.concat_ws("-", *parts)).alias("valid"))


@query("SELECT l_orderkey * 10 + l_linenumber AS task_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def a27_concurrent_attempts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task_id"))
    return checks.repeated(li, "task_id")
