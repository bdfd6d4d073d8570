"""Scalar functions and single-table predicates over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text
from ..functions.time import duration_ms
from ..sources import projections as P
from ..sources.template import journal
from .registry import query, table

_K = "o_orderkey"


@query(
    f"""SELECT {_K}, CASE {_K} % 5 WHEN 0 THEN ({_K} % 90) * 1000 WHEN 1 THEN ({_K} % 90) * 60000 + 30000 WHEN 2 THEN {_K} % 900 WHEN 3 THEN NULL ELSE 5400000 END::BIGINT AS ms FROM orders"""
)
def f16_durations(spark, sf_dir):
    k = F.col(_K)
    n = lambda m: (k % m).cast("string")
    s = F.when(k % 5 == 0, F.concat(n(90), F.lit("s"))).when(k % 5 == 1, F.concat(n(90), F.lit("m30s"))).when(k % 5 == 2, F.concat(n(900), F.lit("ms"))).when(k % 5 == 3, n(90)).otherwise(F.lit("1.5h"))
    return table(spark, sf_dir, "orders").select(_K, duration_ms(s).alias("ms"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 2048 THEN substr(text, 1, (SELECT max(k) FROM range(512, 2049) r(k) WHERE strlen(substr(text, 1, k)) <= 2048)) || '... (truncated)' ELSE text END AS t FROM documents")
def f08_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_error(F.col("text")).alias("t"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey || ':t' || l_linenumber || ':charge' AS key FROM lineitem")
def f13_effect_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", text.effect_key(F.col("l_orderkey"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")), F.lit("charge")).alias("key"))


@query("SELECT s_suppkey, replace(replace('dial postgres://u:pw@h/' || s_name || ' pw', 'postgres://u:pw@h/' || s_name, '[redacted]'), 'pw', '[redacted]') AS said FROM supplier")
def f34_redact(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    dsn = F.concat(F.lit("postgres://u:pw@h/"), "s_name")
    return s.select("s_suppkey", text.redact(F.concat(F.lit("dial "), dsn, F.lit(" pw")), dsn, F.lit("pw")).alias("said"))


@query(f"SELECT {_K}, CASE {_K} % 6 WHEN 0 THEN 'conflict' WHEN 1 THEN 'reference' WHEN 2 THEN 'check' WHEN 3 THEN 'serialization' WHEN 4 THEN 'deadlock' ELSE 'other' END AS class FROM orders")
def f35_error_classes(spark, sf_dir):
    codes = F.array(*map(F.lit, ("23505", "23503", "23514", "40001", "40P01", "42601")))
    return table(spark, sf_dir, "orders").select(_K, text.sqlstate_class(F.element_at(codes, (F.col(_K) % 6 + 1).cast("int"))).alias("class"))


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments, count(*) || CASE WHEN count(*) = 1 THEN ' customer' ELSE ' customers' END AS n FROM customer GROUP BY c_nationkey")
def f36_format_set(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("s"), F.count("*").alias("k"))
    return g.select("c_nationkey", text.format_set(F.col("s")).alias("segments"), text.plural(F.col("k"), "customer").alias("n"))


@query("SELECT r_regionkey, r_regionkey AS version, lower(r_name) AS name FROM region")
def f41_migration_names(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    file = F.concat(F.lpad(F.col("r_regionkey").cast("string"), 3, "0"), F.lit("_"), F.lower("r_name"), F.lit(".sql"))
    return r.select("r_regionkey", text.migration_name(file).alias("m")).select("r_regionkey", "m.*")


@query("SELECT doc_id, doc_id % 2 = 0 AS valid FROM documents")
def p22_valid_hashes(spark, sf_dir):
    h = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", text.valid_sha256(F.when(F.col("doc_id") % 2 == 0, h).otherwise(F.upper(F.concat(F.lit("x"), h)))).alias("valid"))


@query("SELECT event_id, (props::JSON->>'$.k') IS NOT NULL AS ok FROM events")
def p25_payload_is_object(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT") & F.get_json_object("props", "$.k").isNotNull()).alias("ok"))


@query(f"SELECT run_id, seq FROM journal WHERE type IN ('TASK_FAILED', 'TASK_DEAD_LETTERED', 'WORKER_LOST', 'TASK_LEASE_EXPIRED', 'FAULT_INJECTED', {V.sql_list(V.TERMINAL_TYPES)})", journal=True)
def p33_highlighted(spark, sf_dir):
    return journal(spark, sf_dir).where(F.col("type").isin(*V.TROUBLE_TYPES, "TASK_DEAD_LETTERED", *V.TERMINAL_TYPES)).select("run_id", "seq")


@query("SELECT run_id, coalesce(min((payload->>'$.attempt')::INT) FILTER (WHERE type = 'SIDE_EFFECT_SKIPPED'), 0) AS first_attempt, max(seq) AS last_seq FROM journal GROUP BY run_id", journal=True)
def a06_first_recorded_attempt(spark, sf_dir):
    attempt = text.decode(F.col("payload"))["attempt"]
    return journal(spark, sf_dir).groupBy("run_id").agg(F.coalesce(F.min(F.when(F.col("type") == "SIDE_EFFECT_SKIPPED", attempt)), F.lit(0)).alias("first_attempt"), F.max("seq").alias("last_seq"))


@query("SELECT DISTINCT type FROM journal WHERE type NOT IN (" + V.sql_list(k for k, g in V.GROUPS_OF.items() if g) + ")", journal=True)
def j12_ungrouped_types(spark, sf_dir):
    j = journal(spark, sf_dir)
    return j.where(F.size(text.groups(F.col("type"))) == 0).select("type").distinct()


@query(f"WITH {P.sql('runs')} SELECT id, status IN ({V.sql_list(V.RUN_TERMINAL)}) AS terminal, completed_at IS NULL AS open FROM runs")
def p13_terminal_runs(spark, sf_dir):
    r = P.table(spark, sf_dir, "runs")
    return r.select("id", F.col("status").isin(*V.RUN_TERMINAL).alias("terminal"), F.col("completed_at").isNull().alias("open"))


@query(f"WITH {P.sql('tasks')} SELECT run_id, map_from_entries(list((task_name, status) ORDER BY task_name))::VARCHAR AS x, count(*) AS n FROM tasks WHERE task_name IN ('t1', 't2') GROUP BY run_id".replace("map_from_entries(list((task_name, status) ORDER BY task_name))::VARCHAR AS x", "string_agg(task_name || '=' || status, ',' ORDER BY task_name) AS x"))
def s13_dependency_outputs(spark, sf_dir):
    t = P.table(spark, sf_dir, "tasks").where(F.array_contains(F.array(F.lit("t1"), F.lit("t2")), F.col("task_name")))
    pairs = F.array_sort(F.collect_list(F.struct("task_name", "status")))
    return t.groupBy("run_id").agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["task_name"], p["status"])), ",").alias("x"), F.count("*").alias("n"))
