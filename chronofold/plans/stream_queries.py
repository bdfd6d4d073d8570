"""Streaming queries, drained over what is there, and the nested snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import at
from ..operators import metrics
from ..sources import projections as P
from ..sources import storage, tables, template
from ..streaming import append, ledger, observed
from ..streaming import journal as streaming
from .registry import query


def _events(spark, sf_dir):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return streaming.tail(spark, f"{sf_dir}/events.parquet", schema)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def t10_stream_tail(spark, sf_dir):
    got = streaming.drain(_events(spark, sf_dir).select("event_type", "user_id"), storage.new_path(spark, "tail"), storage.new_path(spark, "tail-checkpoint"))
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT DISTINCT user_id || ':' || event_type AS key FROM events")
def t08_stream_once_by_key(spark, sf_dir):
    keyed = _events(spark, sf_dir).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    once = streaming.once_by_key(keyed, "key", "at", "36500 days").select("key")
    return streaming.drain(once, storage.new_path(spark, "once"), storage.new_path(spark, "once-checkpoint"))


@query(
    """WITH j AS (SELECT conv_id AS run_id, turn, turn + 1 + CASE WHEN turn >= 2 AND conv_id % 5 = 0 THEN 1 ELSE 0 END AS seq, bool_or(turn = 2 AND conv_id % 3 = 0) OVER (PARTITION BY conv_id) AS ends FROM conversations),
l AS (SELECT *, lag(seq, 1, 0) OVER (PARTITION BY run_id ORDER BY turn) AS last FROM j)
SELECT run_id, CASE WHEN ends AND turn > 2 THEN 'after-terminal' ELSE 'gap' END AS kind, CASE WHEN NOT (ends AND turn > 2) THEN last + 1 END AS expected, seq AS found FROM l WHERE ends AND turn > 2 OR seq <> last + 1"""
)
def t09_stream_contiguity(spark, sf_dir):
    turns = streaming.tail(spark, f"{sf_dir}/conversations.parquet", "conv_id long, turn long, role string, text string")
    seq = F.col("turn") + 1 + F.when((F.col("turn") >= 2) & (F.col("conv_id") % 5 == 0), 1).otherwise(0)
    kind = F.when((F.col("turn") == 2) & (F.col("conv_id") % 3 == 0), "RUN_SUCCEEDED").otherwise("RUN_STARTED")
    found = streaming.contiguity(turns.select(F.col("conv_id").alias("run_id"), seq.alias("seq"), kind.alias("type")))
    return streaming.drain(found, storage.new_path(spark, "gaps"), storage.new_path(spark, "gaps-checkpoint"))


_TURNS = """WITH t AS (SELECT conv_id AS run_id, turn AS ord, CASE WHEN turn = 3 AND conv_id % 3 = 0 THEN 'RUN_SUCCEEDED' ELSE 'TASK_STARTED' END AS type, md5(text) AS payload FROM conversations),
n AS (SELECT *, row_number() OVER w AS seq, coalesce(bool_or(type = 'RUN_SUCCEEDED') OVER (PARTITION BY run_id ORDER BY ord, type, payload ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM t WINDOW w AS (PARTITION BY run_id ORDER BY ord, type, payload))"""
_TURN = "run_id long, ord long, type string, payload string"


def _appended(spark, sf_dir):
    """The log after all turns were appended as a stream; in every third conversation the run ends with the fourth."""
    path, turns = storage.new_path(spark, "log"), streaming.tail(spark, f"{sf_dir}/conversations.parquet", "conv_id long, turn long, role string, text string")
    kind = F.when((F.col("turn") == 3) & (F.col("conv_id") % 3 == 0), "RUN_SUCCEEDED").otherwise("TASK_STARTED")
    stream = turns.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("ord"), kind.alias("type"), F.md5("text").alias("payload"))
    append.append(stream, path, storage.new_path(spark, "log-checkpoint"), buckets=16).awaitTermination()
    return path


@query(f"{_TURNS} SELECT run_id, seq, type, payload FROM n WHERE NOT late")
def k01_stream_append(spark, sf_dir):
    return append.events(spark, _appended(spark, sf_dir), "run_id long, type string, payload string, seq long").select("run_id", "seq", "type", "payload")


@query(f"{_TURNS} SELECT run_id, ord, type, payload FROM n WHERE late")
def t09_stream_refused(spark, sf_dir):
    return append.refused(spark, _appended(spark, sf_dir), _TURN).select("run_id", "ord", "type", "payload")


@query(
    """WITH a AS (SELECT l_orderkey || ':t' || (l_linenumber // 3) AS key, l_orderkey AS run_id, 't' || (l_linenumber // 3) AS task, l_partkey::INT AS attempt, md5(l_suppkey::VARCHAR) AS result, l_shipdate AS made FROM lineitem),
r AS (SELECT *, row_number() OVER w AS nth, first_value(attempt) OVER w AS first_attempt, first_value(result) OVER w AS won FROM a WINDOW w AS (PARTITION BY key ORDER BY made, attempt, run_id, task, result))
SELECT key AS idempotency_key, attempt, CASE WHEN nth = 1 THEN 'recorded' ELSE 'skipped' END AS outcome, first_attempt, won AS result FROM r"""
)
def t08_stream_ledger(spark, sf_dir):
    """Effects of orders, of which lines share keys, as they arrive by year; the second year arrives twice."""
    task = F.concat(F.lit("t"), F.floor(F.col("l_linenumber") / 3).cast("string"))
    asked = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), task).alias("idempotency_key"), F.col("l_orderkey").alias("run_id"), task.alias("task_name"),
        F.col("l_partkey").cast("int").alias("attempt"), F.md5(F.col("l_suppkey").cast("string")).alias("result"), F.col("l_shipdate").cast("timestamp_ntz").alias("created_at"),
    )
    path = storage.new_path(spark, "ledger")
    for n, (low, high) in enumerate((("0001-01-01", "1994-01-01"), ("1994-01-01", "1996-01-01"), ("1996-01-01", "9999-01-01"))):
        for _ in range(2 if n == 1 else 1):
            ledger.do_batch(asked.where((F.col("created_at") >= at(low)) & (F.col("created_at") < at(high))), n, path, 16)
    return ledger.outcomes(spark, path).select("idempotency_key", "attempt", "outcome", "first_attempt", "result")


_BETWEEN = list(zip(["-Infinity", *metrics.RUN_BOUNDS], [*metrics.RUN_BOUNDS, "Infinity"], strict=True))


@query(
    "SELECT 'events_total' AS metric, count(*)::DOUBLE AS value FROM events UNION ALL SELECT 'errors_total', (count(*) FILTER (WHERE event_type = 'error'))::DOUBLE FROM events"
    " UNION ALL SELECT 'value_count', count(value)::DOUBLE FROM events UNION ALL SELECT 'value_sum', round(sum(value), 2) FROM events"
    + "".join(f" UNION ALL SELECT 'value_bucket:{'+Inf' if high == 'Infinity' else f'{high:g}'}', (count(*) FILTER (WHERE value > '{low}'::DOUBLE AND value <= '{high}'::DOUBLE))::DOUBLE FROM events" for low, high in _BETWEEN)
)
def k10_observed_figures(spark, sf_dir):
    """Counters and a histogram of the events, taken while they are written as a stream."""
    path = storage.new_path(spark, "observed")
    figures = observed.counter("events_total") | observed.counter("errors_total", F.col("event_type") == "error") | observed.histogram("value", F.col("value"), metrics.RUN_BOUNDS)
    observed.write(_events(spark, sf_dir).select("event_type", "value"), path, storage.new_path(spark, "observed-checkpoint"), figures).awaitTermination()
    return observed.totals(spark, path).withColumn("value", F.round("value", 2))


_T = f"TIMESTAMP '{P.NOW}'"


@query(
    f"""WITH {P.sql("tasks", "runs", "workers")}, lost AS (SELECT id FROM workers WHERE status IN ('HEALTHY', 'SUSPECT') AND last_heartbeat <= {_T} - INTERVAL 25 SECOND),
t AS (SELECT *, CASE WHEN worker_id IN (SELECT id FROM lost) THEN {_T} ELSE lease_expires_at END AS due FROM tasks WHERE status IN ('LEASED', 'RUNNING'))
SELECT t.id, CASE WHEN r.status IN ('SUCCEEDED', 'FAILED', 'CANCELLED') THEN 'abandon' WHEN t.attempt < 3 THEN 'requeue' ELSE 'dead' END AS fate FROM t LEFT JOIN runs r ON r.id = t.run_id WHERE due <= {_T}"""
)
def t02_reap(spark, sf_dir):
    tasks, runs, workers = (P.table(spark, sf_dir, n) for n in ("tasks", "runs", "workers"))
    return streaming.reap(tasks, runs, workers, at(P.NOW))["leases"].select("id", "fate")


@query(
    f"""WITH {template.journal_sql()}, {P.sql("runs", "tasks")},
t AS (SELECT run_id, string_agg(task_name || ':' || status || ':' || attempt, ',' ORDER BY task_name) AS tasks FROM tasks GROUP BY run_id),
e AS (SELECT run_id, string_agg(seq || ':' || type || ':' || coalesce(task_name, '') || ':' || md5(payload), ',' ORDER BY seq) AS events FROM journal GROUP BY run_id)
SELECT r.id AS run_id, r.status || ':' || r.seed AS run, t.tasks, e.events FROM runs r LEFT JOIN t ON t.run_id = r.id LEFT JOIN e ON e.run_id = r.id"""
)
def k04_snapshot(spark, sf_dir):
    """The nested rows of the snapshot, flattened again in their order."""
    runs = P.table(spark, sf_dir, "runs")
    tasks = P.table(spark, sf_dir, "tasks").select("run_id", "task_name", "status", "attempt")
    rows = tables.snapshot(runs, tasks, template.journal(spark, sf_dir).select("run_id", "seq", "type", "task_name", "payload"))
    said = lambda x, *names: F.concat_ws(":", *[F.coalesce(x[n].cast("string"), F.lit("")) for n in names])
    task = F.array_join(F.transform("tasks", lambda x: said(x, "task_name", "status", "attempt")), ",")
    event = F.array_join(F.transform("events", lambda x: F.concat_ws(":", said(x, "seq", "type", "task_name"), F.md5(x["payload"]))), ",")
    return rows.select("run_id", F.concat_ws(":", "run.status", "run.seed").alias("run"), task.alias("tasks"), event.alias("events"))
