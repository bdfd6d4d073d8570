"""Operational tables as projections of star-schema tables: runs over orders, workflows over customer, tasks over lineitem
(one row a run and line number), workers over supplier. The same text serves Spark and DuckDB but for interval syntax."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "1997-01-01 00:00:00"

_SPARK = {"after": lambda ts, s: f"({ts} + make_dt_interval(0, 0, 0, cast({s} as decimal(18, 6))))", "text": "string"}
_DUCK = {"after": lambda ts, s: f"({ts} + to_seconds({s}))", "text": "varchar"}


def _selects(d: dict) -> dict[str, str]:
    after, text = d["after"], d["text"]
    terminal = "o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderkey % 4 < 2)"
    return {
        "runs": f"""SELECT o_orderkey AS id, o_custkey AS workflow_id,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'RUNNING' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'QUEUED' ELSE 'CREATED' END END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS scenario_name, o_orderkey % 97 AS seed, o_orderkey % 6 + 6 AS event_seq, o_orderdate AS created_at,
  CASE WHEN {terminal} THEN {after("o_orderdate", "o_orderkey % 600 + 1")} END AS completed_at FROM orders""",
        "workflows": "SELECT c_custkey AS id, c_mktsegment AS name, c_custkey AS version, md5(c_name) AS definition_hash FROM customer",
        "tasks": f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS run_id, concat('t', cast(l_linenumber AS {text})) AS task_name, cast(l_quantity AS int) % 4 AS attempt, 3 AS max_attempts, status,
  CASE WHEN status IN ('LEASED', 'RUNNING') THEN l_suppkey END AS worker_id, CASE WHEN status IN ('LEASED', 'RUNNING') THEN {after("l_shipdate", "l_partkey % 3600")} END AS lease_expires_at,
  l_shipdate AS scheduled_at, CASE WHEN status IN ('FAILED', 'DEAD') THEN concat('error ', l_returnflag) END AS error, l_partkey AS part
  FROM (SELECT *, CASE l_partkey % 8 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'READY' WHEN 2 THEN 'LEASED' WHEN 3 THEN 'RUNNING' WHEN 4 THEN 'SUCCEEDED' WHEN 5 THEN 'FAILED' WHEN 6 THEN 'RETRYING' ELSE 'DEAD' END AS status,
   row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS nth FROM lineitem) x WHERE nth = 1""",
        "workers": f"""SELECT s_suppkey AS id, s_name AS hostname, CASE s_suppkey % 10 WHEN 8 THEN 'SUSPECT' WHEN 9 THEN 'LOST' WHEN 7 THEN 'STOPPED' ELSE 'HEALTHY' END AS status, s_nationkey % 8 + 1 AS capacity, s_suppkey % 4 AS active_tasks,
  {after("timestamp_now", "-(s_suppkey * 7 % 40)")} AS last_heartbeat FROM supplier""".replace("timestamp_now", f"cast('{NOW}' AS {'timestamp_ntz' if d is _SPARK else 'timestamp'})"),
        "ledger": f"SELECT concat(cast(l_orderkey AS {text}), ':t', cast(l_linenumber AS {text}), ':charge') AS idempotency_key, l_orderkey AS run_id, concat('t', cast(l_linenumber AS {text})) AS task_name, l_partkey AS attempt, l_shipdate AS created_at FROM lineitem",
    }


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of runs, workflows, tasks, workers, ledger."""
    base = {"runs": "orders", "workflows": "customer", "tasks": "lineitem", "workers": "supplier", "ledger": "lineitem"}[name]
    text = _selects(_SPARK)[name].replace(f"FROM {base}", f"FROM {{{base}}}")
    return spark.sql(text, **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet")})


def sql(*names: str) -> str:
    """Common table expressions for DuckDB."""
    return ",\n".join(f"{n} AS ({_selects(_DUCK)[n]})" for n in names)
