"""Queries over workflow graphs, fault scenarios and simulated runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text
from ..operators import checks, dag, faults, simulate
from ..sources import examples, storage
from ..sources import projections as P
from ..sources.definitions import parse_scenario, parse_workflow
from . import registry
from .registry import query

def example_steps(spark):
    rows = [r for t in examples.WORKFLOWS.values() for r in parse_workflow(t)["steps"]]
    return spark.createDataFrame(rows, dag.STEPS)


_LINES = f"WITH {P.sql('tasks')}, l AS (SELECT run_id::VARCHAR AS workflow, task_name AS name, lag(task_name) OVER (PARTITION BY run_id ORDER BY task_name) AS parent, part FROM tasks)"


def order_steps(spark, sf_dir):
    """A workflow for each order: its lines in turn, each after the one before."""
    t = P.table(spark, sf_dir, "tasks").select(F.col("run_id").cast("string").alias("workflow"), F.expr("cast(substr(task_name, 2) as int)").alias("position"), F.col("task_name").alias("name"))
    before = F.lag("name").over(Window.partitionBy("workflow").orderBy("name"))
    return t.withColumn("depends_on", F.array_compact(F.array(before)))


@query(f"{_LINES} SELECT a.workflow, a.name, b.name AS descendant FROM l a JOIN l b ON a.workflow = b.workflow AND a.name < b.name")
def g03_descendants(spark, sf_dir):
    return dag.descendants(dag.edges(order_steps(spark, sf_dir)))


@query(f"{_LINES} SELECT workflow, name FROM l WHERE parent IS NULL")
def g01_roots(spark, sf_dir):
    return dag.roots(order_steps(spark, sf_dir))


@query(f"{_LINES} SELECT workflow, parent AS name, string_agg(name, ',' ORDER BY name) AS children FROM l WHERE parent IS NOT NULL GROUP BY workflow, parent")
def g02_dependents(spark, sf_dir):
    return dag.dependents(order_steps(spark, sf_dir))


@query(
    """WITH RECURSIVE e AS (SELECT r_name AS workflow, r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, n_name, c_mktsegment || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) ON c_nationkey = n_nationkey),
w(workflow, name, descendant) AS (SELECT workflow, parent, child FROM e UNION SELECT w.workflow, w.name, e.child FROM w JOIN e ON e.workflow = w.workflow AND e.parent = w.descendant) SELECT workflow, name, descendant FROM w"""
)
def g03_region_closure(spark, sf_dir):
    n, r, c = (registry.table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    seg = c.select("c_nationkey", "c_mktsegment").distinct()
    low = nr.join(seg, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("workflow"), F.col("n_name").alias("parent"), F.concat("c_mktsegment", F.col("n_nationkey").cast("string")).alias("child"))
    return dag.descendants(nr.select(F.col("r_name").alias("workflow"), F.col("r_name").alias("parent"), F.col("n_name").alias("child")).unionByName(low))


def supplier_steps(spark, sf_dir):
    """A workflow for each nation: its suppliers in turn, each after the one before; in every third nation the first comes
    after the last. Some steps break a rule, by their supplier's key."""
    s = registry.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("k"))
    k, by = F.col("k"), Window.partitionBy("nation").orderBy("k")
    plain = F.concat(F.lit("s"), k.cast("string"))
    twin = F.coalesce((k % 37 == 2) & F.lag("k").over(by).isNotNull(), F.lit(False))
    s = s.withColumns({"position": F.row_number().over(by), "twin": twin, "plain": F.when(k % 31 == 1, F.concat(F.lit("s "), k.cast("string"))).otherwise(plain)})
    s = s.withColumn("name", F.when(F.col("twin"), F.lag("plain").over(by)).otherwise(F.col("plain")))
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("name").over(by), F.when(F.col("nation") % 3 == 0, F.last("name").over(whole)))
    s = s.withColumn("before", before)
    deps = F.when(F.col("twin"), F.array().cast("array<string>")).when(k % 19 == 6, F.array(F.lit("x"), F.lit("x"))).when(k % 19 == 7, F.array("name")).otherwise(F.array_compact(F.array("before")))
    pick = lambda m, table, other: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[(k % m).cast("int")], F.lit(other))
    return s.select(
        F.col("nation").cast("string").alias("workflow"), "position", "name", pick(29, {3: "", 4: "other"}, "h").alias("handler"), deps.alias("depends_on"), pick(17, {8: 0, 9: 101}, 3).alias("max_attempts"),
        pick(13, {10: -1, 11: 50_000}, 1_000).cast("long").alias("initial_delay_ms"), pick(11, {5: 0.5}, 2.0).alias("multiplier"), F.lit(30_000).cast("long").alias("max_delay_ms"), pick(41, {6: 2.0}, 0.2).alias("jitter"), pick(23, {5: -5}, 0).cast("long").alias("timeout_ms"),
    )


_SUPPLIERS = """WITH p AS (SELECT s_nationkey AS nation, s_suppkey AS k, row_number() OVER w AS position, s_suppkey % 37 = 2 AND lag(s_suppkey) OVER w IS NOT NULL AS twin, CASE WHEN s_suppkey % 31 = 1 THEN 's ' ELSE 's' END || s_suppkey AS plain FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
q AS (SELECT *, CASE WHEN twin THEN lag(plain) OVER (PARTITION BY nation ORDER BY k) ELSE plain END AS name FROM p),
r AS (SELECT *, coalesce(lag(name) OVER (PARTITION BY nation ORDER BY k), CASE WHEN nation % 3 = 0 THEN last_value(name) OVER (PARTITION BY nation ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END) AS prior, min(position) OVER (PARTITION BY nation, name) AS first_at, nation::VARCHAR AS workflow FROM q),
f AS (SELECT workflow, name AS step, unnest(list_filter([CASE WHEN k % 31 = 1 OR twin AND name LIKE 's %' THEN 'name is not valid' END, CASE WHEN first_at <> position THEN 'declared twice, at positions ' || first_at || ' and ' || position END, CASE WHEN k % 29 = 3 THEN 'handler is required' END, CASE WHEN k % 23 = 5 THEN 'timeout must not be negative' END,
  CASE WHEN NOT twin AND (k % 19 = 7 OR k % 19 <> 6 AND prior = name) THEN 'depends on itself' END, CASE WHEN NOT twin AND k % 19 = 6 THEN 'lists a dependency twice' END, CASE WHEN NOT twin AND k % 19 = 6 THEN 'depends on what is not a step: x' END,
  CASE WHEN k % 17 = 8 THEN 'max_attempts must be at least 1' WHEN k % 17 = 9 THEN 'max_attempts must be at most 100' END, CASE WHEN k % 13 = 10 THEN 'initial_delay must not be negative' END, CASE WHEN k % 11 = 5 AND k % 17 <> 8 THEN 'multiplier must be at least 1' END,
  CASE WHEN k % 13 = 11 THEN 'initial_delay exceeds max_delay' END, CASE WHEN k % 41 = 6 THEN 'jitter must be between 0 and 1' END, CASE WHEN k % 29 = 4 THEN 'handler is not registered: other' END], lambda x: x IS NOT NULL)) AS problem FROM r)"""
#: The loop of a nation whose steps follow each other all round, from the step with the least name.
_LOOPS = """c AS (SELECT workflow, string_agg(name, ' -> ' ORDER BY (least_at - position + n) % n) || ' -> ' || min(name) AS path FROM (SELECT *, first_value(position) OVER (PARTITION BY nation ORDER BY name) AS least_at, count(*) OVER (PARTITION BY nation) AS n FROM {}) WHERE nation % 3 = 0 GROUP BY workflow)"""


@query(
    f"""WITH s AS (SELECT s_nationkey AS nation, s_nationkey::VARCHAR AS workflow, 's' || s_suppkey AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS position FROM supplier),
{_LOOPS.format("s")} SELECT workflow, path FROM c"""
)
def g04_cycles(spark, sf_dir):
    s = registry.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("k"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child"))
    by = Window.partitionBy("nation").orderBy("k")
    last = F.last("child").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    e = s.select(F.col("nation").cast("string").alias("workflow"), F.coalesce(F.lag("child").over(by), F.when(F.col("nation") % 3 == 0, last)).alias("parent"), "child")
    return dag.cycles(e.where("parent is not null"))


@query(f"{_SUPPLIERS}, {_LOOPS.format('r')} SELECT workflow, step, problem FROM f UNION ALL SELECT workflow, '', 'steps form a cycle: ' || path FROM c WHERE workflow NOT IN (SELECT workflow FROM f)")
def g08_problems(spark, sf_dir):
    return dag.problems(supplier_steps(spark, sf_dir), ["h"])


def _fan_out_tasks(spark, sf_dir):
    """A fan-out run for each order; statuses from its key."""
    o = registry.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    k = F.col("run_id")
    status = {"split": "SUCCEEDED"} | {s: None for s in ("shard_a", "shard_b", "shard_c")}
    parts = [o.select("run_id", F.lit("fan-out").alias("workflow"), F.lit(n).alias("task_name"), F.when((k % (i + 2)) == 0, "SUCCEEDED").when(k % 7 == i, "DEAD").otherwise("RUNNING").alias("status") if s is None else F.lit(s).alias("status")) for i, (n, s) in enumerate(status.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(o.select("run_id", F.lit("fan-out").alias("workflow"), F.lit("merge").alias("task_name"), F.lit("PENDING").alias("status")))


_S = "CASE WHEN o_orderkey % {m} = 0 THEN 'SUCCEEDED' WHEN o_orderkey % 7 = {i} THEN 'DEAD' ELSE 'RUNNING' END"


@query("SELECT o_orderkey AS run_id, 'merge' AS name FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 AND o_orderkey % 5 = 0")
def g06_unlocked(spark, sf_dir):
    return dag.unlocked(example_steps(spark), _fan_out_tasks(spark, sf_dir))


@query(
    f"""WITH d AS (SELECT o_orderkey AS run_id, 'shard_a' AS name, {_S.format(m=3, i=1)} AS s FROM orders UNION ALL SELECT o_orderkey, 'shard_b', {_S.format(m=4, i=2)} FROM orders UNION ALL SELECT o_orderkey, 'shard_c', {_S.format(m=5, i=3)} FROM orders)
SELECT run_id, 'merge' AS name, 'upstream task ' || min(name) || ' did not succeed: ' AS reason FROM d WHERE s = 'DEAD' GROUP BY run_id"""
)
def g07_abandoned(spark, sf_dir):
    return dag.abandoned(example_steps(spark), _fan_out_tasks(spark, sf_dir))


def order_faults(spark, sf_dir):
    """A scenario for each order: its lines as faults, some of which break a rule, by their part's key."""
    part = F.col("part")
    kinds = F.array(*map(F.lit, (*V.FAULT_TYPES, *V.FAULT_TYPES_PLANNED)))
    return P.table(spark, sf_dir, "tasks").select(
        F.col("run_id").cast("string").alias("scenario"), F.expr("cast(substr(task_name, 2) as int)").alias("idx"), F.when(part % 31 == 0, "melt").otherwise(F.element_at(kinds, (part % 6 + 1).cast("int"))).alias("type"),
        F.when(part % 3 == 1, "before-claim").when(part % 3 == 2, "noon").alias("at"), F.element_at(F.array(*map(F.lit, (0.0, 0.5, 1.5, -0.5))), (part % 4 + 1).cast("int")).alias("probability"), F.when(part % 10 == 9, -1).otherwise(0).alias("attempt"),
    )


_FAULTS = f"WITH {P.sql('tasks')}, f AS (SELECT run_id::VARCHAR AS scenario, substr(task_name, 2)::INT AS idx, CASE WHEN part % 31 = 0 THEN 'melt' ELSE [{', '.join(repr(x) for x in (*V.FAULT_TYPES, *V.FAULT_TYPES_PLANNED))}][part % 6 + 1] END AS type, CASE part % 3 WHEN 1 THEN 'before-claim' WHEN 2 THEN 'noon' ELSE '' END AS point, [0.0, 0.5, 1.5, -0.5][part % 4 + 1] AS p, part % 10 = 9 AS neg FROM tasks)"


@query(f"{_FAULTS} SELECT scenario, bool_and(p = 0) AS deterministic, bool_or(type = 'worker-crash') AS separate_workers FROM f GROUP BY scenario")
def p19_scenario_flags(spark, sf_dir):
    return faults.scenario_flags(order_faults(spark, sf_dir))


@query(
    f"""{_FAULTS} SELECT scenario, idx, CASE type WHEN 'queue-overload' THEN 'queue-overload is not implemented' ELSE 'unknown type melt' END AS problem FROM f WHERE type IN ('queue-overload', 'melt')
UNION ALL SELECT scenario, idx, CASE WHEN point = '' THEN CASE WHEN p = 0 THEN 'set either a trigger point or a probability' ELSE 'probability must be between 0 and 1' END WHEN p <> 0 THEN 'set a trigger point or a probability, not both' ELSE 'unknown trigger point noon' END FROM f WHERE CASE WHEN point = '' THEN p <> 0.5 ELSE p <> 0 OR point = 'noon' END
UNION ALL SELECT scenario, idx, 'target attempt must not be negative' FROM f WHERE neg"""
)
def v25_fault_problems(spark, sf_dir):
    return faults.fault_problems(order_faults(spark, sf_dir))


def simulated(spark, sf_dir):
    """A simulated run for each order: the eight scenarios in turn, each on the workflow it names."""
    scenarios = {s["name"]: s for s in map(parse_scenario, examples.SCENARIOS.values())}
    workflows = {n: parse_workflow(t)["steps"] for n, t in examples.WORKFLOWS.items()}
    names = sorted(scenarios)
    pick = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names) + 1).cast("int"))
    on = text.lookup(F.col("scenario"), {n: s["workflow"] or "data-pipeline" for n, s in scenarios.items()})
    runs = registry.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), pick.alias("scenario"), F.col("o_orderdate").alias("started")).withColumn("workflow", on)
    return simulate.journal(runs, workflows, scenarios)


def _asserted(spark):
    rows = [(s["name"], *[s["asserts"].get(k) for k in ("run_status", "lost_tasks", "duplicate_effects", "max_recovery_time_ms", "max_retries_per_task", "min_retries_per_task", "faults_injected")]) for s in map(parse_scenario, examples.SCENARIOS.values())]
    return spark.createDataFrame(rows, "scenario string, run_status string, lost_tasks int, b_duplicate_effects int, max_recovery_time_ms int, max_retries_per_task int, min_retries_per_task int, faults_injected int")


_NAMES = sorted(examples.SCENARIOS)


@query("SELECT n AS scenario, count(*) AS runs, 0::BIGINT AS failed FROM orders JOIN (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMES)) + f") t(i, n) ON o_orderkey % {len(_NAMES)} = i GROUP BY n")
def v19_scenario_corpus(spark, sf_dir):
    return checks.repeats(checks.evaluate(checks.observed(storage.written(simulated(spark, sf_dir), "simulated")), _asserted(spark)))


@query()
def x10_simulated_journal(spark, sf_dir):
    return simulated(spark, sf_dir)


