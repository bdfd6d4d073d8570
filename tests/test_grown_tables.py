"""What grows with the data is not sent through the driver, sorted more than it must be, or moved twice."""

from pyspark.sql import functions as F

from chronofold import vocabulary as V
from chronofold.operators import dag, recovery, simulate
from chronofold.plans import change_queries, dag_queries
from chronofold.sources import examples, template
from chronofold.sources.definitions import parse_scenario, parse_workflow
from chronofold.streaming import state

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_state_sends_nothing_through_the_driver(spark, tmp_path, monkeypatch):  # F1, F2
    path, seen, real = f"file://{tmp_path}/state", [], state.keyed.apply
    state.create(spark, path, V.JOURNAL, 4)

    def watched(spark_, table, changes, **how):
        seen.append(plan(changes))
        return real(spark_, table, changes, **how)

    monkeypatch.setattr(state.keyed, "apply", watched)
    j = template.journal(spark, SF).where("run_id % 5 = 0")
    for low, high in ((0, 5), (5, 99)):
        state.advance_batch(j.where((F.col("seq") > low) & (F.col("seq") <= high)), path)
    assert len(seen) == 4 and not [p for p in seen if "Broadcast" in p]


def test_changes_of_runs_and_events_send_nothing_through_the_driver(spark):  # F3, F4
    made = change_queries._completed(spark, SF)
    assert "Broadcast" not in plan(made["runs"]) and "Broadcast" not in plan(made["events"])


def test_a_journal_is_grouped_where_its_runs_lie(spark, monkeypatch):  # F9, F12 to F16, F23
    monkeypatch.setattr(template, "RUNS", 500)
    p = plan(recovery.evidence(template.journal(spark, SF)))
    assert p.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(o_orderkey" in p
    assert "SortAggregate" not in p


def test_a_simulated_journal_is_not_joined(spark):  # F7, F8
    p = plan(dag_queries.simulated(spark, SF))
    assert "Join" not in p and "MapInPandas" in p


def test_simulated_runs_are_dealt_out(spark):  # F1 of round 4
    assert dag_queries.simulated(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_runs_that_share_a_history_are_simulated_as_one_by_one(spark):  # F1 of round 4
    """Retries with jitter, skipped effects, an attempt limit; by draws that decide, and by tasks ready at once, runs differ."""
    scenarios = {s["name"]: s for s in map(parse_scenario, examples.SCENARIOS.values())}
    workflows = {n: parse_workflow(t)["steps"] for n, t in examples.WORKFLOWS.items()}
    scenarios["chance"] = {"name": "chance", "seed": 5, "faults": [{"type": "http-error", "at": None, "probability": 0.4, "task": None, "attempt": 0, "params": {}}]}
    runs = [(i, w, s) for i, (w, s) in enumerate((w, s) for w in workflows for s in scenarios for _ in range(5))]
    assert simulate.history("", workflows["effectful"], scenarios["worker-crash-after-effect"]).shared
    assert not simulate.history("", workflows["effectful"], scenarios["chance"]).shared and not simulate.history("", workflows["fan-out"], scenarios["baseline-no-faults"]).shared
    j = simulate.journal(spark.createDataFrame(runs, "run_id long, workflow string, scenario string").withColumn("started", F.lit("2024-01-01").cast("timestamp_ntz")), workflows, scenarios)
    got = j.select("run_id", "seq", "type", "task_name", "worker_id", "payload", F.expr("timestampdiff(millisecond, timestamp_ntz'2024-01-01', occurred_at)")).collect()
    want = [e for i, w, s in runs for e in simulate.run(i, workflows[w], scenarios[s])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and any("SKIPPED" in str(e) for e in want)


def test_unlocked_gathers_no_run(spark):  # F22
    steps = dag_queries.example_steps(spark)
    assert "collect_set" not in plan(dag.unlocked(steps, dag_queries._fan_out_tasks(spark, SF)))


def test_small_graphs_are_closed_without_rounds(spark, monkeypatch):  # F25
    """Chains, cycles, nulls and repeats; a graph of more than ROW_EDGES edges, and a null workflow, go by rounds."""
    rows = [(f"w{w}", f"n{i}", f"n{(i + 1) % (7 if w % 2 else 99)}") for w in range(20) for i in range(w % 8)] + [("w3", "n0", "n1"), ("x", None, "a"), ("x", "a", "b"), ("x", "b", None), ("x", None, "c"), ("x", "a", "a")]
    more = [("big", f"n{i}", f"n{i + 1}") for i in range(dag.ROW_EDGES + 8)] + [(None, "a", "b"), (None, "b", "c")]
    rounds, written = [], dag.written
    monkeypatch.setattr(dag, "written", lambda df, name: rounds.append(name) or written(df, name))

    def closure(edges):
        found = set(edges)
        while True:
            new = {(w, a, d) for w, a, b in found for v, c, d in edges if w is not None and w == v and b is not None and b == c} - found
            if not new:
                return found
            found |= new

    for edges, by_rounds in ((rows, False), (rows + more, True)):
        rounds.clear()
        got = [tuple(r) for r in dag.descendants(spark.createDataFrame(edges, "workflow string, parent string, child string")).collect()]
        assert len(got) == len(set(got)) and set(got) == closure(edges)
        assert ("closure" in rounds) == by_rounds
