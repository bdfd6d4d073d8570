import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chronofold import api
from chronofold import vocabulary as V
from chronofold.functions import draws, handlers, params, text
from chronofold.functions.time import at, duration_ms, human_duration, parse_ms
from chronofold.operators import compare, dag, faults, fold, metrics, ops, simulate
from chronofold.operators.order import numbered
from chronofold.plans import dag_queries
from chronofold.sources import definitions, examples, projections, storage, tables, template
from chronofold.streaming import journal as streaming

from .conftest import SF


def test_pages_of_two_are_the_whole(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(1, 8)], "seq long, task_name string")
    seen, after, more = [], 0, True
    while more:
        page = ops.keyset_page(rows, "seq", after, 2).orderBy("seq").collect()
        seen += [r.seq for r in page]
        after, more = page[-1].seq, page[-1].has_more
    assert seen == list(range(1, 8))


@pytest.mark.parametrize("asked,want", [("x", 100), (None, 100), (0, 100), (-3, 100), ("7", 7), (9999, 500)])
def test_page_limit(asked, want):
    assert ops.page_limit(asked) == want


@pytest.mark.parametrize("shown,ms", [("30s", 30_000), ("1m30s", 90_000), ("1.5h", 5_400_000), ("250ms", 250)])
def test_durations(spark, shown, ms):
    assert parse_ms(shown) == ms and spark.range(1).select(duration_ms(F.lit(shown))).first()[0] == ms


@pytest.mark.parametrize("bad", ["30", "", "s", "1x", "1s "])
def test_durations_need_units(spark, bad):
    with pytest.raises(ValueError):
        parse_ms(bad)
    assert spark.range(1).select(duration_ms(F.lit(bad))).first()[0] is None


def test_human_durations(spark):
    a = at("2000-01-01 00:00:00")
    show = lambda s: spark.range(1).select(human_duration(a, at(s) if s else F.lit(None).cast("timestamp_ntz"))).first()[0]
    assert [show(s) for s in ("2000-01-01 00:00:00.012", "2000-01-01 00:00:03.5", "2000-01-01 00:02:05", "1999-12-31 00:00:00", None)] == ["12ms", "3.50s", "2m 5s", None, None]


def test_draws_depend_on_names_only(spark):
    df = spark.createDataFrame([(7, "ab", "c"), (7, "a", "bc"), (8, "ab", "c")], "s long, a string, b string")
    u = [r[0] for r in df.select(draws.uniform(F.col("s"), F.col("a"), F.col("b"))).collect()]
    assert len(set(u)) == 3 and all(0 <= x < 1 for x in u)
    assert u[0] == simulate.draw(7, "ab", "c") == df.repartition(3).select(draws.uniform(F.col("s"), F.col("a"), F.col("b")).alias("u")).where(f"abs(u - {u[0]}) < 1e-15").first().u


@pytest.mark.parametrize("n,u,want", [(1, 0.5, 1000), (2, 0.5, 2000), (10, 0.5, 30_000), (10, 0.999999, 35_999), (0, 0.0, 800), (5000, 0.5, 30_000)])
def test_backoff(spark, n, u, want):
    r = V.DEFAULT_RETRY
    got = spark.range(1).select(draws.backoff_ms(F.lit(n), F.lit(r["initial_delay_ms"]), F.lit(r["multiplier"]), F.lit(r["max_delay_ms"]), F.lit(r["jitter"]), F.lit(u))).first()[0]
    assert got == want


def test_state_machines():
    assert set(V.RUN_TRANSITIONS) == set(V.RUN_STATUSES) and set(V.TASK_TRANSITIONS) == set(V.TASK_STATUSES)
    assert sum(map(len, V.RUN_TRANSITIONS.values())) == 9 and sum(map(len, V.TASK_TRANSITIONS.values())) == 17


def test_definitions_are_strict():
    for bad in ("{name: a, version: 1, steps: [], extra: 1}", "{name: a, version: 1, steps: [{name: x, handler: h, retry: {tries: 3}}]}", "{name: a, version: 1, steps: [{name: x, handler: h, timeout: 30}]}"):
        with pytest.raises(ValueError):
            definitions.parse_workflow(bad)
    a = definitions.parse_workflow("{name: a, version: 1, steps: [{name: x, handler: h}]}")
    assert a["hash"] == definitions.parse_workflow("name: a\nversion: 1\nsteps:\n  - {handler: h, name: x}\n")["hash"]
    assert a["hash"] != definitions.parse_workflow("{name: a, version: 1, steps: [{name: y, handler: h}]}")["hash"]


def test_examples_are_sound(spark):
    assert dag.problems(dag_queries.example_steps(spark), handlers.examples().names()).count() == 0


@pytest.mark.parametrize("name", sorted(examples.SCENARIOS))
def test_scenarios_get_their_verdict(spark, name):
    s = definitions.parse_scenario(examples.SCENARIOS[name])
    got = api.run_scenario(spark, examples.WORKFLOWS[s["workflow"] or "data-pipeline"], examples.SCENARIOS[name], 2).collect()
    assert got and all(r.passed for r in got), [r for r in got if not r.passed]


def test_every_fitting_fault_fires(spark):
    points = spark.createDataFrame([("after-task-start", "b", 1)], "point string, task_name string, attempt int")
    rules = [("before-claim", None, 0, "latency"), (None, "b", 1, "http-error"), ("after-task-start", None, 2, "latency")]
    assert [r.kind for r in faults.matches(points, rules).collect()] == ["http-error"]


def test_handlers():
    steps = lambda n: definitions.parse_workflow(examples.WORKFLOWS[n])["steps"]
    out = handlers.run_steps("r", steps("data-pipeline"), handlers.examples())
    assert json.loads(out["validate"]["output"]) == {"valid": 994, "invalid": 6} and json.loads(out["analyze"]["output"]) == {"mean": 497.0}
    assert json.loads(handlers.run_steps("r", steps("fan-out"), handlers.examples())["merge"]["output"]) == {"records": 321}
    r = handlers.Registry()
    r.handle("x", lambda c: c.input("nothing"))
    with pytest.raises(ValueError):
        r.handle("x", print)
    assert "not an input" in handlers.invoke(r.lookup("x"), handlers.TaskContext("r", "t", 1, {}))["error"]
    ledger = handlers.MemoryLedger()
    assert [ledger.do("k", lambda: 1), ledger.do("k", lambda: 2)] == [1, 1] and ledger.suppressed == ["k"]


def test_names(spark):
    df = spark.createDataFrame([("wf@3",), ("wf",), ("wf@x",), ("wf@0",)], "a string")
    assert [tuple(r[0]) for r in df.select(text.name_and_version(F.col("a"))).collect()] == [("wf", 3), ("wf", 0), ("wf@x", 0), ("wf@0", 0)]


def test_append_is_gapless_and_refuses_closed_runs(spark):
    j = template.journal(spark, SF).where("run_id < 12")
    new = spark.createDataFrame([(r, o) for r in range(1, 12) for o in (5, 1)], "run_id long, ord long")
    made, refused = ops.append_events(j, new)
    assert {r.run_id % 6 for r in refused.collect()} == {0, 1, 2, 3, 4} - ({0} if 6 not in {r.run_id for r in j.collect()} else set())
    assert sorted(r.seq for r in made.where("run_id = 5").collect()) == [7, 8]


def test_token_bucket(spark):
    from datetime import datetime, timedelta

    t = datetime(2000, 1, 1)
    rows = [(1, t + timedelta(seconds=s), i) for i, s in enumerate([0, 0, 0, 10, 10])]
    got = ops.rate_limited(spark.createDataFrame(rows, "client long, at timestamp_ntz, n long"), rate=0.1, burst=2.0).orderBy("n").collect()
    assert [r.allowed for r in got] == [True, True, False, True, False]


def test_stream_finds_breaks_across_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "run_id long, seq long, type string"
    for i, seqs in enumerate([[1, 2], [4, 5]]):
        spark.createDataFrame([(1, s, "RUN_SUCCEEDED" if s == 5 else "RUN_STARTED") for s in seqs] + ([(1, 6, "RUN_STARTED")] if i else []), schema).coalesce(1).write.mode("append").parquet(src)
    found = streaming.drain(streaming.contiguity(streaming.tail(spark, src, schema, files_per_batch=1)), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.kind for r in found.collect()) == ["after-terminal", "gap"]


def test_sweep_runs_its_step(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "t"))
    seen = []
    streaming.sweep(streaming.tail(spark, str(tmp_path / "t"), "id long"), lambda df, i: seen.append(df.count()), str(tmp_path / "ck")).awaitTermination()
    assert sum(seen) == 3


def test_snapshot_round_trip_and_migrations(spark, tmp_path):
    runs = projections.table(spark, SF, "runs").limit(5)
    rows = tables.snapshot(runs, projections.table(spark, SF, "tasks").select("run_id", "task_name", "status"), template.journal(spark, SF).select("run_id", "seq", "type"))
    tables.write_snapshot(rows, str(tmp_path / "s"))
    assert tables.read_snapshot(spark, str(tmp_path / "s"), rows.select("run", "tasks", "events").schema).count() == 5
    (tmp_path / "m").mkdir()
    for n in ("001_init.sql", "002_more.sql"):
        (tmp_path / "m" / n).write_text(n)
    shipped = tables.migrations(spark, str(tmp_path / "m"))
    applied = shipped.where("version = 1").withColumn("checksum", F.lit("other")).union(shipped.limit(1).withColumn("version", F.lit(9)))
    assert {r.version: r.state for r in tables.drift(shipped, applied).collect()} == {1: "changed", 2: "pending", 9: "unknown"}


def test_store_and_routes(spark, tmp_path):
    base, run = str(tmp_path), "0" * 8 + "-0000-0000-0000-" + "0" * 12
    empty = {n: spark.createDataFrame([], s) for n, s in V.TABLES.items()}
    events = [(run, i, k, t or "", None, p, None) for (c, i, _, k, t, _, p) in template.rows() if c == 0]
    for n, df in empty.items():
        (spark.createDataFrame(events, V.TABLES["events"]) if n == "events" else df).write.parquet(f"{base}/{n}.parquet")
    s = api.Store(spark, base)
    assert len(api.ROUTES) == 9 and s.events(run, 3, 2).count() == 2 and s.runs(limit="junk").count() == 0 and s.ready(0)
    with pytest.raises(ValueError):
        s.run("not-an-id")
    bad, runs, tasks = s.replay()
    assert bad.count() == 0 and runs.first().status == "SUCCEEDED" and tasks.count() == 2


def test_shared_dir_prefers_the_session(spark):
    assert storage.shared_dir(spark).endswith("/chronofold") or storage.shared_dir(spark).startswith("file:")


def test_queries_have_names_and_stable_schemas(spark):
    assert len(__spark_entry__.queries()) > 100 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["run_id", "recovery_ms"]


def test_assign_fills_more_than_100_000_slots(spark):
    n, now = 100_003, F.lit("2026-01-02").cast("timestamp")
    tasks = spark.range(n + 5).select("id", F.col("id").alias("run_id"), F.lit("t").alias("task_name"), F.lit("READY").alias("status"), F.lit("2026-01-01").cast("timestamp").alias("scheduled_at"))
    workers = spark.createDataFrame([(1, "HEALTHY", n, 1), (2, "HEALTHY", 3, 2), (3, "LOST", 9, 0), (4, "HEALTHY", 2, 2)], "id long, status string, capacity long, active_tasks long")
    got = ops.assign(tasks, workers, now)
    assert got.agg(F.count("*"), F.max("id")).first() == (n, n - 1)
    assert ops.assign(tasks, workers.where("id > 2"), now).count() == 0


def test_truncate_error_cuts_before_a_character(spark):
    words = ["é" * 1500, "x" + "é" * 1500, "日" * 900, "x日" + "日" * 900, "😀" * 600, "x" + "😀" * 600, "xy" + "😀" * 600, "xyz" + "😀" * 600, "a" * 2048, "a" * 2049, "é" * 1024, ""]
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [w for w in words + docs if w is not None]
    want = [w if len(w.encode()) <= 2048 else w.encode()[:2048].decode(errors="ignore") + "... (truncated)" for w in rows]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, s string").select("i", text.truncate_error(F.col("s")).alias("t")).collect()
    assert [r.t for r in sorted(got)] == want


def test_closures_and_cycles_of_any_size(spark):
    chain = [("chain", f"n{i:03}", f"n{i + 1:03}") for i in range(150)]
    diamond = [("diamond", f"{k}{i:02}", f"{m}{i + 1:02}") for i in range(24) for k in "ab" for m in "ab"]
    loop = [("loop", f"c{i:03}", f"c{(i + 1) % 130:03}") for i in range(130)] + [("loop", "c000", "out"), ("loop", "out", "further")]
    edge = spark.createDataFrame(chain + diamond + loop, "workflow string, parent string, child string")
    pairs = {r.workflow: r["count"] for r in dag.descendants(edge.where("workflow <> 'loop'")).groupBy("workflow").count().collect()}
    assert pairs == {"chain": 150 * 151 // 2, "diamond": 4 * 24 * 25 // 2}
    (found,) = dag.cycles(edge).collect()
    path = found.path.split(" -> ")
    assert found.workflow == "loop" and path[0] == path[-1] == "c000" and len(path) == 131 and set(path) == {f"c{i:03}" for i in range(130)}
    assert dag.find_cycle([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")]) == ["b", "c", "b"] and dag.find_cycle([("a", "a")]) == ["a", "a"]


def test_contiguity_over_many_arrow_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(1, 30_001).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("seq"), F.lit("RUN_STARTED").alias("type"))
    broken = rows.where("seq <> 20000").withColumn("run_id", F.lit(2).cast("long")).withColumn("type", F.when(F.col("seq") == 29_999, "RUN_FAILED").otherwise(F.col("type")))
    rows.unionByName(broken).orderBy(F.xxhash64("seq", "run_id")).coalesce(1).write.parquet(src)
    found = streaming.drain(streaming.contiguity(streaming.tail(spark, src, "run_id long, seq long, type string")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted((r.run_id, r.kind, r.expected, r.found) for r in found.collect()) == [(2, "after-terminal", None, 30_000), (2, "gap", 20_000, 20_001)]


def test_metric_bounds_and_duplicates(spark):
    assert metrics.TASK_BOUNDS == [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1, 5, 10, 30, 60]
    assert metrics.RUN_BOUNDS == [0.01, 0.1, 0.5, 1, 5, 10, 30, 60, 300, 900]
    assert metrics.RECOVERY_BOUNDS == [0.1, 0.25, 0.5, 1, 2, 5, 10, 30, 60, 120]
    assert len(V.BENCH_COLUMNS) + len(metrics.ENVIRONMENT) == 27
    starts = [(1, 1, "RUN_CREATED", None, '{"v":1,"workflow_name":"w"}'), *[(1, i, "TASK_STARTED", "t", f'{{"v":1,"attempt":{a}}}') for i, a in enumerate((1, 2, 2, 2), 2)], (1, 6, "WORKER_LOST", None, "{}")]
    j = spark.createDataFrame([(r, s, k, t, "w1", p, None) for r, s, k, t, p in starts] + [(2, 1, "WORKER_LOST", None, "w1", "{}", None)], V.JOURNAL)
    assert sorted((r.counter, r.task, r.n) for r in metrics.counters(j).collect()) == [("duplicate_executions_total", "t", 2), ("worker_lost_total", None, 1)]


def test_numbered_by_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v")).repartition(5)
    got = sorted(numbered(df, [F.col("k")], {"v": "before"}, "test").collect())
    total = 0
    for i, r in enumerate(got):
        assert (r.k, r.pos, r.before) == (i, i, total)
        total += r.v


def test_settings():
    assert params.int_list("1, 2,,5", "--runs") == [1, 2, 5] and params.fraction_list("0,0.05", "--rates") == [0, 0.05]
    for bad in (lambda: params.int_list("0", "x"), lambda: params.int_list(",", "x"), lambda: params.fraction_list("1.5", "x"), lambda: params.duration_param({"d": 5}, "d", 1), lambda: params.int_param({"n": "5"}, "n", 1), lambda: params.duration_setting({"A": "5"}, "A", 1)):
        with pytest.raises(ValueError):
            bad()
    assert params.duration_param({"d": "250ms"}, "d", 1) == 250 and params.duration_param({}, "d", 7) == 7 and params.int_param({"n": 5.7}, "n", 1) == 5
    assert params.Timing().problems() == [] and params.Timing.of({"LEASE_MS": "1m", "LOST_AFTER": "9"}) == params.Timing(lease_ms=60_000, lost_after=9)
    assert len(params.Timing(renew_ms=20_000, beat_ms=0, suspect_after=1, lost_after=1).problems()) == 4
    assert 0 < params.new_seed() < 1 << 63


def test_failing_handlers_and_scenario_source():
    r = handlers.failing(handlers.examples(), 0.3)
    said = [handlers.invoke(r.lookup("import_csv"), handlers.TaskContext(str(i), "t", 1, {})) for i in range(400)]
    bad = [s["error"] for s in said if s["error"]]
    assert 80 < len(bad) < 160 and "30.0% fault rate" in bad[0] and handlers.failing(r, 0) is r
    asked = []
    source = handlers.ScenarioSource({"a": {"hash": "h"}}, lambda i: asked.append(i) or {1: ("a", ""), 2: ("", ""), 3: ("b", ""), 4: ("a", "x")}[i])
    assert source.for_run(1) == source.for_run(1) == {"hash": "h"} and source.for_run(2) is None and asked == [1, 2]
    for i in (3, 4):
        with pytest.raises(LookupError):
            source.for_run(i)
    with pytest.raises(ValueError):
        handlers.TaskContext("r", "t", 1, {}).emit_hashed("n", "text/plain", "abc", 3)


def test_migrations_run_once_and_refuse_changes(spark, tmp_path):
    (tmp_path / "001_a.sql").write_text("CREATE OR REPLACE TEMP VIEW migrated AS SELECT 1 AS x;\nCREATE OR REPLACE TEMP VIEW migrated AS\nSELECT x + 1 AS x FROM VALUES (1) t(x);\n")
    schema = "version int, name string, checksum string"
    done = tables.migrate(spark, str(tmp_path), spark.createDataFrame([], schema))
    assert [d[:2] for d in done] == [(1, "a")] and spark.table("migrated").first().x == 2
    assert tables.migrate(spark, str(tmp_path), spark.createDataFrame(done, schema)) == []
    with pytest.raises(ValueError, match="modified"):
        tables.migrate(spark, str(tmp_path), spark.createDataFrame([(1, "a", "other")], schema))


def test_pages_are_walked_to_the_end(spark):
    df = spark.range(25).select(F.col("id").alias("seq"))
    assert [r.seq for r in tables.pages(lambda after, n: ops.keyset_page(df, "seq", after, n), "seq", 10)] == list(range(25))
    with pytest.raises(RuntimeError):
        list(tables.pages(lambda after, n: df.where("seq < 3").withColumn("has_more", F.lit(True)), "seq", 3))


def test_a_run_of_one_side_is_a_divergence(spark):
    j = template.journal(spark, SF).where("run_id in (1, 2)")
    state = lambda j: (fold.run_state(j), fold.task_state(j))
    found = compare.compare(state(j), state(j.where("run_id = 1"))).where("subject = 'run'").collect()
    assert [(r.run_id, r.category, r.actual) for r in found] == [(2, "missing-event", "absent")]


def test_errors_and_readiness(spark, tmp_path):
    assert [api.http_status(e) for e in (api.NotFound("x"), ValueError("x"), OSError("x"))] == [404, 400, 500]
    assert not api.Store(spark, str(tmp_path)).ready(1) and api.Store(spark, str(tmp_path)).healthy()
    for n in ("runs", "workflows"):
        spark.createDataFrame([], V.TABLES[n]).write.parquet(f"{tmp_path}/{n}.parquet")
    with pytest.raises(api.NotFound):
        api.Store(spark, str(tmp_path)).run("0" * 8 + "-0000-0000-0000-" + "0" * 12)
