"""Tables that changes are merged into, and the numbered append from a stream."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from chronofold.functions.time import at
from chronofold.operators import changes, dag, ops
from chronofold.plans import change_queries
from chronofold.sources import keyed
from chronofold.streaming import append
from chronofold import vocabulary as V

from .conftest import SF

ROWS = [(i, f"v{i % 7}", i * 10) for i in range(500)]


@pytest.fixture
def table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    keyed.create(spark.createDataFrame(ROWS, "id long, v string, n long"), path, ["id"], 16)
    return path


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path[7:]}/_bucket=*/*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, table):
    before = files(table)
    new = spark.createDataFrame([(3, None), (10_000, "x")], "id long, v string")
    touched = keyed.apply(spark, table, new)
    after = files(table)
    bucket = lambda f: int(f.split("_bucket=")[1].split("/")[0])
    assert 1 <= len(touched) <= 2 and {bucket(f) for f in before.keys() - after.keys()} <= set(touched)
    assert all(after[f] == t for f, t in before.items() if bucket(f) not in touched)
    want = {i: (None if i == 3 else v, n) for i, v, n in ROWS}
    assert {r.id: (r.v, r.n) for r in keyed.read(spark, table).collect()} == want  # what is not set stays, no row is added


def test_reading_touched_buckets_prunes(spark, table):
    plan = keyed.read(spark, table, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_applying_twice_is_once_and_inserts(spark, table):
    new = spark.createDataFrame([(1, "new", 5), (9_001, "row", 6)], "id long, v string, n long")
    seen = []
    for _ in range(2):
        keyed.apply(spark, table, new, insert=True)
        seen.append(sorted(map(tuple, keyed.read(spark, table).collect())))
    assert seen[0] == seen[1] == sorted([r for r in ROWS if r[0] != 1] + [(1, "new", 5), (9_001, "row", 6)])
    keyed.apply(spark, table, spark.createDataFrame([(1, "late", 0), (9_002, "only", 1)], "id long, v string, n long"), update=False, insert=True)
    got = {r.id: r.v for r in keyed.read(spark, table).collect()}
    assert got[1] == "new" and got[9_002] == "only" and len(got) == 502


def test_bad_batches_and_empty_tables(spark, table, tmp_path):
    with pytest.raises(Exception, match="twice"):
        keyed.apply(spark, table, spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string"))
    with pytest.raises(ValueError, match="no column"):
        keyed.apply(spark, table, spark.createDataFrame([(1, 1)], "id long, other int"))
    assert keyed.apply(spark, table, spark.createDataFrame([], "id long, v string")) == []
    path = f"file://{tmp_path}/none"
    keyed.create(spark.createDataFrame([], "a long, b string, c int"), path, ["a", "b"], 4)
    assert keyed.read(spark, path).collect() == []
    keyed.apply(spark, path, spark.createDataFrame([(1, "x", 2)], "a long, b string, c int"), insert=True)
    assert list(map(tuple, keyed.read(spark, path).collect())) == [(1, "x", 2)]


def test_no_rule_is_broken_after_a_batch(spark):
    """Applied, a batch leaves no lease on a finished task and no open end (p23, p24)."""
    tasks, runs = change_queries._kept(spark, SF)
    out = change_queries._completed(spark, SF)
    done = out["tasks"]
    assert done.where("status in ('SUCCEEDED', 'DEAD', 'RETRYING') and lease_expires_at is not null").count() == 0
    assert done.where("(status in ('SUCCEEDED', 'DEAD')) <> (completed_at is not null)").count() == 0
    assert done.where("status in ('DEAD', 'RETRYING') and worker_id is not null").count() == 0
    assert out["runs"].where("completed_at is null or status not in ('SUCCEEDED', 'FAILED')").count() == 0
    assert out["dead_letters"].groupBy("task_id").count().where("count > 1").count() == 0


def test_each_step_has_its_own_policy(spark):
    tasks = spark.createDataFrame([(i, 1, f"s{i}", 1, "RUNNING", 9) for i in (1, 2, 3)], "id long, run_id long, task_name string, attempt int, status string, worker_id long")
    runs = spark.createDataFrame([(1, "RUNNING")], "id long, status string")
    steps = spark.createDataFrame([("w", 1, "s1", "h", [], 1, 10, 1.0, 10, 0.0, 0), ("w", 2, "s2", "h", [], 5, 40, 1.0, 40, 0.0, 0), ("w", 3, "s3", "h", [], None, None, None, None, None, 0)], dag.STEPS)
    outcomes = tasks.select("id", "worker_id", "attempt", F.lit(None).cast("string").alias("output"), F.lit("no").alias("error"), F.lit(False).alias("permanent"), F.lit(1).alias("duration_ms"), F.lit(1).alias("seed"))
    flow = spark.createDataFrame([(1, "w")], "run_id long, workflow string")
    recorded = spark.createDataFrame([(1,)], "task_id long")
    out = changes.complete_tasks(tasks, runs, flow, steps, outcomes, at("2020-01-01 00:00:00"), recorded=recorded)
    got = {r.id: (r.status, str(r.scheduled_at)) for r in out["tasks"].collect()}
    assert got[1][0] == "DEAD" and got[2] == ("RETRYING", "2020-01-01 00:00:00.040000") and got[3][0] == "RETRYING"
    assert out["dead_letters"].count() == 0
    said = [r.payload for r in out["events"].where("type = 'TASK_RETRY_SCHEDULED' and task_name = 's2'").collect()]
    assert said == ['{"v":1,"attempt":1,"next_attempt":2,"delay_ms":40,"run_at":"2020-01-01T00:00:00.04Z"}']


EVENT = "run_id long, ord long, type string, task_name string, worker_id string, payload string, occurred_at timestamp_ntz"


def offered():
    """Files of events: runs that go on over many files, one that ends in the middle of a file, and one long run."""
    out = []
    for f in range(6):
        rows = [(run, f * 100 + k, "RUN_FAILED" if (run, f, k) == (3, 2, 1) else "TASK_STARTED", f"t{k}", None, "{}", None) for run in range(1, 9) for k in range(1 + (run + f) % 3)]
        out.append(rows + [(99, f * 1_000 + k, "TASK_STARTED", None, None, "{}", None) for k in range(200)])
    return out


def expected(spark):
    everything = spark.createDataFrame([r for f in offered() for r in f], EVENT)
    journal = spark.createDataFrame([], V.JOURNAL)
    return ops.append_events(journal, everything)


def test_a_restarted_stream_numbers_without_gaps(spark, tmp_path, monkeypatch):
    src, log, checkpoint = (f"file://{tmp_path}/{n}" for n in ("src", "log", "check"))
    for i, rows in enumerate(offered()):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{src}/f{i}")
    stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    real, broken = append.keyed.apply, []

    def breaks(*args, **how):  # after the third micro-batch has changed the state, before it is committed
        out = real(*args, **how)
        broken.append(1)
        if len(broken) == 3:
            raise RuntimeError("lost driver")
        return out

    monkeypatch.setattr(append.keyed, "apply", breaks)
    q = append.append(stream(), log, checkpoint, buckets=4)
    with pytest.raises(Exception, match="lost driver"):
        q.awaitTermination()
    monkeypatch.setattr(append.keyed, "apply", real)
    append.append(stream(), log, checkpoint, buckets=4).awaitTermination()
    events = append.events(spark, log, V.JOURNAL)
    per_run = events.groupBy("run_id").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d"), F.max("seq").alias("top")).collect()
    assert all(r.n == r.d == r.top for r in per_run)
    want, want_refused = expected(spark)
    key = lambda df: sorted((r.run_id, r.type, r.task_name or "") for r in df.collect())
    ended = lambda df: [x for x in key(df) if x[0] != 3]  # noqa: E731  files come in any order, so run 3 ends somewhere else
    assert ended(events) == ended(want)
    refused = append.refused(spark, log, EVENT)
    assert events.count() + refused.count() == want.count() + want_refused.count()
    assert {r.run_id for r in refused.collect()} <= {3}
    append.append_batch(spark.createDataFrame(offered()[0], EVENT), 0, log, 4)  # a batch that is committed counts once
    assert append.events(spark, log, V.JOURNAL).count() == events.count()


def test_an_end_within_a_batch_refuses_what_follows(spark):
    new = spark.createDataFrame([(1, 0, "RUN_STARTED"), (1, 1, "RUN_SUCCEEDED"), (1, 2, "TASK_STARTED"), (2, 0, "RUN_STARTED")], "run_id long, ord long, type string")
    kept, refused = ops.append_events(spark.createDataFrame([(2, 7, "RUN_CREATED", None, None, None, None)], V.JOURNAL), new)
    assert sorted((r.run_id, r.seq) for r in kept.collect()) == [(1, 1), (1, 2), (2, 8)]
    assert [(r.run_id, r.ord) for r in refused.collect()] == [(1, 2)]


def test_cancelling_with_text_ids(spark):
    tasks = spark.createDataFrame([("t1", "r1", "a", "READY", None), ("t2", "r1", "b", "RUNNING", "w"), ("t3", "r2", "a", "READY", None)], "id string, run_id string, task_name string, status string, worker_id string")
    runs = spark.createDataFrame([("r1", "RUNNING"), ("r2", "FAILED")], "id string, status string")
    asked = spark.createDataFrame([("r1", ""), ("r2", "x"), ("r3", "y")], "run_id string, reason string")
    out = changes.cancel_runs(runs, tasks, asked, at("2020-01-01 00:00:00"))
    assert sorted((r.id, r.status, r.worker_id, r.error) for r in out["tasks"].collect()) == [("t1", "DEAD", None, "run cancelled"), ("t2", "RUNNING", "w", None)]
    assert [(r.run_id, r.payload) for r in out["events"].collect()] == [("r1", '{"v":1}')]
    assert sorted(map(tuple, out["refused"].collect())) == [("r2", "run is finished: FAILED"), ("r3", "no such run")]
