import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronofold import vocabulary as V
from chronofold.operators import checks, compare, fold, metrics, recovery, validity
from chronofold.sources import template

from .conftest import SF

START = datetime(2023, 11, 14, 22, 13, 20)


def journal_of(spark, events, run_id=1):
    """events: (type, task, worker, payload, seconds); seq counts from 1."""
    rows = [(run_id, i, k, t, w, p if isinstance(p, str) else json.dumps({"v": 1, **p}), START + timedelta(seconds=at)) for i, (k, t, w, p, at) in enumerate(events, 1)]
    return spark.createDataFrame(rows, V.JOURNAL)


def of_class(k):
    return [(kind, task, worker, p, at / 1000) for (c, _, at, kind, task, worker, p) in template.rows() if c == k]


RECOVERY = [("RUN_STARTED", None, None, {}, 0), ("TASK_STARTED", "t", "w", {"attempt": 1}, 1), ("TASK_LEASE_EXPIRED", "t", "w", {"attempt": 1}, 2), ("TASK_STARTED", "t", "w", {"attempt": 2}, 3), ("RUN_SUCCEEDED", None, None, {}, 5)]


def test_fold_of_a_clean_run(spark):
    j = journal_of(spark, of_class(0))
    run, tasks = fold.run_state(j).first(), {r.task_name: r for r in fold.task_state(j).collect()}
    assert (run.status, run.workflow, run.version, run.seed, run.event_count, run.last_seq) == ("SUCCEEDED", "wf", 1, 42, 12, 12)
    assert set(tasks) == {"first", "second"} and tasks["first"].attempts == 1 and [a.name for a in tasks["first"].artifacts] == ["out.txt"]


def test_fold_of_a_recovered_run(spark):
    j = journal_of(spark, of_class(1))
    task, run = fold.task_state(j).first(), fold.run_state(j).first()
    assert (task.status, task.attempts, task.requeues, task.lease_expiries, task.retries) == ("SUCCEEDED", 2, 1, 1, 0)
    assert run.workers_lost == 1 and [(s.key, s.attempt, s.first_attempt) for s in run.skipped] == [("k", 2, 1)]


def test_dead_letter_keeps_an_error(spark):
    j = journal_of(spark, of_class(2))
    error = {r.task_name: r.error for r in fold.task_state(j).collect()}
    assert error["validate"].startswith("injected http-error") and error["report"] == "upstream task validate did not succeed: "
    assert fold.run_state(j).first().failure_reason == "tasks dead-lettered: 2 of 2 tasks did not succeed"


def test_aggregates_are_the_strict_fold(spark):
    for k in template.HISTORIES:
        j = journal_of(spark, of_class(k))
        state = fold.reduce_events([r.asDict() for r in j.orderBy("seq").collect()])
        run = fold.run_state(j).first()
        assert (run.status, run.seed, run.workers_lost, len(run.faults), len(run.skipped)) == (state["status"], state["seed"], state["workers_lost"], len(state["faults"]), len(state["skipped"]))
        for r in fold.task_state(j).collect():
            want = state["tasks"][r.task_name]
            assert {f: r[f] for f in ("status", "attempts", "retries", "requeues", "lease_expiries", "error")} == {f: want[f] for f in ("status", "attempts", "retries", "requeues", "lease_expiries", "error")}


def test_every_type_has_a_rule():
    assert set(V.GROUPS_OF) == set(V.LABEL_OF) == set(V.EVENT_TYPES) and len(V.EVENT_TYPES) == 21
    for kind in V.EVENT_TYPES:
        fold.reduce_events([{"seq": 1, "type": kind, "task_name": "t", "payload": '{"v":1}'}])


@pytest.mark.parametrize(
    "damage,kind,message",
    [
        (lambda e: e[:3] + e[4:], "gap", "gap in run"),
        (lambda e: [*e[:3], ("TASK_TELEPORTED", *e[3][1:]), *e[4:]], "unknown-type", "unknown type"),
        (lambda e: [*e[:3], (*e[3][:3], '{"attempt":1}', e[3][4]), *e[4:]], "no-version", "no version field"),
        (lambda e: [*e[:3], (*e[3][:3], '{"v":99}', e[3][4]), *e[4:]], "bad-version", "not supported by this build"),
        (lambda e: [*e, ("TASK_SCHEDULED", "x", None, {"attempt": 0}, 9)], "after-terminal", "after the run ended"),
    ],
)
def test_corruption_is_named(spark, damage, kind, message):
    whole = journal_of(spark, of_class(0))
    events = of_class(0)
    j = whole.where("seq <> 4") if kind == "gap" else journal_of(spark, damage(events))
    assert validity.anomalies(whole).count() == 0
    row = validity.first_anomaly(j).first()
    assert row.kind == kind and message in row.message
    assert validity.valid_runs(j).count() == 0
    with pytest.raises(ValueError, match=message):
        fold.reduce_events([r.asDict() for r in j.orderBy("seq").collect()])


def test_start_payload_is_not_looked_at(spark):
    assert validity.anomalies(journal_of(spark, [("RUN_STARTED", None, None, "{}", 0), ("WORKER_HEARTBEAT", None, "w", '{"v":7}', 1)])).count() == 0


def test_recovery_time(spark):
    assert recovery.recovery_time(journal_of(spark, RECOVERY)).first().recovery_ms == 3000
    assert recovery.recovery_time(journal_of(spark, [RECOVERY[0], RECOVERY[1], RECOVERY[4]])).first().recovery_ms == 0
    assert recovery.evidence(journal_of(spark, RECOVERY[:3])).first().recovery_ms is None


def test_story_is_part_of_the_journal(spark):
    j = journal_of(spark, RECOVERY)
    assert [r.seq for r in recovery.story(j).orderBy("seq").collect()] == [1, 3, 4, 5]
    assert recovery.story(journal_of(spark, [RECOVERY[0], RECOVERY[4]])).count() == 0


@pytest.mark.parametrize("values,p,want", [(list(range(1, 101)), 0.5, 50), (list(range(1, 101)), 0.95, 95), (list(range(1, 101)), 0.99, 99), (list(range(1, 101)), 1.0, 100), (list(range(1, 12)), 0.95, 10), ([], 0.5, 0), ([7], 0.01, 7)])
def test_percentile(spark, values, p, want):
    df = spark.range(1).select(metrics.percentile(F.array(*map(F.lit, values)).cast("array<long>"), p).alias("x"))
    assert df.first().x == want
    if values:
        rows = spark.createDataFrame([("k", v) for v in values], "k string, v long")
        assert metrics.percentile_by(rows, ["k"], "v", {"x": p}).first().x == want


def test_bench_summary(spark):
    rows = spark.createDataFrame([(1, i, "SUCCEEDED", 4, 0, 0, 0, i) for i in range(1, 101)], "point int, run_id long, status string, attempts long, retries long, lost long, recovery_ms long, duration_ms long")
    r = metrics.summarise(rows, ["point"], 10.0).first()
    assert (r.run_p50_ms, r.run_p95_ms, r.run_p99_ms, r.run_max_ms, r.runs_per_second, r.tasks_per_second, r.recovery_p50_ms) == (50, 95, 99, 100, 10.0, 40.0, 0)
    mixed = rows.limit(4).union(rows.limit(1).withColumn("recovery_ms", F.lit(2000).cast("long")))
    assert metrics.summarise(mixed, ["point"], 1.0).first().recovery_p50_ms == 2000


def states(j):
    return fold.run_state(j), fold.task_state(j)


def test_compare_with_itself_is_empty(spark):
    j = template.journal(spark, SF).where("run_id < 200")
    assert compare.compare(states(j), states(j)).count() == 0


def test_compare_finds_a_tampered_artifact_and_is_symmetric(spark):
    a = journal_of(spark, of_class(0))
    b = a.withColumn("payload", F.replace("payload", F.lit("aaaa"), F.lit("bbbb"))).where("seq < 8")
    found = {(r.category, r.subject): (r.expected, r.actual) for r in compare.compare(states(a), states(b)).collect()}
    back = {(r.category, r.subject): (r.expected, r.actual) for r in compare.compare(states(b), states(a)).collect()}
    assert found[("artifact-hash", "first/out.txt")] == ("a" * 12, "b" * 12) and found[("missing-event", "second")] == ("SUCCEEDED", "absent")
    swap = {"missing-event": "extra-event", "extra-event": "missing-event"}
    assert {(swap.get(k[0], k[0]), k[1]): v[::-1] for k, v in found.items()} == back


def test_assertions_that_are_not_set_are_not_checked(spark):
    seen = checks.observed(journal_of(spark, of_class(3)))
    bounds = "scenario string, run_status string, lost_tasks int, b_duplicate_effects int, max_recovery_time_ms int, max_retries_per_task int, min_retries_per_task int, faults_injected int"
    got = checks.evaluate(seen, spark.createDataFrame([("upstream-503-on-validate", "FAILED", 0, None, None, None, 2, None)], bounds)).collect()
    assert {r.name: r.passed for r in got} == {"run_status": False, "lost_tasks": True, "min_retries_per_task": False}
