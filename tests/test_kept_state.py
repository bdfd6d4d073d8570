"""State kept in tables and the ledger, over streams that break off."""

import pytest
from pyspark.sql import functions as F

from chronofold import vocabulary as V
from chronofold.operators import fold
from chronofold.sources import template
from chronofold.streaming import journal, ledger, state

from .conftest import SF


def rows(df):
    return sorted(map(str, map(tuple, df.select(*sorted(df.columns)).collect())))


def test_kept_state_is_the_fold(spark, tmp_path, monkeypatch):
    j = template.journal(spark, SF).where("run_id % 5 = 0").select("run_id", "seq", "type", "task_name", "worker_id", "payload", "occurred_at")
    src, path, checkpoint = (f"file://{tmp_path}/{n}" for n in ("src", "state", "check"))
    state.create(spark, path, V.JOURNAL, 4)
    stream = lambda: journal.tail(spark, src, V.JOURNAL, files_per_batch=1)
    seen, real, broken = [], state.keyed.apply, []
    for low, high in ((0, 3), (3, 6), (6, 99)):
        j.where((F.col("seq") > low) & (F.col("seq") <= high)).coalesce(1).write.mode("append").parquet(src)
        if low == 3:  # the driver is lost when tasks are written and runs are not

            def breaks(spark_, table, *args, **how):
                if table.endswith("/runs"):
                    raise RuntimeError("lost driver")
                broken.append(table)
                return real(spark_, table, *args, **how)

            monkeypatch.setattr(state.keyed, "apply", breaks)
            with pytest.raises(Exception, match="lost driver"):
                state.advance(stream(), path, checkpoint).awaitTermination()
            monkeypatch.setattr(state.keyed, "apply", real)
        q = state.advance(stream(), path, checkpoint)
        q.awaitTermination()
        seen.append(sum(p["numInputRows"] for p in q.recentProgress))
        upto = j.where(F.col("seq") <= high)
        assert rows(state.read(spark, path, "tasks")) == rows(fold.task_state(upto))
        assert rows(state.read(spark, path, "runs")) == rows(fold.run_state(upto))
    assert broken and seen == [j.where("seq <= 3").count(), j.where("seq > 3 and seq <= 6").count(), j.where("seq > 6").count()]  # new files only


def test_a_batch_writes_its_parts_and_its_buckets(spark, tmp_path, monkeypatch):  # F3, F4 of round 4
    """Events that a batch repeats count once, also where it goes on with others; only such keys are folded twice."""
    j = template.journal(spark, SF).where("run_id % 9 < 4").select("run_id", "seq", "type", "task_name", "worker_id", "payload", "occurred_at")
    written, applied, real = [], [], state.keyed.apply
    for module in (state, state.keyed):
        monkeypatch.setattr(module, "written", lambda df, name, write=module.written: written.append(name) or write(df, name))
    monkeypatch.setattr(state.keyed, "apply", lambda spark_, table, *args, **how: applied.append(table.rpartition("/")[2]) or real(spark_, table, *args, **how))
    for names in (["tasks"], ["runs"], ["tasks", "runs"]):
        path = f"file://{tmp_path}/{'-'.join(names)}"
        state.create(spark, path, V.JOURNAL, 4, names)
        for low, high, times in ((0, 5, 1), (0, 5, 1), (3, 9, 2), (9, 99, 1)):
            written.clear(), applied.clear()
            state.advance_batch(j.where((F.col("seq") > low) & (F.col("seq") <= high)), path, names)
            assert written == ["tail"] * (len(names) > 1) + ["fresh"] * len(names) and applied == [n for n in names for _ in range(times)]
        for name in names:
            assert rows(state.read(spark, path, name)) == rows({"tasks": fold.task_state, "runs": fold.run_state}[name](j))


def test_the_ledger_answers_with_the_first_result(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    make = lambda *r: spark.createDataFrame([(k, 1, "t", a, res, None) for k, a, res in r], "idempotency_key string, run_id long, task_name string, attempt int, result string, created_at timestamp_ntz")
    batches = [make(("a", 1, "one"), ("a", 1, "one"), ("b", 2, "two")), make(("a", 2, "other"), ("c", 1, None)), make(("c", 2, "late"), ("b", 3, "x"))]
    for n in (0, 1, 1, 2, 0, 2):  # batches that are run again decide as before
        ledger.do_batch(batches[n], n, path, 4)
    got = sorted((r.idempotency_key, r.attempt, r.outcome, r.first_attempt, str(r.result)) for r in ledger.outcomes(spark, path).collect())
    assert got == [("a", 1, "recorded", 1, "one"), ("a", 1, "skipped", 1, "one"), ("a", 2, "skipped", 1, "one"), ("b", 2, "recorded", 2, "two"), ("b", 3, "skipped", 2, "two"), ("c", 1, "recorded", 1, "None"), ("c", 2, "skipped", 1, "None")]
