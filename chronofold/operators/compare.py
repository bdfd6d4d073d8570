"""Divergence of two states of a run: what the system claims to be deterministic about, never wall-clock times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.storage import written
from . import fold

COLUMNS = ("run_id", "rank", "category", "subject", "expected", "actual")


def _row(rank: int, category: str | Column, subject: str | Column, expected: Column, actual: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(rank).alias("rank"), lit(category).alias("category"), lit(subject).alias("subject"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))


def _rows(df: DataFrame, *tests: tuple[Column, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(test, row) for test, row in tests]))
    return df.select("run_id", F.explode(found).alias("d")).select("run_id", "d.*")


def compare_runs(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Runs that one side lacks; status, definition hash, seed, number of suppressed effects; faults by position unless
    their numbers differ."""
    here = F.lit(True).alias("here")
    full = expected.select("*", here).alias("e").join(actual.select("*", here).alias("a"), "run_id", "full")
    e, a = (lambda c: F.col(f"e.{c}")), (lambda c: F.col(f"a.{c}"))
    alone = _rows(
        full,
        (a("here").isNull(), _row(0, "missing-event", "run", e("status"), F.lit("absent"))),
        (e("here").isNull(), _row(0, "extra-event", "run", F.lit("absent"), a("status"))),
    )
    j = full.where(e("here") & a("here"))
    differs = lambda x: ~e(x).eqNullSafe(a(x))
    flat = _rows(
        j,
        (differs("status"), _row(1, "terminal-state", "run", e("status"), a("status"))),
        (differs("definition_hash"), _row(2, "state", "definition", text.short_hash(e("definition_hash")), text.short_hash(a("definition_hash")))),
        (differs("seed"), _row(3, "state", "seed", e("seed"), a("seed"))),
        (F.size(e("faults")) != F.size(a("faults")), _row(5, "state", "faults", F.size(e("faults")), F.size(a("faults")))),
        (F.size(e("skipped")) != F.size(a("skipped")), _row(7, "state", "skipped-effects", F.size(e("skipped")), F.size(a("skipped")))),
    )
    pairs = j.where(F.size(e("faults")) == F.size(a("faults"))).select("run_id", F.posexplode(F.arrays_zip(e("faults").alias("w"), a("faults").alias("g"))).alias("i", "z"))
    same = F.lit(True)
    for f in ("type", "point", "task", "draw"):
        same &= F.col(f"z.w.{f}").eqNullSafe(F.col(f"z.g.{f}"))
    said = lambda s: F.concat_ws("", F.col(f"z.{s}.type"), F.lit(" at "), F.col(f"z.{s}.point"), F.lit(" on "), F.col(f"z.{s}.task"))
    ordered = pairs.where(~same).select("run_id", F.lit(6).alias("rank"), F.lit("ordering").alias("category"), F.concat(F.lit("fault["), F.col("i"), F.lit("]")).alias("subject"), said("w").alias("expected"), said("g").alias("actual"))
    return alone.unionByName(flat).unionByName(ordered)


def compare_tasks(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tasks that one side lacks, statuses and attempt counts: one full outer join on the key both folds are grouped by."""
    cols = ["run_id", "task_name", "status", "attempts"]
    j = expected.select(*cols, F.lit(True).alias("here")).alias("e").join(actual.select(*cols, F.lit(True).alias("here")).alias("a"), ["run_id", "task_name"], "full")
    e, a = (lambda c: F.col(f"e.{c}")), (lambda c: F.col(f"a.{c}"))
    both = e("here").isNotNull() & a("here").isNotNull()
    return _rows(
        j,
        (a("here").isNull(), _row(4, "missing-event", F.col("task_name"), e("status"), F.lit("absent"))),
        (both & (e("status") != a("status")), _row(4, "state", F.col("task_name"), e("status"), a("status"))),
        (both & (e("attempts") != a("attempts")), _row(4, "attempt-count", F.col("task_name"), e("attempts"), a("attempts"))),
        (e("here").isNull(), _row(4, "extra-event", F.col("task_name"), F.lit("absent"), a("status"))),
    )


def compare_artifacts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Artifacts of tasks that both sides have, by name: absent, added, or of another hash. Inputs: run_id, task_name,
    artifacts (array of structs with name and sha256)."""
    tasks = expected.select("run_id", "task_name").join(actual.select("run_id", "task_name"), ["run_id", "task_name"])
    flat = lambda df, side: df.join(tasks, ["run_id", "task_name"], "left_semi").select("run_id", "task_name", F.explode("artifacts").alias("x")).groupBy("run_id", "task_name", F.col("x.name").alias("name")).agg(F.max("x.sha256").alias(side))
    j = flat(expected, "w").join(flat(actual, "g"), ["run_id", "task_name", "name"], "full")
    subject = F.concat_ws("/", "task_name", "name")
    return _rows(j, (~F.col("w").eqNullSafe(F.col("g")), _row(4, "artifact-hash", subject, F.coalesce(text.short_hash(F.col("w")), F.lit("absent")), F.coalesce(text.short_hash(F.col("g")), F.lit("absent")))))


def verify_artifacts(tasks: DataFrame, stored: DataFrame) -> DataFrame:
    """The journal's artifacts against the stored ones (run_id, task_name, name, sha256), for tasks the journal mentions."""
    held = stored.groupBy("run_id", "task_name").agg(F.collect_list(F.struct("name", "sha256")).alias("artifacts"))
    want = tasks.select("run_id", "task_name", F.transform(F.coalesce("artifacts", F.array()), lambda x: F.struct(x["name"].alias("name"), x["sha256"].alias("sha256"))).alias("artifacts"))
    have = want.select("run_id", "task_name").join(held, ["run_id", "task_name"], "left").withColumn("artifacts", F.coalesce("artifacts", F.array()))
    return compare_artifacts(want, have)


#: What a comparison reads of the two states.
RUN_READ, TASK_READ = ("run_id", "status", "definition_hash", "seed", "faults", "skipped"), ("run_id", "task_name", "status", "attempts", "artifacts")


def states(expected: DataFrame, actual: DataFrame) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Both sides' (run_state, task_state) of two journals, folded in one go and written once with only what a comparison
    reads."""
    both = expected.withColumn("side", F.lit(0)).unionByName(actual.withColumn("side", F.lit(1)))
    runs = written(fold.run_state(both, ("side",)).select("side", *RUN_READ), "run-state", partition_by=["side"])
    tasks = written(fold.task_state(both, ("side",)).select("side", *TASK_READ), "task-state", partition_by=["side"])
    of = lambda n: (runs.where(F.col("side") == n).drop("side"), tasks.where(F.col("side") == n).drop("side"))
    return of(0), of(1)


def compare(expected: tuple[DataFrame, DataFrame], actual: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The whole report of two (run_state, task_state) pairs: run_id, rank (order of the checks), category, subject,
    expected, actual."""
    (er, et), (ar, at) = expected, actual
    return compare_runs(er, ar).unionByName(compare_tasks(et, at)).unionByName(compare_artifacts(et, at)).select(*COLUMNS)


def report_json(divergences: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, match, report: each compared run's divergences in order as one JSON object."""
    found = divergences.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "subject", "category", "expected", "actual"))).alias("d"))
    all_ = runs.select("run_id").join(found, "run_id", "left").withColumn("d", F.coalesce("d", F.array().cast(found.schema["d"].dataType)))
    return all_.select("run_id", (F.size("d") == 0).alias("match"), F.to_json(F.struct((F.size("d") == 0).alias("match"), F.col("d").alias("divergences"))).alias("report"))


def line(category: Column, subject: Column, expected: Column, actual: Column) -> Column:
    return F.format_string("%-15s %-20s expected %s, got %s", category, subject, expected, actual)
