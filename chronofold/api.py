"""Read endpoints over a folder of tables, as functions that return DataFrames, and the command line."""

from __future__ import annotations

import argparse
import datetime
import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import changes, checks, compare, dag, fold, metrics, ops, recovery, simulate, validity
from .sources import definitions, examples, storage, tables

_UUID = re.compile(r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")


class NotFound(LookupError):
    pass


class Store:
    """Tables of one folder (see vocabulary.TABLES). Malformed ids are refused before any scan."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def table(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.base, name)

    def _run(self, run_id: str) -> str:
        if not _UUID.fullmatch(run_id):
            raise ValueError(f"{run_id!r} is not a run id")
        return run_id

    def workflows(self) -> DataFrame:
        return ops.list_workflows(self.table("workflows"))

    def runs(self, status: str = "", workflow: str = "", limit=None) -> DataFrame:
        return ops.list_runs(self.table("runs"), self.table("workflows"), status=status, workflow=workflow, limit=ops.page_limit(limit, 50))

    def run(self, run_id: str) -> DataFrame:
        found = ops.run_by_id(self.table("runs"), self.table("workflows"), self._run(run_id))
        if not found.limit(1).count():
            raise NotFound(f"there is no run {run_id}")
        return found

    def tasks(self, run_id: str, after_task: str | None = None, limit=None) -> DataFrame:
        return ops.keyset_page(self.table("tasks").where(F.col("run_id") == self._run(run_id)), "task_name", after_task, ops.page_limit(limit))

    def events(self, run_id: str, after_seq=0, limit=None) -> DataFrame:
        return ops.keyset_page(self.table("events").where(F.col("run_id") == self._run(run_id)), "seq", ops.int_param(after_seq), ops.page_limit(limit))

    def workers(self) -> DataFrame:
        return ops.list_workers(self.table("workers"))

    def stats(self) -> DataFrame:
        return ops.stats(self.table("runs"), self.table("tasks"), self.table("workers"))

    def healthy(self) -> bool:
        """Whether the process answers, whatever its tables do."""
        return True

    def ready(self, expected_version: int) -> bool:
        """Whether the tables are there, in the expected version."""
        try:
            return tables.schema_version(self.table("schema_migrations")).first()[0] == expected_version
        except PySparkException:
            return False

    def journal(self) -> DataFrame:
        return tables.journal(self.table("events"))

    def replay(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Anomalies, and the run and task states of the runs without one."""
        j = self.journal()
        good = validity.valid_runs(j)
        return validity.first_anomaly(j), fold.run_state(good), fold.task_state(good)


ROUTES = {
    "/healthz": Store.healthy, "/readyz": Store.ready, "/api/v1/workflows": Store.workflows, "/api/v1/runs": Store.runs, "/api/v1/runs/{id}": Store.run,
    "/api/v1/runs/{id}/tasks": Store.tasks, "/api/v1/runs/{id}/events": Store.events, "/api/v1/workers": Store.workers, "/api/v1/stats": Store.stats,
}


def http_status(error: Exception) -> int:
    """The status that an endpoint answers an error with."""
    return 404 if isinstance(error, NotFound) else 400 if isinstance(error, ValueError) else 500


def simulated(spark: SparkSession, workflow: str, scenario: str, runs: int = 1) -> DataFrame:
    """The journals of runs of a workflow under a scenario, both as file texts."""
    w, s = definitions.parse_workflow(workflow), definitions.parse_scenario(scenario)
    table = spark.range(1, runs + 1).select(F.col("id").alias("run_id"), F.lit(w["name"]).alias("workflow"), F.lit(s["name"]).alias("scenario"), F.lit("2000-01-01").cast("timestamp_ntz").alias("started"))
    return storage.written(simulate.journal(table, {w["name"]: w["steps"]}, {s["name"]: s}), "simulated")


def run_scenario(spark: SparkSession, workflow: str, scenario: str, runs: int = 1) -> DataFrame:
    """Simulate runs of a workflow under a scenario (both as file texts) and evaluate its assertions."""
    s, j = definitions.parse_scenario(scenario), simulated(spark, workflow, scenario, runs)
    names = ("run_status", "lost_tasks", "duplicate_effects", "max_recovery_time_ms", "max_retries_per_task", "min_retries_per_task", "faults_injected")
    bounds = spark.createDataFrame([(s["name"], *[s["asserts"].get(n) for n in names])], "scenario string, run_status string, lost_tasks int, b_duplicate_effects int, max_recovery_time_ms int, max_retries_per_task int, min_retries_per_task int, faults_injected int")
    return checks.evaluate(checks.observed(j), bounds)


def show(df: DataFrame, most: int = 1000) -> None:
    """The first rows, and how many there are besides."""
    df.show(most, truncate=False)
    rest = df.count() - most
    if rest > 0:
        print(f"{rest} more rows")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="chronofold")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {
        "runs": ["base", "--status", "--workflow", "--limit"], "workers": ["base"], "stats": ["base"], "workflows": ["base"], "inspect": ["base", "run"],
        "replay": ["base", "--other"], "validate": ["file"], "register": ["base", "file"], "cancel": ["base", "run", "--reason"], "migrate": ["base", "path"], "demo": [], "test": ["workflow", "scenario", "--repeat"], "bench": ["base"], "export": ["base", "out"],
    }.items():
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("chronofold").getOrCreate()
    store = Store(spark, getattr(a, "base", ""))
    if a.command == "runs":
        show(store.runs(a.status or "", a.workflow or "", a.limit))
    elif a.command in ("workers", "stats", "workflows"):
        show(getattr(store, a.command)())
    elif a.command == "inspect":
        show(store.run(a.run))
        line = lambda after, n: store.events(a.run, after or 0, n).select("seq", "type", "task_name", text.summary(F.col("payload")).alias("summary"), "has_more")
        for r in tables.pages(line, "seq"):
            print(r.seq, r.type, r.task_name or "", r.summary or "", sep="\t")
    elif a.command == "replay":
        bad, runs, tasks = store.replay()
        show(bad)
        if a.other:
            _, other_runs, other_tasks = Store(spark, a.other).replay()
            found = compare.compare((runs, tasks), (other_runs, other_tasks)).orderBy("run_id", "rank", "subject")
            show(found)
            return int(found.limit(1).count() > 0)
        show(runs.join(recovery.recovery_time(store.journal()), "run_id"))
        return int(bad.limit(1).count() > 0)
    elif a.command == "validate":
        with open(a.file, encoding="utf-8") as f:
            steps = definitions.parse_workflow(f.read())["steps"]
        found = dag.problems(spark.createDataFrame(steps, dag.STEPS))
        show(found)
        return int(found.limit(1).count() > 0)
    elif a.command == "register":
        with open(a.file, encoding="utf-8") as f:
            w = definitions.parse_workflow(f.read())
        asked = spark.createDataFrame([(w["name"], w["version"], w["hash"])], "name string, version int, definition_hash string")
        found = ops.register_workflows(store.table("workflows"), asked)
        print("Dry run: what registering would do.")
        show(found)
        return int(found.where("outcome = 'conflict'").limit(1).count() > 0)
    elif a.command == "cancel":
        store.run(a.run)
        asked, now = spark.createDataFrame([(a.run, a.reason or "")], "run_id string, reason string"), F.lit(datetime.datetime.now(datetime.UTC).replace(tzinfo=None))
        print("Dry run: what cancelling would write; operators.changes with sources.keyed writes it.")
        out = changes.cancel_runs(store.table("runs"), store.table("tasks"), asked, now)
        for name in ("runs", "tasks", "events", "refused"):
            print(name)
            show(out[name])
        return int(out["refused"].limit(1).count() > 0)
    elif a.command == "migrate":
        for version, name, _ in tables.migrate(spark, a.path, store.table("schema_migrations")):
            print(f"{version:03d}_{name}")
    elif a.command == "demo":
        name = "worker-crash-after-effect"
        s = definitions.parse_scenario(examples.SCENARIOS[name])
        j = simulated(spark, examples.WORKFLOWS[s["workflow"] or "data-pipeline"], examples.SCENARIOS[name])
        for r in recovery.narrate(j).orderBy("seq").collect():  # the events of one run
            print(r.line)
    elif a.command == "test":
        with open(a.workflow, encoding="utf-8") as w, open(a.scenario, encoding="utf-8") as s:
            results = run_scenario(spark, w.read(), s.read(), int(a.repeat or 1)).cache()
        show(results)
        return int(results.where("not passed").limit(1).count() > 0)
    elif a.command == "bench":
        show(metrics.summarise(metrics.samples(store.journal()).withColumn("all", F.lit("all")), ["all"], 60.0))
    elif a.command == "export":
        tables.write_snapshot(tables.snapshot(store.table("runs"), store.table("tasks"), store.journal()), a.out)
    return 0
