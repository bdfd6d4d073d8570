"""Queries over workflow graphs. A step table has workflow, position (from 1), name, handler, depends_on (array), and retry
fields; graphs are small, tables of many workflows are not, so closures run for all workflows at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text
from ..sources.storage import forget, keyed_side, written

STEPS = (
    "workflow string, position int, name string, handler string, depends_on array<string>, max_attempts int, initial_delay_ms long, "
    "multiplier double, max_delay_ms long, jitter double, timeout_ms long"
)


def edges(steps: DataFrame) -> DataFrame:
    """workflow, parent, child."""
    return steps.select("workflow", F.explode("depends_on").alias("parent"), F.col("name").alias("child"))


def roots(steps: DataFrame) -> DataFrame:
    return steps.where(F.coalesce(F.size("depends_on"), F.lit(0)) <= 0).select("workflow", "name")


def dependents(steps: DataFrame) -> DataFrame:
    """workflow, name, children: direct dependents in step order, joined by commas."""
    kids = steps.select("workflow", "position", F.explode("depends_on").alias("parent"), F.col("name").alias("child"))
    return kids.groupBy("workflow", F.col("parent").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "child"))), lambda x: x["child"]), ",").alias("children"))


#: Edges up to which a workflow's graph is closed in one row.
ROW_EDGES = 32


def descendants(edge: DataFrame) -> DataFrame:
    """workflow, name, descendant: the transitive closure of the edges, for all workflows at once. Workflows of up to
    ROW_EDGES edges are gathered by one shuffle and closed each in its row; larger ones (and a null workflow, whose edges
    meet none) are closed by joins in rounds."""
    edge = written(edge.select("workflow", F.col("parent").alias("name"), F.col("child").alias("descendant")), "edges")
    large = written(edge.groupBy("workflow").count().where((F.col("count") > ROW_EDGES) | F.col("workflow").isNull()).select("workflow"), "large")
    if large.isEmpty():
        return _closed_in_rows(edge)
    is_large = edge["workflow"].eqNullSafe(large["workflow"])
    return _closed_in_rows(edge.join(keyed_side(large), is_large, "left_anti")).unionByName(_closed_in_rounds(edge.join(keyed_side(large), is_large, "left_semi")))


def _closed_in_rows(edge: DataFrame) -> DataFrame:
    graphs = edge.groupBy("workflow").agg(F.collect_set(F.struct("name", "descendant")).alias("_e"))
    after = lambda which: F.transform(F.filter("_e", which), lambda e: e["descendant"])
    grown = lambda r, _: F.array_union(r, after(lambda e: F.array_contains(r, e["name"])))
    reached = lambda p: F.aggregate(F.sequence(F.lit(1), F.size("_e")), F.array_distinct(after(lambda e: e["name"].eqNullSafe(p))), grown)
    names = F.array_distinct(F.transform("_e", lambda e: e["name"]))
    each = graphs.select("workflow", F.explode(F.transform(names, lambda p: F.struct(p.alias("name"), reached(p).alias("below")))).alias("_n"))
    return each.select("workflow", F.col("_n.name").alias("name"), F.explode("_n.below").alias("descendant"))


def _closed_in_rounds(edge: DataFrame) -> DataFrame:
    """Each round joins the pairs found with themselves, so paths double in length, until no pair is new; rounds are
    written."""
    pairs = written(edge.distinct(), "closure")
    while True:
        a, b = pairs.alias("a"), pairs.alias("b")
        further = a.join(b, (F.col("a.workflow") == F.col("b.workflow")) & (F.col("a.descendant") == F.col("b.name"))).select("a.workflow", "a.name", "b.descendant")
        more = written(pairs.unionByName(further).distinct(), "closure")
        if more.count() == pairs.count():
            forget(more)
            return pairs
        forget(pairs)
        pairs = more


def find_cycle(edge: list[tuple[str, str]]) -> list[str] | None:
    """Of (step, dependency) pairs: the shortest cycle through the least step that lies on one, closed; of several, the one
    whose steps come first. None if there is none."""
    deps: dict[str, set[str]] = {}
    for child, parent in edge:
        deps.setdefault(child, set()).add(parent)
    for start in sorted(deps):
        came: dict[str, str] = {}
        front = [start]
        while front:
            after = []
            for at in front:
                for d in sorted(deps.get(at, ())):
                    if d == start:
                        path = [d, at]
                        while path[-1] != start:
                            path.append(came[path[-1]])
                        return path[::-1]
                    if d not in came:
                        came[d] = at
                        after.append(d)
            front = after
    return None


def cycles(edge: DataFrame) -> DataFrame:
    """workflow, path: a cycle of each workflow that has one, of any length (find_cycle). A workflow's steps are one group:
    it is a graph that its author wrote."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        path = find_cycle(list(zip(pdf["child"], pdf["parent"], strict=True)))
        return pd.DataFrame({"workflow": [pdf["workflow"].iloc[0]] if path else [], "path": [" -> ".join(path)] if path else []}, dtype=object)

    return edge.groupBy("workflow").applyInPandas(search, "workflow string, path string")


def unlocked(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """run_id, name: pending tasks all of whose dependencies have succeeded. tasks: run_id, workflow, task_name, status."""
    done = tasks.where("status = 'SUCCEEDED'").select("run_id", F.col("task_name").alias("needs"))
    waiting = tasks.where("status = 'PENDING'").select("run_id", "workflow", F.col("task_name").alias("name")).join(steps.select("workflow", "name", "depends_on"), ["workflow", "name"]).where("depends_on is not null")
    needs = waiting.select("run_id", "name", F.explode("depends_on").alias("needs"))
    short = needs.join(keyed_side(done), ["run_id", "needs"], "left_anti").select("run_id", "name")
    return waiting.select("run_id", "name").join(keyed_side(short), ["run_id", "name"], "left_anti")


def abandoned(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """run_id, name, reason: unfinished descendants of dead tasks; the first dead step by name gives the reason."""
    below = descendants(edges(steps))
    dead = tasks.where("status = 'DEAD'").select("run_id", "workflow", F.col("task_name").alias("name"))
    hit = dead.join(below, ["workflow", "name"]).groupBy("run_id", "descendant").agg(F.min("name").alias("upstream"))
    open_ = tasks.where(~F.col("status").isin(*V.TASK_TERMINAL)).select("run_id", F.col("task_name").alias("descendant"))
    return hit.join(open_, ["run_id", "descendant"]).select("run_id", F.col("descendant").alias("name"), F.concat(F.lit("upstream task "), "upstream", F.lit(" did not succeed: ")).alias("reason"))


def with_retry(steps: DataFrame, default: dict = V.DEFAULT_RETRY) -> DataFrame:
    """Steps without a retry policy take the default's fields, all together."""
    own = F.col("max_attempts").isNotNull()
    return steps.withColumns({k: F.when(own, F.col(k)).otherwise(F.lit(v)) for k, v in default.items()})


def problems(steps: DataFrame, handlers: list[str] | None = None) -> DataFrame:
    """workflow, step, problem: every rule that a workflow's steps break. A cycle is looked for only in workflows whose
    edges all point at steps."""
    where, deps = F.col("name"), F.coalesce("depends_on", F.array().cast("array<string>"))
    seen = Window.partitionBy("workflow", "name").orderBy("position")
    names = steps.groupBy("workflow").agg(F.collect_set("name").alias("_names"))
    s = steps.withColumn("_first", F.first("position").over(seen)).join(names, "workflow").withColumn("depends_on", deps)
    unknown = F.array_except("depends_on", "_names")
    own = F.array_contains("depends_on", F.col("name"))
    rules = [
        F.when(~text.valid_name(where), F.lit("name is not valid")),
        F.when(F.col("_first") != F.col("position"), F.format_string("declared twice, at positions %d and %d", "_first", "position")),
        F.when(F.coalesce("handler", F.lit("")) == "", F.lit("handler is required")),
        F.when(F.coalesce("timeout_ms", F.lit(0)) < 0, F.lit("timeout must not be negative")),
        F.when(own, F.lit("depends on itself")),
        F.when(F.size("depends_on") > F.size(F.array_distinct("depends_on")), F.lit("lists a dependency twice")),
        F.when(F.size(unknown) > 0, F.concat(F.lit("depends on what is not a step: "), F.array_join(F.array_sort(unknown), ", "))),
        F.when(F.col("max_attempts") < 1, F.lit("max_attempts must be at least 1")),
        F.when(F.col("max_attempts") > 100, F.lit("max_attempts must be at most 100")),
        F.when(F.col("initial_delay_ms") < 0, F.lit("initial_delay must not be negative")),
        F.when((F.col("max_attempts") > 1) & (F.col("multiplier") < 1), F.lit("multiplier must be at least 1")),
        F.when((F.col("max_delay_ms") > 0) & (F.col("initial_delay_ms") > F.col("max_delay_ms")), F.lit("initial_delay exceeds max_delay")),
        F.when((F.col("jitter") < 0) | (F.col("jitter") > 1), F.lit("jitter must be between 0 and 1")),
    ]
    if handlers is not None:
        rules.append(F.when(~F.col("handler").isin(*handlers) & (F.coalesce("handler", F.lit("")) != ""), F.concat(F.lit("handler is not registered: "), "handler")))
    found = s.select("workflow", F.col("name").alias("step"), F.explode(F.array_compact(F.array(*rules))).alias("problem"))
    sound = steps.join(found.select("workflow").distinct(), "workflow", "left_anti")
    loops = cycles(edges(sound)).select("workflow", F.lit("").alias("step"), F.concat(F.lit("steps form a cycle: "), "path").alias("problem"))
    return found.unionByName(loops)


def definition_hash(steps: DataFrame) -> DataFrame:
    """workflow, hash: equal for definitions that mean the same, whatever their layout."""
    fields = [c for c in steps.columns if c != "workflow"]
    return steps.groupBy("workflow").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))), 256).alias("hash"))
