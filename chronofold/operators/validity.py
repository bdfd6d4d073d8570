"""Checks of a journal before it is folded. The scan refuses a run at its first anomaly; here all anomalies are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from .order import scan

#: An anomaly of a lower rank hides those above it at the same event.
RANK = {"gap": 1, "unknown-type": 2, "after-terminal": 3, "no-version": 4, "bad-version": 5}
_ANY_VERSION = ("WORKER_REGISTERED", "WORKER_HEARTBEAT", "WORKER_SUSPECT")


def anomalies(journal: DataFrame, after: int = 0) -> DataFrame:
    """run_id, seq, kind, rank, expected, found, type: events that break a run's order (a gap or repeat in seq counted from
    after + 1; reported at the first offender only, as every later one follows from it), have an unknown type, come after
    the run's first terminal event, or carry a payload without a version or with one that is not 1. The start event's
    payload is not looked at, and worker events only need some version.

    One shuffle by run: both windows and the rest share it."""
    by_run = Window.partitionBy("run_id")
    in_order = by_run.orderBy("seq")
    row = F.row_number().over(in_order) + after
    ended = F.min(F.when(F.col("type").isin(*V.TERMINAL_TYPES), F.col("seq"))).over(by_run)
    e = journal.withColumns({"_want": row.cast("long"), "_end": ended, "_v": F.get_json_object("payload", "$.v")})
    first_gap = F.min(F.when(F.col("seq") != F.col("_want"), F.col("_want"))).over(by_run)
    e = e.withColumn("_gap", first_gap)
    found = {"gap": (F.col("seq") != F.col("_want")) & (F.col("_want") == F.col("_gap"))} | _rules()
    return _listed(e, found)


def _rules() -> dict[str, Column]:
    """The rules that a row breaks by itself, once _end, the seq of the run's end, and _v are known."""
    known = F.col("type").isin(*V.EVENT_TYPES)
    versioned = known & (F.col("type") != "RUN_STARTED")
    return {
        "unknown-type": ~known,
        "after-terminal": F.coalesce(F.col("seq") > F.col("_end"), F.lit(False)),
        "no-version": versioned & F.col("_v").isNull(),
        "bad-version": versioned & ~F.col("type").isin(*_ANY_VERSION) & F.coalesce(F.col("_v") != "1", F.lit(False)),
    }


def _listed(e: DataFrame, found: dict[str, Column]) -> DataFrame:
    kinds = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(RANK[k]).alias("rank"), F.lit(k).alias("kind"))) for k, test in found.items()]))
    return e.select("run_id", "seq", "type", "_want", F.explode(kinds).alias("k")).select(
        "run_id", "seq", F.col("k.kind").alias("kind"), F.col("k.rank").alias("rank"),
        F.when(F.col("k.kind") == "gap", F.col("_want")).alias("expected"), F.when(F.col("k.kind") == "gap", F.col("seq")).alias("found"), "type",
    )


def anomalies_of_long_runs(journal: DataFrame, after: int = 0) -> DataFrame:
    """What anomalies() gives, for journals in which a run may hold a large part of all events: ranges of (run_id, seq) are
    scanned instead of runs (order.scan), and a run's first gap is an aggregate."""
    terminal = F.when(F.col("type").isin(*V.TERMINAL_TYPES), F.col("seq"))
    narrow = journal.select("run_id", "seq", "type", F.get_json_object("payload", "$.v").alias("_v"))
    e = scan(narrow, ["run_id"], ["seq"], {"_want": ("row", None), "_end": ("min", terminal)}, "long-runs").withColumn("_want", F.col("_want") + 1 + after)
    gaps = e.where(F.col("seq") != F.col("_want")).groupBy("run_id").agg(F.min_by(F.struct("seq", "type", "_want"), "_want").alias("g"))
    gaps = gaps.select("run_id", F.col("g.seq").alias("seq"), F.lit("gap").alias("kind"), F.lit(RANK["gap"]).alias("rank"), F.col("g._want").alias("expected"), F.col("g.seq").alias("found"), F.col("g.type").alias("type"))
    return gaps.unionByName(_listed(e, _rules()))


def first_anomaly(journal: DataFrame, after: int = 0) -> DataFrame:
    """The anomaly at which a scan of each broken run stops: run_id, seq, kind, message. Order and types are checked over
    the whole scan before anything is folded."""
    scan_first = F.struct(F.when(F.col("rank") <= 2, 0).otherwise(1).alias("pass"), "seq", "rank")
    one = anomalies(journal, after).groupBy("run_id").agg(F.min_by(F.struct("seq", "kind", "expected", "found", "type"), scan_first).alias("a"))
    text = (
        F.when(F.col("a.kind") == "gap", F.format_string("gap in run %d: expected seq %d, found %d", F.col("run_id"), F.col("a.expected"), F.col("a.found")))
        .when(F.col("a.kind") == "unknown-type", F.format_string("run %d seq %d: unknown type %s", F.col("run_id"), F.col("a.seq"), F.col("a.type")))
        .when(F.col("a.kind") == "after-terminal", F.format_string("run %d seq %d: %s after the run ended", F.col("run_id"), F.col("a.seq"), F.col("a.type")))
        .when(F.col("a.kind") == "no-version", F.format_string("run %d seq %d: payload has no version field", F.col("run_id"), F.col("a.seq")))
        .otherwise(F.format_string("run %d seq %d: payload version is not supported by this build", F.col("run_id"), F.col("a.seq")))
    )
    return one.select("run_id", F.col("a.seq").alias("seq"), F.col("a.kind").alias("kind"), text.alias("message"))


def valid_runs(journal: DataFrame) -> DataFrame:
    """The journal without the runs that have an anomaly."""
    return journal.join(anomalies(journal).select("run_id").distinct(), "run_id", "left_anti")


def illegal_transitions(statuses: DataFrame, edges: dict, key: list[str], order: str = "seq", kind: str = "task", *, long_keys: bool = False) -> DataFrame:
    """Consecutive statuses of a key that are no legal edge: key, order, from_status, to_status, message. edges maps a
    status to those it may go to; the table is a literal of a dozen rows. long_keys: a key may hold a large part of all
    rows, so ranges are scanned."""
    if long_keys:
        moved = scan(statuses.select(*key, order, "status"), key, [order], {"from_status": ("lag", F.col("status"))}, "transitions")
    else:
        moved = statuses.withColumn("from_status", F.lag("status").over(Window.partitionBy(*key).orderBy(order)))
    moved = moved.where(F.col("from_status").isNotNull() & (F.col("from_status") != F.col("status")))
    allowed = F.create_map(*[x for a, to in edges.items() for x in (F.lit(a), F.array(*map(F.lit, to)).cast("array<string>"))])[F.col("from_status")]
    bad = moved.withColumn("_to", allowed).where(~F.coalesce(F.array_contains("_to", F.col("status")), F.lit(False)))
    text = F.when(F.size("_to") == 0, F.format_string(f"{kind} cannot leave terminal state %s (attempted %s)", "from_status", "status")).otherwise(
        F.format_string(f"illegal {kind} transition %s -> %s (allowed from %s: %s)", F.col("from_status"), F.col("status"), F.col("from_status"), F.array_join("_to", " "))
    )
    return bad.select(*key, order, "from_status", F.col("status").alias("to_status"), text.alias("message"))
