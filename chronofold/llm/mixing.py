"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document has a fixed 56-bit key (digits of the md5 of its id). Sizes are summed by source and key bucket (8 bits
at a time, combined map-side); the bucket where a source's running sum passes its budget is the boundary, and only its
documents are summed again by the next 8 bits, until a boundary holds one document or the key ends. What stays is a
key threshold a source, and the mix is a filter: nothing is sorted. Larger budgets give larger thresholds, so mixes
nest. Documents are read once; the rounds read (doc_id, source, size, key).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from . import shared

WORD = "[^\\x20\\x09-\\x0D]+"
DIGIT_BITS, LEVELS, KEY_BITS = 8, 7, 56


def _shift_right(col, bits: int):
    return F.shiftright(col, bits) if bits else col


def targets(by_source: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """source, source_size -> also target: share of all sizes by weight, no target over cap times its source's size, the
    excess reshared by weight. A source is at its cap if cap/weight is below the common level; taking sources by
    cap/weight, the level after k capped ones is (budget - caps) / (other weights), and the first source whose
    cap/weight reaches its level ends the capped ones."""
    s = numbered(by_source, [F.asc_nulls_last("source")], {}, "mix-sources")
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int")).cast("long")
    s = s.select("source", "source_size", F.col("pos").alias("rank"), w.alias("w"), (F.col("source_size") * cap).alias("cap"))
    s = numbered(s, [F.col("cap") / F.col("w"), F.col("rank")], {"cap": "caps", "w": "ws"}, "mix-caps")
    all_size, all_w = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    budget = math.floor(all_size * float(share))
    s = s.withColumn("room", F.lit(budget).cast("long") - F.col("caps")).withColumn("rest_w", F.lit(all_w).cast("long") - F.col("ws"))
    reached = F.col("cap") * F.col("rest_w") >= F.col("w") * F.col("room")
    level = s.where(reached).agg(F.min_by(F.col("room") / F.col("rest_w"), "pos")).first()[0]
    full = F.lit(True) if level is None else F.col("cap") <= F.col("w") * F.lit(level)
    target = F.col("cap").cast("double") if level is None else F.when(full, F.col("cap").cast("double")).otherwise(F.col("w") * F.lit(level))
    return s.select("source", "source_size", target.alias("target"))


def _key(docs: DataFrame, text: str, id_col: str):
    t = shared.text_of(docs, text)
    own = F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("t"), F.md5(t)))
    return F.conv(F.substring(F.md5(own), 1, KEY_BITS // 4), 16, 10).cast("long")


def _copies(docs_source: Column, key: Column, edges: DataFrame, bits: int) -> tuple[Column, Column]:
    """The join condition with the edges, and how often the mix takes a row."""
    source, _, _, copies, prefix, whole, some = (F.col(c) for c in edges.columns)
    p = _shift_right(key, bits)
    once_more = some & ((p < prefix) | ((p == prefix) & whole))
    return docs_source.eqNullSafe(source), copies + once_more.cast("long")


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it. Rows without words have no part in word targets
    and stay once. Options as for mix()."""
    text, id_col, source = (options.get(k, d) for k, d in (("text", "text"), ("id_col", "doc_id"), ("source", "source")))
    _, edges, bits = _edges(docs, **options)
    n_times, n_th, *names = shared.unused(docs, "n_times", "n_th", *edges.columns)
    edges = edges.toDF(*names)
    on, times = _copies(docs[source].cast("string"), _key(docs, text, id_col), edges, bits)
    times = F.when(shared.text_of(docs, text).rlike(WORD), times).otherwise(1)
    joined = docs.join(shared.small(edges), on).withColumn(n_times, times).where(F.col(n_times) > 0)
    return joined.withColumn(n_th, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n_times)))).select(*[docs[c] for c in docs.columns])


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, size (words), source, source_size, target, taken (words the mix takes of the
    document, repeats counted: size times its number of copies, cap at most).

    Options: weights, share, cap, text, id_col, source. Sources in code-point order, null last, take the weights in turn.
    A source whose target is q times its size and a rest takes every document q times, and once more those under the key
    threshold. Its words come within half the boundary document of the target. Null text has size 0; a null id is keyed
    by the text; rows equal in id share a key and are taken alike. An empty table gives no rows."""
    sized, edges, bits = _edges(docs, **options)
    on, times = _copies(sized["source"], F.col("key"), edges, bits)
    return sized.join(shared.small(edges), on).select("doc_id", "size", "source", F.col("e_size").alias("source_size"), F.col("e_target").alias("target"), (F.col("size") * times).alias("taken"))


def _edges(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: int = 3, text: str = "text", id_col: str = "doc_id", source: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """The sized documents, and for each source its targets, whole copies and key threshold, in units of 2**bits keys."""
    t = shared.text_of(docs, text)
    sized = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source].cast("string").alias("source"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"), _key(docs, text, id_col).alias("key"))
    sized = shared.written(sized, "mix-sizes")
    wanted = shared.written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mix-targets")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = wanted.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    state = state.withColumn("below", F.lit(0).cast("long")).withColumn("cell", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        bits = KEY_BITS - DIGIT_BITS * level
        at = shared.small(state.where("rest > 0").select(F.col("source").alias("s"), "prefix"))
        inside = sized.join(at, sized["source"].eqNullSafe(F.col("s")) & (_shift_right(F.col("key"), bits + DIGIT_BITS) == F.col("prefix")))
        sums = inside.groupBy("source", _shift_right(F.col("key"), bits).alias("p")).agg(F.sum("size").alias("cell"), F.count("*").alias("n"))
        up_to = Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 256 rows a source
        run = sums.withColumn("upto", F.sum("cell").over(up_to))
        old = state.select(F.col("source").alias("s"), "rest", F.col("below").alias("below0"))
        passed = run.join(shared.small(old), run["source"].eqNullSafe(F.col("s"))).where((F.col("below0") + F.col("upto")) >= F.col("rest"))
        edge = passed.groupBy("source").agg(F.min_by(F.struct("p", "cell", "n", (F.col("below0") + F.col("upto") - F.col("cell")).alias("below")), "p").alias("e"))
        edge = edge.select(F.col("source").alias("es"), "e")
        state = state.join(shared.small(edge), state["source"].eqNullSafe(F.col("es")), "left").select(
            "source", "source_size", "target", "copies", "rest",
            *[F.coalesce(F.col(f"e.{new}"), F.lit(0)).cast("long").alias(name) for new, name in (("p", "prefix"), ("below", "below"), ("cell", "cell"), ("n", "n"))],
        )
        state = shared.written(state, f"mix-edge-{level}")
        if (state.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    whole = (F.col("rest") > 0) & ((F.col("rest") - F.col("below")) * 2 >= F.col("cell"))
    edges = state.select(
        F.col("source").alias("e_source"), F.col("source_size").alias("e_size"), F.col("target").alias("e_target"), F.col("copies").alias("e_copies"),
        F.col("prefix").alias("e_prefix"), whole.alias("e_whole"), (F.col("rest") > 0).alias("e_some"),
    )
    return sized, edges, bits


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))), 1, 14))::BIGINT AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER o, 0)::BIGINT AS room,
              (sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER o, 0)::BIGINT AS rest_w, row_number() OVER (ORDER BY cap / w, rank) AS nth
       FROM s1 WINDOW o AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (SELECT room::DOUBLE / rest_w::DOUBLE FROM s2 WHERE cap * rest_w >= w * room ORDER BY nth LIMIT 1) AS level FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN cap <= w * level THEN cap::DOUBLE ELSE w * level END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM s4),
s6 AS (SELECT *, target - copies * source_size AS rest FROM s5),
cells AS (SELECT source, key, sum(size)::BIGINT AS cell,
                 (sum(sum(size)) OVER (PARTITION BY source ORDER BY key))::BIGINT AS upto FROM sized GROUP BY source, key),
edge AS (SELECT c.source, min_by(c.key, c.key) AS key, min_by(c.cell, c.key) AS cell, min_by(c.upto - c.cell, c.key) AS below
         FROM cells c JOIN s6 ON c.source IS NOT DISTINCT FROM s6.source WHERE c.upto >= s6.rest GROUP BY c.source)
SELECT d.doc_id, d.size, d.source, s.source_size, s.target,
       d.size * (s.copies + CASE WHEN s.rest > 0 AND (d.key < e.key OR (d.key = e.key AND (s.rest - e.below) * 2 >= e.cell)) THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN s6 s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN edge e ON d.source IS NOT DISTINCT FROM e.source
"""
