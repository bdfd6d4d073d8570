"""Exact dedup by content sort, in DataFrame operations only.

Texts are range-partitioned by sampled splitters over a bounded head of their normalised bytes (the first 24
characters, then a 64-bit hash of the whole), sorted externally within each partition, and compared in full with their
neighbours in the sort (the window's group boundary is equality of the whole text). Bounded splitter keys keep the
splitter sample small however long texts are.

A text whose copies together hold more than a partition's share of the bytes (a row counts ROW_BYTES besides its text)
would land in one task. Such texts are found first by sums over the 64-bit hash (map-side combined, a few bytes a row),
and their rows take a salt into sort key and group: each salted group is compared and summed alone, and the salted groups
of a text, at most SALTS of each, are then merged. The number of such hashes is bounded by HOT_PER_PARTITION times the
number of shuffle partitions, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SALTS = 64
HOT_PER_PARTITION = 8
ROW_BYTES, HOT_BYTES = 64, 4096
HEAD_CHARS = 24


def exact_dedup(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", keep: str = "max", normalise=None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (the id that stays of the equal texts), group_size, kept, text_sha256.

    keep: "max" or "min" id stays. normalise: Column -> Column applied to the text first (None: no change).
    Null text counts as empty. Of fully repeated rows one is kept. A null id stays only if its group has no other id;
    then keep_id is null. An empty table gives no rows. Other columns are not read."""
    if keep not in ("max", "min"):
        raise ValueError(f"keep is max or min, not {keep!r}")
    norm = normalise or (lambda c: c)
    t: Column = norm(shared.text_of(docs, text))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), t.alias("t")).withColumn("h", F.xxhash64("t"))
    spark = docs.sparkSession

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.octet_length("t").cast("long") + ROW_BYTES).alias("bytes"))
    counts = shared.written(counts, "dedup-counts")
    total = max(counts.agg(F.sum("bytes")).first()[0] or 0, 1)
    # At most HOT_PER_PARTITION * parts texts can hold such a share of all bytes, so these can be broadcast.
    hot = F.broadcast(counts.where((F.col("n") > 1) & (F.col("bytes") > max(HOT_BYTES, total // (HOT_PER_PARTITION * parts)))).select(F.col("h").alias("hot_h")))

    salted = (
        rows.join(hot, F.col("h") == F.col("hot_h"), "left")
        .withColumn("head", F.substring("t", 1, HEAD_CHARS))
        .withColumn("salt", F.when(F.col("hot_h").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SALTS)).cast("int")))
        .withColumn("is_hot", F.col("hot_h").isNotNull())
        .drop("hot_h")
    )
    ranged = salted.repartitionByRange("head", "h", "salt")
    best, order = (F.max, F.desc_nulls_last) if keep == "max" else (F.min, F.asc_nulls_last)
    # Range partitioning by (head, h, salt) already brings each of these groups together: no further exchange.
    group = Window.partitionBy("head", "h", "salt", "t").orderBy(order("doc_id"))
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    compared = ranged.select(
        "doc_id", "h", "is_hot", F.sha2("t", 256).alias("text_sha256"), best("doc_id").over(whole).alias("sub_keep"),
        F.count("*").over(whole).alias("sub_size"), F.row_number().over(group).alias("nth"), "t",
    )
    # Of each salted group its first row carries the text on, for the merge to compare in full.
    compared = compared.withColumn("t", F.when(F.col("is_hot") & (F.col("nth") == 1), F.col("t")))
    table = shared.written(compared, "dedup-sorted")

    merged = table.where("is_hot and nth = 1").groupBy("h", "t").agg(best("sub_keep").alias("m_keep"), F.sum("sub_size").alias("m_size"))
    merged = shared.written(merged.select(F.sha2("t", 256).alias("m_sha"), "m_keep", "m_size"), "dedup-merged")
    out = table.drop("t").join(shared.small(merged), (F.col("text_sha256") == F.col("m_sha")) & F.col("is_hot"), "left")
    keep_id = F.when(F.col("is_hot"), F.col("m_keep")).otherwise(F.col("sub_keep"))
    size = F.when(F.col("is_hot"), F.col("m_size")).otherwise(F.col("sub_size"))
    first = (F.col("nth") == 1) & F.col("doc_id").eqNullSafe(keep_id)
    # Null ids of a hot text share one salt, as do repeated rows: nth = 1 marks one of them.
    return out.select("doc_id", keep_id.alias("keep_id"), size.cast("long").alias("group_size"), first.alias("kept"), "text_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
