"""Sharding by global byte-size prefix sums: contiguous shards in doc_id order, cut at equal byte targets.

The text is read once, for its size and checksum. The narrow rows are range-partitioned and sorted by id, each
partition is summed for itself, the partitions' totals give each partition its offset, and the row whose middle byte
lies in the k-th of n equal stretches goes to shard k. A shard's bytes differ from the target by one document at most.
Each row names its group, the hash of its text; groups of equal texts lie where their ids do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

OVERHEAD = 16

#: The checksum by half bytes, the lower half first: crc = T[(crc xor n) mod 16] xor crc / 16.
_CRC_OF_NIBBLES = [0, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]

#: DuckDB SQL of shard_by_bytes over documents into 40 shards.
ORACLE = f"""WITH d AS (SELECT doc_id::BIGINT AS doc_id, encode(coalesce("text", '')) AS b FROM documents),
n AS (SELECT doc_id, octet_length(b)::BIGINT + {OVERHEAD} AS size, md5(b) AS text_group, CASE WHEN octet_length(b) = 0 THEN []::BIGINT[] ELSE
  list_transform(string_split(regexp_replace(hex(b), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: (strpos('0123456789ABCDEF', x) - 1)::BIGINT) END AS nibbles FROM d),
c AS (SELECT doc_id, size, text_group, xor(list_reduce(nibbles, lambda c, x: xor(list_extract({_CRC_OF_NIBBLES}::BIGINT[], (xor(c, x) & 15) + 1), c >> 4), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM n),
s AS (SELECT *, sum(size) OVER o - size AS start, sum(size) OVER () AS total FROM c WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, least(39, (start * 2 + size) * 40 // (2 * total))::INT AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard, text_group FROM p"""


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, *, text: str = "text", id_col: str = "doc_id", overhead: int = OVERHEAD) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law),
    text_group (md5 of the text: equal texts have the same).

    size: UTF-8 bytes of the text (null: none) plus overhead, so empty documents spread too. slot counts from 0 without
    gaps in each shard, in order of doc_id (null ids first, then by checksum and size). Equal texts are not kept
    together: a group of copies can be larger than a shard. An empty table gives no rows."""
    t = shared.text_of(docs, text)
    sized = docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(t) + overhead).cast("long").alias("size"), F.crc32(t).cast("long").alias("text_crc32"), F.md5(t.cast("binary")).alias("text_group"))
    sized = shared.written(sized, "shard-sizes")
    summed = shared.with_prefix_sums(sized, ["doc_id", "text_crc32", "size"], "size", "shard-order")
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    placed = summed.withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"cast((start * 2 + size) * {n_shards} div {max(2 * total, 1)} as int)")))
    firsts = placed.groupBy("shard").agg(F.min("pos").alias("first_pos"))  # n_shards rows
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("pos") - F.col("first_pos")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "text_group")
