"""Tables that changes are merged into, by copy-on-write.

A table is Parquet laid out in buckets of its key. A batch of changes is merged into the buckets that hold its keys and only
these are read and written anew, each replaced as a whole when the write commits; the others' files stay as they are. What a
batch sets is absolute, so a batch that is applied again, or after a write that broke off, leaves the table as applying it
once does.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import forget, keyed_side, written

BUCKET, BUCKETS = "_bucket", 64
#: Part of a bucket: its rows may go to several tasks.
SLICE = "_slice"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write df as a new table. buckets: so many that one fits a task; keys name a row and are never null."""
    _put(df.withColumn(BUCKET, bucket_of(keys, buckets)), path, buckets)
    schema = re.sub(r'("(?:nullable|containsNull|valueContainsNull)"): ?false', r"\1:true", df.schema.json())
    meta = [(keys, buckets, schema)]
    df.sparkSession.createDataFrame(meta, "keys array<string>, buckets int, schema string").coalesce(1).write.parquet(f"{path}/_keyed")


def _put(df: DataFrame, path: str, buckets: int) -> None:
    _replace(df.repartition(min(buckets, 200), BUCKET), path)


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def _meta(spark: SparkSession, path: str) -> tuple[list[str], int, T.StructType]:
    m = spark.read.schema("keys array<string>, buckets int, schema string").parquet(f"{path}/_keyed").first()
    return list(m["keys"]), m["buckets"], T.StructType.fromJson(json.loads(m["schema"]))


def read(spark: SparkSession, path: str, touched: list[int] | None = None) -> DataFrame:
    """The table's rows; of some buckets only, if told so."""
    _, _, schema = _meta(spark, path)
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)
    return (df if touched is None else df.where(F.col(BUCKET).isin(touched))).drop(BUCKET)


def touched_by(changes: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """The buckets that hold the keys of changes; at most as many as there are buckets."""
    return sorted(r[0] for r in changes.select(bucket_of(keys, buckets)).distinct().collect())


def dealt(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """df with BUCKET and SLICE, the rows of a slice in one task. What groups by the keys and these two moves no row again.
    There are several slices to a task, so that tasks are alike and a bucket of any size is shared among them."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-4 * tasks // buckets))
    return df.withColumns({BUCKET: bucket_of(keys, buckets), SLICE: F.pmod(F.hash(*keys), F.lit(slices))}).repartition(BUCKET, SLICE)


def apply(spark: SparkSession, path: str, changes: DataFrame, *, update: bool = True, insert: bool = False, whole: list[int] | None = None) -> list[int]:
    """Merge changes (the keys and the columns that they set, null included; a key at most once) and return the buckets that
    were rewritten. update: rows there are take what is set and keep their other columns; insert: keys there are not become
    rows, with nulls in columns not set. Neither drops a row. Changes to a column that the table lacks are an error. whole: changes are
    all rows that these buckets have from now on, with all columns and BUCKET (dealt); they may be made from the rows there, which
    stay until the write commits, so the rows are written once."""
    keys, buckets, schema = _meta(spark, path)
    if more := [c for c in changes.columns if c not in schema.names and not (whole is not None and c == BUCKET)]:
        raise ValueError(f"the table has no column {', '.join(more)}")
    if whole is not None:
        _replace(changes.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], BUCKET), path)
        return whole
    sets = [c for c in changes.columns if c not in keys]
    new = written(changes.select(*keys, F.struct(F.lit(True).alias("_hit"), *sets).alias("_new")), "changes")
    if not new.groupBy(*keys).agg(F.count("*").alias("_times")).where("_times > 1").isEmpty():
        raise ValueError("a key is changed twice in one batch")
    touched = touched_by(new, keys, buckets)
    if touched:
        old = read(spark, path, touched).withColumn("_old", F.lit(True))
        j = old.join(keyed_side(new), keys, "full" if insert else "left")
        take = F.col("_old").isNull() | (F.lit(update) & F.col("_new").isNotNull())
        columns = [F.col(f.name) if f.name in keys else F.when(take, F.col("_new")[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in sets else F.col(f.name) for f in schema.fields]
        merged = written(j.select(*columns).withColumn(BUCKET, bucket_of(keys, buckets)), "merged")  # beside the table, since it is read and replaced
        _put(merged, path, buckets)
        forget(merged)
    forget(new)
    return touched
