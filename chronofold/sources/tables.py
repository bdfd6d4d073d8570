"""Table sources and sinks: strict schemas, JDBC, the nested snapshot, schema migrations, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of V.TABLES as Parquet under base; columns and types are the schema's, never inferred."""
    return spark.read.schema(V.TABLES[name]).parquet(f"{base}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, name: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table over JDBC, in parallel by ranges of a numeric key if bounds are given. Filters and columns are pushed down."""
    r = spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize="10000", **options)
    if key and bounds:
        r = r.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return r.load()


def journal(events: DataFrame) -> DataFrame:
    """Events as a journal: the empty task name and null are the same."""
    return events.withColumn("task_name", F.nullif("task_name", F.lit("")))


def snapshot(runs: DataFrame, tasks: DataFrame, events: DataFrame) -> DataFrame:
    """One nested row a run: {run, tasks, events}, tasks and events in order. Each table is grouped by run once."""
    pack = lambda df, order, name: df.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c not in (order, "run_id")]))).alias(name))
    flat = runs.select(F.col("id").alias("run_id"), F.struct(*runs.columns).alias("run"))
    return flat.join(pack(tasks, "task_name", "tasks"), "run_id", "left").join(pack(events, "seq", "events"), "run_id", "left")


def write_snapshot(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("run", "tasks", "events"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """Snapshot lines as nested rows; a line that does not fit the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Text columns with a header, as one file: for results of a row a matrix point."""
    rows.coalesce(1).write.option("header", True).csv(path)


def migrations(spark: SparkSession, path: str) -> DataFrame:
    """version, name, checksum of the .sql files under path; a version that two files have is an error when read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sql").load(path)
    named = files.select(text.migration_name(F.element_at(F.split("path", "/"), -1)).alias("m"), F.sha2("content", 256).alias("checksum")).select("m.*", "checksum")
    one = named.groupBy("version").agg(F.count("*").alias("n"), F.first("name").alias("name"), F.first("checksum").alias("checksum"))
    return one.select(F.when(F.col("n") == 1, F.col("version")).otherwise(F.raise_error(F.lit("two migrations have one version")).cast("int")).alias("version"), "name", "checksum")


def drift(shipped: DataFrame, applied: DataFrame) -> DataFrame:
    """version, state of every migration: applied, pending, changed (another checksum) or unknown (not shipped)."""
    j = shipped.select("version", F.col("checksum").alias("s")).join(applied.select("version", F.col("checksum").alias("a")), "version", "full")
    return j.select("version", F.when(F.col("s").isNull(), "unknown").when(F.col("a").isNull(), "pending").when(F.col("a") == F.col("s"), "applied").otherwise("changed").alias("state"))


def migrate(spark: SparkSession, path: str, applied: DataFrame) -> list[tuple[int, str, str]]:
    """Run the pending .sql files under path in order, statement by statement (parted by semicolons at line ends); gives
    (version, name, checksum) of each, to be appended to schema_migrations. A shipped file that differs from what was
    applied is an error before anything runs."""
    shipped = migrations(spark, path)
    state = {r.version: r.state for r in drift(shipped, applied).collect()}  # a row for each file
    changed = sorted(v for v, s in state.items() if s == "changed")
    if changed:
        raise ValueError(f"migration {changed[0]:03d} was modified after it was applied; add a new migration instead")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sql").load(path)
    body = {r.v: bytes(r.content).decode() for r in files.select(text.migration_name(F.element_at(F.split("path", "/"), -1))["version"].alias("v"), "content").collect()}
    done = []
    for r in sorted(shipped.collect()):
        if state[r.version] == "pending":
            for statement in filter(str.strip, body[r.version].replace(";\r\n", ";\n").rstrip().rstrip(";").split(";\n")):
                spark.sql(statement)
            done.append((r.version, r.name, r.checksum))
    return done


def pages(page, key: str, size: int = V.MAX_PAGE):
    """Rows of page(after, size), a keyset page with has_more, one page at a time until the last. A page that says there is
    more without moving on is an error."""
    after = None
    while True:
        rows = page(after, size).orderBy(key).collect()
        yield from rows
        if not rows or not rows[-1]["has_more"]:
            return
        if after is not None and rows[-1][key] <= after:
            raise RuntimeError("a page does not move on")
        after = rows[-1][key]


def schema_version(migrations_: DataFrame) -> DataFrame:
    return migrations_.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))
