"""Where intermediate tables go: a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the folder given to setCheckpointDir. Where both are unset, a local master
    gets a temporary folder and a cluster gets a folder in the warehouse."""
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (set_dir.get() if set_dir.isDefined() else None)
    if base:
        return base.rstrip("/") + "/chronofold"
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_chronofold"
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="chronofold-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def written(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors, and what several plans read
    is made once."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._chronofold_path = path
    return out


def keyed_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: the join sorts and merges. Left to itself Spark sends such a side through
    the driver to all executors if its compressed columns take little room, however many rows they hold."""
    return df.hint("merge")


def forget(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._chronofold_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
