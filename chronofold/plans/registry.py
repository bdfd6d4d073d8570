"""Named queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import template

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, *, journal: bool = False, damaged: bool = False):
    """Register a function (spark, sf_dir) -> DataFrame under its name. journal puts the template journal before the
    oracle's SQL as a common table expression, damaged its corrupt variant too."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            parts = [template.journal_sql()] * (journal or damaged) + [template.corrupted_sql()] * damaged
            body = oracle.strip()
            if parts:
                head = "WITH " + ",\n".join(parts)
                body = head + (",\n" + body[5:] if body[:5].upper() == "WITH " else "\n" + body)
            ORACLE_SQL[f.__name__] = body
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
