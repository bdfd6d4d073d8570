"""Deterministic draws: a value is a pure function of the run's seed and of the names of its position, never of the order in
which rows are met. The sequence of bits differs from other generators'; the property is what counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: Column, *parts: Column) -> Column:
    """A double in [0, 1) by md5 of the seed and the length-prefixed parts (so that ("ab", "c") is not ("a", "bc")): the
    first 52 bits."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    named = [F.concat(F.octet_length(t).cast("string"), F.lit("#"), t) for t in texts]
    digest = F.md5(F.concat(seed.cast("string"), F.lit("|"), *named))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def uniform_sql(seed: str, *parts: str) -> str:
    """The same as DuckDB SQL."""
    named = " || ".join(f"(strlen(coalesce(({p})::VARCHAR, ''))::VARCHAR || '#' || coalesce(({p})::VARCHAR, ''))" for p in parts)
    return f"(('0x' || substr(md5(({seed})::VARCHAR || '|' || {named}), 1, 13))::BIGINT / {float(1 << 52)!r})"


def should_retry(attempt: Column, max_attempts: Column, permanent: Column) -> Column:
    return ~permanent & (attempt < max_attempts)


def backoff_ms(attempt: Column, initial: Column, multiplier: Column, most: Column, jitter: Column, u: Column) -> Column:
    """The wait before the attempt after this one: exponential, capped, then jittered by up to the given fraction either
    way (so it may pass the cap), never negative."""
    n = F.greatest(attempt, F.lit(1)) - 1
    base = F.when(multiplier > 1, initial * F.pow(multiplier, n)).otherwise(initial.cast("double"))
    base = F.when((most > 0) & (base > most), most.cast("double")).otherwise(base)
    return F.floor(F.greatest(F.lit(0.0), base * (1 + jitter * (2 * u - 1)))).cast("long")


def fault_fires(u: Column, probability: Column, explicit: Column) -> Column:
    """Whether a fault fires: always at an explicit point, else by its probability."""
    return explicit | (u < probability)


def fault_draw(u: Column, explicit: Column, index: Column) -> Column:
    """What is recorded: the fault's index at an explicit point, else the draw in billionths."""
    return F.when(explicit, index.cast("long")).otherwise(F.floor(u * 1e9).cast("long"))
