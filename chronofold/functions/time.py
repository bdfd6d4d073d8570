"""Time arithmetic on TIMESTAMP_NTZ columns. Milliseconds are long; `now` is always a literal."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_MS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1.0, "s": 1e3, "m": 60e3, "h": 3600e3}


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ms_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end, cut toward zero."""
    return ((micros(end) - micros(start)) / 1000).cast("long")


def plus_ms(ts: Column, ms: Column | int) -> Column:
    """ts moved by a number of milliseconds."""
    ms = ms if isinstance(ms, Column) else F.lit(ms)
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ms.cast("decimal(18,6)") / 1000)


def at(literal: str) -> Column:
    """A literal instant, such as '1995-01-01 00:00:00'."""
    return F.lit(literal).cast("timestamp_ntz")


def instant(ts: Column) -> Column:
    """ts as a payload writes it: RFC 3339 in UTC, no fraction or one without closing zeros."""
    return F.concat(F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


def parse_ms(text: str) -> int:
    """Milliseconds of a duration with units ('1m30s'); a bare number is refused."""
    found = re.fullmatch(r"([+-]?)((?:\d+(?:\.\d*)?|\.\d+)(?:ns|us|µs|ms|s|m|h))+", text)
    if not found:
        raise ValueError(f"{text!r} is not a duration with a unit, such as 30s")
    total = sum(float(n) * _UNIT_MS[u] for n, u in re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text))
    return int(-total if text.startswith("-") else total)


def duration_ms(text: Column) -> Column:
    """parse_ms as a column expression; text that is no duration gives null."""
    unit = lambda u: F.aggregate(F.regexp_extract_all(text, F.lit(rf"(\d+(?:\.\d+)?){u}(?![a-zµ])"), F.lit(1)), F.lit(0.0), lambda a, x: a + x.cast("double"))
    total = unit("h") * 3600e3 + unit("m") * 60e3 + unit("s") * 1e3 + unit("ms") + unit("us") * 1e-3 + unit("ns") * 1e-6
    return F.when(text.rlike(r"^((\d+(\.\d+)?)(ns|us|ms|s|m|h))+$"), total.cast("long"))


def clock(ts: Column, *, precise: bool = False) -> Column:
    """HH:mm:ss, or with milliseconds; a dash for null."""
    return F.coalesce(F.date_format(ts, "HH:mm:ss.SSS" if precise else "HH:mm:ss"), F.lit("—"))


def human_duration(start: Column, end: Column) -> Column:
    """Null while unfinished or negative; else 12ms, 3.50s or 2m 5s."""
    ms = ms_between(start, end)
    minutes = F.concat((ms / 60000).cast("long").cast("string"), F.lit("m "), F.round((ms % 60000) / 1000).cast("long").cast("string"), F.lit("s"))
    text = F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.format_string("%.2fs", ms / 1000)).otherwise(minutes)
    return F.when(ms >= 0, text)
