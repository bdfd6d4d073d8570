"""Text and payload functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V


def decode(payload: Column) -> Column:
    """The payload as one wide struct; fields its type does not have are null."""
    return F.from_json(payload, V.PAYLOAD)


def encode(**fields: Column) -> Column:
    """A payload: an object stamped with version 1. Null fields are left out."""
    return F.to_json(F.struct(F.lit(1).alias("v"), *[c.alias(n) for n, c in fields.items()]))


def first_line(s: Column) -> Column:
    return F.substring_index(s, "\n", 1)


def compact(s: Column) -> Column:
    """The first line, cut to 57 characters and three dots if longer than 60."""
    line = first_line(s)
    return F.when(F.length(line) > 60, F.concat(F.substring(line, 1, 57), F.lit("..."))).otherwise(line)


def _fields(payload: Column, build) -> Column:
    """build(map of the payload's fields as text): the payload is parsed once, however many fields build reads."""
    parsed = F.array(F.from_json(payload, "map<string,string>"))
    return F.element_at(F.transform(parsed, build), 1)


def summary(payload: Column, keys: Sequence[str] = V.SUMMARY_KEYS) -> Column:
    """key=value of the payload keys that are present, in fixed order."""
    return _fields(payload, lambda m: F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), compact(m[k])) for k in keys]))


def summary_web(payload: Column, keys: Sequence[str] = V.SUMMARY_KEYS_WEB) -> Column:
    """The dashboard's variant: empty values are dropped too, long ones cut to 57 and an ellipsis, two spaces between."""

    def part(m: Column, k: str) -> Column:
        v = F.nullif(m[k], F.lit(""))
        return F.concat(F.lit(f"{k}="), F.when(F.length(v) > 60, F.concat(F.substring(v, 1, 57), F.lit("…"))).otherwise(v))

    return _fields(payload, lambda m: F.concat_ws("  ", *[part(m, k) for k in keys]))


def truncate_error(s: Column, limit: int = 2048) -> Column:
    """Texts over limit bytes are cut to that many bytes, or to the last whole character before, with a mark."""
    data = s.cast("binary")
    inside = lambda at: F.hex(F.substring(data, at + 1, 1)).between("80", "BF")  # noqa: E731  byte at + 1 goes on with a character
    length = F.when(~inside(limit), limit).when(~inside(limit - 1), limit - 1).when(~inside(limit - 2), limit - 2).otherwise(limit - 3)
    cut = F.substring(data, F.lit(1), length).cast("string")
    return F.when(F.octet_length(s) > limit, F.concat(cut, F.lit("... (truncated)"))).otherwise(s)


def short_hash(h: Column) -> Column:
    return F.when(F.length(h) > 12, F.substring(h, 1, 12)).when(h == "", F.lit("(none)")).otherwise(h)


def short_id(s: Column, n: int = 8) -> Column:
    return F.substring(s, 1, n)


def effect_key(run: Column, task: Column, operation: Column) -> Column:
    return F.concat_ws(":", run.cast("string"), task, operation)


def name_and_version(arg: Column) -> Column:
    """struct(name, version) of name@version; without a positive version the whole text is the name and version 0."""
    version = F.regexp_extract(arg, r"^(.+)@(\d+)$", 2).try_cast("int")
    good = F.coalesce(version > 0, F.lit(False))
    return F.struct(F.when(good, F.regexp_extract(arg, r"^(.+)@(\d+)$", 1)).otherwise(arg).alias("name"), F.when(good, version).otherwise(0).alias("version"))


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_-]{1,64}$"), F.lit(False))


def valid_sha256(h: Column) -> Column:
    return F.coalesce(h.rlike(r"^[0-9a-f]{64}$"), F.lit(False))


def valid_uuid(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), F.lit(False))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def format_set(values: Column) -> Column:
    """An array's distinct values, sorted and joined by commas; 'none' if there are none."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(values)), ", "), F.lit("")), F.lit("none"))


def redact(s: Column, dsn: Column, password: Column) -> Column:
    """The connection string and its password are not shown."""
    return F.replace(F.replace(s, dsn, F.lit("[redacted]")), password, F.lit("[redacted]"))


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return found if default is None else F.coalesce(found, default)


def label(kind: Column) -> Column:
    """The plain-language name of an event type; a type without one is its own."""
    return lookup(kind, V.LABEL_OF, kind)


def groups(kind: Column) -> Column:
    """The groups of an event type; none for an unknown type."""
    table = F.create_map(*[x for k, v in V.GROUPS_OF.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(table[kind], F.array().cast("array<string>"))


def migration_name(file: Column) -> Column:
    """struct(version, name) of a file such as 001_init.sql."""
    pattern = r"^(\d+)_(.+)\.sql$"
    return F.struct(F.nullif(F.regexp_extract(file, pattern, 1), F.lit("")).cast("int").alias("version"), F.nullif(F.regexp_extract(file, pattern, 2), F.lit("")).alias("name"))


def sqlstate_class(code: Column) -> Column:
    """The error class of an SQLSTATE."""
    return lookup(code, {"23505": "conflict", "23503": "reference", "23514": "check", "40001": "serialization", "40P01": "deadlock"}, F.lit("other"))
