"""Repair of conversations by cheapest edits, with one dynamic programme over a trie of signatures.

A conversation's signature has a letter for each row in order: the class of its role and its first fault. What the repair
costs and which edits it takes follow from the signature alone, so each distinct signature is answered once; the sorted
signatures are walked as a trie, whose path from the root holds one layer of the programme for each letter, so that a
prefix that many signatures share is worked out once, and a signature's end emits its answer.

A repaired conversation's roles read: nothing, or a system row if any, then user and assistant in turn, ending with
assistant. Edits, in order: K keeps a row, R gives it the role that is due (user or assistant), D deletes it, I inserts an
empty row of the role that is due. What is due follows from the rows before, so the letters say all. Of equally cheap
edits those whose letters sort first are taken.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

RE_ROLE, DELETE, INSERT, LEFT_TRUNCATED = 3, 4, 3, 3
CLASSES, FAULTS = "sua-", ("none", "blank", "duplicate", "truncated")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Where the rows so far end: nowhere, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What is due after each, and where it leads.
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Where a kept row of a class (an index of CLASSES) leads.
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}

SPACES = " \t\n\x0b\x0c\r"


def letter(role_class: int, fault: int) -> str:
    return chr(ord("A") + 4 * role_class + fault)


def damage(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, there: rows damaged by crc32 of `conv_id:turn`, modulo 20: 0 drops the row (it stays as
    one that is not there, so that no conversation is lost), 1 empties its text, 2 removes its `.`, `!` and `?`, 3 repeats
    it, 4 makes its role user. A null role, text or part of the key counts as one space; a null turn stays null."""
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", space(rows[conv]), space(rows[turn]))) % 20
    new_text = F.when(h == 1, "").when(h == 2, F.translate(space(rows[text]), ".!?", "")).otherwise(space(rows[text]))
    new_role = F.when(h == 4, "user").otherwise(space(rows[role]))
    copies = F.explode(F.when(h == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(h != 0))).alias("there")
    return rows.select(rows[conv].alias("conv_id"), rows[turn].cast("long").alias("turn"), new_role.alias("role"), new_text.alias("text"), copies)


def _order() -> list[Column]:
    """Rows of a turn of their own lie by role and digest; equal rows are alike, so it does not matter which is first."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, signature of rows (conv_id, turn, role, text, there). Texts stay where they are read: their faults
    and digests move, in one shuffle by conversation, and in a task the rows of a conversation stream past."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    seen = rows.select(
        "conv_id", "turn", "role", "there", _digest("text").alias("digest"),
        F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0).alias("own"),
    ).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "there").orderBy(F.col("turn").asc_nulls_first())) > 1
    role_class = F.greatest(F.position(F.substring("role", 1, 1), F.lit(CLASSES[:3])) - 1, F.lit(-1))
    role_class = F.when((F.col("role") == "") | (role_class < 0), 3).otherwise(role_class)
    fault = F.when(F.col("own") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("own"))
    code = F.when(F.col("there"), F.lit(ord("A")) + 4 * role_class + fault).otherwise(0).cast("int")
    placed = seen.withColumn("code", code).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, parts, stats = None, [], None

        def done():
            said = b"".join(parts).decode()
            low, high, n, _ = stats
            return now, 0 if low is None else high - low + 1 - n, said

        for b in batches:
            out, codes, turns = [], b.column(2).to_numpy().astype(np.uint8), b.column(1).to_pylist()
            for conv, at, to in _runs(b.column(0)):
                if stats is None or conv != now:
                    if stats is not None:
                        out.append(done())
                    now, parts, stats = conv, [], (None, None, 0, None)
                here = codes[at:to]
                parts.append(here[here > 0].tobytes())
                low, high, n, previous = stats
                for t, c in zip(turns[at:to], here.tolist(), strict=True):
                    if c and t is not None:
                        low, high, n, previous = t if low is None else low, t, n + (t != previous), t
                stats = (low, high, n, previous)
            if out:
                yield _rows(out, names, types)
        if stats is not None:
            yield _rows([done()], names, types)

    names, types = ["conv_id", "gaps", "signature"], [None, pa.int64(), pa.string()]
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, gaps long, signature string"
    return placed.select("conv_id", "turn", "code").mapInArrow(_typed(run, types), schema)


def _typed(run, types: list):
    """run, with the first of its output types set to that of its first input column."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def seen():
            for b in batches:
                types[0] = b.column(0).type
                yield b

        return run(seen())

    return wrapped


def _rows(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _runs(column: pa.Array) -> Iterator[tuple[object, int, int]]:
    """(value, first, end) of each run of equal values, null being one."""
    import pyarrow.compute as pc

    encoded = pc.run_end_encode(column)
    at = 0
    for value, end in zip(encoded.values.to_pylist(), encoded.run_ends.to_pylist(), strict=True):
        yield value, at, end
        at = end


@functools.lru_cache(maxsize=100_000)
def step(costs: tuple, ranks: tuple, sign: str) -> tuple[int, tuple, tuple, tuple]:
    """The layer after one more row. A layer has, for each place where the rows so far may end, the least cost (None: not
    to be reached; the least of a layer is 0) and the rank of its letters among the layer's. Returns what to add to all
    costs, costs, ranks, and for each place (place before, letters). All letters of a layer end with one edit of the same
    row, so none is the beginning of another: ranks before decide, then the letters added, and a later letter never turns
    an order round."""
    role_class, fault = divmod(ord(sign) - ord("A"), 4)
    best: dict[int, tuple] = {}

    def offer(place: int, cost: int, before: int, added: str) -> None:
        best[place] = min(best.get(place, (1 << 60, 0, "", 0)), (cost, ranks[before], added, before))

    for before, cost in enumerate(costs):
        if cost is None:
            continue
        place, added = before, ""
        for _ in range(3):  # further inserts only come round
            offer(place, cost + DELETE, before, added + "D")
            if fault not in (BLANK, DUPLICATE):
                left = cost + (LEFT_TRUNCATED if fault == TRUNCATED else 0)
                if (place, role_class) in KEPT:
                    offer(KEPT[place, role_class], left, before, added + "K")
                offer(DUE[place], left + RE_ROLE, before, added + "R")
            place, cost, added = DUE[place], cost + INSERT, added + "I"
    least = min(v[0] for v in best.values())
    order = sorted(best, key=lambda p: best[p][1:3])
    return (
        least,
        tuple(best[p][0] - least if p in best else None for p in range(4)),
        tuple(order.index(p) if p in best else 0 for p in range(4)),
        tuple((best[p][3], best[p][2]) if p in best else None for p in range(4)),
    )


ROOT = (0, (0, None, None, None), (0, 0, 0, 0), None)
#: Inserts that end a conversation well from each place.
CLOSE = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def answer(layers: list[tuple]) -> tuple[int, str]:
    """Cost and letters of the cheapest repair along a path of the trie."""
    total, costs, ranks, _ = layers[-1]
    cost, _, place = min((c + INSERT * len(CLOSE[p]), ranks[p], p) for p, c in enumerate(costs) if c is not None)
    letters = [CLOSE[place]]
    for _, _, _, came in reversed(layers[1:]):
        place, added = came[place]
        letters.append(added)
    return total + cost, "".join(reversed(letters))


def descend(layers: list[tuple], before: str, signature: str) -> int:
    """Turn the path of the trie to one signature into that to another; layers of what they share stay. Returns how many
    layers were made."""
    shared_letters = 0
    for x, y in zip(before, signature, strict=False):
        if x != y:
            break
        shared_letters += 1
    del layers[shared_letters + 1 :]
    for sign in signature[shared_letters:]:
        total, costs, ranks, _ = layers[-1]
        more, costs, ranks, came = step(costs, ranks, sign)
        layers.append((total + more, costs, ranks, came))
    return len(signature) - shared_letters


def solved(distinct: DataFrame) -> DataFrame:
    """signature, blank, duplicate, truncated, illegal, cost, audit of distinct signatures. They are sorted in ranges, so
    those that share a prefix lie together; a task holds the layers of one path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, before = [ROOT], ""
        roles = {ord(letter(c, f)): CLASSES[c] for c in range(4) for f in range(4)}
        for b in batches:
            out = []
            for s in b.column(0).to_pylist():
                descend(layers, before, s)
                before = s
                said = s.translate(roles)
                illegal = max(len(s) - 1, 0) - sum(map(said.count, ("su", "ua", "au")))
                out.append((s, *(sum(s.count(letter(c, f)) for c in range(4)) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, *answer(layers)))
            if out:
                yield _rows(out, names, types)

    names = ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = [pa.string(), *[pa.int64()] * 5, pa.string()]
    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(run, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for each conversation of rows (conv_id, turn, role,
    text, there: false for a row that only names its conversation).

    Rows are taken by turn, nulls first, then role and digest of the text. gaps are turns missing between the least and the
    largest, nulls aside. A row's first fault counts: blank (nothing but white space), duplicate (role and text of an
    earlier row), truncated (the last character that is not white space is none of `.!?`). A null conv_id is a conversation
    like any. A conversation without rows has zeros and no edits. An empty table gives an empty result."""
    each = shared.written(signatures(rows), "signatures")
    solutions = shared.written(solved(each.select("signature").distinct()), "solutions")
    return each.join(solutions, "signature").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, role, text, edit (K, R or I) of the repaired conversations, each in one partition and in order. A
    conversation's edits come first in its partition and its rows stream past them, so a task holds one conversation's
    letters and no more than a batch of texts."""
    edits = repairs.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("kind"))
    own = rows.where("there").select("conv_id", "turn", "role", "text", _digest("text").alias("digest"), F.lit(1).alias("kind"))
    placed = edits.unionByName(own).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, at, place = None, "", 0, START
        role_of = {USER: "user", ASSISTANT: "assistant"}
        for b in batches:
            out = []

            def inserted() -> None:
                nonlocal at, place
                while at < len(audit) and audit[at] == "I":
                    at, place = at + 1, DUE[place]
                    out.append((now, role_of[place], "", "I"))  # noqa: B023  of this batch

            for conv, role, text, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    now, audit, at, place = conv, text, 0, START
                    inserted()
                    continue
                edit, at = audit[at], at + 1
                if edit == "R":
                    place = DUE[place]
                    role = role_of[place]
                elif edit == "K":
                    place = KEPT[place, CLASSES.index(role[0])]
                if edit != "D":
                    out.append((conv, role, text, edit))
                inserted()
            if out:
                yield _rows(out, names, types)

    names, types = ["conv_id", "role", "text", "edit"], [None, pa.string(), pa.string(), pa.string()]
    return placed.select("conv_id", "role", "text", "kind").mapInArrow(_typed(run, types), f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, role string, text string, edit string")


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, sha256 of each conversation's `role:text` joined by newlines, of rows as repaired() has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h is None or conv != now:
                    if h is not None:
                        out.append((now, h.hexdigest()))
                    now, h = conv, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if out:
                yield _rows(out, names, types)
        if h is not None:
            yield _rows([(now, h.hexdigest())], names, types)

    names, types = ["conv_id", "sha256"], [None, pa.string()]
    return conversations.select("conv_id", "role", "text").mapInArrow(_typed(run, types), f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, sha256 string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage conversations, repair them, and give what repair() gives with repaired_sha256 of each repaired conversation."""
    rows = damage(conversations)
    repairs = shared.written(repair(rows), "repairs")
    said = digests(repaired(rows, repairs)).withColumnRenamed("conv_id", "_conv")
    nothing = hashlib.sha256(b"").hexdigest()
    return repairs.join(said, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv").withColumn("repaired_sha256", F.coalesce("sha256", F.lit(nothing))).drop("sha256")


#: The same in DuckDB. crc32 goes byte by byte; the programme is a recursive table of the cheapest ways to each place.
ORACLE = r"""WITH RECURSIVE k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END)), 4294967295::BIGINT) % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
  unnest(CASE h WHEN 3 THEN [1, 2] WHEN 0 THEN [] ELSE [1] END) AS copy FROM h),
f AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM d),
r AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(c) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM f),
s AS (SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pos > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
moves(p, q, x, lines) AS (VALUES (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])),
edits(q, c, e, after) AS (SELECT q, NULL::VARCHAR, 'D', q FROM (VALUES (0), (1), (2), (3)) t(q) UNION ALL SELECT q, NULL::VARCHAR, 'R', CASE q WHEN 2 THEN 3 ELSE 2 END FROM (VALUES (0), (1), (2), (3)) t(q)
  UNION ALL SELECT * FROM (VALUES (0, 's', 'K', 1), (0, 'u', 'K', 2), (1, 'u', 'K', 2), (3, 'u', 'K', 2), (2, 'a', 'K', 3)) t(q, c, e, after)),
dp(conv_id, pos, place, way) AS (SELECT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM s
  UNION ALL SELECT dp.conv_id, r.pos, e.after, min({'cost': way.cost + 3 * length(m.x) + CASE e.e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END, 'audit': way.audit || m.x || e.e,
    'lines': list_concat(list_concat(way.lines, m.lines), CASE e.e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE e.after WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || text] END)})
  FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos + 1 JOIN moves m ON m.p = dp.place JOIN edits e ON e.q = m.q AND (e.c IS NULL OR e.c = r.c) WHERE e.e = 'D' OR fault NOT IN ('blank', 'duplicate') GROUP BY dp.conv_id, r.pos, e.after),
ends AS (SELECT dp.conv_id, min({'cost': way.cost + 3 * length(x), 'audit': way.audit || x, 'lines': list_concat(way.lines, m.lines)}) AS way FROM dp JOIN s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.n = dp.pos
  JOIN (VALUES (0, '', []::VARCHAR[]), (1, 'II', ['user:', 'assistant:']), (2, 'I', ['assistant:']), (3, '', [])) m(place, x, lines) ON m.place = dp.place GROUP BY dp.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost, coalesce(way.audit, '') AS audit,
  sha256(coalesce(array_to_string(way.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id"""
