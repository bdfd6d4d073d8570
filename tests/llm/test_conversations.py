import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from chronofold.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, edit string, signature string, there int, kind int"


def conversation_rows() -> list[tuple]:
    rng = random.Random(3)
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 8)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "ünder"])
            text = rng.choice(["Hi there.", "What? Why! ", "cut off", "", " \t\n", None, "same", "ends. \x0b", "a\x1c", "日本。", "yes!"])
            rows.append((conv, turn if rng.random() < 0.9 else turn + 2, role, text))
    rows += [(500, t, "user" if t % 2 else "assistant", f"t{t % 50}.") for t in range(900)]  # a third of all rows
    rows += [(600, 3, "user", "dropped?")] * 2 + [(None, 1, "user", "x."), (None, None, "assistant", "y."), (700, None, None, None)]
    rows += [(c, 2, "user", "a.") for c in range(800, 840)]  # some conversations lose their only row
    return [(*r, "e", "s", 1, 2) for r in rows]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(conversation_rows(), SCHEMA).repartition(3)


def damaged(rows):
    space = lambda v: " " if v is None else str(v)
    out = {}
    for conv, turn, role, text, *_ in rows:
        h = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(rs, key=key) for c, rs in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, letters, repaired) by all ways, shortest first; memo on the place and what is due, nothing shared."""

    def ways(i, end):  # end: "" start, s, u, a
        due = {"": "user", "s": "user", "u": "assistant", "a": "user"}[end]
        found = [(0, "", ())] if i == len(rows) and end in ("", "a") else []
        if depth[0] < 3:
            depth[0] += 1
            found += [(c + 3, "I" + s, ((due, ""), *t)) for c, s, t in best(i, due[0])]
            depth[0] -= 1
        if i < len(rows):
            kept, depth[0] = depth[0], 0
            _, role, text = rows[i]
            found += [(c + 4, "D" + s, t) for c, s, t in best(i + 1, end)]
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] == due[0] or role[:1] == "s" and end == "":
                    found += [(c + more, "K" + s, ((role, text), *t)) for c, s, t in best(i + 1, role[0])]
                found += [(c + 3 + more, "R" + s, ((due, text), *t)) for c, s, t in best(i + 1, due[0])]
            depth[0] = kept
        return found

    memo, depth = {}, [0]

    def best(i, end):
        key = (i, end, depth[0])
        if key not in memo:
            memo[key] = sorted(ways(i, end))[:1]
        return memo[key]

    return best(0, "")[0]


def summary(rows):
    faults = faults_of(rows)
    turns = {t for t, *_ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, letters, repaired = cheapest(rows, faults)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, sha)


def test_repair_is_the_cheapest_of_all_edits(table):
    import sys

    sys.setrecursionlimit(20_000)
    want = {c: summary(rows) for c, rows in damaged(conversation_rows()).items()}
    got = conversations.repair_damaged(table).collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want
    assert any(not rows for rows in damaged(conversation_rows()).values())


def test_every_short_signature():
    layers, before, at = [conversations.ROOT], "", 0
    signs = [conversations.letter(c, f) for c in range(4) for f in range(4)]
    alike = {1: 2}  # a blank costs as a duplicate does
    for s in sorted("".join(p) for n in range(4) for p in itertools.product([x for i, x in enumerate(signs) if i % 4 not in alike], repeat=n)):
        at += conversations.descend(layers, before, s)
        before = s
        codes = [divmod(ord(x) - ord("A"), 4) for x in s]
        rows = [(i, "sua-"[c], "t") for i, (c, _) in enumerate(codes)]
        faults = [("", "blank", "duplicate", "truncated")[f] for _, f in codes]
        assert conversations.answer(layers) == cheapest(rows, faults)[:2], s
    assert at == sum(12**n for n in range(1, 4))  # each prefix once


def test_repaired_rows(table):
    rows = conversations.damage(table)
    repairs = conversations.repair(rows)
    out = conversations.repaired(rows, repairs).collect()
    by = {}
    for r in out:
        by.setdefault(r.conv_id, []).append(r)
    for rs in by.values():
        roles = "".join(r.role[0] for r in rs)
        roles = roles[1:] if roles[0] == "s" else roles
        assert roles and roles == "ua" * (len(roles) // 2)
    letters = {r.conv_id: r.audit for r in repairs.collect()}
    assert all("".join(r.edit for r in by.get(c, [])) == s.replace("D", "") for c, s in letters.items())


def test_undamaged_rows_and_empty_table(spark):
    good = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "assistant", "a!"), (2, 0, "user", "only.")], "conv_id int, turn long, role string, text string").withColumn("there", F.lit(True))
    got = {r.conv_id: (r.cost, r.audit, r.illegal) for r in conversations.repair(good).collect()}
    assert got == {1: (0, "KKK", 0), 2: (3, "KI", 0)}
    assert conversations.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_gives_the_same(spark, table):
    import duckdb

    rows = [r[:4] for r in conversation_rows() if r[0] != 500 or r[1] < 40]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.sql(conversations.ORACLE)
    got = conversations.repair_damaged(table.where("conv_id is null or conv_id <> 500 or turn < 40"))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
