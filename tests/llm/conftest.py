import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, kept string, part int, h long"


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}{c}" for c in "abcdefgh" for _ in range(50)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randrange(5, 80)) for _ in range(60)]
    rows = [(i, base[i % 60] if i % 3 else text(30), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(120)]
    rows += [(1000 + i, base[0], "en", "s0") for i in range(90)]  # a third of all rows
    rows += [(2000, None, "en", "s1"), (2001, "", None, None), (2002, " \t\n", "fr", None), (None, text(20), None, "s2"), (None, None, None, None), (2003, text(30_000), "en", "s1")]
    rows += [(2004, "ÀÉ 日本 ünï 😀 a b\x1cc", "fr", "s0"), (2005, "12 34 !!", "en", "s0"), (2006, "one", "en", "s1"), (2007, "one two", "en", "s1")]
    rows += [rows[7], rows[7]]
    near = base[1].split()
    for i in range(12):
        edited = near + [f"x{i}"]
        rows.append((3000 + i, " ".join(edited), "en", "s2"))
    return [(*r, len(r[1] or ""), 7, 0.5, "yes", 3, 11) for r in rows]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


#: Names that operators give columns of their own.
TAKEN = "e_some e_source e_times e_nth e_size n_times n_th n_at n_part o_part pos _id _t _s _h _n _r near_id near_hash text_hash component h t fp mark key number word n k c is_hot is_first nth row first y cell kind body root start at target taken source_size copies".split()


@pytest.fixture(scope="session")
def clashing_docs(edge_docs):
    """The same rows with columns that clash with operators' own."""
    from pyspark.sql import functions as F

    return edge_docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(TAKEN) if n not in edge_docs.columns])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
