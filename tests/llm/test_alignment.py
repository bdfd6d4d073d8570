import bisect
import hashlib
import itertools
from collections import Counter

import pytest

from chronofold.llm import alignment, queries

from .conftest import SCHEMA, edge_rows

ODD = ["▁raised", "a▁b", "two  spaces", " leading", "trailing ", "tab\tand\nnewline\n", "<|endoftext|> and <s> </s> <unk> <0x41>", "nul\0byte", "'s 't don't I'LL", "日本語テキスト 😀👩‍👩‍👧 é", "x" * 3000, "1234567890" * 20, "...!!!??", "  wide　", "a \n b", "\x1c\x1d"]


def docs():
    return [*edge_rows(), *[(9000 + i, t, "en", "s", len(t), 7, 0.5, "yes", 3, 11) for i, t in enumerate(ODD)]]


def groups_of(aligner, text):
    """(A ids, B ids) of each group and the links of a text, from the library's ids of the whole text."""
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    want = b" " + text.encode()
    if not text or b"".join(aligner.a_bytes[x] for x in a) != want or b"".join(aligner.b_bytes[x] for x in b) != want:
        return [], []

    def spans(ids, length):
        out, at = [], 0
        for x in ids:
            out.append((at, at + len(length[x]), x))
            at = out[-1][1]
        return out

    sa, sb = spans(a, aligner.a_bytes), spans(b, aligner.b_bytes)
    cuts = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
    groups = [([], []) for _ in cuts]
    for side, part in ((sa, 0), (sb, 1)):
        for low, _, x in side:
            groups[bisect.bisect_right(cuts, low)][part].append(x)
    links, first = [], 0
    for s, e, x in sa:
        while sb[first][1] <= s:
            first += 1
        links += [(x, y) for _, _, y in itertools.takewhile(lambda t: t[0] < e, sb[first : first + e - s])]  # noqa: B023  a token has a byte at least
    return groups, links


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(queries.byte_bpe(), queries.piece_bpe())


def brute(aligner, rows):
    each = [(r[0], *groups_of(aligner, r[1] or "")) for r in rows]
    count = Counter(x for _, _, links in each for x in links)
    most: dict = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for doc_id, groups, links in each:
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        n_a, n_b = sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups)
        best, total = sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links)
        out.append((doc_id, n_a, n_b, len(groups), len(links), best, total, hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str), count


def test_alignment_by_brute_force(spark, aligner):
    df = spark.createDataFrame(docs(), SCHEMA).withColumnsRenamed({"part": "block", "kept": "kind", "size": "n_a"}).repartition(3)
    found, pairs = alignment.align(df, queries.byte_bpe(), queries.piece_bpe())
    want, count = brute(aligner, docs())
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert {(r.a, r.b): r.cnt for r in pairs.collect()} == count


def test_blocks_and_a_small_cache(spark, aligner, monkeypatch):
    rows = edge_rows()
    monkeypatch.setattr(alignment, "BLOCK", 4_000)
    monkeypatch.setattr(alignment, "CACHE_UNITS", 50)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert sorted(map(tuple, alignment.align(df, queries.byte_bpe(), queries.piece_bpe())[0].collect()), key=str) == brute(aligner, rows)[0]


def test_texts_are_cut_only_between_words(aligner):
    assert aligner.split
    assert aligner.units("a b  c\n d ") == ["a", "b  c\n d "]


def test_no_documents(spark, no_docs):
    found, pairs = alignment.align(no_docs, queries.byte_bpe(), queries.piece_bpe())
    assert found.collect() == [] and pairs.collect() == []


def test_given_documents(spark, aligner):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op13_alignment(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(aligner, rows)[0]
