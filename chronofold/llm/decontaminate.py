"""Benchmark decontamination by pigeonhole edit matching: a test item of n characters may differ by e = n * rate edits;
cut into e + 1 pieces, at least one piece occurs unchanged, so every near occurrence has an exact piece hit. Hits of all
pieces come from one pass of an Aho-Corasick automaton over the whole text, and the places they point to are verified
with Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, shared

EDIT_RATE = 0.08
#: Characters of normalised items in one automaton; more items take more passes over the documents.
BLOCK_CHARS = 4_000_000


def normalise(text: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(text.lower().split())


@dataclass
class Item:
    item_id: int
    text: str
    budget: int
    masks: dict
    whole: bool

    @classmethod
    def of(cls, item_id: int, text: str, rate: float, words_below: int = 0) -> Item:
        whole = len(text) < words_below
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << i
        return cls(item_id, text, 0 if whole else int(len(text) * rate), masks, whole)

    def pieces(self) -> list[tuple[int, str]]:
        """budget + 1 pieces of near equal length, with their offsets."""
        n, k = len(self.text), self.budget + 1
        cuts = [i * n // k for i in range(k + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: Item, text: str) -> tuple[int, int]:
    """Least edit distance of item to any substring of text, and the first end where it is reached (Myers 1999). The
    columns of the edit matrix are two bit vectors, vertical differences of +1 and -1."""
    n = len(item.text)
    every, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, now = every, 0, n
    best, end = n, 0
    for j, c in enumerate(text, 1):
        eq = item.masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | x
        h_plus, h_minus = minus | (every & ~(d | plus)), plus & d
        if h_plus & top:
            now += 1
        elif h_minus & top:
            now -= 1
        if now < best:
            best, end = now, j
        h_plus, h_minus = h_plus << 1 & every, h_minus << 1 & every
        plus, minus = h_minus | (every & ~(x | h_plus)), h_plus & x
    return best, end


def _joins(a: str, b: str) -> bool:
    """Whether two neighbouring characters belong to one word, in scripts that part words by spaces."""
    return a.isalnum() and b.isalnum() and a < "\u2e80" and b < "\u2e80"


class Matcher:
    """Finds the near occurrences of a block of items."""

    def __init__(self, rows: list[tuple[int | None, str]], rate: float, words_below: int = 0) -> None:
        import ahocorasick

        self.items = [Item.of(i, t, rate, words_below) for i, t in rows]
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for offset, piece in item.pieces():
                owners.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owner in owners.items():
            self.automaton.add_word(piece, (len(piece), owner))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item_id, least distance, end in the normalised text) of each item within its budget, by item_id (null last)."""
        places: dict[int, list[int]] = {}
        found: dict[int | None, tuple[int, int]] = {}
        for last, (length, owner) in self.automaton.iter(text):
            for k, offset in owner:
                item = self.items[k]
                if not item.whole:
                    places.setdefault(k, []).append(last + 1 - length - offset)
                elif not (last + 1 < len(text) and _joins(text[last], text[last + 1])) and not (last >= length and _joins(text[last - length], text[last - length + 1])):
                    found[item.item_id] = min((0, last + 1), found.get(item.item_id, (0, last + 1)))
        for k, starts in places.items():
            item = self.items[k]
            starts = sorted(set(starts))
            at = 0
            while at < len(starts):
                stop = at
                while stop + 1 < len(starts) and starts[stop + 1] - starts[stop] <= item.budget:
                    stop += 1
                a = max(0, starts[at] - item.budget)
                distance, end = best_match(item, text[a : starts[stop] + len(item.text) + item.budget])
                if distance <= item.budget:
                    found[item.item_id] = min((distance, a + end), found.get(item.item_id, (distance, a + end)))
                at = stop + 1
        return sorted(((i, d, e) for i, (d, e) in found.items()), key=lambda x: (x[0] is None, x[0] or 0))


def _blocks(benchmark: DataFrame, text: str, item_id: str) -> Iterator[list[tuple[int, str]]]:
    """The normalised items in blocks of bounded size, in id order; the driver holds one block at a time."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    block, size = [], 0
    for i, t in rows.orderBy("i", "t").toLocalIterator():
        n = normalise(t)
        if not n:
            continue
        if block and size + len(n) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((i, n))
        size += len(n)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, *, rate: float = EDIT_RATE, words_below: int = 0, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """A row for each document and test item that occurs in it within the item's edit budget: doc_id, item_id, distance
    (least over the document), end (where that occurrence ends in the normalised text), contaminated (true).

    Documents and items are compared in lower case with white space collapsed, whole, however long. An item of n characters
    may differ by int(n * rate) edits and may stand anywhere. words_below: items of fewer characters must occur unchanged and
    as whole words instead; 0, the default, has one rule for all. Null and empty texts match nothing, and an empty table of
    either kind gives no rows. Other columns are not read. Items equal in id, null included, give
    one row with the best of them; repeated documents give rows of their own. Documents are read once for each block of
    items."""

    def scan(rows):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(rows, rate, words_below)
            for b in batches:
                out: list = [[], [], [], []]
                for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    for hit in matcher.search(normalise(t.as_py() or "")):
                        for c, v in zip(out, (doc_id, *hit), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "end"])

        return run

    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].cast("string").alias("t"))
    schema = "doc_id long, item_id long, distance int, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for k, rows in enumerate(_blocks(benchmark, text, item_id)):
        hits = shared.written(read.mapInArrow(shared.lean(scan(rows)), schema), "contaminated")
        out = hits if not k else out.unionByName(hits)
    return out.withColumn("contaminated", F.lit(True))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, rate: float = EDIT_RATE, words_below: int = 0, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of docs, as they are, in which no test item occurs: by what contaminated() finds, repeated rows and null
    ids included. An empty table, or a benchmark without items, changes nothing."""

    def clean(rows):
        def test():
            matcher = Matcher(rows, rate, words_below)
            return lambda texts: [not matcher.search(normalise(t or "")) for t in texts]

        return test

    for k, rows in enumerate(_blocks(benchmark, text, item_id)):
        docs = features.where_text(docs if not k else shared.written(docs, "decontaminated"), clean(rows), text=text)
    return docs
