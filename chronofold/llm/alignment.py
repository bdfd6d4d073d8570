"""Alignment of two tokenizers over a corpus, by a dictionary of groups.

Two tokenizations of the same bytes are cut into groups wherever tokens of both end at the same byte. Few groups make up
most of a corpus, so each distinct group is interned once and its links (pairs of an A token and a B token that share a
byte) are expanded once; its frequency then carries them to the counts of the whole corpus, and what a group is worth is
joined back by its key to the blocks of documents that hold it.

A block is a stretch of rows with a few megabytes of text. A task writes for each block its documents, each with the
numbers of its distinct groups in the block and how often it has them, and the block's dictionary of groups. So what is
shuffled grows with the distinct groups of a block, not with tokens; documents move once, to their block's dictionary.

A group is written `a1,a2|b1`: decimal A ids, then B ids, in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import content_store, shared

#: Bytes of text in a block; units that a worker keeps from one block to the next, of those that a block has so often.
BLOCK, CACHE_UNITS, CACHE_TIMES = 8 << 20, 200_000, 3
#: Between words: a single space with no white space beside it. A byte-level token takes such a space to what follows it,
#: and so does a piece, so both tokenizers have a token's end before it, and what lies on either side does not depend on
#: the other.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")

DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Aligner:
    """Groups of texts under a byte-level BPE of the tokenizers library (A) and a sentencepiece model (B).

    A reads a space and the text; B adds its space itself. split: the model adds a space in front, changes no text and has
    no piece with a space inside, so that texts may be cut between words; else each text is one unit."""

    def __init__(self, tokenizer_json: str, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(tokenizer_json), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a.encode_special_tokens = True
        self.a_bytes, self.b_bytes = a_token_bytes(tokenizer_json), b_token_bytes(model)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        n = spec.normalizer_spec
        self.split = n.name == "identity" and n.add_dummy_prefix and not n.remove_extra_whitespaces and all("▁" not in p.piece.lstrip("▁") for p in spec.pieces)
        self.a_size, self.b_size = ([len(x) for x in side] for side in (self.a_bytes, self.b_bytes))
        self.known: dict[str, tuple] = {}

    def units(self, text: str) -> list[str]:
        return BETWEEN.split(text) if self.split else [text]

    def learn(self, units: list[str]) -> dict[str, tuple]:
        """For each unit n_a, n_b and its groups; no group where the bytes of A or B are not those of a space and the unit.
        Units that have no white space at either end are encoded many at once, as the words of one text."""
        plain = [u for u in units if self.split and not u[0].isspace() and not u[-1].isspace() and "▁" not in u]
        out = {}
        for k in range(0, len(plain), 20_000):
            out |= self.together(plain[k : k + 20_000])
        return out | {u: self.alone(u) for u in units if u not in out}

    def alone(self, unit: str) -> tuple:
        whole = (" " + unit).encode("utf-8", "surrogatepass")
        a, b = self.a.encode(" " + unit, add_special_tokens=False).ids, self.b.encode(unit, num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return 0, 0, ()
        return len(a), len(b), tuple(self.groups(a, b)[1])

    def groups(self, a: list[int], b: list[int]):
        """Where the groups of two tokenizations of the same bytes end, their texts, and how many A and B tokens each has."""
        import numpy as np

        a, b = np.array(a, np.uint32), np.array(b, np.uint32)
        end_a, end_b = np.cumsum(np.array(self.a_size)[a]), np.cumsum(np.array(self.b_size)[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        n_a, n_b = (np.diff(np.searchsorted(e, cuts, "right"), prepend=0) for e in (end_a, end_b))
        size = n_a + n_b + 1  # A ids, a mark that is no id, B ids
        begin = np.cumsum(size) - size
        laid = np.full(size.sum(), 0xFFFFFFFF, np.uint32)
        for ids, n, at in ((a, n_a, begin), (b, n_b, begin + n_a + 1)):
            laid[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        packed, said, texts = laid.tobytes(), {}, []
        for at, to, n in zip((begin * 4).tolist(), ((begin + size) * 4).tolist(), n_a.tolist(), strict=True):
            key = packed[at:to]
            if key not in said:
                ids = laid[at // 4 : to // 4].tolist()
                said[key] = ",".join(map(str, ids[:n])) + "|" + ",".join(map(str, ids[n + 1 :]))
            texts.append(said[key])
        return cuts, texts, n_a, n_b

    def together(self, units: list[str]) -> dict[str, tuple]:
        import numpy as np

        text = " ".join(units)
        whole = (" " + text).encode("utf-8", "surrogatepass")
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text, num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return {}  # some unit is not plain; each goes by itself
        cuts, texts, n_a, n_b = self.groups(a, b)
        ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) + 1 for u in units])
        last = np.searchsorted(cuts, ends)
        if not (cuts[last] == ends).all():
            return {}
        sums = [np.diff(np.cumsum(n)[last], prepend=0).tolist() for n in (n_a, n_b)]
        return {u: (x, y, tuple(texts[i:j])) for u, x, y, i, j in zip(units, *sums, [0, *(last + 1).tolist()], (last + 1).tolist(), strict=False)}

    def of(self, times: dict[str, int]) -> list[tuple]:
        """What learn() gives for each of the units, which a block has so many times. Units that return are kept."""
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        new = self.learn([u for u in times if u not in self.known])
        out = [new[u] if u in new else self.known[u] for u in times]
        self.known |= {u: v for u, v in new.items() if times[u] >= CACHE_TIMES}
        return out


def a_token_bytes(tokenizer_json: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary. An added token's entry stands for its text."""
    import json

    from tokenizers import Tokenizer

    byte_of = {mark: b for b, mark in content_store.byte_marks().items()}
    added = {t["id"]: t["content"].encode() for t in json.loads(tokenizer_json).get("added_tokens") or []}
    known = Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True)
    out = [b""] * (max(known.values(), default=-1) + 1)
    for token, i in known.items():
        out[i] = added[i] if i in added else bytes(byte_of[c] for c in token)
    return out


def b_token_bytes(model: bytes) -> list[bytes]:
    """Bytes of each piece: <0xHH> is a byte, U+2581 a space; unknown and control pieces have none, so that a text with
    one never equals its bytes."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [
        bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else b"" if p.is_unknown(i) or p.is_control(i) else p.id_to_piece(i).replace("▁", " ").encode()
        for i in range(p.get_piece_size())
    ]


def _encoded(docs: DataFrame, tokenizer_json: str, model: bytes, text: str, id_col: str) -> DataFrame:
    """Rows of kind d, a document each (`groups`, `times`: its distinct groups by number in the block and how often it has
    them), and of kind g, a distinct group of a block (`n`: its number, `n_a`: how often the block has it)."""
    import hashlib

    shipped = docs.sparkSession.sparkContext.broadcast((tokenizer_json, model))
    schema = f"kind string, block long, {DOCS}, n int, `group` string, groups array<int>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        state = shared.worker_state()
        if state.get("aligner_of") != shipped.value:
            state |= {"aligner": Aligner(*shipped.value), "aligner_of": shipped.value}
        aligner, block = state["aligner"], TaskContext.get().partitionId() << 32
        for b in batches:
            for some in content_store.slices(b, 1, BLOCK):
                number: dict[str, int] = {}
                codes = [np.array([number.setdefault(u, len(number)) for u in aligner.units(t)] if t else [], np.int64) for t in some.column(1).to_pylist()]
                times = np.bincount(np.concatenate(codes), minlength=len(number)) if codes else []
                of = aligner.of(dict(zip(number, times.tolist(), strict=True)))
                group_no: dict[str, int] = {}
                own = [[group_no.setdefault(g, len(group_no)) for g in v[2]] for v in of]
                count = np.array([len(x) for x in own], np.int64)
                first, flat = np.cumsum(count) - count, np.array([x for xs in own for x in xs], np.int32)
                n_a, n_b = (np.array([v[k] for v in of], np.int64) for k in (0, 1))
                said = [";".join(v[2]) for v in of]
                d: list = [[] for _ in range(7)]
                total = np.zeros(len(group_no), np.int64)
                for c in codes:
                    if not len(c) or not count[c].all():  # bytes of a unit differ: the document has no tokens
                        c = c[:0]
                    n = count[c]
                    at, of_doc = np.unique(flat[np.repeat(first[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())], return_counts=True)
                    total[at] += of_doc
                    a, b_, g = int(n_a[c].sum()), int(n_b[c].sum()), int(n.sum())
                    digest = hashlib.sha256(";".join([said[x] for x in c.tolist()]).encode()).hexdigest() if len(c) else ""
                    # No end inside a group is common to both sides, so each token of it but one adds a link.
                    for column, v in zip(d, (a, b_, g, a + b_ - g, digest, at, of_doc.astype(np.int32)), strict=True):
                        column.append(v)
                n, m, long = some.num_rows, len(group_no), pa.int64()
                lists = [pa.array(c, pa.list_(pa.int32())) for c in d[5:]]
                rows = [pa.array(["d"] * n), pa.array([block] * n, long), some.column(0), *(pa.array(c, long) for c in d[:4]), pa.array(d[4], pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(rows, names=names)
                none = pa.nulls(m, long)
                rows = [pa.array(["g"] * m), pa.array([block] * m, long), none, pa.array(total), none, none, none, pa.nulls(m, pa.string()), pa.array(np.arange(m, dtype=np.int32)), pa.array(list(group_no), pa.string()), *(pa.nulls(m, x.type) for x in lists)]
                yield pa.RecordBatch.from_arrays(rows, names=names)
                block += 1

    names = ["kind", "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n", "group", "groups", "times"]
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].cast("string").alias("t")).mapInArrow(shared.lean(run), schema)


def links(groups: DataFrame, tokenizer_json: str, model: bytes) -> DataFrame:
    """group, a, b, m, freq: the links of each distinct group (group, freq), m where a pair is linked m times in it. The
    byte ranges of the group's tokens are laid end to end and all overlaps of a batch are found at once."""
    shipped = groups.sparkSession.sparkContext.broadcast(([len(x) for x in a_token_bytes(tokenizer_json)], [len(x) for x in b_token_bytes(model)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        len_a, len_b = (np.array(x, np.int64) for x in shipped.value)
        for b in batches:
            halves = [g.split("|") for g in b.column(0).to_pylist()]
            sides = []
            for k, length in ((0, len_a), (1, len_b)):
                ids = [np.array(h[k].split(","), np.int64) for h in halves]
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                ends = np.cumsum(length[flat])
                sides.append((flat, ends - length[flat], ends, np.repeat(np.arange(len(ids)), [len(x) for x in ids])))
            (a, begin, end, row), (other, b_begin, b_end, _) = sides
            first, last = np.searchsorted(b_end, begin, "right"), np.searchsorted(b_begin, end, "left")
            n = last - first
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pair, times = np.unique(np.stack([np.repeat(row, n), np.repeat(a, n), other[at]]), axis=1, return_counts=True)
            where = pa.array(pair[0])
            yield pa.RecordBatch.from_arrays([b.column(0).take(where), pa.array(pair[1].astype(np.int32)), pa.array(pair[2].astype(np.int32)), pa.array(times.astype(np.int64)), b.column(1).take(where)], names=["group", "a", "b", "m", "freq"])

    return groups.select("group", "freq").mapInArrow(run, "`group` string, a int, b int, m long, freq long")


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, cnt (links of the corpus that hold the pair), best (1 if no pair of this b has more). There is at most a row
    for each id of B to compare with, a bound of the vocabulary, so those rows are broadcast."""
    counts = shared.written(linked.groupBy("a", "b").agg(F.sum(F.col("m") * F.col("freq")).alias("cnt")), "pair-counts")
    most = counts.groupBy(F.col("b").alias("_b")).agg(F.max("cnt").alias("_most"))
    return counts.join(F.broadcast(most), F.col("b") == F.col("_b")).select("a", "b", "cnt", (F.col("cnt") == F.col("_most")).cast("long").alias("best"))


def align(docs: DataFrame, tokenizer_json: str, model: bytes, *, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """What each document has (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and the corpus's
    table of linked id pairs (a, b, cnt, best).

    Null and empty texts, and texts whose A or B bytes are not those of a space and the text (such that hold U+2581), have
    no tokens: zeros, and an empty hash column. Repeated rows and null ids are documents of their own, and count. An empty
    table gives empty results. Other columns are not read. A text is encoded whole; a word, however long, is one unit."""
    made = shared.written(_encoded(docs, tokenizer_json, model, text, id_col), "aligned", partition_by=["kind"])
    own = made.where("kind = 'g'").select("block", "n", "group", F.col("n_a").alias("times"))
    groups = own.groupBy("group").agg(F.sum("times").alias("freq")).where("freq > 0")
    linked = shared.written(links(groups, tokenizer_json, model), "links")
    pairs = shared.written(pair_counts(linked), "pairs")
    worth = linked.select("group", "a", "b", "m").join(pairs, ["a", "b"]).groupBy("group").agg(F.sum(F.col("m") * F.col("best")).alias("n_best"), F.sum(F.col("m") * F.col("cnt")).alias("count_sum"))
    of_block = own.join(worth, "group").select(F.col("block").alias("_block"), "n", "n_best", "count_sum")

    def total(d: pa.Table, w: pa.Table) -> pa.Table:
        import numpy as np

        at = w.column("n").to_numpy()
        size = int(at.max(initial=-1)) + 1
        lists = d.column("groups").combine_chunks()
        flat, times = lists.flatten().to_numpy(), d.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(d.num_rows), np.diff(lists.offsets.to_numpy()))
        out = []
        for name in ("n_best", "count_sum"):
            value = np.zeros(size, np.int64)
            value[at] = w.column(name).to_numpy()
            sums = np.zeros(d.num_rows, np.int64)
            np.add.at(sums, row, value[flat] * times)
            out.append(pa.array(sums))
        return pa.table([*(d.column(c) for c in kept[:5]), *out, d.column("groups_sha256")], names=names)

    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    names = [*kept[:5], "n_best", "count_sum", "groups_sha256"]
    d = made.where("kind = 'd'").select("block", *kept, "groups", "times")
    found = d.groupBy("block").cogroup(of_block.groupBy("_block")).applyInArrow(total, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return found, pairs
