"""Near copies by exact shingle similarity: texts are linked when the Jaccard similarity of their sets of 5-word shingles
is 4/5 or more. No candidate is lost, as every filter follows from that bound.

1. A text similar to another shares 4/5 of its own shingles with it. Shingles are dealt by hash to BUCKETS as packed
   arrays, each bucket says which of them stand in two texts or more, and texts with fewer shared ones go.
2. What is left is one text for each set. Sets are linked first by the SimHash index over their fingerprints (5-word
   shingles), every link verified by the sets' similarity.
3. What the fingerprints miss: in order of rarity among these sets, two similar ones share a shingle among the first
   n - ceil(4n/5) + 1 of each (prefix filter). Of the sets with a shingle there, each is verified against the one with
   the fewest rarer shingles, the nearest to what a group has in common, and against the next in size.
4. Pairs that these links leave in different components are verified if they can be similar at all: sets of n and m
   shingles, whose first common shingle stands after i and j others, need 9 * min(n - i, m - j) >= 4 * (n + m). So a group
   of copies is a few stars and chains, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, simhash

#: Words of a shingle, and bits by which linked fingerprints may differ.
WIDTH, MAX_DIFF = 5, 6
BUCKETS = 2048  # at least; a bucket holds the shingles of ROWS_A_BUCKET rows on average at most
ROWS_A_BUCKET = 8192
FLUSH = 1 << 18


def shingles(data: bytes, width: int = WIDTH):
    """The sorted hashes (XXH64, seed 42) of a text's distinct shingles: ASCII-lower-cased words; fewer words than width
    make one shingle of all, no word makes none."""
    import numpy as np
    import xxhash

    words, digest = data.lower().split(), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n))


def _mark(h) -> int:
    """A signed 64-bit name of a set of shingles."""
    import xxhash

    return xxhash.xxh64_intdigest(h.tobytes(), 7) - (1 << 63)


def _shared(texts: DataFrame, buckets: int, full: bool) -> DataFrame:
    """texts (id, t binary) -> id, mark, n (shingles), s (those that stand in another row too) and, if full, prefix: the
    hashes of the prefix filter, rarest first. Not full, shingles go by 32 bits and their bucket: s can only be over."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, serial = TaskContext.get().partitionId() << 24, 0
        ids, marks, sizes, sets, held = [], [], [], [], 0
        names = ["bucket", "flush", "a", "b", "c"]

        def flush():
            h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            at = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            h, at, bucket = h[order], at[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(h) else np.zeros(0, np.int64)
            stop = np.r_[cut[1:], len(h)][: len(cut)]
            key = h if full else h.astype(np.uint32)
            head = [(np.array(ids, np.int64).tobytes(), np.array(marks, np.int64).tobytes(), np.array(sizes, np.int64).tobytes())]
            rows = head + [(key[i:j].tobytes(), at[i:j].tobytes(), None) for i, j in zip(cut.tolist(), stop.tolist(), strict=True)]
            where = [-1 - (part + serial) % buckets, *bucket[cut].tolist()]  # below zero: the texts themselves
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array([part + serial] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], names=names)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = shingles(t.as_py() or b"")
                ids.append(i)
                marks.append(_mark(h))
                sizes.append(len(h))
                sets.append(h)
                held += len(h)
                if held >= FLUSH:
                    yield from flush()
                    serial, held = serial + 1, 0
                    ids, marks, sizes, sets = [], [], [], []
        if ids:
            yield from flush()

    def tell(table: pa.Table) -> pa.Table:
        import numpy as np

        out: list = [[], [], [], [], []]

        def give(*row):
            for o, x in zip(out, row, strict=True):
                o.append(x)

        if table.column("bucket")[0].as_py() < 0:
            for f, a, b, c in zip(*(table.column(x).to_pylist() for x in ("flush", "a", "b", "c")), strict=True):
                give(f, 0, a, b, c)
        else:
            kind = np.uint64 if full else np.uint32
            parts = [np.frombuffer(x.as_py(), kind) for x in table.column("a")]
            _, inverse, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            df, k = times[inverse], 0
            for f, h, b in zip(table.column("flush").to_pylist(), parts, table.column("b"), strict=True):
                d, at = df[k : k + len(h)], np.frombuffer(b.as_py(), np.uint32)
                k, twice = k + len(h), d > 1
                if not twice.any():
                    continue
                if full:
                    give(f, 1, at[twice].tobytes(), h[twice].tobytes(), d[twice].astype(np.int64).tobytes())
                else:
                    which, s = np.unique(at[twice], return_counts=True)
                    give(f, 1, which.astype(np.uint32).tobytes(), s.astype(np.int64).tobytes(), None)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=["flush", "kind", "a", "b", "c"])

    def gather(table: pa.Table) -> pa.Table:
        import numpy as np

        kinds = table.column("kind").to_numpy()
        cols = [table.column(x) for x in ("a", "b", "c")]
        head = int(np.flatnonzero(kinds == 0)[0])
        ids, marks, n = (np.frombuffer(c[head].as_py(), np.int64) for c in cols)
        s, rows = np.zeros(len(ids), np.int64), np.flatnonzero(kinds == 1).tolist()
        if full and rows:
            at, h, d = (np.concatenate([np.frombuffer(c[r].as_py(), k) for r in rows]) for c, k in zip(cols, (np.uint32, np.uint64, np.int64), strict=True))
            s += np.bincount(at, minlength=len(ids))
            order = np.lexsort((h, d, at))
            h, start = h[order], np.cumsum(s) - s
        elif rows:
            for r in rows:
                s[np.frombuffer(cols[0][r].as_py(), np.uint32)] += np.frombuffer(cols[1][r].as_py(), np.int64)
        keep = np.flatnonzero(5 * s >= 4 * n)
        prefix = [None] * len(keep)
        if full:
            first = n - (4 * n + 4) // 5 + 1 - (n - s)  # shingles of one set only lead the order and meet nothing
            prefix = [h[start[i] : start[i] + first[i]].view(np.int64).tolist() if s[i] else [] for i in keep.tolist()]
        columns = [pa.array(ids[keep]), pa.array(marks[keep]), pa.array(n[keep]), pa.array(s[keep]), pa.array(prefix, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, names=["id", "mark", "n", "s", "prefix"])

    dealt = texts.select("id", "t").mapInArrow(shared.lean(deal), "bucket long, flush long, a binary, b binary, c binary")
    told = dealt.groupBy("bucket").applyInArrow(tell, "flush long, kind int, a binary, b binary, c binary")
    return told.groupBy("flush").applyInArrow(gather, "id long, mark long, n long, s long, prefix array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v (u > v) of the pairs whose sets are similar. Sets are met in the JVM, a pair at a time: where very many pairs
    share a set, no batch of Arrow rows holds it over and over."""
    with_u = pairs.join(sets.select(F.col("mark").alias("u"), F.col("hashes").alias("x")), "u")
    with_both = with_u.join(sets.select(F.col("mark").alias("v"), F.col("hashes").alias("y")), "v")
    both = F.size(F.array_intersect("x", "y"))  # a set has each of its hashes once
    return with_both.where(5 * both >= 4 * (F.size("x") + F.size("y") - both)).select("u", "v")


def near_copies(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), component (a name that similar texts share, directly or by others), for
    the rows of docs that share 4/5 of their shingles with other rows, among them all that have a near or exact copy.

    Texts without words are copies of each other. Null ids and repeated ids are rows like any other."""
    t = shared.text_of(docs, text)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.cast("binary").alias("t"))
    buckets = max(BUCKETS, docs.count() // ROWS_A_BUCKET)
    marks = shared.written(_shared(rows.select(F.col("text_hash").alias("id"), "t"), buckets, False).select(F.col("id").alias("h"), "mark").distinct(), "near-marks")
    once = shared.small(marks.groupBy("mark").agg(F.min("h").alias("one")).select("one"))
    texts = shared.written(rows.join(once, F.col("text_hash") == F.col("one"), "left_semi").select(F.col("text_hash").alias("id"), "t").dropDuplicates(["id"]), "near-texts")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            words = [x.as_py() or b"" for x in b.column(0)]
            found, fps = [shingles(x) for x in words], np.array([simhash.fingerprint(x, WIDTH) for x in words], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([_mark(h) for h in found], pa.int64()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64())), pa.array(fps.view(np.int64))], names=["mark", "hashes", "fp"])

    rare = _shared(texts, buckets, True).select("mark", "n", "s", F.posexplode("prefix").alias("at", "h"))
    posting = shared.written(rare.select("mark", "n", "h", (F.col("n") - F.col("s") + F.col("at")).alias("i")), "near-postings")
    sets = texts.select("t").mapInArrow(shared.lean(hashes), "mark long, hashes array<long>, fp long")
    sets = shared.written(sets.join(shared.small(posting.select(F.col("mark").alias("m")).distinct()), F.col("mark") == F.col("m"), "left_semi"), "near-sets")
    shared.forget(texts)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            h, n, m = (c.to_numpy() for c in b.columns)
            if last is not None:
                h, n, m = np.r_[last[0], h], np.r_[last[1], n], np.r_[last[2], m]
            last = (h[-1], n[-1], m[-1])
            near = np.flatnonzero((h[1:] == h[:-1]) & (5 * n[:-1] >= 4 * n[1:]) & (m[1:] != m[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(m[near], m[near + 1])), pa.array(np.minimum(m[near], m[near + 1]))], names=["u", "v"])

    chain = posting.select("h", "n", "mark").repartitionByRange("h", "n", "mark").sortWithinPartitions("h", "n", "mark").mapInArrow(neighbours, "u long, v long").distinct()
    # Sets of one fingerprint, and fingerprints within MAX_DIFF bits, as a spanning forest of sets.
    rep = sets.groupBy("fp").agg(F.min("mark").alias("rep"))
    alike = sets.select("mark", "fp").join(rep, "fp").where("mark <> rep").select(F.col("mark").alias("u"), F.col("rep").alias("v"))
    close = simhash.near_links(shared.written(rep, "near-fingerprints"), MAX_DIFF)
    centre = posting.groupBy("h").agg(F.min(F.struct("i", "n", "mark")).alias("c"))
    star = posting.join(shared.small(centre), "h").where("mark <> c.mark and 5 * least(n, c.n) >= 4 * greatest(n, c.n)")
    star = star.select(F.greatest("mark", "c.mark").alias("u"), F.least("mark", "c.mark").alias("v"))
    likely = shared.written(alike.unionByName(close).unionByName(chain).unionByName(star).distinct(), "near-likely")
    links = shared.written(_verified(likely, sets), "near-links")
    labels = simhash.components(links, "near-components")
    named = posting.join(labels, posting["mark"] == labels["node"], "left").select("h", "n", "i", "mark", F.coalesce("label", "mark").alias("label"))
    named = shared.written(named, "near-named")
    mixed = named.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
    left = shared.written(named.join(mixed, "h", "left_semi"), "near-left")
    a, b = left.alias("a"), left.alias("b")
    # The smaller set, whose first common shingle must then stand among its first n / 9, with the larger.
    b = b.where("9 * (n - i) >= 8 * n")
    order = (F.col("b.n") < F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.mark") < F.col("a.mark")))
    fits = F.expr("9 * least(a.n - a.i, b.n - b.i) >= 4 * (a.n + b.n)")
    rest = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.label") != F.col("b.label")) & order & fits)
    rest = shared.written(rest.select(F.greatest("a.mark", "b.mark").alias("u"), F.least("a.mark", "b.mark").alias("v")).distinct(), "near-rest")
    more = shared.written(_verified(rest, sets), "near-links")
    shared.forget(posting, sets, likely, named, left, rest)
    if more.limit(1).count():
        labels = simhash.components(links.unionByName(more), "near-components")
    of_text = marks.join(labels, marks["mark"] == labels["node"], "left").select("h", F.coalesce("label", "mark").alias("component"))
    of_text = shared.written(of_text, "near-of-text")
    shared.forget(marks, links, more)
    return rows.select("doc_id", "text_hash").join(shared.small(of_text), F.col("text_hash") == F.col("h")).select("doc_id", "text_hash", "component")


def keep_one(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, as they are, of which one of each component of near copies stays: that of the smallest id (null
    last), then of the smallest text hash, and of rows equal in both the one whose columns have the smallest digest.

    Null and empty texts and those of white space are copies of each other. An empty table gives no rows."""
    found = shared.written(near_copies(docs, text=text, id_col=id_col).groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n")), "near-members")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("i"), F.col("text_hash").alias("t"))
    first = shared.written(found.groupBy("component").agg(F.min(order).alias("first")), "near-first")
    k_id, k_hash = shared.unused(docs, "near_id", "near_hash")
    named = found.join(shared.small(first), "component").withColumn("is_first", order == F.col("first"))
    named = shared.written(named.select(F.col("doc_id").alias(k_id), F.col("text_hash").alias(k_hash), "n", "is_first"), "near-verdicts")
    shared.forget(found, first)
    others, repeated = named.where("not is_first").select(k_id, k_hash), named.where("is_first and n > 1").select(k_id, k_hash)
    t = F.xxhash64(shared.text_of(docs, text))
    same = docs[id_col].cast("long").eqNullSafe(F.col(k_id)) & (t == F.col(k_hash))
    kept = docs.join(shared.small(others), same, "left_anti")
    if not repeated.limit(1).count():
        return kept
    rows = F.struct(*[docs[c] for c in docs.columns])
    once = kept.join(shared.small(repeated), same).groupBy(k_id, k_hash).agg(F.min_by(rows, F.md5(F.to_json(rows))).alias("row")).select("row.*")
    return kept.join(shared.small(repeated), same, "left_anti").unionByName(once)
