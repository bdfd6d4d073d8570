"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

A vector's code has the signs of its rotations. The rotations are learned on a bounded sample, each turned until its signs
lie close to the vectors (alternating signs and the orthogonal matrix that fits them best); several of them make a code
longer than the vector, so that Hamming distances are steadier. A code is cut into substrings, and each substring has an
index over all codes. Codes within a Hamming radius agree with the query's in some substring up to a share of the radius
(pigeonhole), so probing each index within its share finds them all; these are reranked by their vectors.

A query's radius follows from a distance that its nearest neighbours cannot exceed: that of its k-th neighbour in the
sample at first, then that of the k-th found so far. Which radius holds the neighbours within a distance is measured on
pairs of the sample (RECALL of the pairs at about that distance, in parts of the query's length about the mean).

Each task indexes the vectors it reads, a stretch at a time, and answers all queries of a block over them, so no bucket of
an index and no group of copies meets in one task; of its finds those stay that may be among the k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Rows that codes are learned on (bounded_sample may take half as many again), vectors indexed at once in a task, queries
#: answered in one pass over the vectors.
FIT_ROWS, STRETCH, QUERY_BLOCK = 20_000, 1 << 16, 8_192
#: Code bits for each dimension, bits of a substring, rounds of learning, share of neighbours a radius has to hold.
BITS, SUBSTRING, ROUNDS, RECALL = 4, 16, 25, 0.995


@dataclass
class Codes:
    """mean and rotations (dimensions x bits) of the codes; edges of relative distances and the radius up to each."""

    mean: object
    turn: object
    edges: object
    radius: object

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def __call__(self, x):
        """Codes of the rows of x as 64-bit words."""
        import numpy as np

        return np.packbits((x - self.mean) @ self.turn > 0, axis=1).view(np.uint64)

    def radii(self, distance, length):
        """Hamming radii that hold neighbours within distance of queries that lie length away from the mean."""
        import numpy as np

        with np.errstate(divide="ignore", invalid="ignore"):
            at = np.searchsorted(self.edges, np.nan_to_num(distance / length, nan=np.inf, posinf=np.inf))
        return np.r_[self.radius, self.bits][at]


def hamming(a, b):
    import numpy as np

    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def learn(x, seed: int = 7) -> Codes:
    """Codes fitted to the rows of x (float64)."""
    import numpy as np

    rng, (n, d) = np.random.default_rng(seed), x.shape
    bits = -(-BITS * d // 64) * 64
    mean, turns = x.mean(0), []
    c = x - mean
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(c.T @ np.where(c @ r > 0, 1.0, -1.0))
            r = u @ v
        turns.append(r)
    codes = Codes(mean, np.concatenate(turns, axis=1)[:, :bits], None, None)
    words, length = codes(x), np.linalg.norm(c, axis=1)
    some = rng.choice(n, min(n, 1_000), replace=False)
    near, differ = [], []
    for i in some:
        gap = np.sqrt(((x - x[i]) ** 2).sum(1))
        gap[i] = np.inf
        close = np.argpartition(gap, min(n - 1, 200))[:200] if n > 200 else np.arange(n)  # near pairs are what matters
        close = close[np.isfinite(gap[close]) & (length[i] > 0)]
        near.append(gap[close] / max(length[i], 1e-300))
        differ.append(hamming(words[close], words[i]))
    near, differ = np.concatenate(near), np.concatenate(differ)
    order = np.argsort(near)
    groups = np.array_split(order, max(1, min(64, len(order) // 1_000))) if len(order) else []
    codes.edges = np.array([near[g].max() for g in groups])
    codes.radius = np.maximum.accumulate([int(np.quantile(differ[g], RECALL)) for g in groups]) if groups else np.zeros(0, np.int64)
    codes.radius = np.asarray(codes.radius, np.int64)
    return codes


class Index:
    """An index over each substring of some codes: rows in order of the substring's value, and where each value begins."""

    def __init__(self, words) -> None:
        import numpy as np

        self.words = words
        self.parts = words.view(np.uint8).view(np.dtype(f"u{SUBSTRING // 8}"))
        self.order = [np.argsort(p, kind="stable").astype(np.int32) for p in self.parts.T]
        self.begin = [np.r_[0, np.cumsum(np.bincount(p, minlength=1 << SUBSTRING))] for p in self.parts.T]

    @staticmethod
    def masks():
        """All values of a substring by how many bits they have, and how many values have at most so many."""
        import numpy as np

        ones = np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint32))
        return np.argsort(ones, kind="stable"), np.cumsum(np.bincount(ones))

    def within(self, word, radius: int, masks):
        """All rows whose codes differ from word in at most radius bits, and the differences. With radius = m * share +
        rest, one of the first rest + 1 substrings differs in at most share bits, or one of the others in less. Where that
        takes more probes than there are codes, the codes themselves are compared, with the same result."""
        import numpy as np

        by_ones, upto = masks
        m = self.parts.shape[1]
        share, rest = divmod(min(radius, 64 * self.words.shape[1]), m)
        limits = [min(share if j <= rest else share - 1, SUBSTRING) for j in range(m)]
        if radius < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if sum(int(upto[k]) for k in limits if k >= 0) >= len(self.words):
            rows = np.arange(len(self.words))
        else:
            own, found = word.view(np.uint8).view(self.parts.dtype), []
            for j, k in enumerate(limits):
                if k >= 0:
                    v = by_ones[: upto[k]] ^ int(own[j])
                    at, to = self.begin[j][v], self.begin[j][v + 1]
                    found += [self.order[j][a:b] for a, b in zip(at[to > at].tolist(), to[to > at].tolist(), strict=True)]
            rows = np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)
        differ = hamming(self.words[rows], word)
        near = differ <= radius
        return rows[near], differ[near]


def _matrix(column: pa.Array, d: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def _distances(x, q):
    import numpy as np

    return np.sqrt(((x - q) ** 2).sum(axis=1))


class Nearest:
    """For each query the k nearest of what it was offered: distance, then id (null last), then row."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.best = k, [[] for _ in range(n)]

    def offer(self, i: int, distance, ids, rows) -> None:
        import numpy as np

        order = np.lexsort((rows, ids, distance))[: self.k]
        self.best[i] = sorted([*self.best[i], *zip(distance[order].tolist(), ids[order].tolist(), rows[order].tolist(), strict=True)])[: self.k]

    def bound(self, i: int) -> float:
        return self.best[i][-1][0] if len(self.best[i]) == self.k else float("inf")


#: In place of a null id, so that it sorts last.
NO_ID = (1 << 63) - 1


def usable(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """row (of its own for each row), vec_id, v: the vectors that take part. Null ones, ones without a component other than
    zero, ones with a null or non-finite component do not, nor do those of another length than most have (of lengths equally
    frequent the largest counts)."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    named = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].alias("v"))
    good = named.where(v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    kept = shared.written(good.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    return kept.where(F.size("v") == (sizes[0].d if sizes else 0)).select("row", "vec_id", "v")


def nearest(vectors: DataFrame, queries: str, k: int = 10, *, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets the condition `queries` (SQL on vec_id) its k nearest rows by
    Euclidean distance in double precision, itself left out, nearest first, ties to the smaller vec_id (null last). Fewer
    rows: all of them. See usable() for the vectors that take part; rows alike are rows of their own, so a copy of a query
    is its neighbour, and a query that stands twice is answered twice. No usable vector, or no other: no rows.

    What is reported is exact in distance and order; which neighbours are found rests on the codes (see the module)."""
    spark = vectors.sparkSession
    table = usable(vectors, vector, vec_id)
    sample = shared.bounded_sample(table, F.col("row"), FIT_ROWS).orderBy("row").toArrow()  # FIT_ROWS * 1.5 rows at most
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = sample.column("v").combine_chunks()
    d = len(own[0])
    known = _matrix(own, d)
    codes = learn(known)
    shipped = spark.sparkContext.broadcast((codes, known, sample.column("vec_id").fill_null(NO_ID).to_numpy(), sample.column("row").to_numpy()))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's distance to its k-th neighbour in the sample."""
        _, x, ids, rows = shipped.value
        for b in batches:
            out = []
            for q, row in zip(_matrix(b.column(2), d), b.column(0).to_pylist(), strict=True):
                near = Nearest(1, k)
                other = rows != row
                near.offer(0, _distances(x, q)[other], ids[other], rows[other])
                out.append(near.bound(0))
            yield b.append_column("bound", pa.array(out, pa.float64()))

    kind = table.schema["v"].dataType.simpleString()
    asked = shared.written(table.where(queries).mapInArrow(bounds, f"row long, vec_id long, v {kind}, bound double"), "queries")
    blocks = -(-asked.count() // QUERY_BLOCK)
    found = None
    for block in range(blocks):  # one for each QUERY_BLOCK queries: a pass over the vectors with a part of bounded size
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").toArrow()
        if part.num_rows:
            answers = shared.written(_answers(table, shipped, part, k, d), "answers")
            found = answers if found is None else found.unionByName(answers)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _answers(table: DataFrame, shipped, part: pa.Table, k: int, d: int) -> DataFrame:
    """query_row, query_id, vec_id, row, score: what each task has of a block of queries, no more than k rows a query."""
    queries = table.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codes, asked, masks = shipped.value[0], queries.value, Index.masks()
        q = _matrix(asked.column("v").combine_chunks(), d)
        words, length = codes(q), np.linalg.norm(q - codes.mean, axis=1)
        q_row, first = asked.column("row").to_numpy(), asked.column("bound").to_numpy()
        near = Nearest(len(q), k)

        def search(stretch: list[pa.RecordBatch]) -> None:
            rows = np.concatenate([b.column(0).to_numpy() for b in stretch])
            ids = np.concatenate([b.column(1).fill_null(NO_ID).to_numpy() for b in stretch])
            x = np.concatenate([_matrix(b.column(2), d) for b in stretch])
            index = Index(codes(x))
            bound = np.array([min(first[i], near.bound(i)) for i in range(len(q))])
            for i, radius in enumerate(codes.radii(bound, length).tolist()):
                at, _ = index.within(words[i], radius, masks)
                gap = _distances(x[at], q[i])
                ok = (gap <= bound[i]) & (rows[at] != q_row[i])
                if ok.any():
                    near.offer(i, gap[ok], ids[at[ok]], rows[at[ok]])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= STRETCH:
                search(held)
                held, n = [], 0
        if n:
            search(held)
        best = [(i, *x) for i, xs in enumerate(near.best) for x in xs]
        for at in range(0, len(best), 10_000):
            i, gap, ids, rows = (np.array(c) for c in zip(*best[at : at + 10_000], strict=True))
            vec = pa.array(ids, pa.int64(), mask=ids == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(q_row[i]), asked.column("vec_id").combine_chunks().take(pa.array(i)), vec, pa.array(rows, pa.int64()), pa.array(gap)], names=["query_row", "query_id", "vec_id", "row", "score"])

    return table.select("row", "vec_id", "v").mapInArrow(shared.lean(run), "query_row long, query_id long, vec_id long, row long, score double")
