"""Hashed n-gram counts of whole texts as numpy arrays, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Classifiers are fitted on labelled texts of at most this many characters; every text is scored, and counted, whole.
FIT_CHARS = 1 << 16
#: Code units hashed at once; longer texts are taken in overlapping stretches, so memory stays bounded.
STRETCH = 1 << 20


def ngram_counts(text: str, orders: tuple[int, ...], bits: int, lower: bool = True):
    """float32 counts of the text's character n-grams in 2**bits hashed cells, over the whole text."""
    import numpy as np

    out = np.zeros(1 << bits, np.float32)
    over = max(orders) - 1
    points = np.frombuffer((text.lower() if lower else text).encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(points), STRETCH):
        c = points[max(0, at - over) : at + STRETCH]
        h = np.zeros(len(c), np.uint32)
        fresh = at - max(0, at - over)  # n-grams that end in the overlap were counted before
        for n in range(1, max(orders) + 1):
            h = (h[: len(c) - n + 1] if n == 1 else h[: max(0, len(c) - n + 1)]) * np.uint32(0x01000193) + c[n - 1 :]
            if n in orders and len(h):
                mixed = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                first = max(0, fresh - n + 1)
                out += np.bincount(mixed[first:] >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def weighted(counts, idf):
    """L2-normalised TF-IDF of counts (rows x cells); a row without n-grams stays zero."""
    import numpy as np

    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def idf_of(seen, n: int):
    """Inverse document frequencies from the number of texts that have each cell, of n texts."""
    import numpy as np

    return (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)


def score_whole(docs: DataFrame, columns: dict, extra: str, block, *, text: str = "text", rows: int = 64) -> DataFrame:
    """columns (name -> Column of docs) and the columns of `extra` (DDL): what block()(texts) gives for up to `rows` whole
    texts at a time, a list of arrays."""
    kept = docs.select(*[c.alias(n) for n, c in columns.items()])
    more = T.StructType.fromDDL(extra)
    schema = T.StructType([*kept.schema.fields, *more.fields])
    names, n = schema.names, len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = block()
        for b in batches:
            for k in range(0, b.num_rows, rows):
                some = b.slice(k, rows)
                got = made(some.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns[:n], *map(pa.array, got)], names=names)

    return docs.select(*[c.alias(name) for name, c in columns.items()], docs[text].cast("string").alias("_t")).mapInArrow(shared.lean(run), schema)


def where_text(docs: DataFrame, test, *, text: str = "text", rows: int = 64) -> DataFrame:
    """The rows of docs whose whole text passes: test() gives a function from up to `rows` texts to booleans. Columns
    that are not the text stay in the JVM."""

    @F.arrow_udf("boolean")
    def passes(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = test()
        for a in arrays:
            yield pa.array([bool(x) for k in range(0, len(a), rows) for x in made(a.slice(k, rows).to_pylist())], pa.bool_())
        shared.give_back()

    return docs.where(passes(docs[text].cast("string")))


def held_out(id_col, parts: int, part: int):
    return F.pmod(shared.id_crc(id_col), F.lit(parts)) == part


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y, t): at most about per_class documents of each class that are not held out (crc32(doc_id) mod 3 is not
    1), of at most FIT_CHARS characters. Null labels are skipped; of several labels of an id the mean decides, a tie for
    1; of several texts of an id the one of the least digest is taken."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), 3, 1))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = shared.written(shared.bounded_sample(known, F.col("doc_id"), per_class, F.col("y")), "labelled")
    rows = docs.select(docs[id_col].cast("long").alias("_id"), shared.text_of(docs, text).alias("t"))
    found = rows.join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).where(F.length("t") <= FIT_CHARS)  # chosen: at most 3 * per_class rows
    return found.groupBy("doc_id", "y").agg(F.min_by("t", F.md5("t")).alias("t"))


def document_frequencies(texts: DataFrame, count, cells: int):
    """For each cell the number of texts (one string column) that have it, and the number of texts, over all rows. count:
    text -> counts by cell. Tasks sum for themselves; what moves is a row for each cell and task."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(cells + 1, np.int64), 0
        for b in batches:
            for t in b.column(0):
                seen[:cells] += count(t.as_py()) > 0
                n += 1
        seen[cells] = n
        at = np.flatnonzero(seen)
        for k in range(0, len(at), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 10_000]), pa.array(seen[at[k : k + 10_000]])], names=["cell", "n"])

    found = texts.mapInArrow(shared.lean(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # cells + 1 rows at most
    out = np.zeros(cells + 1, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out[:cells], int(out[cells])


def training_texts(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """t: the texts of all documents that are not held out."""
    return docs.where(docs[text].isNotNull() & ~held_out(docs[id_col], 3, 1)).select(docs[text].cast("string").alias("t"))