"""Quality by nearest-neighbour voting: documents and labelled documents as latent-semantic vectors, exact cosine
products of every document with all labelled vectors in blocks, and the nearest labels weighted by similarity."""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features

ORDERS, BITS, RANK = (1, 3), 12, 64
#: At most 1.5 times this many labelled documents of each class become vectors; that bounds what is broadcast.
VECTORS_PER_CLASS = 700
NEIGHBOURS, SHARPNESS = 15, 4


#: Weight of the pseudo-term that counts words equal to the word before.
REPEAT_WEIGHT = 6.0


def term_counts(text: str):
    """Counts of the text's character n-grams, then of its words that repeat the word before."""
    import numpy as np

    words = text.split()
    return np.append(features.ngram_counts(text, ORDERS, BITS, lower=False), np.float32(sum(map(operator.eq, words, words[1:]))))


def vectors_of(counts, idf):
    """Unit TF-IDF rows; the pseudo-term's weight does not depend on its document frequency."""
    import numpy as np

    return features.weighted(counts, np.append(idf[:-1], np.float32(REPEAT_WEIGHT)))


@dataclass
class Model:
    idf: object
    axes: object  # cells x rank
    vectors: object  # labelled x rank, unit length
    labels: object
    prior: float


def unit(x):
    import numpy as np

    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", *, per_class: int = VECTORS_PER_CLASS, text: str = "text", id_col: str = "doc_id") -> Model | None:
    import numpy as np

    def sparse():
        def block(texts):
            found = [term_counts(t) for t in texts]
            cells = [np.flatnonzero(c).astype(np.int32) for c in found]
            return cells, [c[i] for c, i in zip(found, cells, strict=True)]

        return block

    sample = features.labelled_sample(docs, labels, label, per_class, text=text, id_col=id_col)
    got = features.score_whole(sample, {"doc_id": F.col("doc_id"), "y": F.col("y")}, "cells array<int>, n array<float>", sparse, text="t").collect()
    if not got:
        return None
    got = sorted(got, key=lambda r: (r.doc_id, r.y, tuple(r.cells)))
    counts, y = np.zeros((len(got), (1 << BITS) + 1), np.float32), np.array([r.y for r in got], np.float32)
    for i, r in enumerate(got):
        counts[i, r.cells] = r.n
    idf = features.idf_of(*features.document_frequencies(features.training_texts(docs, text=text, id_col=id_col), term_counts, (1 << BITS) + 1))
    x = vectors_of(counts, idf)
    values, u = np.linalg.eigh((x @ x.T).astype(np.float64))  # of the smaller side: documents x documents
    top = np.argsort(-values)[: min(RANK, len(got))]
    axes = (x.T @ (u[:, top] / np.sqrt(np.maximum(values[top], 1e-9)))).astype(np.float32)
    return Model(idf, axes, unit(x @ axes).astype(np.float32), y, float(y.mean()))


def predict(docs: DataFrame, model: Model | None, columns: dict, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """columns, score, predicted. A text without n-grams, and every text where there was nothing to learn from, scores
    the labelled share of 1 (0.5 if there are no labels)."""

    def scorer():
        import numpy as np

        def block(texts):
            score = np.full(len(texts), 0.5 if model is None else model.prior)
            if model is not None:
                counts = np.stack([term_counts(t or "") for t in texts])
                near = unit(vectors_of(counts, model.idf) @ model.axes) @ model.vectors.T
                k = min(NEIGHBOURS, near.shape[1])
                best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                w = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** SHARPNESS
                some = (w.sum(axis=1) > 0) & (counts.sum(axis=1) > 0)
                score[some] = ((w * model.labels[best]).sum(axis=1)[some] / w.sum(axis=1)[some]).clip(0, 1)
            return score, (score >= threshold).astype(np.int32)

        return block

    return features.score_whole(docs, columns, "score double, predicted int", scorer, text=text)


def score_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (that the label is 1), predicted (1 from a score of 0.5).

    Null text counts as empty and scores the labelled share of 1. Repeated rows are scored alike, each for itself; a text
    of any length is scored whole. Neighbours equally near beyond the last place are taken as numpy's partition has them,
    the same at every run. Document frequencies are those of all documents that are not held out. An empty table gives no
    rows; other columns are not read."""
    model = fit(docs, labels, label, text=text, id_col=id_col)
    return predict(docs, model, {"doc_id": docs[id_col].cast("long"), "held_out": features.held_out(docs[id_col], 3, 1)}, text=text)
