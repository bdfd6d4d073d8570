"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties, then temperature-calibrated."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, shared

ORDERS, BITS = (1, 2, 3), 14
#: The classifier is fitted on at most 1.5 times this many labelled documents of each language, and of all together.
TRAIN_PER_LANGUAGE, TRAIN_TOTAL = 400, 20_000
UNKNOWN = "und"


@dataclass
class Model:
    langs: list
    idf: object
    weights: object  # cells x languages
    bias: object
    temperature: float

    def probabilities(self, counts):
        import numpy as np

        z = (features.weighted(counts, self.idf) @ self.weights + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train_ftrl(rows: list, y, n_cells: int, n_langs: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 4):
    """Weights and bias by FTRL-proximal. rows: (cells, values) of each example. A coordinate whose accumulated gradient
    stays within l1 is zero; l2 shrinks the others."""
    import numpy as np

    z, n = np.zeros((n_cells + 1, n_langs)), np.zeros((n_cells + 1, n_langs))
    order = np.random.default_rng(7)
    lazily = lambda zi, ni, pen: np.where(np.abs(zi) <= pen, 0.0, -(zi - np.sign(zi) * pen) / ((beta + np.sqrt(ni)) / alpha + l2))
    penalty = lambda cells: np.where(cells == n_cells, 0.0, l1)[:, None]  # noqa: E731  the bias is free
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            cells, values = np.append(rows[i][0], n_cells), np.append(rows[i][1], 1.0)
            w = lazily(z[cells], n[cells], penalty(cells))
            p = values @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = values[:, None] * p[None, :]
            step = (np.sqrt(n[cells] + g * g) - np.sqrt(n[cells])) / alpha
            z[cells] += g - step * w
            n[cells] += g * g
    w = lazily(z, n, penalty(np.arange(n_cells + 1)))
    return w[:-1].astype(np.float32), w[-1].astype(np.float32)


def _temperature(logits, y) -> float:
    """The temperature of least negative log-likelihood, by golden section over its logarithm."""
    import numpy as np

    def loss(t):
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE) -> Model | None:
    """Fit on a bounded sample of the documents that are not held out (crc32(doc_id as text) mod 3 is not 1) and have a
    text and a language; document frequencies are those of all documents that are not held out. One sampled document in
    five calibrates. None if there is nothing to learn from."""
    import numpy as np

    rows = docs.where(docs[lang].isNotNull() & docs[text].isNotNull() & ~features.held_out(docs[id_col], 3, 1))
    rows = rows.select(docs[id_col].cast("long").alias("doc_id"), docs[lang].cast("string").alias("lang"), docs[text].cast("string").alias("t"))
    sample = shared.bounded_sample(rows, F.col("doc_id"), per_language, F.col("lang"), TRAIN_TOTAL)

    def sparse():
        def block(texts):
            found = [features.ngram_counts(t, ORDERS, BITS) for t in texts]
            cells = [np.flatnonzero(c).astype(np.int32) for c in found]
            return cells, [c[i] for c, i in zip(found, cells, strict=True)]

        return block

    got = features.score_whole(sample, {"doc_id": F.col("doc_id"), "lang": F.col("lang")}, "cells array<int>, n array<float>", sparse, text="t").collect()
    got = sorted((r for r in got if len(r.cells)), key=lambda r: (r.doc_id is None, r.doc_id, r.lang))
    if not got:
        return None
    langs = sorted({r.lang for r in got})
    count = functools.partial(features.ngram_counts, orders=ORDERS, bits=BITS)
    idf = features.idf_of(*features.document_frequencies(features.training_texts(docs, text=text, id_col=id_col), count, 1 << BITS))
    rows, y = [], np.array([langs.index(r.lang) for r in got])
    for r in got:
        cells, x = np.array(r.cells), np.log1p(np.array(r.n)) * idf[r.cells]
        rows.append((cells, x / np.linalg.norm(x)))
    test = np.arange(len(rows)) % 5 == 4
    if test.sum() < 20:
        test[:] = False
    train = np.flatnonzero(~test)
    w, b = train_ftrl([rows[i] for i in train], y[train], 1 << BITS, len(langs))
    temperature = 1.0
    if test.any():
        held = np.flatnonzero(test)
        temperature = _temperature(np.stack([rows[i][1] @ w[rows[i][0]] + b for i in held]), y[held])
    return Model(langs, idf, w, b, max(temperature, 0.05))


def _scorer(model: Model | None):
    import numpy as np

    def block(texts):
        pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if model is not None and some:
            p = model.probabilities(np.stack([features.ngram_counts(texts[i], ORDERS, BITS) for i in some]))
            for i, q in zip(some, p, strict=True):
                pred[i], score[i] = model.langs[int(q.argmax())], float(min(1.0, q.max()))
        return pred, score

    return block


def predict(docs: DataFrame, model: Model | None, columns: dict, *, text: str = "text") -> DataFrame:
    """columns, lang_pred, score (probability of lang_pred). 'und' with score 0 where the text is null or has no letter,
    or where nothing was learned."""
    return features.score_whole(docs, columns, "lang_pred string, score double", lambda: _scorer(model), text=text)


def keep_known(docs: DataFrame, model: Model | None, min_score: float, *, text: str = "text") -> DataFrame:
    """The rows of docs whose language is known with at least min_score."""

    def test():
        block = _scorer(model)

        def run(texts):
            pred, score = block(texts)
            return [p != UNKNOWN and s >= min_score for p, s in zip(pred, score, strict=True)]

        return run

    return features.where_text(docs, test, text=text)


def identify(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score. Repeated rows are scored alike, each for itself; a text of
    any length is scored whole; of languages equally likely the first by code point is given. An empty table gives no
    rows; the language column is read in training only."""
    model = fit(docs, text=text, lang=lang, id_col=id_col)
    return predict(docs, model, {"doc_id": docs[id_col].cast("long"), "held_out": features.held_out(docs[id_col], 3, 1)}, text=text)
