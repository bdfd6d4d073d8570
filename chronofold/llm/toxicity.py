"""Toxicity by compression distance: one zstandard dictionary of ordinary text and one of toxic text. A window of a
document that compresses shorter once the toxic dictionary is at hand counts as toxic evidence.

Both dictionaries are trained by zstandard: the ordinary one on windows of ordinary documents, the toxic one on whole
toxic documents. Labels are of documents, and most of a toxic document is ordinary text, so what zstandard picks from
them is mostly ordinary too (measured as it is: held-out AUC 0.6). The toxic dictionary is therefore pruned: of its
segments those stay that many toxic documents share and ordinary ones lack. It is laid before the ordinary content, both
as raw content, so that a window without toxic matches compresses to the same length under both and the difference has
no noise. Margins are calibrated on documents that trained no dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features

#: Words of a window.
WINDOW = 16
#: The dictionaries are trained on at most 1.5 times this many labelled documents of each class.
TRAIN_PER_CLASS = 1200
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 114_688
#: The toxic dictionary's training: bytes of a segment and of the pieces whose frequency is counted.
SEGMENT, PIECE = 16, 8
#: A segment of it stays from this many bytes, if at least this share of toxic documents has it, and its share is so many
#: times that among ordinary documents.
LEAST, SHARE, RATIO = 5, 0.03, 10


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """All words of a text, lower-cased, in windows of `size` words; the last one may be shorter."""
    words = data.lower().split()
    return [b" " + b" ".join(words[i : i + size]) for i in range(0, len(words), size)]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    center: object
    spread: object
    weights: object
    bias: float
    prior: float


class Distance:
    """Compressed lengths of windows with and without the toxic dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(3, strategy=z.STRATEGY_LAZY, min_match=4, search_log=4, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.packers = []
        for raw in (toxic + ordinary, ordinary):
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.packers.append(z.ZstdCompressor(dict_data=d, compression_params=params))

    def gains(self, parts: list[bytes]):
        """Bytes that the toxic dictionary saves, for each window."""
        import numpy as np

        a, b = (np.fromiter((len(p.compress(w)) for w in parts), np.int32, len(parts)) for p in self.packers)
        return b - a


def _facts(gain):
    """What a document's gains say: its largest gains, and the shares of windows over growing margins."""
    import numpy as np

    if not len(gain):
        return np.zeros(6)
    up = np.maximum(gain, 0)
    return np.array([np.log1p(up.max()), np.log1p(up.sum()), *(np.log1p((gain >= m).sum()) for m in (2, 3, 5)), np.sqrt(up.mean())], np.float64)


def _logistic(x, y, rounds: int = 60, ridge: float = 1.0):
    """Weights and bias of a ridge logistic regression, by Newton steps."""
    import numpy as np

    a, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    pull = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, a.T @ (p - y) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _ordinary(samples: list[bytes]) -> bytes:
    """A trained dictionary; samples too few to train one are its content as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(ORDINARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-ORDINARY_BYTES:] or b" " * 8


def _segments(toxic: list[bytes]) -> list[bytes]:
    """The segments of a dictionary trained on whole documents, cut at white space; samples too few to train one are cut
    as they are."""
    import zstandard

    samples = [b" " + b" ".join(t.lower().split()) for t in toxic]
    try:
        size = min(TOXIC_BYTES, max(1024, sum(map(len, samples)) // 4))
        content = zstandard.train_dictionary(size, samples, k=SEGMENT, d=PIECE).as_bytes()
    except zstandard.ZstdError:
        content = b"".join(samples)[-TOXIC_BYTES:]
    return list(dict.fromkeys(x for x in content.split() if len(x) >= LEAST))


def _shares(segments: list[bytes], rows: list[bytes]):
    """The share of rows that has each segment, by one automaton over all."""
    import ahocorasick
    import numpy as np

    automaton, seen = ahocorasick.Automaton(), np.zeros(len(segments))
    for i, x in enumerate(segments):
        automaton.add_word(x.decode("latin-1"), i)
    automaton.make_automaton()
    for t in rows:
        seen[list({i for _, i in automaton.iter(b" ".join(t.lower().split()).decode("latin-1"))})] += 1
    return seen / max(1, len(rows))


def _toxic(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """The trained dictionary's segments that stand out in toxic documents, the most shared last, where matches are
    cheapest."""
    segments = _segments(toxic)
    if not segments:
        return b""
    among, beside = _shares(segments, toxic), _shares(segments, ordinary)
    stay = [i for i in range(len(segments)) if among[i] >= max(SHARE, 3 / len(toxic)) and among[i] > RATIO * beside[i]]
    return b"".join(b" " + segments[i] for i in sorted(stay, key=lambda i: (among[i], segments[i])))


def fit_texts(rows: list[tuple[bytes, int]]) -> Model | None:
    """Fit on (text, label) rows; every third of a class calibrates. None without both classes."""
    import numpy as np

    y = np.array([label for _, label in rows], np.float64)
    if len(rows) < 2 or y.min() == y.max():
        return None
    calibrates = np.zeros(len(rows), bool)
    for c in (0, 1):
        calibrates[np.flatnonzero(y == c)[2::3]] = True
    toxic, plain = ([rows[i][0] for i in np.flatnonzero((y == c) & ~calibrates)] for c in (1, 0))
    model = Model(_toxic(toxic, plain), _ordinary([w for t in plain for w in windows(t, 6)]), 0, 1, None, 0.0, float(y.mean()))
    distance = Distance(model.toxic, model.ordinary)
    use = np.flatnonzero(calibrates if 0 < y[calibrates].sum() < calibrates.sum() else y >= 0)
    facts = np.stack([_facts(distance.gains(windows(rows[i][0]))) for i in use])
    model.center, model.spread = facts.mean(axis=0), facts.std(axis=0) + 1e-6
    model.weights, model.bias = _logistic((facts - model.center) / model.spread, y[use])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, per_class: int = TRAIN_PER_CLASS, text: str = "text", id_col: str = "doc_id") -> Model | None:
    sample = features.labelled_sample(docs, labels, label, per_class, text=text, id_col=id_col)
    got = sample.select("doc_id", "y", F.col("t").cast("binary").alias("t")).collect()
    return fit_texts([(bytes(r.t), r.y) for r in sorted(got, key=lambda r: (r.doc_id, bytes(r.t)))])


def predict(docs: DataFrame, model: Model | None, columns: dict, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """columns, score, predicted. A text without words scores as one without evidence; where one class was not seen in
    training, every score is 0.5 and predicted is 0."""

    def scorer():
        import numpy as np

        distance = Distance(model.toxic, model.ordinary) if model else None

        def block(texts):
            if model is None:
                return np.full(len(texts), 0.5), np.zeros(len(texts), np.int32)
            facts = np.stack([_facts(distance.gains(windows((t or "").encode()))) for t in texts])
            z = ((facts - model.center) / model.spread) @ model.weights + model.bias
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return score, (score >= threshold).astype(np.int32)

        return block

    return features.score_whole(docs, columns, "score double, predicted int", scorer, text=text)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (that the label is 1), predicted (1 from a score of 0.7).

    Null text counts as empty and scores as a text without evidence. Repeated rows are scored alike, each for itself; a
    text of any length is scored whole. An empty table gives no rows; other columns are not read."""
    model = fit(docs, labels, label, text=text, id_col=id_col)
    return predict(docs, model, {"doc_id": docs[id_col].cast("long"), "held_out": features.held_out(docs[id_col], 3, 1)}, text=text)
