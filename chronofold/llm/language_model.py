"""Language-model scoring: exact corpus counts, and a log-bilinear neural model trained with noise-contrastive estimation.

Words are counted over all training documents. The model's outcomes are the end, RARE classes of rare words, and the
commonest words, each with vectors of its own; their number grows with the square root of the training tokens (ROOT times
it), so the model does too. A word below them shares a rare class, by the crc32 of its first two bytes, and has its share
of the class's add-one counts there, one unit being left for words never seen, so every position has a normalised
distribution over all texts.

A context, the two outcomes before, is the sum of their position-wise vectors. Outcomes in order of frequency are cut
into classes of about the square root of their number: the probability of an outcome is that of its class times that
within the class, both log-bilinear, normalised in batched matrix products. Biases start from the corpus counts; vectors
are trained by noise-contrastive estimation on every position of every training document, once. Parts of the documents,
of POSITIONS positions an outcome, are trained apart, each by one task; a row of the model then becomes the mean of the
parts' rows, weighted by their squared gradients. A first round on one document in FIRST gives the second a common
start. What a round moves is a model for each part, so less than a number a position.

Text is read once. A task gives its words local numbers, by Arrow's dictionaries, and writes documents as number arrays,
and a vocabulary for every VOCABULARY words or TOKENS tokens. What then moves between tasks is the vocabularies (a row for each word of each,
so a frequent word is a row a vocabulary, never a row an occurrence) and the number arrays.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, shared

#: The model's words are ROOT times the square root of the training tokens, of those that occur MIN_COUNT times.
ROOT, MIN_COUNT, RARE = 2.0, 3, 31
END = 0
WIDTH = 24
#: The bias of places beyond the last outcome: no probability, and finite, so that it can stand in a matrix product.
NO_WORD = -1e30
#: A vocabulary ends at so many words of its slices, or tokens; texts are cut into words SLICE bytes at a time.
VOCABULARY, TOKENS, SLICE = 1_500_000, 4_000_000, 4 << 20
#: Training positions of a part for each outcome of the model, and one document of so many is trained on in the first round.
POSITIONS, FIRST = 400, 16
#: Passes over positions given as arrays; positions of a step (a part has about STEPS); noise outcomes of a step.
PASSES, BATCH, STEPS, CLASS_NOISE, WORD_NOISE, RATE = 2, (2048, 32768), 512, 32, 8, 0.15
#: Positions that are put in order of outcome together, rows of one matrix product, and rows of a model sent together.
BLOCK, ROWS, SENT = 1 << 20, 2048, 4096


def _slices(b: pa.RecordBatch) -> Iterator[list[pa.Array]]:
    """The columns of slices of a batch whose last column (binary) has about SLICE bytes in each, or a row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(b.columns[-1]).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = np.flatnonzero(np.r_[True, ends[1:] // SLICE != ends[:-1] // SLICE, True]) if len(ends) else []
    for s, t in itertools.pairwise(at):
        yield b.slice(s, t - s).columns


def _words(text: pa.Array) -> tuple:
    """How many words each text (binary) has, and all of them in order (binary): A-Z lower-cased, cut at ASCII spaces."""
    import numpy as np
    import pyarrow.compute as pc

    cut = pc.ascii_split_whitespace(pc.ascii_lower(text.view(pa.string())))  # an empty word stands where a text begins or ends with spaces
    words = cut.flatten().view(pa.binary())
    full = pc.binary_length(words).to_numpy() > 0
    size = np.add.reduceat(full, cut.offsets.to_numpy()[:-1], dtype=np.int64)
    return size, words if full.all() else words.filter(pa.array(full))


def tokenise(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of two kinds. Documents (kind 0): part, doc_id, held_out, ids (packed 32-bit local word numbers, without the
    end). Words (kind 1): part, local number, word (bytes), its count in training documents."""

    names = ["kind", "part", "doc_id", "held_out", "ids", "number", "word", "n"]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.binary(), pa.int64())

    def table(**columns) -> pa.RecordBatch:
        rows = max(len(c) for c in columns.values() if isinstance(c, pa.Array))
        at = [columns.get(name) for name in names]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.repeat(pa.scalar(c, t), rows) for c, t in zip(at, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, held = TaskContext.get().partitionId() << 24, []

        def vocabulary() -> Iterator[pa.RecordBatch]:
            doc_id, out, size, coded = zip(*held, strict=True)
            coded = pa.chunked_array(coded).unify_dictionaries()
            ids, word = np.concatenate([c.indices.to_numpy() for c in coded.chunks]), coded.chunk(0).dictionary
            doc_id, out, size = pa.concat_arrays(doc_id), np.concatenate(out), np.concatenate(size)
            n, out = np.bincount(ids[np.repeat(~out, size)], minlength=len(word)), pa.array(out)
            ends = pa.array(np.append(0, np.cumsum(4 * size))).cast(pa.int32())  # an error where they do not fit
            packed = pa.Array.from_buffers(pa.binary(), len(size), [None, ends.buffers()[1], pa.py_buffer(ids)])
            for i in range(0, len(size), 256):
                yield table(kind=0, part=part, doc_id=doc_id[i : i + 256], held_out=out[i : i + 256], ids=packed[i : i + 256])
            number, n = pa.array(np.arange(len(word), dtype=np.int32)), pa.array(n)
            for i in range(0, len(word), 50_000):
                yield table(kind=1, part=part, number=number[i : i + 50_000], word=word[i : i + 50_000], n=n[i : i + 50_000])

        for b in batches:
            for doc_id, out, text in _slices(b):
                size, words = _words(text)
                # Copies, since a column holds its whole batch, texts included.
                held.append((pa.array(doc_id.to_pylist(), pa.int64()), out.to_numpy(zero_copy_only=False), size, words.dictionary_encode()))
                # The slices' own words are at least as many as those of all.
                if sum(len(c.dictionary) for *_, c in held) >= VOCABULARY or sum(len(c) + len(x) for x, *_, c in held) >= TOKENS:
                    yield from vocabulary()
                    part, held = part + 1, []
        if held:
            yield from vocabulary()

    read = docs.select(docs[id_col].cast("long").alias("doc_id"), features.held_out(docs[id_col], 7, 2).alias("held_out"), shared.text_of(docs, text).cast("binary").alias("t"))
    return read.mapInArrow(shared.lean(run), "kind int, part long, doc_id long, held_out boolean, ids binary, number int, word binary, n long")


class Model:
    """The arrays of a model over `counts` (of each outcome, in order). Outcome y is number y % size of class y // size."""

    def __init__(self, counts, seed: int = 11) -> None:
        import numpy as np

        rng, k = np.random.default_rng(seed), len(counts)
        self.size = max(2, round(k**0.5))
        n = -(-k // self.size)
        share = np.append(np.asarray(counts, np.float64) + 0.5, np.zeros(n * self.size - k)).reshape(n, self.size)
        self.share = share / share.sum()  # the noise distribution; places beyond the last outcome have none
        small = lambda *shape: (rng.standard_normal(shape) * 0.05).astype(np.float32)
        self.near, self.far, self.of_class, self.of_word = small(k, WIDTH), small(k, WIDTH), small(n, WIDTH), small(n * self.size, WIDTH)
        with np.errstate(divide="ignore"):
            self.class_bias = np.log(self.share.sum(axis=1)).astype(np.float32)
            within = np.log(self.share / self.share.sum(axis=1, keepdims=True)).ravel()
            self.word_bias = np.maximum(within, NO_WORD).astype(np.float32)

    def arrays(self) -> tuple:
        return self.size, self.near, self.far, self.of_class, self.of_word, self.class_bias, self.word_bias

    def trained(self) -> list:
        return [self.near, self.far, self.of_class, self.of_word, self.class_bias, self.word_bias]


def _sums(x, first):
    """Sums of the runs of x's rows that begin at first. NumPy adds a column at a time, so two go as one complex number."""
    import numpy as np

    if x.ndim == 1 or x.dtype != np.float32 or x.shape[1] % 2:
        return np.add.reduceat(x, first, axis=0)
    return np.add.reduceat(np.ascontiguousarray(x).view(np.complex64), first, axis=0).view(np.float32)


def _move(x, grown, at, gradient, rate: float, *, in_order: bool = False) -> None:
    """One Adagrad step on the rows `at` of x, whose gradients may repeat rows; grown is a number for each row."""
    import numpy as np

    if not in_order:
        order = np.argsort(at.astype(np.uint16) if len(x) <= 1 << 16 else at, kind="stable")
        at, gradient = at[order], gradient[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    g, at = _sums(gradient, first), at[first]
    if g.ndim == 1:
        grown[at] += g * g
        x[at] += rate * g / np.sqrt(grown[at])
    else:
        grown[at] += np.einsum("nd,nd->n", g, g) / g.shape[1]
        x[at] += g * (rate / np.sqrt(grown[at]))[:, None]


def _odds(z):
    """1 / (1 + exp(-z)), in place."""
    import numpy as np

    np.negative(z, out=z)
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _learn(m: Model, grown: list, far, near, y, n_outcomes: int, batch: int, rng, rate: float = RATE) -> None:
    """One pass of noise-contrastive estimation over positions, in steps of about `batch` that have each its share of every
    outcome. A position's class is set against CLASS_NOISE classes drawn by count, which a step shares, and its outcome
    against WORD_NOISE outcomes of the class, drawn by count, which the step's positions of the class share."""
    import numpy as np

    near_g, far_g, class_g, word_g, class_bias_g, word_bias_g = grown
    share, n_class, width = m.share.ravel(), len(m.of_class), m.near.shape[1]
    class_share = m.share.sum(axis=1)
    upto, class_upto, start = np.cumsum(share), np.cumsum(class_share), np.arange(n_class) * m.size
    with np.errstate(divide="ignore"):
        class_noise, word_noise = np.log(CLASS_NOISE * class_share).astype(np.float32), np.log(WORD_NOISE * share / np.repeat(class_share, m.size)).astype(np.float32)
    low, last = np.r_[0.0, upto[start[1:] - 1]], np.minimum(start + m.size, n_outcomes) - 1
    order = np.argsort(y.astype(np.uint16) if n_outcomes <= 1 << 16 else y, kind="stable")
    steps = -(-len(y) // batch)
    for i in range(steps):
        pick = order[i::steps]
        a, b, w = far[pick], near[pick], y[pick]
        c = w // m.size
        cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True])
        here, runs = c[cut[:-1]], np.diff(cut)
        k = np.searchsorted(class_upto, rng.random(CLASS_NOISE) * class_upto[-1], side="right").clip(max=n_class - 1)
        other = np.searchsorted(upto, low[here][:, None] + rng.random((len(here), WORD_NOISE)) * class_share[here][:, None], side="right").clip(start[here][:, None], last[here][:, None])

        q = m.near[b]
        q += m.far[a]
        miss = _odds(q @ m.of_class[k].T + (m.class_bias[k] - class_noise[k]))
        np.negative(miss, out=miss)
        own = m.of_word[w]
        hit = 1 - _odds(np.einsum("nd,nd->n", q, own) + (m.word_bias - word_noise)[w])
        # Of each class that is here: its noise outcomes, then the class itself.
        sides = np.concatenate([m.of_word[other], m.of_class[here][:, None]], axis=1)
        z = np.repeat(np.c_[m.word_bias[other] - word_noise[other], m.class_bias[here] - class_noise[here]], runs, axis=0)
        spans = list(enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)))
        for j, (s, t) in spans:
            z[s:t] += q[s:t] @ sides[j].T
        np.negative(_odds(z), out=z)
        z[:, -1] += 1
        of_q, of_sides = miss @ m.of_class[k], np.empty_like(sides)
        own *= hit[:, None]
        of_q += own
        for j, (s, t) in spans:
            of_q[s:t] += z[s:t] @ sides[j]
            of_sides[j] = z[s:t].T @ q[s:t]
        of_bias = np.add.reduceat(z, cut[:-1], axis=0)

        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        classes, words = np.r_[here, k], np.r_[w[first], other.ravel()]
        _move(m.near, near_g, b, of_q, rate)
        _move(m.far, far_g, a, of_q, rate)
        _move(m.of_class, class_g, classes, np.concatenate([of_sides[:, -1], miss.T @ q]), rate)
        _move(m.class_bias, class_bias_g, classes, np.r_[of_bias[:, -1], miss.sum(axis=0)], rate / 4)
        q *= hit[:, None]
        _move(m.of_word, word_g, words, np.concatenate([_sums(q, first), of_sides[:, :-1].reshape(-1, width)]), rate)
        _move(m.word_bias, word_bias_g, words, np.r_[np.add.reduceat(hit, first), of_bias[:, :-1].ravel()], rate / 4)


def _batch(positions: float) -> int:
    return int(min(max(positions / STEPS, BATCH[0]), BATCH[1]))


def train(counts, *positions, seed: int = 11) -> Model:
    """The model of outcomes with these counts, trained on positions: arrays of the outcome two before, the one before and
    the outcome, passed over PASSES times; or a table of documents (doc_id, outcomes: packed 32-bit numbers without the
    end), every position of which is passed over once, by its tasks."""
    import numpy as np

    m = Model(counts, seed)
    grown = [np.full(len(x), 1e-3, np.float32) for x in m.trained()]
    if len(positions) == 1:
        for first in (True, False):
            _train_round(m, grown, len(counts), float(np.sum(counts)), positions[0], first, seed)
        return m
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        order = rng.permutation(len(positions[0]))
        for i in range(0, len(order), BLOCK):
            _learn(m, grown, *(x[order[i : i + BLOCK]] for x in positions), len(counts), _batch(len(order)), rng)
    return m


def _train_round(m: Model, grown: list, n_outcomes: int, n: float, docs: DataFrame, first: bool, seed: int) -> None:
    """Train m, in place, on the documents of the first round or on all others. The n positions of all rounds are dealt to
    parts of POSITIONS an outcome, or to more where the table's files are fewer; m takes the parts' weighted means."""
    import numpy as np

    parts = max(1, round(n / (POSITIONS * n_outcomes)))
    chosen = F.pmod(F.xxhash64("doc_id", "outcomes"), F.lit(FIRST)) == 0
    shipped = docs.sparkSession.sparkContext.broadcast((vars(m), grown))
    batch = _batch(n / parts / FIRST if first else n / parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        part = TaskContext.get().partitionId()
        own, start = Model.__new__(Model), shipped.value[1]
        vars(own).update(copy.deepcopy(shipped.value[0]))
        gone, rng = [x.copy() for x in start], np.random.default_rng([seed, part, first])
        held, size = [], 0

        def learn() -> None:
            _learn(own, gone, *(np.concatenate(x) for x in zip(*map(_contexts, held), strict=True)), n_outcomes, batch, rng)

        for b in batches:
            for packed in b.column("outcomes"):
                held.append(np.append(np.frombuffer(packed.as_py(), np.int32), np.int32(END)))
                size += len(held[-1])
                if size >= BLOCK:
                    learn()
                    held, size = [], 0
        if held:
            learn()
        for what, (x, g, g0) in enumerate(zip(own.trained(), gone, start, strict=True)):
            for i in range(0, len(x), SENT):
                w = g[i : i + SENT] - g0[i : i + SENT]
                if w.any():
                    yield pa.RecordBatch.from_arrays([pa.array([what], pa.int32()), pa.array([i], pa.int64()), pa.array([part], pa.int32()), pa.array([x[i : i + SENT].tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], names=["what", "at", "part", "x", "w"])

    def mean(rows: pa.Table) -> pa.Table:
        rows, total = rows.sort_by("part"), 0.0
        weight, parts_here = 0.0, 0
        for x, w in zip(rows.column("x"), rows.column("w"), strict=True):
            w = np.frombuffer(w.as_py(), np.float32).astype(np.float64)
            x = np.frombuffer(x.as_py(), np.float32).reshape(len(w), -1)
            total, weight, parts_here = total + w[:, None] * x, weight + w, parts_here + (w > 0)
        x = np.where(weight[:, None] > 0, total / np.maximum(weight, 1e-300)[:, None], np.nan).astype(np.float32)
        w = (weight / np.maximum(parts_here, 1)).astype(np.float32)
        return pa.table([rows.column("what")[:1], rows.column("at")[:1], pa.array([x.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], names=["what", "at", "x", "w"])

    moved = docs.where(chosen if first else ~chosen).select("outcomes").coalesce(parts).mapInArrow(shared.lean(run), "what int, at long, part int, x binary, w binary")
    for r in moved.groupBy("what", "at").applyInArrow(mean, "what int, at long, x binary, w binary").collect():  # one model
        x, w, into = np.frombuffer(r.x, np.float32), np.frombuffer(r.w, np.float32), m.trained()[r.what][r.at : r.at + SENT]
        x = x.reshape(into.shape)
        into[w > 0] = x[w > 0]
        grown[r.what][r.at : r.at + SENT] += w
    shipped.unpersist()


def log_probabilities(model: tuple, far, near, y):
    """log10 probability of each outcome y after its context."""
    import numpy as np

    size, vec_near, vec_far, of_class, of_word, class_bias, word_bias = model
    out, n_class, k = np.empty(len(y)), len(of_class), len(vec_near)
    classes = np.c_[of_class, class_bias].T  # the bias is the weight of a one
    words = np.concatenate([of_word, word_bias[:, None]], axis=1).reshape(n_class, size, -1).transpose(0, 2, 1)
    for i in range(0, len(y), BLOCK):
        # Equal contexts are normalised over the classes once, and equal pairs of a class and a context within the class once.
        key = (y[i : i + BLOCK] // size * np.int64(k) + near[i : i + BLOCK]) * k + far[i : i + BLOCK]
        order = np.argsort(key)
        key, w = key[order], y[i : i + BLOCK][order]
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        c, context = np.divmod(key[first], k * k)
        context, at = np.unique(context, return_inverse=True)
        q = np.ones((len(context), vec_near.shape[1] + 1), np.float32)
        np.add(vec_near[context // k], vec_far[context % k], out=q[:, :-1])
        over_classes = np.concatenate([_log_sum(q[s : s + ROWS] @ classes) for s in range(0, len(q), ROWS)])
        row, got = np.cumsum(new) - 1, np.empty(len(w))
        ends = np.r_[first, len(w)]
        cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True])
        for s, t in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):  # contexts of one class
            inside = np.c_[words[c[s]], classes[:, c[s]]]
            for u in range(s, t, ROWS):
                v = min(u + ROWS, t)
                z = q[at[u:v]] @ inside
                less = _log_sum(z[:, :-1]) + over_classes[at[u:v]] - z[:, -1]
                its = slice(ends[u], ends[v])
                got[its] = z[row[its] - u, w[its] - c[s] * size] - less[row[its] - u]
        out[i + order] = got
    return out / np.log(10)


def _log_sum(z):
    """Of each row the logarithm of its exponentials' sum."""
    import numpy as np

    with np.errstate(over="ignore"):
        total = np.exp(z).sum(axis=1)
    if 1e-30 < total.min(initial=1) <= total.max(initial=1) < 1e30:
        return np.log(total, dtype=np.float64)
    most = z.max(axis=1)  # exponentials do not fit their type as they are
    return np.log(np.exp(z - most[:, None]).sum(axis=1), dtype=np.float64) + most


def _log_softmax_at(z, columns):
    """Of each row's log-softmax the given column."""
    import numpy as np

    return z[np.arange(len(z)), columns] - _log_sum(z)


def _contexts(outcomes):
    """Far, near and outcome of all positions of a document's outcomes; before its start stands the end."""
    import numpy as np

    before = np.concatenate([np.array([END, END], np.int32), outcomes])
    return before[:-2], before[1:-1], outcomes


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of documents, of about BLOCK positions or one document."""
    at, size = 0, 0
    for i, packed in enumerate(batch.column("outcomes")):
        size += len(packed.as_buffer() or b"") // 4 + 1
        if size >= BLOCK:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def score(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out (crc32(doc_id as text) mod 7 is 2), n_tokens (words and one end), n_known
    (tokens seen in training), train_tokens, base_score (add-one unigram, log10), score (the model's log10 probability).

    Null text counts as empty: its one token is the end. Words equally frequent are ranked by their bytes. Repeated rows
    count, and are scored, each for itself; texts of any length are scored whole. Without training documents nothing is
    known and base_score is log10(1/1) a token; the model is then uniform over its outcomes. An empty table gives no rows;
    other columns are not read."""
    import numpy as np

    spark = docs.sparkSession
    tokens = shared.written(tokenise(docs, text=text, id_col=id_col), "lm-tokens")
    rows = tokens.where("kind = 0").select("part", "doc_id", "held_out", "ids")
    words = tokens.where("kind = 1").select("part", "number", "word", "n")

    counted = shared.written(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "lm-counts")
    train_docs = rows.where("not held_out").count()
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + train_docs, v + (train_docs > 0)  # the end is a token of every document
    top = counted.where(F.col("c") >= MIN_COUNT).orderBy(F.desc("c"), "word").limit(int(ROOT * n**0.5)).toArrow()  # grows as the root of the tokens
    outcome = pa.array(np.arange(len(top)) + RARE + 1, pa.int32())
    model_words = shared.written(spark.createDataFrame(pa.table({"w": top.column("word"), "k": outcome}).cast(pa.schema([("w", pa.binary()), ("k", pa.int32())]))), "lm-words")
    rare = (F.crc32(F.substring("word", 1, 2)) % RARE + 1).cast("int")
    counted_k = counted.join(shared.small(model_words), F.col("word") == F.col("w"), "left").select("word", "c", F.coalesce("k", rare).alias("k"))
    counted_k = shared.written(counted_k, "lm-outcomes")
    of_rare = counted_k.where(F.col("k") <= RARE).groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    rare_count, mass = np.zeros(RARE + 1), np.ones(RARE + 1)
    for r in of_rare:
        rare_count[r.k], mass[r.k] = r.c, r.c + r.n + 1
    counts = np.concatenate([[train_docs], rare_count[1:], top.column("c").to_numpy()])

    # Counts return to every vocabulary that holds the word. Both sides are a row for each word (of a vocabulary).
    # A task holds its share of the distinct words in a table, so that no word is sorted.
    known = words.join(counted_k.hint("shuffle_hash"), "word", "left").select(F.col("part").alias("p"), "number", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("k", rare).alias("k"))
    unseen = float(n + v + 1)

    def place(documents: pa.Table, vocabulary: pa.Table) -> pa.Table:
        at = vocabulary.column("number").to_numpy()
        c, k = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32)
        c[at], k[at] = vocabulary.column("c").to_numpy(), vocabulary.column("k").to_numpy()
        base, inner = np.log10((c + 1) / unseen), np.zeros(len(at))
        is_rare = k <= RARE
        inner[is_rare] = np.log10((c[is_rare] + 1) / mass[k[is_rare]])
        out: list = [[], [], [], []]
        for packed in documents.column("ids"):
            ids = np.frombuffer(packed.as_py(), np.int32)
            for o, x in zip(out, (int((c[ids] > 0).sum()), float(base[ids].sum()), float(inner[ids].sum()), k[ids].tobytes()), strict=True):
                o.append(x)
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.Table.from_arrays([documents.column("doc_id"), documents.column("held_out"), *(pa.array(o, t) for o, t in zip(out, kinds, strict=True))], names=["doc_id", "held_out", "known", "base", "inner", "outcomes"])

    schema = "doc_id long, held_out boolean, known long, base double, inner double, outcomes binary"
    placed = shared.written(rows.groupBy("part").cogroup(known.groupBy("p")).applyInArrow(place, schema), "lm-placed")
    shared.forget(tokens, counted, counted_k, model_words)
    shipped = spark.sparkContext.broadcast(train(counts, placed.where("not held_out").select("doc_id", "outcomes")).arrays())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end_base = shipped.value, float(np.log10((train_docs + 1) / unseen))
        for b in (part for b in batches for part in _blocks(b)):
            outcomes = [np.append(np.frombuffer(x.as_py(), np.int32), np.int32(END)) for x in b.column("outcomes")]
            size = np.array([len(x) for x in outcomes])
            each = log_probabilities(model, *(np.concatenate(x) for x in zip(*map(_contexts, outcomes), strict=True)))
            score = b.column("inner").to_numpy() + np.add.reduceat(each, np.cumsum(size) - size)
            known = pa.array(b.column("known").to_numpy() + (train_docs > 0))
            base = pa.array(b.column("base").to_numpy() + end_base)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(size), known, pa.array([n] * b.num_rows, pa.int64()), base, pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return placed.mapInArrow(shared.lean(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
