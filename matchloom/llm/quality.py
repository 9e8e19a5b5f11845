"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Every word is seen as a unit for its shape (case, last character, length, repetition of the word
before) and, where the vocabulary has it, as a unit of its own.  Random indexing gives each unit a sparse
random index vector; a unit's word vector is its index vector plus the normalised sum of its
neighbours' index vectors.  A document is the means of its shape vectors and of its word vectors.
Two numpy layers turn that into a logit, and a temperature fitted on held-back rows calibrates it.

The fit is bounded: at most SAMPLE labelled documents, chosen by a hash of the id, give vocabulary,
vectors and network.  Every document is then scored in one scan without a shuffle.

Defined results: null or empty text pools to zeros and has that score; ids with contradicting or null
labels teach nothing; of rows that share an id one teaches; without both labels in the sample every score is the share of label 1 (0.5
without labels); repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, checkpointed, fold, in_arrow, texts
from .words import Words, mix, signed, split_words

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 6000
#: Words of the sample with units of their own, at most.
VOCABULARY = 1 << 14
DIMS = 64
NONZERO = 8
HIDDEN = 32
THRESHOLD = 0.7

_ENDS = "!*$%&#|.,;:?)\"'"
_SLOTS = 20
_SHAPES = 4 * 16 * 4 * 2


def _last_class() -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[np.frombuffer(_ENDS.encode(), np.uint8)] = np.arange(1, len(_ENDS) + 1)
    return out


_LAST = _last_class()


def shapes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """The shape unit of each word."""
    data = words.data
    upper = np.append(0, np.cumsum((data >= 65) & (data <= 90)))
    lower = np.append(0, np.cumsum((data >= 97) & (data <= 122)))
    has_upper = upper[words.ends] > upper[words.starts]
    has_lower = lower[words.ends] > lower[words.starts]
    size = np.digitize(words.ends - words.starts, [2, 5, 12])
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    heads = words.offsets[:-1]
    again[heads[heads < len(hashes)]] = False
    return (((has_upper * 2 + has_lower) * 16 + _LAST[data[words.ends - 1]]) * 4 + size) * 2 + again


def index_vectors(units: np.ndarray) -> np.ndarray:
    """The sparse ternary vector of each unit, from its number or hash alone."""
    out = np.zeros((len(units), DIMS), np.float32)
    rows = np.arange(len(units))
    for k in range(NONZERO):
        draw = mix(units.astype(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        out[rows, (draw % np.uint64(DIMS)).astype(np.int64)] += np.where(draw >> np.uint64(63), 1, -1)
    return out


@dataclass
class Units:
    """Vocabulary words by ascending hash, and which hash prefixes they have; numbered from _SHAPES on, after the shapes."""

    hashes: np.ndarray
    numbers: np.ndarray
    maybe: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray) -> Units:
        """`words`: distinct hashes, numbered in their order."""
        maybe, order = np.zeros(1 << _SLOTS, bool), np.argsort(words)
        maybe[(words >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True
        return cls(words[order], order + _SHAPES, maybe)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The unit of each word, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        own = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[own]), len(self.hashes) - 1)
        if len(own):
            out[own] = np.where(self.hashes[at] == hashes[own], self.numbers[at], -1)
        return out


def contexts(units: Units, column: pa.Array, count: int) -> np.ndarray:
    """For each of `count` units, the sum of its neighbours' index vectors over the texts."""
    index = index_vectors(np.arange(count)).astype(np.float64)
    total = np.zeros((count, DIMS))
    for words in split_words(column):
        hashes = words.hashes(lower=False)
        if len(hashes) < 2:
            continue
        shape, word = shapes(words, hashes), units.lookup(hashes)
        unit = np.where(word < 0, shape, word)
        row = np.repeat(np.arange(len(words.counts)), words.counts)
        pair = np.flatnonzero(row[1:] == row[:-1])
        for own in (unit, shape):  # a shape unit also has the contexts of known words of that shape
            for a, b in ((pair, pair + 1), (pair + 1, pair)):
                key, times = np.unique(own[a] * count + unit[b], return_counts=True)
                order = key // count
                heads = np.flatnonzero(np.append(True, order[1:] != order[:-1])) if len(order) else order
                if len(heads):
                    total[order[heads]] += np.add.reduceat(index[key % count] * times[:, None], heads, axis=0)
    return total


def pooled(units: Units, vectors: np.ndarray, column: pa.Array) -> np.ndarray:
    """Means of shape vectors and of known words' vectors for each text."""
    out = np.zeros((len(column), 2 * DIMS), np.float32)
    for words in split_words(column):
        hashes = words.hashes(lower=False)
        if not len(hashes):
            continue
        counts = words.counts
        rows = np.repeat(np.arange(len(counts)), counts)
        here = slice(words.first_row, words.first_row + len(counts))
        seen = np.bincount(rows * _SHAPES + shapes(words, hashes), minlength=len(counts) * _SHAPES).reshape(len(counts), _SHAPES)
        n = np.maximum(counts, 1)[:, None]
        out[here, :DIMS] = seen.astype(np.float32) @ vectors[:_SHAPES] / n
        unit = units.lookup(hashes)
        at = np.flatnonzero(unit >= 0)
        if len(at):
            heads = np.flatnonzero(np.append(True, rows[at][1:] != rows[at][:-1]))
            out[words.first_row + rows[at][heads], DIMS:] = np.add.reduceat(vectors[unit[at]], heads, axis=0) / n[rows[at][heads]]
    return out


@dataclass
class Network:
    """Standardisation, two layers, and the temperature that divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on the log loss of four fifths of the rows; the temperature has the least log loss on the rest."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    if len(set(y.tolist())) < 2 or len(y) < 10:
        share = y.mean() if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        dims = x.shape[1]
        return Network(np.zeros(dims), np.ones(dims), np.zeros((dims, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    net = Network(x[used].mean(0), x[used].std(0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = (x - net.mean) / net.scale
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    step = 0
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), 128):
            rows = used[at : at + 128]
            h = np.tanh(z[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3][0], -60, 60))) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - h * h)
            step += 1
            for w, g, (m, v) in zip(weights, (z[rows].T @ back, back.sum(0), h.T @ error, np.array([error.sum()])), moments, strict=True):
                g = g + decay * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    logit, label = net.logits(x[held]), y[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, -np.clip(logit / t, -60, 60) * (2 * label - 1))) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class Model:
    units: Units
    vectors: np.ndarray
    network: Network

    def scores(self, column: pa.Array) -> np.ndarray:
        return self.network.scores(pooled(self.units, self.vectors, column))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """`docs`: doc_id and text; `labels`: doc_id and quality (0 or 1), of the rows that may teach."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    known = known.where("quality = _most").drop("_most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Of rows that share an id one teaches, so that the rows are no more than the labels.
    taught = checkpointed(docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "quality-sample").coalesce(4)

    def counted(rows: pa.RecordBatch):
        for words in split_words(rows.column("text")):
            word, times = np.unique(words.hashes(lower=False), return_counts=True)
            yield batch(word=signed(word), times=times)

    vocabulary = in_arrow(taught, counted, "word long, times long").groupBy("word").agg(F.sum("times").alias("times")).where("times > 1").orderBy(F.desc("times"), "word").limit(VOCABULARY)
    words = np.array([r.word for r in vocabulary.collect()], np.int64).view(np.uint64)
    units = Units.of(words)
    count = _SHAPES + len(words)
    shared = spark.sparkContext.broadcast(units)

    def summed(batches):
        total = np.zeros((count, DIMS))
        for rows in batches:
            total += contexts(shared.value, rows.column("text"), count)
        yield batch(sums=pa.array([total.astype(np.float32).tobytes()], pa.binary()))

    total = np.zeros((count, DIMS))
    for r in taught.mapInArrow(summed, "sums binary").toLocalIterator():
        total += np.frombuffer(r.sums, np.float32).reshape(count, DIMS)
    length = np.linalg.norm(total, axis=1, keepdims=True)
    vectors = (index_vectors(np.arange(count)) + DIMS**0.5 * total / np.maximum(length, 1)).astype(np.float32)
    sent = spark.sparkContext.broadcast((units, vectors))

    def features(rows: pa.RecordBatch):
        x = pooled(*sent.value, rows.column("text"))
        yield batch(doc_id=rows.column("doc_id"), quality=rows.column("quality").cast(pa.int32()), x=pa.array([v.tobytes() for v in x], pa.binary()))

    found = sorted(((r.doc_id, bytes(r.x), r.quality) for r in in_arrow(taught, features, "doc_id long, quality int, x binary").collect()))
    x = np.array([np.frombuffer(f[1], np.float32) for f in found]).reshape(len(found), 2 * DIMS)
    return Model(units, vectors, fit_network(x, np.array([f[2] for f in found])))


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; rows whose crc32(id) mod `folds` is `held_out` teach nothing."""
    docs = texts(df, id_col, text_col)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    model = df.sparkSession.sparkContext.broadcast(fit(docs, labels.where(fold("doc_id", folds) != held_out)))

    def task(rows: pa.RecordBatch):
        yield batch(doc_id=rows.column("doc_id"), score=model.value.scores(rows.column("text")).astype(np.float64))

    scored = in_arrow(docs, task, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 2, folds: int = 4) -> DataFrame:
    """The rows of `df`, with all their columns, that score_quality predicts to be good."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    model = df.sparkSession.sparkContext.broadcast(fit(texts(df, id_col, text_col), labels.where(fold("doc_id", folds) != held_out)))
    at = df.columns.index(text_col)

    def task(rows: pa.RecordBatch):
        yield rows.filter(pa.array(model.value.scores(rows.column(at).cast(pa.string())) >= THRESHOLD))

    return in_arrow(df, task, df.schema)
