"""Quality classifier: supervised subword embeddings.

Every document is the average of learned vectors of its hashed words, ordered
word pairs and character n-grams (3 and 4 characters of UTF-8), one end mark
included; a softmax over the average gives the classes.  A word that repeats
the one before it is written as a mark, so that runs of any word look alike.
Vectors and output weights are trained by numpy stochastic gradient descent (Adagrad) on a bounded
sample of labelled rows.

With two classes the softmax depends only on each feature's vector times the
difference of the two output rows, so scoring sums one number a feature.  The
numbers are held in fixed point: a score does not depend on how rows are
batched or in which order features are summed.

Cases: a null or empty text has the end mark alone and so a defined score.
Rows whose label is null or not 0 or 1, and doc_ids with contrary labels, are
not learned from; with no label, or labels of one class only, that class's
smoothed share is every score.  Null doc_ids are never held out and never
learned from; of rows that share a doc_id the one of least text is learned
from, and none of more than ``MAX_TEXT`` bytes.  Repeated rows get equal scores;
an empty table gives no rows.  Other columns are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import text as tx
from corvane.llm.runtime import bounded

#: Documented bound of the training sample: rows, chosen by hash of doc_id.
MAX_ROWS = 3_000
#: Documented bound of the bytes of a text that is learned from.
MAX_TEXT = 1 << 17
BITS = 17
DIMENSIONS = 8
EPOCHS = 4
RATE = 0.2
#: Scores from here on are predicted 1.
CUTOFF = 0.7
#: doc_ids whose crc32 has this remainder are held out.
FOLDS, HELD_OUT = 4, 2

_U = np.uint64
_FIXED = 1 << 24
_END = (1 << BITS) - 1
#: Stands for a word that repeats the one before it.
_AGAIN = _U(0x1F83D9ABFB41BD6B)


def held_out(folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character (its bytes) of all texts, and n+1 bounds."""
    packed = np.zeros(len(data), np.uint32)
    for k in range(4):
        packed[: max(0, len(data) - k)] |= data[k:].astype(np.uint32) << np.uint32(8 * k)
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(lead)
    size = np.minimum(np.diff(np.append(starts, len(data))), 4)
    return packed[starts] & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)[size], np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, text after text, and n+1 bounds.

    The end mark is left out; it is each text's one more feature.
    """
    starts, ends, where = tx.words(data, offsets)
    hashes = tx.word_hashes(data, starts, ends)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[where[:-1][where[:-1] < len(hashes)]] = False
    hashes[again] = _AGAIN
    word = (hashes >> _U(64 - BITS)).astype(np.int32)
    pair = (tx.mix(hashes[:-1] * _U(0x9FB21C651E98DF25) + hashes[1:]) >> _U(64 - BITS)).astype(np.int32)
    within = np.ones(len(pair), bool)
    within[[i - 1 for i in where[1:-1] if 0 < i < len(starts)]] = False
    paired = np.flatnonzero(within)
    parts = [(pair[paired], np.searchsorted(paired, where))]
    chars, bounds = characters(data, offsets)
    for size, odd in ((3, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)), (4, (0x27D4EB2F, 0x165667B1, 0x9E3779B1, 0x85EBCA77))):
        n = max(0, len(chars) - size + 1)
        value = sum((chars[k : k + n] * np.uint32(m) for k, m in enumerate(odd)), np.zeros(n, np.uint32))
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x2C1B3C6D)
        whole = np.ones(n, bool)
        for edge in bounds[1:]:  # n-grams that would cross into the next text
            whole[max(0, edge - size + 1) : edge] = False
        at = np.flatnonzero(whole)
        parts.append(((value[at] >> np.uint32(32 - BITS)).astype(np.int32), np.searchsorted(at, bounds)))
    counts = sum(np.diff(b) for _, b in parts) + np.diff(where)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(bounds[-1], np.int32)
    for i in range(len(offsets) - 1):
        to = bounds[i]
        for values, b in (*parts, (word, where)):
            piece = values[b[i] : b[i + 1]]
            out[to : to + len(piece)] = piece
            to += len(piece)
    return out, bounds


def slopes(own: np.ndarray, output: np.ndarray, part: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a document's loss by its features' vectors and by the output weights."""
    hidden = part @ own
    z = output @ hidden
    p = np.exp(z - z.max())
    p /= p.sum()
    p[label] -= 1
    return part[:, None] * (p @ output), np.outer(p, hidden)


def learned(texts: list[str], y: np.ndarray, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all features and the two classes' output weights."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BITS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    output = np.zeros((2, DIMENSIONS), np.float32)
    squares = [np.full(1 << BITS, 1e-10, np.float32), np.full((2, 1), 1e-10, np.float32)]
    rows = []
    for begin in range(0, len(texts), 64):
        data, offsets = tx.raw(pa.array(texts[begin : begin + 64], pa.large_string()))
        values, bounds = features(data, offsets)
        for i in range(len(offsets) - 1):
            which, n = np.unique(np.append(values[bounds[i] : bounds[i + 1]], _END), return_counts=True)
            rows.append((which, (n / n.sum()).astype(np.float32)))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            which, part = rows[i]
            own_slope, output_slope = slopes(vectors[which], output, part, int(y[i]))
            squares[0][which] += (own_slope**2).mean(1)
            squares[1] += (output_slope**2).mean(1, keepdims=True)
            vectors[which] -= rate * own_slope / np.sqrt(squares[0][which])[:, None]
            output -= rate * output_slope / np.sqrt(squares[1])
    return vectors, output


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> np.ndarray:
    """Fixed-point weight of each feature; the last but one entry is the end mark's
    (``_END``), and the last holds a constant that is used alone where it isn't 0."""
    weights = np.zeros((1 << BITS) + 1, np.int64)
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        weights[-1] = round(float(np.log(share / (1 - share))) * _FIXED)
        return weights
    vectors, output = learned(texts, y, epochs, rate, seed)
    weights[:-1] = np.round((vectors @ (output[1] - output[0])).astype(np.float64) * _FIXED)
    return weights


def score(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of class 1 of each text."""
    n = len(offsets) - 1
    if weights[-1]:
        z = np.full(n, weights[-1] / _FIXED)
    else:
        values, bounds = features(data, offsets)
        z = (tx.segment_sums(weights[values], bounds) + weights[_END]) / (np.diff(bounds) + 1) / _FIXED
    return 1 / (1 + np.exp(-z))


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: Column | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, label) to learn from: at most ``max_rows`` doc_ids in hash order.

    The ids are chosen on the narrow label table; only their texts are read.
    """
    wanted = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
    )
    if learn is not None:
        wanted = wanted.where(learn)
    return texts_of(docs, wanted.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), ["doc_id"])


def texts_of(docs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` (a bounded number of rows) with one text for each: bounded in rows and in bytes, however often an id occurs."""
    own = docs.select(*[F.col(k).cast("long" if k == "doc_id" else "string").alias(k) for k in keys], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return bounded(own.where(F.octet_length("text") <= MAX_TEXT).join(F.broadcast(wanted), keys).groupBy(*wanted.columns).agg(F.min("text").alias("text")))


def fitted(sample: DataFrame, fit: Callable[[list[str], list[int]], Any]) -> Any:
    """What ``fit`` makes of the bounded sample's texts and labels, in order of doc_id.

    One task does the work, so the driver holds the model and never the texts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["text"] or "", r["label"]) for batch in batches for r in batch.to_pylist())
        made = pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])

    got = sample.select("doc_id", "text", "label").repartition(1).mapInArrow(run, "model binary").first()
    return fit([], []) if got is None else pickle.loads(bytes(got[0]))


def classifier(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    """Weights learned from the rows that are not held out, broadcast (1 MB)."""
    return docs.sparkSession.sparkContext.broadcast(fitted(labelled(docs, labels, "quality", ~held_out(), max_rows), train))


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    weights = classifier(docs, labels, max_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in tx.slices(tx.column(batch, "text")):
                got = score(weights.value, data, offsets)
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([tx.column(own, "doc_id"), tx.column(own, "held_out"), pa.array(got), pa.array((got >= CUTOFF).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, max_rows: int = MAX_ROWS, source: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose score is below ``cutoff``; all columns as they are.

    The labelled texts come from ``source``, or else from ``docs``.
    """
    weights = classifier(docs if source is None else source, labels, max_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in tx.slices(tx.column(batch, "text")):
                yield batch.slice(first, last - first).filter(pa.array(score(weights.value, data, offsets) >= cutoff))

    return bounded(docs).mapInArrow(run, docs.schema)
