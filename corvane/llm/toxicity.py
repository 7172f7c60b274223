"""Toxicity by classifier chains.

Categories are predicted one after the other by linear (logistic) models over
the words, and beginnings of words, that a text has.  A later model also gets
the probabilities of the earlier categories; while learning, these come from
models that have not seen the row (out of fold), so a chain does not learn to
trust fitted values.  The last category is ``toxic`` as labelled.  The earlier
ones are kinds of toxic rows, learned from the rows themselves in whatever
language: the labelled toxic rows are split along their main direction in the
space of telling words, the larger part again, until there are CATEGORIES.

Cases: a null text, or one without words, has no features and gets the
intercepts' probabilities, which are below one half unless most labelled rows
are toxic.  Null or other labels and doc_ids with contrary labels are not
learned from; a category without both classes in the sample is its smoothed
share, and without any label nothing is rejected.  Words of equal strength are taken in byte order, kinds of equal size in
order of their first row.  Repeated rows get equal results; an empty table
gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import text as tx
from corvane.llm.runtime import bounded
from corvane.llm.quality import fitted, labelled

#: Documented bound of the training sample: rows, chosen by hash of doc_id.
MAX_ROWS = 8_000
#: Words and beginnings that a model may use (of the bounded sample), documents of the
#: sample that must have one, and standard errors by which its share must differ between the classes.
VOCABULARY, LEAST, STRENGTH = 4_000, 5, 4.0
#: Bytes of a word's beginning that count as a feature of their own.
BEGINNING = 5
#: Kinds of toxic rows that are told apart.
CATEGORIES = 3
FOLDS = 3
ROUNDS, RATE = 150, 0.2
#: Score from which on a text is rejected.
CUTOFF = 0.4
TARGET = "toxic"

#: Letters stay (A-Z lower-cased, all non-ASCII bytes as they are), the rest separates.
_NORMAL = bytes(c + 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(data: bytes | None) -> set[bytes]:
    """The words of a text and, after a mark, the beginnings of longer ones."""
    own = set((data or b"").translate(_NORMAL).split())
    return own | {b"^" + w[:BEGINNING] for w in own if len(w) > BEGINNING}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Linear:
    """Logistic regression on words that are there or not (``at`` lists them, row
    after row between ``bounds``) and a few dense columns."""

    def __init__(self, at: np.ndarray, bounds: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray, strength: float = 1e-6) -> None:
        n, times = len(y), np.diff(bounds)
        share = (y.sum() + 1) / (n + 2)
        self.w, self.b = np.zeros(width + dense.shape[1]), float(np.log(share / (1 - share)))
        if n == 0:
            self.b = -35.0  # nothing is known, nothing is rejected
            return
        if y.min() == y.max():
            return
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
        self.b = 0.0
        square_w, square_b = np.zeros_like(self.w), 0.0
        move_w, move_b = np.zeros_like(self.w), 0.0
        for k in range(1, ROUNDS + 1):
            run = np.concatenate([[0.0], np.cumsum(self.w[at])])
            z = run[bounds[1:]] - run[bounds[:-1]] + dense @ self.w[width:] + self.b
            slope = weight * (_sigmoid(z) - y)
            dw = np.concatenate([np.bincount(at, np.repeat(slope, times), minlength=width), dense.T @ slope]) + strength * self.w
            db = float(slope.sum())
            move_w, move_b = 0.9 * move_w + 0.1 * dw, 0.9 * move_b + 0.1 * db
            square_w, square_b = 0.99 * square_w + 0.01 * dw**2, 0.99 * square_b + 0.01 * db**2
            up, down = 1 - 0.9**k, 1 - 0.99**k
            self.w -= RATE * move_w / up / (np.sqrt(square_w / down) + 1e-8)
            self.b -= float(RATE * move_b / up / (np.sqrt(square_b / down) + 1e-8))

    def __call__(self, at: np.ndarray, dense: list[float]) -> float:
        width = len(self.w) - len(dense)
        z = float(self.w[at].sum()) + sum(p * w for p, w in zip(dense, self.w[width:], strict=True)) + self.b
        return float(_sigmoid(np.float64(z)))


def _main_direction(x: np.ndarray) -> np.ndarray:
    """Each row's place on the first principal axis (power iteration from the widest row)."""
    x = x - x.mean(0)
    axis = x[np.argmax((x * x).sum(1))].copy()
    for _ in range(60):
        axis = x.T @ (x @ axis)
        axis /= max(float(np.linalg.norm(axis)), 1e-12)
    return x @ axis


def kinds(rows: list[np.ndarray], width: int) -> np.ndarray:
    """For each row (of feature numbers) its kind, from 0 to CATEGORIES - 1, larger kinds first."""
    x = np.zeros((len(rows), width), np.float32)
    for own, at in zip(x, rows, strict=True):
        own[at] = 1 / max(1, len(at)) ** 0.5
    parts = [np.arange(len(rows))]
    while len(parts) < CATEGORIES:
        parts.sort(key=lambda p: (-len(p), *p[:1]))
        whole = parts[0]
        if len(whole) < 2 * LEAST:
            break
        side = _main_direction(x[whole]) > 0
        if side.all() or not side.any():
            break
        parts[:1] = [whole[~side], whole[side]]
    out = np.zeros(len(rows), int)
    for k, part in enumerate(sorted(parts, key=lambda p: (-len(p), *p[:1]))):
        out[part] = k
    return out


class Chain:
    """Linear models of CATEGORIES kinds and of toxic, in this order, over presence of chosen words."""

    def __init__(self, texts: list[str], toxic: list[int]) -> None:
        last = np.array(toxic, float)
        # word sets are made twice and never held together: they would be many times the texts
        self.ids = {w: i for i, w in enumerate(self._chosen((words(t.encode()) for t in texts), last))}
        rows = [np.array(sorted(i for w in words(t.encode()) if (i := self.ids.get(w)) is not None), np.int64) for t in texts]
        bad = np.flatnonzero(last)
        kind = np.full(len(rows), -1)
        kind[bad] = kinds([rows[i] for i in bad], len(self.ids))
        fold = np.arange(len(rows)) % FOLDS
        earlier = np.zeros((len(rows), 0))
        self.models: list[Linear] = []
        for k in range(CATEGORIES + 1):
            y = (kind == k).astype(float) if k < CATEGORIES else last
            self.models.append(self._fit(rows, earlier, y, np.arange(len(rows))))
            if k < CATEGORIES:
                earlier = np.concatenate([earlier, self._unseen(rows, earlier, y, fold)[:, None]], 1)

    def _unseen(self, rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Each row's probability from a model of the other folds."""
        out = np.zeros(len(rows))
        for f in range(FOLDS):
            own = self._fit(rows, earlier, y, np.flatnonzero(fold != f))
            for i in np.flatnonzero(fold == f):
                out[i] = own(rows[i], earlier[i].tolist())
        return out

    def _fit(self, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, which: np.ndarray) -> Linear:
        own = [rows[i] for i in which]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in own])]).astype(np.int64)
        at = np.concatenate(own) if own else np.zeros(0, np.int64)
        return Linear(at, bounds, len(self.ids), dense[which], y[which])

    @staticmethod
    def _chosen(sets: Iterable[set[bytes]], y: np.ndarray) -> list[bytes]:
        """The words whose shares differ most between the classes, by their standard error."""
        ones = max(1.0, y.sum())
        zeros = max(1.0, len(y) - y.sum())
        inside: Counter[bytes] = Counter()
        every: Counter[bytes] = Counter()
        for own, label in zip(sets, y, strict=True):
            every.update(own)
            if label:
                inside.update(own)

        def strength(w: bytes) -> float:
            a, b = inside[w] / ones, (every[w] - inside[w]) / zeros
            p = every[w] / max(1, len(y))
            return abs(a - b) / (p * (1 - p) * (1 / ones + 1 / zeros) + 1e-12) ** 0.5

        kept = [w for w, n in every.items() if n >= LEAST and strength(w) >= STRENGTH]
        return sorted(kept, key=lambda w: (-strength(w), w))[:VOCABULARY]

    def __call__(self, found: set[bytes]) -> list[float]:
        """The probability of each category for a text with these words."""
        at = np.array(sorted(i for w in found if (i := self.ids.get(w)) is not None), np.int64)
        out: list[float] = []
        for model in self.models:
            out.append(model(at, out))
        return out


def learn(texts: list[str], toxic: list[int]) -> Chain:
    return Chain(texts, toxic)


def chain(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    """The chain learned from the labelled sample, broadcast (a vocabulary of bounded size)."""
    return docs.sparkSession.sparkContext.broadcast(fitted(labelled(docs, labels, TARGET, None, max_rows), learn))


def _probabilities(own: Chain, texts: pa.Array) -> list[list[float]]:
    return [own(words(t)) for first, last, _, _ in tx.slices(texts) for t in texts.slice(first, last - first).cast(pa.binary()).to_pylist()]


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, the kinds' probabilities, score (of ``toxic``), predicted and toxic: whether it is rejected."""
    model = chain(docs, labels, max_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array(_probabilities(model.value, tx.column(batch, "text"))).reshape(-1, CATEGORIES + 1)
            bad = got[:, -1] >= CUTOFF
            yield pa.RecordBatch.from_arrays([tx.column(batch, "doc_id"), *map(pa.array, got.T), pa.array(bad.astype(np.int32)), pa.array(bad)], names=names)

    names = ["doc_id", *[f"p_kind_{k + 1}" for k in range(CATEGORIES)], "score", "predicted", "toxic"]
    schema = ", ".join(["doc_id long", *[f"{n} double" for n in names[1:-2]], "predicted int", "toxic boolean"])
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, max_rows: int = MAX_ROWS, source: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows that are rejected; all columns as they are.

    The labelled texts come from ``source``, or else from ``docs``.
    """
    model = chain(docs if source is None else source, labels, max_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([p[-1] < cutoff for p in _probabilities(model.value, tx.column(batch, "text"))], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)
