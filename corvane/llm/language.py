"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit a binary logistic classifier over
byte n-grams (2 and 3, hashed, square roots of shares) predicts it.  Decoding
weights each bit's exponential loss by how well its classifier did on the
language's training rows and takes the codeword of least loss; a small gap to
the runner-up marks the text as ambiguous.

Cases: a null text, or one without a letter, is ``und`` with score 0.  Rows
with a null lang or doc_id are not learned from.  With no learnable row every
text is ``und``; with one language every text with a letter is that language.
Languages of equal loss go by name.  Of rows that share doc_id and lang the one
of least text is learned from, and none of more than ``quality.MAX_TEXT`` bytes.
Repeated rows get equal results; an empty table gives no rows; other columns
are never read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import text as tx
from corvane.llm.runtime import bounded
from corvane.llm.quality import fitted, held_out, texts_of

#: Documented bound of the training sample: rows, shared evenly by the languages.
#: A language needs a row, so as many languages at most (the commonest) are learned.
MAX_ROWS = 3_000
BUCKETS = 4096
ROUNDS = 120
FOLDS, HELD_OUT = 3, 1
#: Score gap to the second language below which a text is ambiguous.
GAP = 0.2
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: the exhaustive code for up to 5, else the best of
    seeded random codes by least distance between rows."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = 2 ** (n - 1) - 1
        return np.array([[1 if r == 0 else -1 if (b + 1) >> (r - 1) & 1 else 1 for b in range(bits)] for r in range(n)], float)
    rng, best, most = np.random.default_rng(11), None, -1.0
    bits = int(10 * np.ceil(np.log2(n)))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        near = (code @ code.T - 2 * bits * np.eye(n)).max()
        if best is None or -near > most:
            best, most = code, -near
    return best


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples, a row for each text."""
    n = len(data)
    low = tx.LOWER[data].astype(np.uint32)
    two, three = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    two[: max(0, n - 1)] = low[:-1] | low[1:] << np.uint32(8)
    three[: max(0, n - 2)] = two[: max(0, n - 2)] | low[2:] << np.uint32(16)
    shift = np.uint32(32 - 12)
    two = (two * np.uint32(0x9E3779B1)) >> shift
    three = ((three | np.uint32(1 << 24)) * np.uint32(0x85EBCA6B)) >> shift
    out = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
    for i in range(len(offsets) - 1):
        begin, end = offsets[i], offsets[i + 1]
        seen = np.bincount(np.concatenate([two[begin : max(begin, end - 1)], three[begin : max(begin, end - 2)]]), minlength=BUCKETS)
        if total := seen.sum():
            out[i] = np.sqrt(seen / total)
    return out


class Model:
    def __init__(self, texts: list[str], langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        self.code = codewords(len(self.langs))
        if len(self.langs) < 2:
            return
        blocks = [features(*tx.raw(pa.array(texts[i : i + 256], pa.large_string()))) for i in range(0, len(texts), 256)]
        x = np.concatenate(blocks)
        y = np.array([self.langs.index(v) for v in langs])
        bits = self.code[y].astype(np.float32)
        w, b = np.zeros((BUCKETS, bits.shape[1]), np.float32), np.zeros(bits.shape[1], np.float32)
        speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
        for _ in range(ROUNDS):  # gradient descent with momentum on the mean logistic loss
            slope = -bits / (1 + np.exp(bits * (x @ w + b))) / len(x)
            speed_w = 0.9 * speed_w - 4.0 * (x.T @ slope + 1e-4 * w)
            speed_b = 0.9 * speed_b - 4.0 * slope.sum(0)
            w, b = w + speed_w, b + speed_b
        right = (np.sign(x @ w + b) == bits).astype(float)
        trust = np.stack([right[y == k].mean(0) for k in range(len(self.langs))])
        self.trust = trust / np.maximum(trust.sum(1, keepdims=True), 1e-9)
        self.w, self.b = w, b

    @classmethod
    def of(cls, texts: list[str], langs: list[str]) -> Model:
        """The model of the texts that have a letter."""
        kept = [i for i, t in enumerate(texts) if has_letter(t)]
        return cls([texts[i] for i in kept], [langs[i] for i in kept])

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and gap of each text."""
        n = len(offsets) - 1
        if len(self.langs) < 2:
            return np.zeros(n, int), np.ones(n), np.ones(n)
        x = features(data, offsets)
        # one row at a time, so that a result can't depend on the rows beside it
        margin = np.stack([row @ self.w for row in x]).astype(float) + self.b
        loss = (self.trust[None] * np.exp(-self.code[None] * np.clip(margin, -30, 30)[:, None, :])).sum(2)
        p = np.exp(-np.log(loss) + np.log(loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        return p.argmax(1), order[:, -1], order[:, -1] - order[:, -2]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() or unicodedata.category(c)[0] == "L" for c in text)


def learn(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most ``max_rows`` rows, chosen by hash of doc_id evenly over
    the languages on the narrow columns; only those rows' texts are read, and a
    task fits the model."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null").where(~held_out(FOLDS, HELD_OUT))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()
    if not counts:
        return Model([], [])
    share = max(1, max_rows // len(counts))
    # a hash range of about twice the share first: a common language is never ordered as a whole
    part = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, 2 * share / n))])
    near = known.distinct().where(F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30)) < F.try_element_at(part, F.col("lang")) * (1 << 30))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    wanted = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= share).select("doc_id", "lang")
    return fitted(texts_of(docs, wanted, ["doc_id", "lang"]).withColumnRenamed("lang", "label"), Model.of)


def predict(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, max_rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for first, last, data, offsets in tx.slices(tx.column(batch, "text")):
                part = batch.slice(first, last - first)
                letters = [bool(own.langs) and has_letter(t) for t in tx.column(part, "text").to_pylist()]
                which, score, gap = own.predict(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        tx.column(part, "doc_id"),
                        tx.column(part, "held_out"),
                        pa.array([own.langs[k] if ok else UNKNOWN for k, ok in zip(which, letters, strict=True)]),
                        pa.array([float(s) if ok else 0.0 for s, ok in zip(score, letters, strict=True)]),
                        pa.array([not ok or bool(g < GAP) for g, ok in zip(gap, letters, strict=True)]),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(FOLDS, HELD_OUT).alias("held_out"), "text")
    return bounded(out).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
