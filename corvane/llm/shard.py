"""Sharding by histogram sort, with near-equal bytes for each shard.

Rows are ordered by (hash of the text, doc_id).  Candidate boundaries (probes)
are laid over the key space; one pass over a narrow key table counts the exact
bytes and rows between neighbouring probes, and only intervals that hold a
splitter's target and are heavier than the tolerance are probed more finely.
A hash that alone is heavier (many equal texts) is refined by doc_id.  The same
counts cut the order into buckets that are small in rows and in bytes: whole
rows, with all their columns, are exchanged once by (shard, bucket) and ranked
within their bucket, and no task holds a shard.  A row's slot is its rank after
the counted rows of the shard's earlier buckets.

Rows with equal text and equal doc_id can't be told apart by the order.  Where
there are too many of them for a bucket, or for a splitter to miss its target
by, they are dealt over buckets of their own by a hash of their position in the
table, and these buckets may go to different shards.

``write`` writes a folder of files for each shard and reads the rows with shard
and slot, and ``assign`` derives its digest from them.

Law ``bytes``: a shard's bytes differ from the ideal by at most two tolerances
and one indivisible row.  Equal texts are neighbours in the order and share a
shard unless a splitter must cut their group.

Cases: a null text has size 1 and the checksum of an empty one; a null doc_id
sorts first.  Repeated rows each get a slot of their own (which of two equal
rows gets which is of no consequence).  An empty table gives no rows; columns
other than doc_id and text are carried along, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import text as tx
from corvane.llm.runtime import cut, packed, place

SHARDS = 16
#: Part of a shard's ideal bytes by which a splitter may miss.
TOLERANCE = 0.002
#: Rows and bytes that a bucket of the exchange should hold.
BUCKET_ROWS, BUCKET_BYTES = 200_000, 16 << 20
#: Buckets at least, so that small tables spread too, and about at most: their
#: bounds are broadcast, so beyond this the buckets grow instead.
LEAST_BUCKETS, MOST_BUCKETS = 512, 100_000
#: Probes laid into each interval that is refined.
PROBES = 64

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _size(text: Column) -> Column:
    return (F.octet_length(_text(text)) + F.lit(1)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, h): what the order and the counts need."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _size(F.col("text")).alias("size"), F.xxhash64(_text(F.col("text"))).alias("h"))


class Bounds:
    """Sorted boundaries (hash, doc_id); a row is in the interval of the last
    boundary not above it.  A boundary (h, None) is below all rows of h."""

    def __init__(self, keys: list[tuple[int, int | None]]) -> None:
        self.keys = sorted(set(keys), key=lambda k: (k[0], k[1] is not None, k[1] or 0))
        self.hashes = np.array([k[0] for k in self.keys], np.int64)
        self.inner: dict[int, tuple[int, np.ndarray]] = {}
        for i, (h, d) in enumerate(self.keys):
            if d is not None and h not in self.inner:
                same = [x[1] for x in self.keys[i : int(np.searchsorted(self.hashes, h, "right"))]]
                self.inner[h] = (i, np.array(same, np.int64))

    def place(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.hashes, h, "right") - 1
        for value, (first, ids) in self.inner.items():
            rows = np.flatnonzero(h == value)
            out[rows] = first - 1 + np.searchsorted(ids, d[rows], "right")
        return out


def _key_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tx.column(batch, "h").to_numpy(), tx.column(batch, "doc_id").fill_null(_LOW).to_numpy()


def _histogram(keys: DataFrame, bounds: Bounds) -> np.ndarray:
    """By interval: bytes, rows, least and greatest hash, least and greatest doc_id."""
    shared = keys.sparkSession.sparkContext.broadcast(bounds)  # as long as the probes
    names = ["at", "bytes", "rows", "h0", "h1", "d0", "d1"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, d = _key_arrays(batch)
            at = shared.value.place(h, d)
            order = np.argsort(at, kind="stable")
            sizes = tx.column(batch, "size").to_numpy()[order]
            found, first = np.unique(at[order], return_index=True)
            h, d = h[order], d[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (found, np.add.reduceat(sizes, first), np.diff(np.append(first, len(at))), np.minimum.reduceat(h, first), np.maximum.reduceat(h, first), np.minimum.reduceat(d, first), np.maximum.reduceat(d, first))],
                names=names,
            )

    counted = keys.mapInArrow(run, ", ".join(f"{n} long" for n in names)).groupBy("at").agg(F.sum("bytes"), F.sum("rows"), F.min("h0"), F.max("h1"), F.min("d0"), F.max("d1"))
    out = np.zeros((len(bounds.keys), 6), np.int64)
    for row in counted.collect():  # a row for each probe at most
        out[row[0]] = row[1:]
    return out


def _probes(low: tuple[int, int], high: tuple[int, int], n: int) -> list[tuple[int, int | None]]:
    """Boundaries that cut the rows from ``low`` to ``high`` (both occur) into about n ranges."""
    if low[0] != high[0]:
        step = max(1, (high[0] - low[0]) // n)
        return [(h, None) for h in range(low[0], high[0] + 1, step)][: n + 2] + [(high[0], None)]
    if low[1] != high[1]:
        step = max(1, (high[1] - low[1]) // n)
        return [(low[0], d) for d in range(low[1], high[1] + 1, step)][: n + 2] + [(low[0], high[1])]
    return []


class Plan(NamedTuple):
    """Intervals of the order; for each the first of its buckets and their number; for each bucket its shard."""

    bounds: Bounds
    first: np.ndarray
    parts: np.ndarray
    shard: np.ndarray

    def place(self, h: np.ndarray, d: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The bucket of each row; the salt deals rows that the order can't tell apart."""
        at = self.bounds.place(h, d)
        return self.first[at] + salt % self.parts[at]


def plan(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> Plan:
    total, count = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-count // BUCKET_ROWS), -(-total // BUCKET_BYTES)))
    most_rows, most_bytes = 8 * max(1, count // buckets), max(2 * BUCKET_BYTES, 2 * (total // buckets))
    step = (1 << 64) // buckets
    bounds = Bounds([(_LOW + i * step, None) for i in range(buckets)])
    ideal = total / shards
    targets = [ideal * k for k in range(1, shards)]
    while True:
        found = _histogram(keys, bounds)
        below = np.concatenate([[0], np.cumsum(found[:, 0])])
        parts = np.ones(len(found), np.int64)
        more: list[tuple[int, int | None]] = []
        for i in range(len(found)):
            size, n, h0, h1, d0, d1 = (int(x) for x in found[i])
            if n > 1:
                split = size > tolerance * ideal and any(below[i] < t < below[i + 1] for t in targets)
                if split or n > most_rows or size > most_bytes:
                    if (h0, d0) != (h1, d1):
                        more += _probes((h0, d0), (h1, d1), PROBES)
                    else:
                        parts[i] = min(n, max(-(-n // most_rows), -(-size // most_bytes), math.ceil(size / (tolerance * ideal)) if split else 1))
        grown = Bounds(bounds.keys + more)
        if len(grown.keys) == len(bounds.keys):
            break
        bounds = grown
    first = np.cumsum(parts) - parts
    # the bytes below each bucket: exact at intervals, in equal steps within one that is dealt out
    share = np.repeat(found[:, 0] / parts, parts)
    at = np.arange(parts.sum()) - np.repeat(first, parts)
    edges = np.append(np.repeat(below[:-1], parts) + share * at, total)
    shard = np.zeros(len(share), np.int64)
    for target in targets:
        shard[int(np.argmin(np.abs(edges - target))) :] += 1
    return Plan(bounds, first, parts, shard)


def rows(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """shard, bucket, rank in the bucket (from 1) and the whole row (a struct ``row`` with all columns of ``docs``), moved once."""
    shared = docs.sparkSession.sparkContext.broadcast(plan(cut(keyed(docs)), shards, tolerance))  # as long as the buckets

    @F.arrow_udf("bucket long, shard int")
    def placing(h: pa.Array, doc_id: pa.Array, salt: pa.Array) -> pa.Array:
        own = shared.value
        at = own.place(h.to_numpy(zero_copy_only=False), doc_id.fill_null(_LOW).to_numpy(zero_copy_only=False), salt.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(at), pa.array(own.shard[at].astype(np.int32))], names=["bucket", "shard"])

    whole = docs.select(F.struct("*").alias("row"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40)).alias("salt"))
    keyed_rows = whole.withColumns({"doc_id": F.col("row.doc_id").cast("long"), "h": F.xxhash64(_text(F.col("row.text")))})
    placed = keyed_rows.withColumn("place", placing("h", "doc_id", "salt")).select("row", "doc_id", "h", "place.*")
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "doc_id"))
    return placed.select("shard", "bucket", rank.cast("long").alias("rank"), "row")


def write(docs: DataFrame, folder: str, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """shard, slot and row of every row, written to ``folder`` with a subfolder for each shard and read again."""
    moved = rows(docs, shards, tolerance)
    moved.write.partitionBy("shard").parquet(folder)
    found = docs.sparkSession.read.schema(moved.schema).parquet(folder)
    counts = packed(found.groupBy("shard", "bucket").agg(F.max("rank").alias("n")))  # a row for each bucket
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return found.join(F.broadcast(begins), ["shard", "bucket"]).select("shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"), "row")


def assign(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, from the written shards."""
    text, found = F.col("row.text"), write(docs, place(docs.sparkSession, "shards"), shards, tolerance)
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        _size(text).alias("size"),
        F.crc32(_text(text).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
