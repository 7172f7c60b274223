"""N-gram Jaccard join with token-combination prefixes.

A document is its set of distinct 4-word shingles; two documents link when
100 * intersection >= 85 * union.  Tokens (shingles) are ordered by how many
documents have them, rare ones first.  Of a set of n, a partner may lack at most
e = n - ceil(0.85 n) tokens.  Rare tokens are a class of their own, indexed
singly; frequent ones are dealt by hash into classes of which pairs are indexed
(k = 2).  A prefix is extended until its tokens, less k - 1 for each class in
it, exceed e: then two linked sets share a whole k-combination of some class,
for the set whose prefix ends first has all but e of its tokens in the other
set, and within the other's prefix.  The number of pair classes follows the
smaller set's size, so that few tokens of a prefix share a class and the
combinations grow with the prefix and not with its square.

0. ``_copies``: of rows with the same text (by SHA-256) all but the least doc_id
   are left out of what follows and get its results; a table of bits, whose size
   follows the rows, tells them, and those that it can't tell go along.
1. ``tokens``: texts become hashed shingles, packed into blobs by hash range.
2. An exchange by range counts each token's documents and sends back only the
   tokens that two documents share.  With more than ``ONE_LEVEL`` ranges it has
   two levels, there and back: as many wide ranges as the root of the number,
   in which the blobs of a group of chunks are merged, then the narrow ones, so
   that blobs stay long and their number follows the input and not its square.  The others can't link anything, yet they
   count in a prefix: a document with more than e of them is settled.
3. The rest, equal sets as one class, are indexed by their prefixes' singles
   and pairs; lists of one fall away.  A table of bits tells most equals before
   signatures are made, an anti-join the others.
4. Long lists are worked in blocks.  Every member has one home block, that of
   its longest list, in which all pairs are compared; then members outside a
   list's main component are compared with the home blocks of all its members.
   A block yields a spanning forest of its links, so what is written grows with
   members and blocks and not with pairs.
5. Members of short lists are verified against the list's pivots only, in
   rounds with more pivots each, and only where the two aren't connected yet.
   Every list is worked until its members are one component or all have been
   pivots, so no pair that could connect two components stays unseen.

Tokens are told apart by 63 bits of hash: two different shingles are taken for
equal once in 2**63 comparisons.

Cases: null and empty texts, and texts of white space, have no shingles and are
their own components.  Fewer than four words make one shingle.  Rows that share
a doc_id are one node: a link of any of them is a link of the id.  Rows with a
null doc_id get a null component and link nothing.  Long texts are handled
whole; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import text as tx
from corvane.llm.components import components
from corvane.llm.runtime import bounded, cut, packed, swept

WORDS = 4
#: Similarity in hundredths.
SIMILARITY = 85
#: Documents from which on a token counts as frequent, and up to which they are told apart.
FREQUENT, CAP = 32, 128
#: Tokens that one blob set holds before it is sent on, and that one range should hold.
CHUNK_TOKENS = 1_500_000
RANGE_TOKENS = 2_000_000
#: Ranges from which on the exchange has two levels.
ONE_LEVEL = 256
#: Members from which on a list is long, and members and tokens of a block.
LONG, BLOCK, BLOCK_TOKENS = 64, 1024, 4_000_000
#: Pairs that are few enough to be sent to every task instead of moving the sets (16 bytes each).
FEW_PAIRS = 15_000
#: Bits that tell most sets that have a standing equal, a fixed 1 MB, and those of a page.
STANDING, PAGE = 1 << 23, 1 << 13
#: Bits for each row that tell most copies of a text, and the most there are (8 MB).
COPY_BITS, MOST_BITS = 8, 1 << 26
#: Pivots of a list in the first round, and how many times as many in each next one.
PIVOTS, GROWTH = 2, 8

_U = np.uint64


def need(n: int) -> int:
    """Least intersection that a set of n must have with a linked one."""
    return -(-SIMILARITY * n // 100)


def spare(n: int) -> int:
    return n - need(n)


def classes(n: int) -> int:
    """Number of pair classes when the smaller set has n tokens: a power of 4 near a quarter of the prefix."""
    out = 1
    while out * 16 <= spare(n) + 1:
        out *= 4
    return out


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 63-bit shingle hashes of each text, and n+1 bounds."""
    starts, ends, where = tx.words(tx.LOWER[data], offsets)
    h = tx.word_hashes(tx.LOWER[data], starts, ends)
    rolled = np.zeros(len(h), _U)
    for k in range(min(WORDS, len(h))):  # a slice may hold fewer words than a shingle
        rolled[: len(h) - k] = rolled[: len(h) - k] * _U(0x9FB21C651E98DF25) + h[k:]
    rolled = tx.mix(rolled) >> _U(1)
    out, bounds = [], [0]
    for i in range(len(offsets) - 1):
        n = where[i + 1] - where[i]
        if n >= WORDS:
            own = np.unique(rolled[where[i] : where[i + 1] - WORDS + 1])
        elif n:
            value = _U(n)
            for x in h[where[i] : where[i + 1]]:
                value = _U((int(value) * 0x9FB21C651E98DF25 + int(x)) & 0xFFFFFFFFFFFFFFFF)
            own = tx.mix(np.array([value], _U)) >> _U(1)
        else:
            own = np.zeros(0, _U)
        out.append(own)
        bounds.append(bounds[-1] + len(own))
    return np.concatenate(out) if out else np.zeros(0, _U), np.array(bounds)


def _runs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values of a sorted array begins, and its length."""
    edge = np.flatnonzero(np.append(np.ones(min(1, len(row)), bool), row[1:] != row[:-1]))
    return edge, np.diff(np.append(edge, len(row)))


def _pack(row: np.ndarray) -> bytes:
    """A sorted array as its first value and six-byte gaps; as it is where a gap is too wide."""
    gaps = np.diff(row)
    if len(row) < 2 or gaps.max() >> _U(48):
        return b"\0" + row.tobytes()
    return b"\1" + row[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"\0":
        return np.frombuffer(data, _U, offset=1)
    gaps = np.zeros(((len(data) - 9) // 6 + 1, 8), np.uint8)
    gaps[0] = np.frombuffer(data, np.uint8, 8, 1)
    gaps[1:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    return np.cumsum(gaps.view(_U).ravel(), dtype=_U)


_BLOBS = "bucket long, chunk long, kind int, tokens binary, at binary"
#: Hashes of tokens are below this.
_HASHES = 1 << 63


def _home(number: int, buckets: int) -> int:
    """The range that carries a chunk's own rows: chunks are dealt over all ranges, whatever the number of ranges has as factors."""
    return ((number >> 32) + (number & 0xFFFFFFFF)) % buckets


def _limits(first: int, n: int, width: int) -> np.ndarray:
    return _U(first) + np.arange(n + 1, dtype=_U) * _U(width)


def tokens(docs: DataFrame, buckets: int, width: int | None = None, standing: np.ndarray | None = None) -> DataFrame:
    """Blobs of tokens by hash range, each with its document's place in the chunk.

    With ``standing`` only the rows whose ``bit`` is null or in it are taken.

    Kinds: 0 tokens to count; 1 a chunk's doc_ids and set sizes; 2 tokens that
    CAP documents of the chunk have, once each; 3 their occurrences, which need
    no counting any more and so don't meet in the range of a hot token.
    """
    limits = _limits(0, buckets, width or _HASHES // buckets + 1)
    known = None if standing is None else docs.sparkSession.sparkContext.broadcast(standing)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, ids, sizes, total, number = [], [], [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal held, ids, sizes, total, number
            n = np.concatenate(sizes)
            every = np.concatenate(held)
            at = np.repeat(np.arange(len(n), dtype=np.uint16), n)
            order = np.argsort(every, kind="stable")
            every, at = every[order], at[order]
            edge, times = _runs(every)
            hot = np.repeat(times >= CAP, times)
            rows = []
            for kind, values, places in ((0, every[~hot], at[~hot]), (2, every[edge[times >= CAP]], None)):
                which = np.searchsorted(values, limits)
                for b in np.flatnonzero(np.diff(which)):
                    rows.append((int(b), number, kind, _pack(values[which[b] : which[b + 1]]), b"" if places is None else places[which[b] : which[b + 1]].tobytes()))
            if hot.any():
                rows.append((_home(number, buckets), number, 3, _pack(every[hot]), at[hot].tobytes()))
            rows.append((_home(number, buckets), number, 1, np.concatenate(ids).tobytes(), n.astype(np.uint32).tobytes()))
            held, ids, sizes, total = [], [], [], 0
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "kind", "tokens", "at"])

        for batch in batches:
            if known is not None:
                batch = batch.filter(pa.array(_stands(known.value, tx.column(batch, "bit"))))
            own = tx.column(batch, "doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last, data, offsets in tx.slices(tx.column(batch, "text")):
                for a in range(first, last, 30_000):
                    b = min(last, a + 30_000)
                    lo, hi = offsets[a - first], offsets[b - first]
                    found, bounds = shingles(data[lo:hi], offsets[a - first : b - first + 1] - lo)
                    held.append(found)
                    ids.append(own[a:b])
                    sizes.append(np.diff(bounds))
                    total += len(found)
                    if total >= CHUNK_TOKENS or sum(map(len, ids)) > 30_000:
                        yield flush()
        if ids:
            yield flush()

    return bounded(docs).mapInArrow(run, _BLOBS)


#: Chunks of a group have 16 bits beside the 16 of a place.
_PLACE_BITS, _GROUPED = 16, np.uint32
_WIDE = _BLOBS + ", units binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _narrowed(fan: int, width: int):
    """Of one wide range and a group of chunks: the blobs merged and dealt over ``fan`` narrow ranges.

    ``units`` lists the group's chunks; a place has its chunk's number in it above the place in the chunk.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, group = (int(k.as_py()) for k in key)
        kinds, chunks, blobs, places = (table.column(n).to_pylist() for n in ("kind", "chunk", "tokens", "at"))
        rows = [(bucket * fan + _home(c, fan), c, k, t, a, b"") for c, k, t, a in zip(chunks, kinds, blobs, places, strict=True) if k in (1, 3)]
        limits = _limits(bucket * fan * width, fan, width)
        own = [i for i, k in enumerate(kinds) if k == 0]
        units = sorted({chunks[i] for i in own})
        number = {c: n for n, c in enumerate(units)}
        parts = [_unpack(blobs[i]) for i in own]
        every = np.concatenate([*parts, np.zeros(0, _U)])
        at = np.concatenate([*(np.frombuffer(places[i], np.uint16).astype(_GROUPED) | _GROUPED(number[chunks[i]] << _PLACE_BITS) for i in own), np.zeros(0, _GROUPED)])
        order = np.argsort(every, kind="stable")
        hot = np.unique(np.concatenate([*(_unpack(blobs[i]) for i, k in enumerate(kinds) if k == 2), np.zeros(0, _U)]))
        listed = np.array(units, np.int64).tobytes()
        for kind, values, origin in ((0, every[order], at[order]), (2, hot, None)):
            which = np.searchsorted(values, limits)
            for b in np.flatnonzero(np.diff(which)):
                mine = slice(which[b], which[b + 1])
                rows.append((bucket * fan + int(b), group, kind, _pack(values[mine]), b"" if origin is None else origin[mine].tobytes(), b"" if origin is None else listed))
        return _table(rows, _WIDE)

    return run


_SHARED = "chunk long, kind int, tokens binary, at binary, count binary"
_BACK = f"bucket long, {_SHARED}, units binary"


def _parted(key: tuple, table: pa.Table) -> pa.Table:
    """Of one wide range and a group: what came back from its narrow ranges, by chunk; what is a chunk's own already stays."""
    del key
    kinds, chunks, blobs, places, counts, units = (table.column(n).to_pylist() for n in ("kind", "chunk", "tokens", "at", "count", "units"))
    rows = [(c, 0 if k == 4 else k, t, a, n) for c, k, t, a, n in zip(chunks, kinds, blobs, places, counts, strict=True) if k]
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for i in sorted((i for i, k in enumerate(kinds) if not k), key=lambda i: table.column("bucket")[i].as_py()):
        own, at, n, listed = _unpack(blobs[i]), np.frombuffer(places[i], _GROUPED), np.frombuffer(counts[i], np.uint8), np.frombuffer(units[i], np.int64)
        of = at >> _GROUPED(_PLACE_BITS)
        order = np.argsort(of, kind="stable")
        edge, times = _runs(of[order])
        for a, b in zip(edge.tolist(), (edge + times).tolist(), strict=True):
            mine = order[a:b]
            held.setdefault(int(listed[of[mine[0]]]), []).append((own[mine], at[mine].astype(np.uint16), n[mine]))
    for chunk, found in held.items():
        own, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
        rows.append((chunk, 0, _pack(own), at.tobytes(), n.tobytes()))
    return _table(rows, _SHARED)


def _shared_wide(key: tuple, table: pa.Table) -> pa.Table:
    """``_shared`` of a narrow range, whose blobs are those of groups."""
    bucket, units = int(key[0].as_py()), dict(zip(zip(table.column("chunk").to_pylist(), table.column("kind").to_pylist(), strict=True), table.column("units").to_pylist(), strict=True))
    found = _counted(table, _GROUPED)
    return _table([(bucket, r["chunk"], r["kind"], r["tokens"], r["at"], r["count"], units.get((r["chunk"], 0), b"") if not r["kind"] else b"") for r in found.to_pylist()], _BACK)


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Of one hash range: the tokens that more than one document has, by chunk, with the (capped) number of documents."""
    del key
    return _counted(table, np.uint16)


def _counted(table: pa.Table, place: type) -> pa.Table:
    direct = 0 if place is np.uint16 else 4  # a chunk's own occurrences, among those of groups
    kinds, chunks, blobs, places = (table.column(n).to_pylist() for n in ("kind", "chunk", "tokens", "at"))
    rows = [(c, 1, t, a, b"") for c, k, t, a in zip(chunks, kinds, blobs, places, strict=True) if k == 1]
    rows += [(c, direct, t, a, bytes([CAP]) * (len(a) // 2)) for c, k, t, a in zip(chunks, kinds, blobs, places, strict=True) if k == 3]
    own = [i for i, k in enumerate(kinds) if k in (0, 2)]
    if own:
        parts = [_unpack(blobs[i]) for i in own]
        every = np.concatenate(parts)
        each = np.concatenate([np.full(len(x), CAP if kinds[i] else 1, np.int64) for i, x in zip(own, parts, strict=True)])
        order = np.argsort(every, kind="stable")
        edge, times = _runs(every[order])
        count = np.empty(len(every), np.uint8)
        count[order] = np.repeat(np.minimum(np.add.reduceat(each[order], edge), CAP), times)
        begin = 0
        for i, part in zip(own, parts, strict=True):
            n = count[begin : begin + len(part)]
            begin += len(part)
            more = n > 1
            if not kinds[i] and more.any():
                rows.append((chunks[i], 0, _pack(part[more]), np.frombuffer(places[i], place)[more].tobytes(), n[more].tobytes()))
    return _table(rows, _SHARED)


def exchanged(named: DataFrame, size: int, standing: np.ndarray | None = None) -> DataFrame:
    """What ``_SHARED`` says of all chunks of texts of so many bytes; of those that stand, if ``standing`` is given."""
    buckets = max(8, int(size / 4 // RANGE_TOKENS))
    if buckets <= ONE_LEVEL:
        return tokens(named, buckets, standing=standing).groupBy("bucket").applyInArrow(_shared, _SHARED)
    fan = math.isqrt(buckets - 1) + 1
    width = _HASHES // fan**2 + 1
    groups = max(1, int(size / 4 // CHUNK_TOKENS // fan))
    wide = tokens(named, fan, fan * width, standing).withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    narrow = wide.groupBy("bucket", "part").applyInArrow(_narrowed(fan, width), _WIDE)
    back = narrow.groupBy("bucket").applyInArrow(_shared_wide, _BACK)
    return back.withColumn("range", F.floor(F.col("bucket") / fan)).groupBy("chunk", "range").applyInArrow(_parted, _SHARED)


_SETS = "doc_id long, n long, alone long, mark string, tokens binary, counts binary"


def _sets(key: tuple, table: pa.Table) -> pa.Table:
    """Of one chunk: its documents, and of those that may link their shared tokens, rare ones first."""
    del key
    kinds = table.column("kind").to_pylist()
    blobs, places, counts = (table.column(n).to_pylist() for n in ("tokens", "at", "count"))
    head = kinds.index(1)
    ids, sizes = np.frombuffer(blobs[head], np.int64), np.frombuffer(places[head], np.uint32)
    own = [i for i, k in enumerate(kinds) if not k]
    every = np.concatenate([_unpack(blobs[i]) for i in own] or [np.zeros(0, _U)])
    at = np.concatenate([np.frombuffer(places[i], np.uint16) for i in own] or [np.zeros(0, np.uint16)])
    count = np.concatenate([np.frombuffer(counts[i], np.uint8) for i in own] or [np.zeros(0, np.uint8)])
    order = np.lexsort((every, count, at))
    every, at, count = every[order], at[order], count[order]
    bounds = np.searchsorted(at, np.arange(len(ids) + 1))
    out: list[tuple] = []
    seen: set[str] = set()
    for i in np.argsort(ids, kind="stable").tolist():
        doc, n, a, b = int(ids[i]), int(sizes[i]), int(bounds[i]), int(bounds[i + 1])
        alone = n - (b - a)
        if n and alone <= spare(n):
            mark = None
            if not alone:
                mark = hashlib.blake2b(every[a:b].tobytes(), digest_size=16).hexdigest()
                if mark in seen:  # a lesser doc_id of the chunk has the same set
                    out.append((doc, n, alone, mark, None, None))
                    continue
                seen.add(mark)
            out.append((doc, n, alone, mark, every[a:b].tobytes(), count[a:b].tobytes()))
        else:
            out.append((doc, n, alone, None, None, None))
    return _table(out, _SETS)


def signatures(n: int, alone: int, row: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """63-bit signatures of a set of n: single rare tokens and pairs of frequent ones of its prefix.

    ``row`` has the shared tokens, rare ones first; ``alone`` tokens of no other
    set precede them.  The set is indexed for the class number of every size
    that a partner not greater than it can have.
    """
    out: list[np.ndarray] = []
    for number in sorted({classes(need(n)), classes(n)}):
        left = spare(n) + 1 - alone
        rare = int(np.searchsorted(counts, FREQUENT))
        out.append(row[: min(rare, left)])
        left -= rare
        if left <= 0:
            continue
        frequent = row[rare:]
        kind = ((frequent * _U(0xC2B2AE3D27D4EB4F)) >> _U(40)).astype(np.int64) % number
        order = np.argsort(kind, kind="stable")
        again = np.zeros(len(frequent), bool)
        again[order[1:]] = kind[order[1:]] == kind[order[:-1]]
        end = int(np.searchsorted(np.cumsum(again), left)) + 1
        frequent, kind = frequent[:end], kind[:end]
        order = np.argsort(kind, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, np.diff(kind[order]) != 0)), len(order))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                own = np.sort(frequent[order[a:b]])
                i, j = np.triu_indices(b - a, 1)
                out.append(tx.mix(own[i] * _U(0x9FB21C651E98DF25) + own[j] + _U(number)) >> _U(1))
    return np.unique(np.concatenate(out))


def _standing(rows: DataFrame) -> np.ndarray:
    """STANDING bits, packed: those of the rows that stand for equal sets.  A set of a mark whose bit is 0 is surely another's equal."""
    return _bits(rows.where("same <> 0 and doc_id = class_id").select(_bit("doc_id").alias("bit")), STANDING)


def _bits(own: DataFrame, width: int) -> np.ndarray:
    """So many bits, packed: 1 for every ``bit`` of ``own``."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(PAGE, bool)
        bits[table.column("bit").to_numpy() % PAGE] = True
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["page", "bits"])

    out = np.zeros(width // 8, np.uint8)
    for page, bits in own.distinct().withColumn("page", F.floor(F.col("bit") / PAGE)).groupBy("page").applyInArrow(run, "page long, bits binary").collect():
        out[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _bit(doc: str) -> Column:
    return F.pmod(F.xxhash64(doc, "same"), F.lit(STANDING))


def _stands(bits: np.ndarray, bit: pa.Array) -> np.ndarray:
    at = bit.fill_null(0).to_numpy(zero_copy_only=False)
    return bit.is_null().to_numpy(zero_copy_only=False) | (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0)


#: What separates words; a text of nothing else links nothing and is no copy.
_BLANK = " \t\n\x0b\x0c\r"


def _digest() -> Column:
    return F.when(F.btrim("text", F.lit(_BLANK)) != "", F.unhex(F.sha2("text", 256)))


def _copies(named: DataFrame) -> tuple[int, DataFrame, np.ndarray | None, DataFrame | None]:
    """Bytes of the texts that stand, ``named`` with each row's bit, the bits that stand, and (doc_id, least) of the rows that don't.

    A row stands if it has the least doc_id of its text or shares its doc_id
    with other rows, and perhaps if not.  Without copies the last two are None.
    """
    texts = cut(named.select("doc_id", _digest().alias("digest"), F.octet_length("text").alias("size")))
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    again = packed(texts.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    texts = texts.where("digest is not null")
    own, shared = (texts, texts.limit(0)) if again.isEmpty() else (texts.join(again, "doc_id", how) for how in ("left_anti", "left_semi"))
    # cut, so that the join with it deals both sides anew and a hot text can be split
    first = cut(own.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("times"), F.min("size").alias("size")))
    several = first.where("times > 1")
    less = several.agg(F.sum((F.col("times") - 1) * F.col("size"))).first()[0]
    if less is None:
        return size, named, None, None
    width = min(MOST_BITS, max(PAGE, 1 << (COPY_BITS * n - 1).bit_length()))
    bit = lambda doc, digest: F.pmod(F.xxhash64(doc, digest), F.lit(width))
    bits = _bits(first.select(bit("least", "digest").alias("bit")).union(shared.select(bit("doc_id", "digest"))), width)
    known = named.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = ~_stands(known.value, tx.column(batch, "bit"))
            yield batch.filter(pa.array(gone)).select(["doc_id", "least"])

    lesser = own.join(several.select("digest", "least"), "digest").where("doc_id <> least")
    gone = cut(lesser.select("doc_id", "least", bit("doc_id", "digest").alias("bit")).mapInArrow(run, "doc_id long, least long"))
    digest = _digest()
    return size - less, named.withColumn("bit", F.when(digest.isNotNull(), bit("doc_id", digest))), bits, gone


def _index(sets: DataFrame, standing: np.ndarray) -> DataFrame:
    """(signature, doc, n, same): every signature of every set that may link; ``same`` tells equal sets' mark, else 0.

    Sets that surely have a standing equal are passed over; some others of them remain.
    """
    known = sets.sparkSession.sparkContext.broadcast(standing)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, bit = (tx.column(batch, c).to_numpy() for c in ("same", "bit"))
            stands = (same == 0) | (known.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1 > 0)
            batch = batch.filter(pa.array(stands))
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500).to_pylist()
                found = [signatures(r["n"], r["alone"], np.frombuffer(r["tokens"], _U), np.frombuffer(r["counts"], np.uint8)) for r in part]
                docs, n, same = (np.repeat(np.array([r[c] for r in part], np.int64), [len(x) for x in found]) for c in ("doc", "n", "same"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64)), pa.array(docs), pa.array(n), pa.array(same)], names=["signature", "doc", "n", "same"])

    marked = sets.select("doc", "n", "alone", "tokens", "counts", _same().alias("same"))
    return marked.withColumn("bit", _bit("doc")).mapInArrow(run, "signature long, doc long, n long, same long")


def _same() -> Column:
    """A number of the mark that equal sets share; 0 for sets with tokens of their own."""
    return F.when(F.col("mark").isNotNull(), F.xxhash64("mark")).otherwise(F.lit(0).cast("long"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (tx.column(batch, n).to_numpy() for n in ("a", "b", "n_a", "n_b"))
            x, y = tx.column(batch, "t_a"), tx.column(batch, "t_b")
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                both = len(np.intersect1d(np.frombuffer(x[i].as_buffer(), _U), np.frombuffer(y[i].as_buffer(), _U), assume_unique=True))
                good[i] = 100 * both >= SIMILARITY * (int(n_a[i]) + int(n_b[i]) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    if pairs.count() <= FEW_PAIRS:
        # the few sets that are needed come to the pairs: the others don't move
        ids = pairs.select("a").union(pairs.select("b")).distinct()
        own = cut(sets.join(F.broadcast(ids.toDF("doc")), "doc", "left_semi"))
        left = own.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
        right = own.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "t_a", "t_b").mapInArrow(run, "a long, b long")


_EDGES = "a long, b long"


def _links(rows: list[tuple[int, int, int, bytes]], others: list[tuple[int, int, int, bytes]]) -> pa.Table:
    """Links of (doc, root, n, tokens) in ``others`` with ``rows`` that join what isn't joined yet."""
    owner = np.repeat(np.arange(len(rows)), [len(r[3]) // 8 for r in rows])
    every = np.frombuffer(b"".join(r[3] for r in rows), _U)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    sizes = np.array([r[2] for r in rows], np.int64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    edges: list[tuple[int, int]] = []
    for doc, home, n, blob in others:
        tokens = np.frombuffer(blob, _U)
        low, high = np.searchsorted(every, tokens, "left"), np.searchsorted(every, tokens, "right")
        times = high - low
        at = np.arange(times.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) if len(times) else times
        both = np.bincount(owner[at], minlength=len(rows))
        for i in np.flatnonzero(100 * both >= SIMILARITY * (n + sizes - both)).tolist():
            x, y = root(home), root(rows[i][1])
            if x != y and doc != rows[i][0]:
                parent[max(x, y)] = min(x, y)
                edges.append((doc, rows[i][0]))
    return pa.table([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])


def _rows(table: pa.Table) -> list[tuple[int, int, int, bytes]]:
    return list(zip(*(table.column(c).to_pylist() for c in ("doc", "root", "n", "tokens")), strict=True))


def _within(key: tuple, table: pa.Table) -> pa.Table:
    """All pairs of one block."""
    del key
    rows = _rows(table)
    return _links(rows, rows)


def _between(key: tuple, table: pa.Table) -> pa.Table:
    """Strays against one block."""
    del key
    stray = table.column("stray").to_numpy(zero_copy_only=False).astype(bool)
    return _links(_rows(table.filter(pa.array(~stray))), _rows(table.filter(pa.array(stray))))


def _rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, rows["doc"] == found["node"], "left").withColumn("root", F.coalesce("least", "doc")).drop("node", "least")


def _long_lists(members: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the links among members of long lists."""
    if members.isEmpty():
        return found
    width = F.greatest(F.lit(16), F.least(F.lit(BLOCK), (F.lit(BLOCK_TOKENS) / F.col("most")).cast("long")))
    sized = members.withColumn("blocks", F.ceil(F.col("size") / width))
    longest = sized.groupBy("doc").agg(F.max(F.struct("size", "signature", "blocks")).alias("l"))
    home = packed(longest.select("doc", F.xxhash64("l.signature", F.pmod(F.xxhash64("doc"), F.col("l.blocks"))).alias("block")))
    full = home.join(sets.select("doc", "n", "tokens"), "doc")
    edges = _rooted(full, found).select("block", "doc", "root", "n", "tokens").groupBy("block").applyInArrow(_within, _EDGES)
    found = components(found.toDF("a", "b").unionByName(edges))
    # what is left: members outside their list's main component, against the home blocks of the list
    placed = packed(_rooted(members.select("signature", "doc"), found).select("signature", "doc", "root"))
    parts = placed.groupBy("signature", "root").agg(F.count("*").alias("of"))
    main = parts.groupBy("signature").agg(F.max(F.struct("of", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1").select("signature", F.col("m.root").alias("main"))
    strays = placed.join(main, "signature").where("root <> main").select("signature", "doc")
    blocks = placed.join(main.select("signature"), "signature", "left_semi").join(home, "doc").select("signature", "block").distinct()
    wanted = packed(strays.join(blocks, "signature").select("doc", "block").distinct())
    if wanted.isEmpty():
        return found
    shares = wanted.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    near = full.join(shares, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "doc", "n", "tokens", F.lit(False).alias("stray"))
    far = wanted.join(shares, "block").join(sets.select("doc", "n", "tokens"), "doc").select("block", F.pmod(F.xxhash64("doc"), F.col("parts")).alias("part"), "doc", "n", "tokens", F.lit(True).alias("stray"))
    both = _rooted(near.unionByName(far), found).select("block", "part", "doc", "root", "n", "tokens", "stray")
    edges = both.groupBy("block", "part").applyInArrow(_between, _EDGES)
    return components(found.toDF("a", "b").unionByName(edges))


def _linked(index: DataFrame, sets: DataFrame, ties: DataFrame) -> DataFrame:
    """(node, least) of the classes that links or ``ties`` connect."""
    # cut, so that the join deals both sides anew and a hot signature can be split
    counts = cut(index.groupBy("signature").agg(F.count("*").alias("size"), F.max("n").alias("most")).where("size > 1"))
    every = packed(index.join(counts, "signature"))
    sets = cut(sets.select("doc", "n", "tokens").join(every.select("doc").distinct(), "doc", "left_semi"))
    found = _long_lists(every.where(F.col("size") > LONG), sets, components(ties))
    members = every.where(F.col("size") <= LONG).select("signature", "doc", "n", F.struct(F.xxhash64("doc").alias("h"), "doc").alias("key"))
    pivots = PIVOTS
    while True:
        placed = _rooted(members, found)
        several = placed.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("signature")
        placed = packed(placed.join(several, "signature", "left_semi"))
        if placed.isEmpty():
            return found
        order = Window.partitionBy("signature").orderBy("key")
        first = packed(placed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= pivots))
        chosen = first.select("signature", F.col("doc").alias("pivot"), F.col("n").alias("m"), F.col("key").alias("from"), F.col("root").alias("base"))
        able = f"key > from and root <> base and 100 * least(n, m) >= {SIMILARITY} * greatest(n, m)"
        pairs = packed(placed.join(chosen, "signature").where(able).select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct())
        found = components(found.toDF("a", "b").unionByName(_verified(pairs, sets)))
        # a pivot has met all members: what is left are the members behind the last one
        last = first.groupBy("signature").agg(F.max("key").alias("to"))
        members = placed.join(last, "signature").where("key > to").select("signature", "doc", "n", "key")
        pivots *= GROWTH


def _counts(docs: DataFrame) -> DataFrame:
    """Rows without a doc_id: their set sizes alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tx.slices(tx.column(batch, "text")):
                n = np.diff(shingles(data, offsets)[1])
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(n), none, none], names=["doc_id", "n_shingles", "class_id", "component_id"])

    return bounded(docs).select("text").mapInArrow(run, "doc_id long, n_shingles long, class_id long, component_id long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (least doc_id with an equal set) and component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size, named, standing, gone_copies = _copies(docs.where("doc_id is not null"))
    every = cut(exchanged(named, size, standing).groupBy("chunk").applyInArrow(_sets, _SETS))
    swept(docs.sparkSession)  # the blobs of both exchanges, which are twice the sets
    equal, other = every.where("mark is not null"), every.where("mark is null")
    # cut, so that the join with it deals both sides anew and a hot group can be split
    marked = cut(equal.groupBy("mark", "n").agg(F.min("doc_id").alias("class_id")))
    rows = cut(
        equal.select("doc_id", "n", "mark").join(marked, ["mark", "n"]).select("doc_id", "n", "class_id", _same().alias("same")).unionByName(other.select("doc_id", "n", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("same")))
    )
    # one row stands for each class: its equals' signatures go, their sets never move
    sets = every.where("tokens is not null").withColumnRenamed("doc_id", "doc")
    gone = rows.where("doc_id <> class_id").select(F.col("doc_id").alias("doc"), "same").distinct()
    index = _index(sets, _standing(rows)).join(gone, ["doc", "same"], "left_anti").drop("same")
    twice = rows.groupBy("doc_id").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")).where("least <> most or least <> doc_id and most = doc_id")
    ties = rows.join(twice.select("doc_id", "least"), "doc_id").select("class_id", "least")
    found = _linked(index, sets, ties)
    out = rows.join(found, rows["class_id"] == found["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("least", "class_id").alias("component_id"))
    if gone_copies is not None:
        first = out.withColumnRenamed("doc_id", "least")
        out = out.unionByName(gone_copies.join(first, "least").select(*out.columns))
    return out.unionByName(_counts(docs.where("doc_id is null")))


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one with the least doc_id.

    Rows that share the kept doc_id are one document; the first of them in
    order of text stays.  Rows with a null doc_id stay.
    """
    joined = cut(join(docs).where("doc_id is not null").select("doc_id", "component_id"))
    gone = joined.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    again = joined.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    if again.isEmpty():
        return kept
    single = kept.join(again, kept["doc_id"].cast("long") == again["again"], "left_anti")
    several = kept.join(again, kept["doc_id"].cast("long") == again["again"], "left_semi")
    order = Window.partitionBy(F.col("doc_id").cast("long")).orderBy("text", F.xxhash64(*[c for c in docs.columns if c != "text"]))
    place = "_place"
    while place in docs.columns:
        place += "_"
    return single.unionByName(several.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place))
