"""Masked pseudo-likelihood of documents under a bidirectional window network.

Texts (A-Z lower-cased) become tokens: runs of letters and digits, each mark by
itself, and each character of scripts written without spaces by itself.  The
``WORDS`` commonest tokens that occur twice or more have numbers of their own.
A network with one hidden layer sees the three tokens on each side of a masked
one and predicts its number along the path in a Huffman tree, whose branches
start from the corpus' counts.  All other tokens, in whatever script, share the
number ``_RARE`` when they are predicted (beside others they are seen by one of
``BUCKETS`` hashed vectors) and are then spelled: their bytes two by two, each
with its share among all rare tokens of the corpus, so that different tokens
never become the same.  A document's score is the sum of the conditional
log-probabilities of all its tokens.

Everything is gathered from all documents.  Tokens are counted in one
pre-aggregated exchange.  Then each part of the table makes one pass of numpy
stochastic gradient descent (Adagrad) over all its windows, from shared
parameters, and hands on the rows of the parameters that it has touched; these
are averaged row by row, weighed by how often each part has met them, so what
only one part has seen isn't thinned by the others.  What is moved grows with
the input; the averaged network has a fixed size.

Cases: a null or empty text, or one of white space, has no tokens and log_prob
0 with a null mean.  Repeated rows count as often as they occur and get equal
scores.  With no token in the corpus there is nothing to train and every score
is 0.  Tokens of equal count are ordered by hash.  Long texts are worked in
pieces that see each other's edges.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import text as tx
from corvane.llm.runtime import bounded, cut

#: Tokens with numbers of their own, and how often one must occur.
WORDS, LEAST = 1 << 15, 2
#: Vectors by which rare tokens are seen.
BUCKETS = 1 << 14
#: Tokens on each side of the masked one, and units of the hidden layer.
SIDE, HIDDEN = 3, 20
#: Tokens of one step, rate of the steps, and tokens that one part should have.
STEP_TOKENS, RATE, PART_TOKENS = 20_000, 0.3, 3_000_000
#: Levels of the tree that learn by products of whole matrices: all tokens meet few nodes there.
DENSE = 5
#: From this mean length on, runs of equal nodes are summed by a product each.
LONG_RUNS = 32
#: Longest run of bytes in one token.
LONGEST = 64
#: Counts that a task holds before it sends them on, blocks of parameter rows, and messages that are merged at once.
HELD, BLOCKS, FAN_IN = 1_000_000, 16, 1_000

_U = np.uint64
_FIXED = 1 << 20
#: Narrow numbers are sorted by radix.
_SORTED = np.uint16 if _U(WORDS + BUCKETS + 2) < (1 << 16) else np.uint32
#: Token numbers: 0 lies outside a text, 1 is any rare token, then the words.
_RARE, _WORD = 1, 2
#: Symbols of spelling: byte pairs, then single last bytes, then the end of a token of even length.
_SINGLE, _END = 1 << 16, (1 << 16) + 256
_SYMBOLS = _END + 1
_PLACES = [o for o in range(-SIDE, SIDE + 1) if o]

#: Kinds of bytes: 0 separates, 1 runs on, 2 and 3 are a token each (3 leads further bytes), 4 goes on.
_KIND = np.full(256, 2, np.uint8)
_KIND[:0x21] = 0
_KIND[0x7F] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F]] = 1
_KIND[0x80:0xC0] = 4
_KIND[0xC0:0xE3] = 1
_KIND[0xE3:] = 3


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))


def _run_sums(rows: np.ndarray, weights: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The weighted sums of the rows of each run; ``edge``: where the runs begin."""
    if len(rows) < LONG_RUNS * len(edge):
        return np.add.reduceat(rows * weights[:, None], edge, axis=0)
    out = np.empty((len(edge), rows.shape[1]), rows.dtype)
    ends = [*edge[1:].tolist(), len(rows)]
    for i, (a, b) in enumerate(zip(edge.tolist(), ends, strict=True)):
        np.dot(weights[a:b], rows[a:b], out=out[i])
    return out


def tokens(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of lower-cased texts, and where each text's tokens begin (n+1)."""
    kind = _KIND[low]
    going = np.flatnonzero(kind == 4)
    if len(going):  # what goes on is of the kind of its lead
        at = np.arange(len(kind))
        at[going] = 0
        lead = kind[np.maximum.accumulate(at)]
        lead[lead == 4] = 1
    else:
        lead = kind
    before = np.zeros(len(low), np.uint8)
    before[1:] = lead[:-1]
    inner = offsets[:-1][offsets[:-1] < len(low)]
    before[inner] = 0
    first = ((kind == 2) | (kind == 3)) | ((lead == 1) & (before != 1))
    first[inner] |= lead[inner] != 0
    edges = np.flatnonzero(first | (lead == 0))
    at = np.flatnonzero(first[edges])
    starts, ends = edges[at], np.append(edges, len(low))[at + 1]  # a token ends where the next edge is
    pieces = -(-(ends - starts) // LONGEST)
    if len(pieces) and pieces.max() > 1:  # cut what runs too long
        whole = np.repeat(ends, pieces)
        starts = np.repeat(starts, pieces) + LONGEST * (np.arange(len(whole)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        ends = np.minimum(starts + LONGEST, whole)
    # a text's end ends its last token: the next text begins with an edge or a token
    return starts, ends, np.searchsorted(starts, offsets)


def _prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = tx.raw(texts)
    low = tx.LOWER[data]
    starts, ends, where = tokens(low, offsets)
    return low, starts, ends, where, tx.word_hashes(low, starts, ends)


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, n): how often the token of each hash occurs in the corpus."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate(hashes)
            order = np.argsort(every, kind="stable")
            edge = _runs(every[order])
            return every[order][edge], np.add.reduceat(np.concatenate(counts)[order], edge) if len(edge) else np.zeros(0, np.int64)

        for batch in batches:
            texts = tx.column(batch, "text")
            for first, last, _, _ in tx.slices(texts):
                h, n = np.unique(_prepared(texts.slice(first, last - first))[4], return_counts=True)
                hashes.append(h)
                counts.append(n)
            if sum(map(len, hashes)) > HELD:
                h, n = merged()
                hashes, counts = [h], [n]
                if len(h) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])
                    hashes, counts = [], []
        if hashes:
            h, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return bounded(docs).select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Numbered(NamedTuple):
    """Tokens of several texts: numbers as predicted and as seen, n+1 bounds of the texts, and the symbols that spell rare ones."""

    number: np.ndarray
    seen: np.ndarray
    bounds: np.ndarray
    owner: np.ndarray
    symbol: np.ndarray


class Codes:
    """Token numbers and their paths in the Huffman tree.

    ``paths[k]`` has, by token number, twice the node at depth k plus the branch
    taken; ``leaf`` orders tokens by depth and so that equal nodes are neighbours
    at every depth; ``lean`` is each node's log-odds of branch 0; the first
    ``above`` nodes are those of the first DENSE levels.
    """

    def __init__(self, words: list[tuple[int, int]], total: int) -> None:
        hashes = np.array([h for h, _ in words], np.int64).view(_U)
        order = np.argsort(hashes)
        # hashes are even: the first of each range of them is found by their upper bits, and few follow it
        self.hashes, self.numbers = hashes[order], (order + _WORD).astype(np.int32)
        self.first = np.searchsorted(self.hashes, np.arange(1 << 18, dtype=_U) << _U(46)).astype(np.int32)
        self.most = int(np.diff(np.append(self.first, len(self.hashes))).max())
        self.size = _WORD + len(words)
        weight = np.zeros(self.size)
        weight[_WORD:] = [n for _, n in words]
        weight[_RARE] = max(total - weight.sum(), 1.0)
        self._tree(weight)

    def _tree(self, weight: np.ndarray) -> None:
        """Canonical Huffman codes: short ones first, so that the leaves stand in order of their depth."""
        live = np.flatnonzero(weight > 0)
        live = live[np.lexsort((live, weight[live]))]
        m = len(live)
        value, up, i, j = [*weight[live].tolist(), *[0.0] * (m - 1)], [0] * (2 * m - 1), 0, m
        for k in range(m, 2 * m - 1):  # the two lightest of what is left become one, from two sorted queues
            for _ in range(2):
                if i < m and (j >= k or value[i] <= value[j]):
                    x, i = i, i + 1
                else:
                    x, j = j, j + 1
                up[x] = k
                value[k] += value[x]
        depth = [0] * (2 * m - 1)
        for x in range(2 * m - 3, -1, -1):
            depth[x] = depth[up[x]] + 1
        order = live[np.lexsort((live, depth[:m]))]
        self.length = np.zeros(self.size, np.int8)
        self.length[live] = depth[:m]
        self.leaf = np.zeros(self.size, _SORTED)
        self.leaf[order] = np.arange(m)
        length = self.length[order].astype(np.int64)
        codes, code = [], 0
        for k, n in enumerate(length.tolist()):
            code = (code + 1) << (n - int(length[k - 1])) if k else 0
            codes.append(code)
        codes, weights = np.array(codes, np.int64), weight[order]
        self.paths = np.zeros((int(length.max(initial=0)), self.size), np.int32)
        lean, self.nodes, self.above = [], 0, 0
        for k, row in enumerate(self.paths):
            first = int(np.searchsorted(length, k, "right"))
            prefix, bit = codes[first:] >> (length[first:] - k), codes[first:] >> (length[first:] - k - 1) & 1
            edge = _runs(prefix)
            node = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(prefix))))
            row[order[first:]] = 2 * (self.nodes + node) + bit
            side = [np.bincount(node, weights[first:] * (bit == b), len(edge)) for b in (0, 1)]
            lean.append(np.log(side[0] / side[1]))
            self.nodes += len(edge)
            self.above = self.nodes if k < DENSE else self.above
        self.lean = np.concatenate([*lean, np.zeros(0)]).astype(np.float32)

    def numbered(self, texts: pa.Array) -> Numbered:
        low, starts, ends, where, h = _prepared(texts)
        number = np.full(len(h), _RARE, np.int32)
        at = self.first[h >> _U(46)]
        for _ in range(self.most):
            np.minimum(at, len(self.hashes) - 1, out=at)
            known = np.flatnonzero(self.hashes[at] == h)
            number[known] = self.numbers[at[known]]
            at += 1
        rare = np.flatnonzero(number == _RARE)
        seen = number.copy()
        seen[rare] = self.size + (h[rare] % _U(BUCKETS)).astype(np.int32)
        symbols = (ends - starts)[rare] // 2 + 1
        owner = np.repeat(rare, symbols)
        source = starts[owner] + 2 * (np.arange(len(owner)) - np.repeat(np.cumsum(symbols) - symbols, symbols))
        left = ends[owner] - source
        one, two = (low[np.minimum(source + k, len(low) - 1)].astype(np.int32) for k in (0, 1)) if len(low) else (source, source)
        return Numbered(number, seen, where, owner, np.where(left > 1, one << 8 | two, np.where(left == 1, _SINGLE + one, _END)))


def parts(tokens: Numbered, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of at most ``size`` tokens: (first, last, their numbers, what is seen around and among them, their places in it)."""
    place = np.arange(len(tokens.number)) + np.repeat(np.arange(1, len(tokens.bounds)) * SIDE, np.diff(tokens.bounds))
    row = np.zeros(len(tokens.seen) + SIDE * len(tokens.bounds), np.int32)
    row[place] = tokens.seen
    for a in range(0, len(place), size):
        b = min(len(place), a + size)
        begin = place[a] - SIDE
        yield a, b, tokens.number[a:b], row[begin : place[b - 1] + SIDE + 1], place[a:b] - begin


class Network:
    """``inputs`` by token as seen, ``scales`` by side place, ``bias``; ``outputs`` and ``lean`` by node of the tree."""

    NAMES = ("inputs", "outputs", "lean", "scales", "bias")

    def __init__(self, codes: Codes) -> None:
        self.inputs = np.random.default_rng(3).normal(0, 0.1, (codes.size + BUCKETS, HIDDEN)).astype(np.float32)
        near = np.array([1 / abs(o) for o in _PLACES], np.float32)
        self.scales = np.repeat(near[:, None], HIDDEN, 1)
        self.bias = np.zeros((1, HIDDEN), np.float32)
        self.outputs = np.zeros((codes.nodes, HIDDEN), np.float32)
        self.lean = codes.lean[:, None].copy()

    def hidden(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = self.inputs.take(row, axis=0)  # of whole rows, take is twice as fast as an index
        out, part = np.empty_like(seen), np.empty_like(seen)
        out[:] = self.bias
        for scale, o in zip(self.scales, _PLACES, strict=True):
            np.multiply(seen, scale, out=part)
            if o < 0:
                out[-o:] += part[:o]
            else:
                out[:-o] += part[o:]
        return seen, np.tanh(out, out=out)

    def log_probabilities(self, codes: Codes, number: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each number at its place, given the tokens beside it."""
        order = np.argsort(codes.leaf[number], kind="stable")
        number, hidden = number[order], self.hidden(row)[1].take(place[order], axis=0)
        length = codes.length[number]
        inverse = np.ones(len(number))  # of the probability: one factor for each step of the path
        for k in range(int(length.max(initial=0))):
            first = int(np.searchsorted(length, k, "right"))  # leaves stand in order of their depth
            step = codes.paths[k][number[first:]]
            node = step >> 1
            z = np.einsum("nh,nh->n", self.outputs.take(node, axis=0), hidden[first:])
            z += self.lean.take(node)
            z *= (2 * (step & 1) - 1).astype(np.float32)
            inverse[first:] *= 1 + np.exp(np.clip(z, -20, 20)).astype(np.float64)
        out = np.empty(len(number))
        out[order] = -np.log(inverse)
        return out

    def slopes(self, codes: Codes, number: np.ndarray, row: np.ndarray, place: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By parameter: rows, the gradient of the summed loss there, and how many tokens met each row."""
        order = np.argsort(codes.leaf[number], kind="stable")  # equal nodes are neighbours at every depth
        number, at = number[order], place[order]
        seen, every = self.hidden(row)
        hidden, length = every.take(at, axis=0), codes.length[number]
        deep = int(length.max(initial=0))
        # the first levels at once: an error for each token and node, zero off the token's path
        weights = self.outputs[: codes.above]
        z = hidden @ weights.T
        z += self.lean[: codes.above, 0]
        errors, met = np.zeros_like(z), np.zeros(codes.above, np.int64)
        for k in range(min(DENSE, deep)):
            first = int(np.searchsorted(length, k, "right"))
            step = codes.paths[k][number[first:]]
            node, sign = step >> 1, (1 - 2 * (step & 1)).astype(np.float32)
            met += np.bincount(node, minlength=codes.above)
            cell = np.arange(first, len(number)) * codes.above + node
            errors.reshape(-1)[cell] = -sign / (1 + np.exp(np.clip(sign * z.reshape(-1)[cell], -20, 20)))
        back = errors @ weights
        node = np.flatnonzero(met)
        nodes, outputs, leans, times = [node], [(errors.T @ hidden)[node]], [errors.sum(0, dtype=np.float64)[node]], [met[node]]
        for k in range(DENSE, deep):
            first = int(np.searchsorted(length, k, "right"))
            step, mine = codes.paths[k][number[first:]], hidden[first:]
            node = step >> 1
            edge = _runs(node)
            weights = self.outputs.take(node, axis=0)
            sign = (1 - 2 * (step & 1)).astype(np.float32)
            z = np.einsum("nh,nh->n", weights, mine)
            z += self.lean.take(node)
            error = -sign / (1 + np.exp(np.clip(sign * z, -20, 20)))
            weights *= error[:, None]
            back[first:] += weights
            nodes.append(node[edge])
            outputs.append(_run_sums(mine, error, edge))
            leans.append(np.add.reduceat(error, edge))
            times.append(np.diff(np.append(edge, len(node))))
        inner = np.zeros_like(every)
        inner[at] = back * (1 - hidden * hidden)
        beside, scales = np.zeros_like(seen), np.empty_like(self.scales)
        for i, (scale, o) in enumerate(zip(self.scales, _PLACES, strict=True)):
            if o < 0:
                beside[:o] += scale * inner[-o:]
                scales[i] = np.einsum("nh,nh->h", seen[:o], inner[-o:])
            else:
                beside[o:] += scale * inner[:-o]
                scales[i] = np.einsum("nh,nh->h", seen[o:], inner[:-o])
        order = np.argsort(row.astype(_SORTED), kind="stable")
        edge = _runs(row[order])
        node, n = np.concatenate(nodes), np.concatenate(times)
        whole = np.full(len(_PLACES), len(place))
        return {
            "inputs": (row[order[edge]], np.add.reduceat(beside.take(order, axis=0), edge, axis=0), np.diff(np.append(edge, len(row)))),
            "outputs": (node, np.concatenate(outputs), n),
            "lean": (node, np.concatenate(leans)[:, None], n),
            "scales": (np.arange(len(_PLACES)), scales, whole),
            "bias": (np.zeros(1, int), inner.sum(0, keepdims=True), whole[:1]),
        }


class Learner:
    """A network that learns, how often each row of its parameters was met, and how rare tokens are spelled."""

    def __init__(self, codes: Codes) -> None:
        self.codes, self.network = codes, Network(codes)
        self.squares = {k: np.zeros_like(getattr(self.network, k)) for k in Network.NAMES}
        self.met = {k: np.zeros(len(v), np.int64) for k, v in self.squares.items()}
        self.spelled = np.zeros(_SYMBOLS, np.int64)

    def learn(self, texts: pa.Array) -> None:
        tokens = self.codes.numbered(texts)
        self.spelled += np.bincount(tokens.symbol, minlength=_SYMBOLS)
        for *_, number, row, place in parts(tokens, STEP_TOKENS):
            self.step(number, row, place)

    def step(self, number: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
        for name, (at, slope, n) in self.network.slopes(self.codes, number, row, place).items():
            square = self.squares[name].take(at, axis=0)
            square += slope * slope
            self.squares[name][at] = square
            np.sqrt(square, out=square)
            square += 1e-4
            np.divide(slope, square, out=square)
            square *= RATE
            getattr(self.network, name)[at] -= square
            self.met[name][at] += n


_MESSAGE = "name string, block int, part long, rows binary, met binary, sums binary"


def _message(name: str, block: int, part: int, rows: np.ndarray, met: np.ndarray, sums: np.ndarray) -> tuple:
    return name, block, part, rows.astype(np.int32).tobytes(), met.astype(np.int64).tobytes(), sums.astype(np.float32).tobytes()


def _batch(messages: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*messages, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _MESSAGE.split(", ")])


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of equal name, block and part as one; what is held is bounded by the network's size."""
    held: dict[tuple[str, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["name"], r["block"], r["part"])
            rows, met = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["met"], np.int64)
            own = (rows, met, np.frombuffer(r["sums"], np.float32).reshape(len(rows), -1).astype(np.float64))
            if key in held:
                rows, at = np.unique(np.concatenate([held[key][0], own[0]]), return_inverse=True)
                met, sums = np.zeros(len(rows), np.int64), np.zeros((len(rows), own[2].shape[1]))
                for part, m, s in ((at[: len(held[key][0])], *held[key][1:]), (at[len(held[key][0]) :], *own[1:])):
                    met[part] += m
                    sums[part] += s
                own = (rows, met, sums)
            held[key] = own
    for key in sorted(held):
        yield _batch([_message(*key, *held[key])])


def train(docs: DataFrame, codes, total: int) -> tuple[Network, np.ndarray]:
    """The average of what all parts of the table have learned (``codes`` is broadcast), and each symbol's log-probability."""
    network, spelled = Network(codes.value), np.zeros(_SYMBOLS)
    if not total:
        return network, spelled

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, learner = TaskContext.get().partitionId(), Learner(codes.value)
        for batch in batches:
            texts = tx.column(batch, "text")
            for first, last, _, _ in tx.slices(texts):
                learner.learn(texts.slice(first, last - first))
        for name, met in [*learner.met.items(), ("spelled", learner.spelled)]:
            touched = np.flatnonzero(met)
            for block in range(BLOCKS):
                at = touched[touched % BLOCKS == block]
                if len(at):
                    values = np.zeros((len(at), 1)) if name == "spelled" else getattr(learner.network, name)[at]
                    yield _batch([_message(name, block, part, at, met[at], values * met[at, None])])

    # parts of a like size whatever the files are like; coalesce never adds parts
    number = -(-total // PART_TOKENS)
    messages = bounded(docs).select("text").coalesce(number).mapInArrow(run, _MESSAGE)
    while True:
        groups = -(-number // FAN_IN)
        messages = messages.withColumn("part", F.pmod("part", F.lit(groups))).repartition(BLOCKS if groups == 1 else BLOCKS * groups, "name", "block", "part").mapInArrow(_added, _MESSAGE)
        if groups == 1:
            break
        number = groups
    for r in messages.toLocalIterator():  # as many rows as the network has
        rows, met = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["met"], np.int64)
        if r["name"] == "spelled":
            spelled[rows] = met
        else:  # rounding hides the order in which parts were added
            getattr(network, r["name"])[rows] = np.round(np.frombuffer(r["sums"], np.float32).reshape(len(rows), -1) / met[:, None], 5)
    return network, np.log((spelled + 1) / (spelled.sum() + _SYMBOLS))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob and mean_log_prob of every row."""
    sc = docs.sparkSession.sparkContext
    counts = cut(token_counts(docs))
    total = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    common = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "h").limit(WORDS).collect()
    codes = sc.broadcast(Codes([(r["h"], r["n"]) for r in common], total))
    shared = sc.broadcast(train(docs, codes, total))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, spelled = shared.value
        for batch in batches:
            ids, texts = tx.column(batch, "doc_id"), tx.column(batch, "text")
            for first, last, _, _ in tx.slices(texts):
                tokens = codes.value.numbered(texts.slice(first, last - first))
                own = np.bincount(tokens.owner, spelled[tokens.symbol], len(tokens.number)).astype(float)
                for a, b, number, row, place in parts(tokens, 2 * STEP_TOKENS):
                    own[a:b] += network.log_probabilities(codes.value, number, row, place)
                # fixed point: a sum can't depend on how rows are batched
                size, total = np.diff(tokens.bounds), tx.segment_sums(np.round(own * _FIXED).astype(np.int64), tokens.bounds) / _FIXED
                mean = pa.array(np.divide(total, size, out=np.zeros(len(size)), where=size > 0), mask=size == 0)
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(size), pa.array(total), mean], names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")
