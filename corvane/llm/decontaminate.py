"""Benchmark decontamination with a generalised suffix automaton.

The test items, normalised to words, are put into one suffix automaton (or
several, see ``MAX_BYTES``).  A document's words are streamed through it; at
each word the state gives the longest run of words ending there that is a run
of some item.  A run of ``window`` words or more, or a whole shorter item, is
an occurrence; the words it covers are hit, and the spans of hit words are what
``remove`` takes out.

Cases: a null or empty text has no words and nothing hit.  Null, empty or
word-less items match nothing.  Repeated items count once for each distinct
item_id, also where one id has several texts; items with equal texts all count.
Repeated document rows are each handled alone.  An empty benchmark hits
nothing, an empty table gives no rows.  Other columns are never read, whatever
their names.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import text as tx
from corvane.llm.runtime import bounded

#: Words in a window.
WINDOW = 10
#: Bytes of items that one automaton holds, about: bounds what is broadcast.  More
#: items go into further automata, each of which sees every document.
MAX_BYTES = 1 << 21
#: Hit words over all words from which ``remove`` drops a whole document.
MAX_COVERAGE = 0.5

#: Separators become a space, A-Z become a-z, digits and all non-ASCII bytes stay.
_NORMAL = bytes(
    c + 0x20 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words(data: bytes) -> list[bytes]:
    return data.translate(_NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences, with the windows they hold."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str] = []
        texts: list[list[int]] = []
        for name, data in items:
            if sequence := [self.ids.setdefault(w, len(self.ids)) for w in words(data)]:
                self.names.append(name)
                texts.append(sequence)
                self._insert(sequence)
        self.shortest = min((min(len(s), window) for s in texts), default=0)
        #: By state: items that hold its run of ``window`` words, and (length, item) of whole shorter items that end there.
        self.owners: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        self._ancestors()
        for item, sequence in enumerate(texts):
            self._own(item, sequence)
        self._chains()

    def _insert(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            known = self.next[last].get(word)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
                continue
            state = self._state(self.length[last] + 1, {}, 0)
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = state
                at = self.link[at]
            if at >= 0:
                known = self.next[at][word]
                self.link[state] = known if self.length[known] == self.length[at] + 1 else self._split(at, word, known)
            last = state

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, at: int, word: int, known: int) -> int:
        clone = self._state(self.length[at] + 1, dict(self.next[known]), self.link[known])
        self.link[known] = clone
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _by_length(self) -> list[int]:
        return sorted(range(1, len(self.length)), key=self.length.__getitem__)

    def _ancestors(self) -> None:
        """For each state of ``window`` words or more the suffix state that stands for the last ``window`` ones."""
        self.last_window = [-1] * len(self.length)
        for state in self._by_length():
            if self.length[state] >= self.window:
                up = self.link[state]
                self.last_window[state] = state if self.length[up] < self.window else self.last_window[up]

    def _own(self, item: int, sequence: list[int]) -> None:
        state = 0
        for n, word in enumerate(sequence, 1):
            state = self.next[state][word]
            if n >= self.window:
                self.owners.setdefault(self.last_window[state], set()).add(item)
        if len(sequence) < self.window:
            self.whole.setdefault(state, []).append((len(sequence), item))

    def _chains(self) -> None:
        """For each state the nearest suffix state, itself included, where whole items end (0: none): chains of less than ``window`` steps."""
        self.nearest = [0] * len(self.length)
        if self.whole:
            for state in self._by_length():
                self.nearest[state] = state if state in self.whole else self.nearest[self.link[state]]

    def match(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans [first, last) of hit words, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if not self.shortest or len(found) < self.shortest:
            return spans, items
        get, follow, link, length, window, whole, nearest = self.ids.get, self.next, self.link, self.length, self.window, self.whole, self.nearest
        known = [get(w, -1) for w in found]
        known.append(-1)
        seen: set[int] = set()
        begin = 0
        while begin < len(known):
            end = known.index(-1, begin)
            if end - begin >= self.shortest:
                state = depth = 0
                for at in range(begin, end):
                    word = known[at]
                    while state and word not in follow[state]:
                        state = link[state]
                        depth = length[state]
                    if word in follow[state]:
                        state = follow[state][word]
                        depth += 1
                    run = 0
                    if depth >= window:
                        run = window
                        if state not in seen:
                            seen.add(state)
                            items |= self.owners[self.last_window[state]]
                    if whole:
                        up = nearest[state]
                        while up:
                            for n, item in whole[up]:
                                if n <= depth:
                                    items.add(item)
                                    run = max(run, n)
                            up = nearest[link[up]]
                    if run:
                        first = at + 1 - run
                        while spans and spans[-1][1] >= first:
                            first = min(first, spans.pop()[0])
                        spans.append((first, at + 1))
            begin = end + 1
        return spans, items


def automata(benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES) -> list:
    """Broadcast automata over all items, dealt by hash of item_id so that each
    holds about ``max_bytes`` of text.  They are built in tasks; the driver only
    passes them on, one at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // max_bytes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[str, bytes]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["block"], []).append((r["item_id"], r["text"]))
        for block in sorted(held):
            # sorted, so that a task that runs again builds the same automaton
            made = pickle.dumps(Automaton(sorted(held.pop(block)), window), pickle.HIGHEST_PROTOCOL)
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.large_binary())], names=["automaton"])

    placed = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))).repartition(blocks, "block")
    made = placed.mapInArrow(run, "automaton binary")
    return [spark.sparkContext.broadcast(pickle.loads(bytes(r[0]))) for r in made.toLocalIterator()]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and out[-1][1] >= first:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _scan(texts: pa.Array, blocks: list) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """(words, hit spans, item names) of each text; with several automata one is held at a time."""
    out: list[tuple[int, list[tuple[int, int]], set[str]]] = [(0, [], set())] * len(texts)
    texts = texts.cast(pa.large_binary())
    runs = [(first, last) for first, last, _, _ in tx.slices(texts)]
    for number, block in enumerate(blocks):
        automaton = block.value
        for first, last in runs:  # word lists of few texts are held at once
            for k, t in enumerate(texts.slice(first, last - first).to_pylist(), first):
                found = words(t or b"")
                spans, items = automaton.match(found)
                if spans or not number:
                    out[k] = (len(found), _merged(out[k][1] + spans), out[k][2] | {automaton.names[i] for i in items})
        if len(blocks) > 1:
            block._value = None
            del block._value
    if not blocks:
        out = [(len(words(t or b"")), [], set()) for t in texts.to_pylist()]
    return out


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>"


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: word counts, hit words and the items found."""
    blocks = automata(benchmark, window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _scan(tx.column(batch, "text"), blocks)
            names = [sorted(x[2]) for x in rows]
            hit = [sum(b - a for a, b in x[1]) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    tx.column(batch, "doc_id"),
                    pa.array([x[0] for x in rows], pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                    pa.array([x > 0 for x in hit]),
                    pa.array(names, pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"],
            )

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, REPORT)


def cleaned(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``data`` without the bytes from each span's first word to its last."""
    where = [m.span() for m in _WORD.finditer(data.translate(_NORMAL))]
    out, at = [], 0
    for first, last in spans:
        out.append(data[at : where[first][0]])
        at = where[last - 1][1]
    return b"".join([*out, data[at:]])


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without the hit spans of their texts; documents of whose words
    more than ``max_coverage`` are cut go.  What a cut joins is looked at again,
    until nothing is hit.  Columns stay as they are; ``n_chars``, where there is
    one, follows a changed text."""
    blocks = automata(benchmark, window)
    fields = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = batch.column(place)
            rows = _scan(texts, blocks)
            changed = {k: x for k, x in enumerate(rows) if x[1]}
            if changed:
                new = texts.cast(pa.large_binary()).to_pylist()
                keep = np.ones(len(new), bool)
                size = {k: x[0] for k, x in changed.items()}
                while changed:
                    for k, x in changed.items():
                        new[k] = cleaned(new[k], x[1])
                    order = list(changed)
                    again = _scan(pa.array([new[k] for k in order], pa.large_binary()), blocks)
                    for k, x in zip(order, again, strict=True):
                        keep[k] = size[k] - x[0] <= max_coverage * size[k]
                    changed = {k: x for k, x in zip(order, again, strict=True) if x[1]}
                columns = list(batch.columns)
                columns[place] = pa.array([None if t is None else t.decode("utf-8", "replace") for t in new], texts.type)
                at = batch.schema.get_field_index("n_chars")
                if at >= 0:
                    columns[at] = pa.array([len(columns[place][k].as_py()) if k in size else n for k, n in enumerate(columns[at].to_pylist())], columns[at].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))
            yield batch

    return bounded(docs).mapInArrow(run, fields)
