"""SentencePiece (merge type) encoding by backtracking, and decoding.

A text is the encoding of its pieces exactly if each piece encodes to itself
and each two neighbours stay apart when their joined text is merged anew.  So
the longest piece is taken at each place (Aho-Corasick over reversed pieces
gives it for all places in one pass), its neighbour is checked by undoing the
merges of both (kept by pair), shorter pieces follow, and a place that leads
nowhere is marked in a bitfield and left for good.

Cases: a null text is an empty one, which has no ids and decodes to "".  Each
row stands alone, so repeated rows give equal results.  Long texts are cut only
where no piece of the vocabulary can cross, so results don't depend on it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import text as tx
from corvane.llm.runtime import bounded

#: The model file's name among the public tokenizers.
MODEL = "piece_bpe_32k.model"
#: Largest vocabulary that is broadcast.
MAX_VOCABULARY = 1_000_000
#: Segments and pairs that a worker remembers.  A full table of segments is set
#: aside, those that occur again move to the new one, and the rest are forgotten.
SEGMENTS, PAIRS = 250_000, 400_000
#: What stands for a space in pieces.
BLANK = "▁"

_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]*")
NORMAL, UNKNOWN, CONTROL, BYTE = "normal", "unknown", "control", "byte"
#: Stands for a control id: no text has this byte, and bytes before and after it make no character together.
ENDS = b"\xff"


#: A segment's ids, these joined by commas, and the bytes that they stand for.
Coded = tuple[tuple[int, ...], str, bytes]
_NOTHING = hashlib.sha256(b"").hexdigest()


class Pieces:
    """Vocabulary rows (piece, score, kind) with an encoder and a decoder."""

    def __init__(self, rows: list[tuple[str, float, str]]) -> None:
        self.rows = rows
        self._ready = False

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.vocab_size() > MAX_VOCABULARY:
            raise ValueError(f"{path}: more than {MAX_VOCABULARY} pieces")
        kind = lambda i: BYTE if model.is_byte(i) else CONTROL if model.is_control(i) else UNKNOWN if model.is_unknown(i) else NORMAL
        return cls([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.vocab_size())])

    def __getstate__(self) -> dict:
        return {"rows": self.rows, "_ready": False}

    def _prepare(self) -> None:
        self.ids = {p: i for i, (p, _, k) in enumerate(self.rows) if k == NORMAL}
        self.scores = {p: s for p, s, k in self.rows if k == NORMAL}
        self.bytes = [0] * 256
        self.output: list[bytes] = []
        for i, (p, _, k) in enumerate(self.rows):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
            self.output.append(bytes([int(p[3:5], 16)]) if k == BYTE else ENDS if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(BLANK, " ").encode())
        self.written = [str(i) for i in range(len(self.rows))]
        self._pairs: dict[tuple[str, str], bool] = {}
        self._segments: dict[str, Coded] = {}
        self._aside: dict[str, Coded] = {}
        #: A cut before a blank that follows another character is safe if no piece holds both.
        self._cuts = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        reached = {p for p in self.ids if self.merged(p) == [p]}
        self._reversed = ahocorasick.Automaton()
        for p in reached:
            self._reversed.add_word(p[::-1], p)
        self._reversed.make_automaton()
        self._shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in reached), None) for p in reached}
        self._reached = reached
        self._single = {p for p in reached if len(p) == 1}
        self._halves = {p: self._last(p) for p in reached if len(p) > 1}
        #: The merges of all other pieces come in the order of their scores (runs of blanks share one).
        self._unordered: set[str] = set()
        for p in sorted(self._halves, key=len):
            if any(half in self._unordered or len(half) > 1 and self.scores[p] >= self.scores[half] for half in self._halves[p]):
                self._unordered.add(p)
        self._ready = True

    def merged(self, text: str) -> list[str]:
        """The merges themselves: the best pair first, the leftmost of equal ones."""
        symbols = list(text)
        while len(symbols) > 1:
            best = max(((self.scores[m], -i) for i in range(len(symbols) - 1) if (m := symbols[i] + symbols[i + 1]) in self.scores), default=None)
            if best is None:
                break
            at = -best[1]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _last(self, piece: str) -> tuple[str, str]:
        """The two parts that the last merge of a piece joins."""
        symbols = list(piece)
        while len(symbols) > 2:
            at = -max((self.scores[m], -i) for i in range(len(symbols) - 1) if (m := symbols[i] + symbols[i + 1]) in self.scores)[1]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols[0], symbols[1]

    def _stay(self, left: str, right: str) -> bool:
        """Whether no merge joins a part of each: the merges of both are undone, the last one first."""
        scores, halves, never = self.scores, self._halves, float("inf")
        undone, equal = -never, False
        while True:
            across = scores.get(left + right)
            if across is not None and (across > undone or equal and across == undone):
                return False
            a, b = scores[left] if left in halves else never, scores[right] if right in halves else never
            if a == b == never:
                return True
            if a < b:
                undone, equal, left = a, False, halves[left][1]
            else:  # of equal ones the left one is made first, and what lies across before the right one
                undone, equal, right = b, True, halves[right][0]

    def _apart(self, left: str, right: str) -> bool:
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        odd = left in self._unordered or right in self._unordered
        good = self._pairs[left, right] = self.merged(left + right) == [left, right] if odd else self._stay(left, right)
        return good

    def _backtrack(self, text: str) -> list[str]:
        """The pieces of a text all of whose characters are pieces."""
        size = len(text)
        longest: list[str | None] = [None] * size
        last = size - 1
        for end, piece in self._reversed.iter(text[::-1]):
            if longest[last - end] is None:  # of the pieces at one place the longest comes first
                longest[last - end] = piece
        dead = 0
        out: list[str] = []
        kept, apart, shorter = self._pairs.get, self._apart, self._shorter
        at, piece, left = 0, longest[0], None
        while at < size:
            while piece is not None:
                if not (dead and dead >> (at + len(piece)) & 1):
                    if left is None:
                        break
                    good = kept((left, piece))
                    if good or good is None and apart(left, piece):
                        break
                piece = shorter[piece]
            if piece is None:
                dead |= 1 << at
                piece = out.pop()
                at -= len(piece)
                left = out[-1] if out else None
            else:
                out.append(piece)
                at += len(piece)
                left = piece
                piece = longest[at] if at < size else None
        return out

    def segment(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch of text in which blanks are already marked."""
        ids = self.ids
        if text in self._reached:
            return (ids[text],)
        if self._single.issuperset(text):
            return tuple([ids[p] for p in self._backtrack(text)]) if text else ()
        out: list[int] = []
        begin = 0
        for at in range(len(text) + 1):
            if at == len(text) or text[at] not in self._single:
                if at > begin:
                    out += [ids[p] for p in self._backtrack(text[begin:at])]
                if at < len(text):
                    out += [self.bytes[b] for b in text[at].encode()]
                begin = at + 1
        return tuple(out)

    def _coded(self, key: str) -> Coded:
        """A segment without its first blank; short ones are kept."""
        found = self._segments.get(key) or self._aside.get(key)
        if found is None:
            ids = self.segment(BLANK + key)
            found = ids, ",".join([self.written[i] for i in ids]), b"".join([self.output[i] for i in ids])
        if len(key) < 64:
            if len(self._segments) >= SEGMENTS:
                self._aside, self._segments = self._segments, {}
            self._segments[key] = found
        return found

    def coded(self, text: str) -> list[Coded]:
        """What each segment of a text becomes: its ids, these as text, and the bytes that they stand for."""
        if not self._ready:
            self._prepare()
        if not text:
            return []
        text = text.replace(BLANK, " ")
        if not self._cuts:
            keys = [text.replace(" ", BLANK)]
        elif text[0] == " " or "  " in text:
            keys = [part[1:] for part in _SEGMENT.findall(BLANK + text.replace(" ", BLANK)) if part]
        else:
            keys = text.split(" ")
        out = list(map(self._segments.get, keys))
        if None in out:
            coded = self._coded
            out = [coded(key) if found is None else found for key, found in zip(keys, out, strict=True)]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids, _, _ in self.coded(text) for i in ids]

    def digested(self, text: str) -> tuple[int, str, str]:
        """How many ids, their digest, and that of what they decode to."""
        parts = self.coded(text)
        if not parts:
            return 0, _NOTHING, _NOTHING
        ids, written, data = zip(*parts, strict=True)
        data = b"".join(data)
        if data[:1] == b" " and self.rows[ids[0][0]][2] == NORMAL:  # as in decode(): bytes of one character are never parted
            data = data[1:]
        sha = hashlib.sha256
        return sum(map(len, ids)), sha(",".join(written).encode()).hexdigest(), sha(data).hexdigest()

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text; each byte that belongs to no character becomes U+FFFD."""
        if not self._ready:
            self._prepare()
        data = b"".join(map(self.output.__getitem__, ids))
        try:
            data.decode()
        except UnicodeDecodeError:
            runs = groupby(ids, lambda i: self.rows[i][2] == CONTROL)
            data = b"".join(_replaced(b"".join(map(self.output.__getitem__, run))) for control, run in runs if not control)
        if data[:1] == b" ":
            first = next(i for i in ids if self.rows[i][2] != CONTROL)
            if self.rows[first][2] == NORMAL:
                data = data[1:]
        return data


def _replaced(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out).encode()


def vocabulary(spark: SparkSession, path: str | None = None):
    """The broadcast vocabulary of the model at ``path`` (read on the driver only)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return spark.sparkContext.broadcast(Pieces.load(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    pieces = vocabulary(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = tx.column(batch, "doc_id"), tx.column(batch, "text")
            for first, last, _, _ in tx.slices(texts):
                coded = [pieces.value.encode(t or "") for t in texts.slice(first, last - first).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(coded, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Count and digest of the ids of every whole text, and digest of what they decode to."""
    pieces = vocabulary(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, own = tx.column(batch, "doc_id"), tx.column(batch, "text"), pieces.value
            for first, last, _, _ in tx.slices(texts):
                n, coded, decoded = zip(*[own.digested(t or "") for t in texts.slice(first, last - first).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST)
