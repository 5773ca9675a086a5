"""Hierarchical multi-length packing of tokenised documents into training sequences.

Each document becomes its token ids plus one end-of-document id. Whole windows of the longest context size leave a
document at once; what remains is routed to the smallest context-size tier that holds it. A tier packs its remainders
into windows of its own size, longest first, and fills the gap that is left in a window with pieces of shorter tiers:
whole ones where they fit, else one that is cut. Every window is thus exactly full and every window size is a power of
two. Only a task's last few hundred ids go to smaller powers of two. Finished windows are dealt to step groups so that
the groups of one round hold as many windows and nearly the same attention cost.

Everything happens inside the task that read the documents: no shuffle, and a bounded pool of pending pieces.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice
from operator import itemgetter
from string import punctuation

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import slices

TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: How byte-level models write the bytes that are no printable characters: those from U+0100 on, in order.
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_ENCODERS: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer's pre-tokenizer never joins characters across a space or a line feed, and its normaliser composes
    nothing with them, so a text's ids are those of its chunks between them, in order. It also ends a token between
    letters and the punctuation after them, and lower-cases. Special tokens hold no space. So a plain word, without case and final punctuation, goes
    to the tokenizer's model alone; other chunks to the whole tokenizer. All are kept until there are ``keep``; then
    the earlier half alone, which has the frequent ones.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep = keep
        self.known = _Known(self.chunk, [("", b"")])
        self.marks: dict[str, bytes] = {"": b""}

    @classmethod
    def at(cls, path: str) -> ChunkEncoder:
        """One encoder for each path in a Python worker."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _each(self, chunks: list[str]) -> Iterator[bytes]:
        for k in range(0, len(chunks), 10_000):
            for e in self.tokenizer.encode_batch_fast(chunks[k : k + 10_000], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Of lower-case letters below U+0100: the model reads UTF-8 bytes written as characters."""
        text = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that isn't known; it is from now on, unless it is long and no word."""
        stem = chunk.rstrip(punctuation)
        # below U+0100 a letter's lower case is one letter, and composing changes nothing
        if not (stem.isalpha() and (stem.isascii() or max(stem) < "\u0100")):
            ids = next(self._each([chunk]))
            if len(chunk) <= 64:
                self.known[chunk] = ids
            return ids
        word = stem.lower()
        ids = None if word == chunk else self.known.get(word)
        if ids is None:
            ids = self.known[word] = self._word(word)
        if chunk != word:
            mark = chunk[len(word) :]
            if mark not in self.marks:
                self.marks[mark] = next(self._each([mark]))
            ids = self.known[chunk] = ids + self.marks[mark]
        return ids

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        out = []
        for t in texts:
            chunks = _lowered(t or "").replace("\n", " ").split(" ")
            out.append(b"".join(itemgetter(*chunks)(self.known)) if len(chunks) > 1 else self.known[chunks[0]])
        if len(self.known) > self.keep:
            self.known = _Known(self.chunk, islice(self.known.items(), self.keep // 2))
            self.marks = {"": b""}
        return out


class _Known(dict):
    """Values by key; ``missing`` gives what isn't there, and keeps it or not."""

    def __init__(self, missing: Callable, items: Iterable):
        super().__init__(items)
        self.missing = missing

    def __missing__(self, key):
        return self.missing(key)


def _lowered(text: str) -> str:
    """``text``, in lower case if it has no character from U+0100 on: the tokenizer does no more to the case of such a text.

    Special tokens are looked for before the case changes, so a text that may hold one keeps its case.
    """
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class TierPacker:
    """Packs the documents of one task. ``add`` and ``finish`` yield rows of SCHEMA."""

    def __init__(self, base: int, tiers: Sequence[int] = TIERS, pool: int = 512, groups: int = 8, per_group: int = 8):
        if sorted(tiers) != list(tiers) or any(t & (t - 1) or t < 1 for t in tiers):
            raise ValueError("tiers must be ascending powers of two")
        self.base, self.tiers, self.pool, self.groups, self.per_group = base, tuple(tiers), pool, groups, per_group
        self.pending: dict[int, list[tuple]] = {t: [] for t in tiers}
        self.n_pending = self.ids_pending = self.n_added = self.n_windows = self.n_rounds = 0
        self.windows: list[tuple[int, int, list[tuple]]] = []

    def _route(self, doc_id, ids: bytes, start: int, end: int, total: int) -> None:
        """To the smallest tier that holds the piece."""
        n = end - start
        tier = next(t for t in self.tiers if t >= n)
        self.n_added += 1
        insort(self.pending[tier], (n, self.n_added, doc_id, ids, start, total))
        self.n_pending += 1
        self.ids_pending += n

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, top, start = len(ids) // 4, self.tiers[-1], 0
        while total - start >= top:
            self._close(top, [(doc_id, ids, start, start + top, total)])
            start += top
        if start < total:
            self._route(doc_id, ids, start, total, total)
        while self.n_pending > self.pool and self.ids_pending >= self.tiers[0]:
            most = max(self.tiers, key=lambda t: len(self.pending[t]))
            self._fill(max(t for t in self.tiers if t <= max(self.tiers[0], min(most, self.ids_pending))))
        if len(self.windows) >= self.groups * self.per_group:
            yield from self._deal()

    def finish(self) -> Iterator[tuple]:
        for tier in reversed(self.tiers):
            while self.ids_pending >= tier and (self.pending[tier] or tier == self.tiers[0]):
                self._fill(tier)
        while self.ids_pending:  # the last few ids, in the powers of two that make them up
            self._fill(min(self.tiers[-1], 1 << (self.ids_pending.bit_length() - 1)))
        yield from self._deal()

    def _take(self, tier: int, k: int) -> tuple:
        piece = self.pending[tier].pop(k)
        self.n_pending -= 1
        self.ids_pending -= piece[0]
        return piece

    def _fill(self, window: int) -> None:
        """One window of this size, from its own tier first, then from shorter ones, then from longer ones."""
        gap, pieces = window, []
        order = [t for t in reversed(self.tiers) if t <= window] + [t for t in self.tiers if t > window]
        while gap:
            for tier in order:
                if k := bisect_right(self.pending[tier], (gap, float("inf"))):
                    n, _, doc_id, ids, start, total = self._take(tier, k - 1)
                    pieces.append((doc_id, ids, start, start + n, total))
                    gap -= n
                    break
            else:  # none fits whole: cut the shortest there is
                tier = next((t for t in self.tiers if self.pending[t]), None)
                if tier is None:
                    break
                n, _, doc_id, ids, start, total = self._take(tier, 0)
                pieces.append((doc_id, ids, start, start + gap, total))
                self._route(doc_id, ids, start + gap, start + n, total)
                gap = 0
        self._close(window, pieces)

    def _close(self, window: int, pieces: list[tuple]) -> None:
        self.windows.append((sum((p[3] - p[2]) ** 2 for p in pieces) + 4096 * window, window, pieces))

    def _deal(self) -> Iterator[tuple]:
        """Costliest window first, each to the cheapest group that still has room."""
        room = -(-len(self.windows) // self.groups)
        load, held = [0] * self.groups, [0] * self.groups
        for cost, window, pieces in sorted(self.windows, key=lambda w: -w[0]):
            g = min((g for g in range(self.groups) if held[g] < room), key=lambda g: (load[g], g))
            load[g] += cost
            held[g] += 1
            offset = 0
            for doc_id, ids, start, end, total in pieces:
                yield doc_id, start, end - start, ids[4 * start : 4 * end], total, self.base + self.n_windows, offset, window, self.base + self.n_rounds * self.groups + g
                offset += end - start
            self.n_windows += 1
        self.windows = []
        self.n_rounds += 1


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", eod_id: int = 1, tiers: Sequence[int] = TIERS) -> DataFrame:
    """Pieces of the packed sequences of ``docs``, a row each, columns as in SCHEMA.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers. ``sequence_id`` is unique over the
    result; ``offset`` runs without gaps from 0 in each sequence; ``tier`` is the window's size.
    A null or empty text is the end-of-document id alone. Repeated rows are packed as often as they occur, a null id
    stays null, other columns are ignored, and an empty table gives an empty result. A text of any length is read whole.
    """
    tiers = tuple(tiers)
    eod = array("I", [eod_id]).tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.at(tokenizer_path)
        packer = TierPacker(TaskContext.get().partitionId() << 36, tiers)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            for part in slices(b, 1, 200):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    rows.extend(packer.add(doc_id, ids + eod))
                if rows:
                    yield batch(rows)
        if rows := list(packer.finish()):
            yield batch(rows)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pack, SCHEMA)
