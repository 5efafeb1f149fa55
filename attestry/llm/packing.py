"""Packing of token ids into fixed windows by the sum-of-squares rule.

Every task packs the documents it reads, one after another, with an array that
counts its open windows by fill level.  A document's remainder goes to the
level whose change makes the sum of squared counts smallest (Csirik et al.), so
no level piles up and remainders find partners that fill a window.  Full
windows are cut off long documents first.  At the end of a task its few open
windows are evened out by cutting the emptiest ones into the gaps of the
fullest, and the one that is left becomes windows of power-of-two lengths,
which need no padding.  Nothing is shuffled, and a task holds the ids of its
open windows only.

Null and empty texts are one end token.  Repeated rows are packed each.  Extra
columns are not carried; every piece names its document by ``doc_id``, which may
be null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from attestry.llm import frames, tokens, words

WINDOW = 4096
END = 2
VOCABULARY = "word_bpe_49k.json"
# Open windows of a task above which they are evened out at once.
OPEN = 4096

FIELDS = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, padding long"
)


class Piece:
    """Consecutive ids of one document."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, size: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc, self.start, self.ids[:size], self.total)
        return head, Piece(self.doc, self.start + size, self.ids[size:], self.total)


def fill(pieces: list[Piece]) -> int:
    return sum(len(p.ids) for p in pieces)


class Packer:
    """Open windows by fill level; ``counts[h]`` of them hold h ids."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.opened = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Windows that are full now."""
        piece = Piece(doc, 0, ids, len(ids))
        while len(piece.ids) >= self.window:
            full, piece = piece.cut(self.window)
            yield [full]
        size = len(piece.ids)
        if not size:
            return
        level = self._level(size)
        if level:
            content = self._take(level)
            content.append(piece)
        else:
            content = [piece]
        if level + size == self.window:
            yield content
        else:
            self._put(content, level + size)
        if self.opened > OPEN:
            yield from self.even_out()

    def _level(self, size: int) -> int:
        """Level whose window takes a piece of this size at the least sum of squares."""
        last = self.window - size
        from_, to = self.counts[: last + 1], self.counts[size:]
        # moving a window from level h to h + size adds 2 (N[h + size] - N[h]) + 2;
        # a new window starts at 0, a full one leaves
        change = np.where(from_ > 0, 2 * (to - from_) + 2, np.iinfo(np.int64).max)
        change[0] = 2 * to[0] + 1
        if from_[last] > 0:
            change[last] = 1 - 2 * from_[last]
        return last - int(np.argmin(change[::-1]))  # of equals the fullest

    def _take(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        self.opened -= 1
        return self.open[level].pop()

    def _put(self, content: list[Piece], level: int) -> None:
        self.counts[level] += 1
        self.opened += 1
        self.open.setdefault(level, []).append(content)

    def even_out(self) -> Iterator[list[Piece]]:
        """Fill the fullest windows from the emptiest; at most one stays open."""
        left = [c for level in sorted(self.open) for c in self.open[level]]
        self.open, self.opened = {}, 0
        self.counts[:] = 0
        spare: list[Piece] = []
        low = 0
        while len(left) > low:
            content = left.pop()
            room = self.window - fill(content)
            while room and (spare or len(left) > low):
                if not spare:
                    spare, low = left[low], low + 1
                piece = spare.pop()
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    spare.append(rest)
                content.append(piece)
                room -= len(piece.ids)
            if room:
                self._put(content, self.window - room)
            else:
                yield content
        if spare:
            level = fill(spare)
            if self.opened:
                raise AssertionError("two windows stay open")
            self._put(spare, level)

    def finish(self) -> Iterator[list[Piece]]:
        """All that is left, the last window in power-of-two lengths."""
        yield from self.even_out()
        for rest in [c for level in self.open.values() for c in level]:
            while rest:
                room = 1 << (fill(rest).bit_length() - 1)
                content = []
                while room:
                    piece = rest.pop(0)
                    if len(piece.ids) > room:
                        piece, after = piece.cut(room)
                        rest.insert(0, after)
                    content.append(piece)
                    room -= len(piece.ids)
                yield content


def _rows(sequence: int, content: list[Piece], window: int) -> Iterator[tuple]:
    offset, length = 0, fill(content)
    padding = 0 if length & (length - 1) == 0 else window - length
    for p in content:
        crc = zlib.crc32(np.ascontiguousarray(p.ids, "<u4"))
        yield p.doc, p.start, len(p.ids), crc, p.total, sequence, offset, length, padding
        offset += len(p.ids)


def pack(docs: DataFrame, text: str = "text", window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of every document in windows of at most ``window`` ids.

    ``sequence_id`` is the task's number in the upper and a running number in
    the lower 32 bits.
    """
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(FIELDS)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(window), tokens.vocabulary(vocabulary)
        sequence = TaskContext.get().partitionId() << 32
        kind = None

        def table(rows):
            columns = list(zip(*rows)) or [[]] * len(schema)
            kinds = [kind] + [pa.int64()] * (len(schema) - 1)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        for batch in batches:
            rows = []
            kind = batch.schema.field(0).type
            for part, data, offsets in words.runs(batch, text):
                found = tokens.units(data, offsets)
                coded = encode(found, found.hashes())
                flat = coded.flat()
                cuts = np.concatenate([[0], np.cumsum(coded.size)])[found.first].tolist()
                for doc, low, high in zip(part.column(0).to_pylist(), cuts, cuts[1:]):
                    ids = np.empty(high - low + 1, np.uint32)
                    ids[:-1], ids[-1] = flat[low:high], END
                    for content in packer.add(doc, ids):
                        rows += _rows(sequence, content, window)
                        sequence += 1
            yield table(rows)
        rows = []
        for content in packer.finish():
            rows += _rows(sequence, content, window)
            sequence += 1
        if rows:
            yield table(rows)

    return frames.map_texts(docs.select("doc_id", text), apply, schema, vocabularies=True)
