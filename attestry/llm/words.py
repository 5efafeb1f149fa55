"""Words of whole texts as arrays: byte spans and 64-bit hashes, one pass per batch.

A batch of texts is one UTF-8 buffer.  Word separators are ASCII in every
operator here, so words are found on bytes, and a word's hash is a difference
of prefix sums of ``byte * R**position`` modulo 2**64, scaled back to position
zero and mixed.  Equal words have equal hashes in every task and session.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Texts are taken in runs of about so many bytes; one longer text is a run alone.
RUN_BYTES = 1_000_000

_R = 0x9E3779B97F4A7C15  # odd, so powers can be inverted modulo 2**64
_Q = 0xD6E8FEB86659FD93


def _table(pairs) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in pairs:
        out[low : high + 1] = True
    return out


SPACE = _table([(0x20, 0x20), (0x09, 0x0D)])
LETTERS = _table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class _Powers:
    """1, x, x**2, ... modulo 2**64, grown on demand."""

    def __init__(self, x: int):
        self.x, self.values = x, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            steps = np.full(max(n, RUN_BYTES + RUN_BYTES // 4), self.x, np.uint64)
            steps[0] = 1
            self.values = np.cumprod(steps, dtype=np.uint64)
        return self.values[:n]


_pow = {x: _Powers(x) for x in (_R, pow(_R, -1, 2**64), _Q, pow(_Q, -1, 2**64))}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(29))


def _sums(values: np.ndarray, x: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _pow[x].upto(n), dtype=np.uint64, out=out[1:])
    return out, _pow[pow(x, -1, 2**64)].upto(n + 1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span, for spans in order; sums are taken over RUN_BYTES at a time."""
    out = np.empty(len(start), np.uint64)
    low = 0
    while low < len(start):
        first = start[low]
        high = max(low + 1, int(np.searchsorted(end, first + RUN_BYTES, side="right")))
        sums, back = _sums(data[first : end[high - 1]].astype(np.uint64) + np.uint64(1), _R)
        s, e = start[low:high] - first, end[low:high] - first
        out[low:high] = (sums[e] - sums[s]) * back[s]
        low = high
    return mix(out)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values that start at each place; the last n - 1 places have none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    sums, back = _sums(hashes, _Q)
    return mix((sums[n:] - sums[:-n]) * back[: len(hashes) - n + 1])


@dataclass
class Words:
    """Words of a run of texts; ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of each text in data
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def strings(self, which) -> list[str]:
        raw = self.data.tobytes() if len(which) > 1000 else None
        if raw is None:
            return [self.data[s:e].tobytes().decode() for s, e in zip(self.start[which], self.end[which])]
        return [raw[s:e].decode() for s, e in zip(self.start[which].tolist(), self.end[which].tolist())]

    def inside(self, n: int) -> np.ndarray:
        """Whether n words that start here lie in one text (for the places of gram_hashes)."""
        places = max(0, len(self.start) - n + 1)
        last = np.repeat(self.first[1:], self.counts)[:places]
        return np.arange(places) + n <= last


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; nulls are empty texts."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4))
    offsets = offsets.astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def find(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    """Maximal runs of bytes of ``word_bytes``, cut at text borders."""
    on = word_bytes[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = on[1:] != on[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    if not len(cuts) or not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64))
    cuts = cuts if cuts[0] == 0 else np.concatenate([[0], cuts])
    keep = on[cuts[:-1]]
    start, end = cuts[:-1][keep], cuts[1:][keep]
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def runs(
    batch: pa.RecordBatch, column: str, size: int = RUN_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``size`` bytes of text each, with the texts' bytes and offsets."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    data, offsets = buffers(texts)
    low = 0
    while low < len(texts):
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(max(high, low + 1), len(texts))
        yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values of each text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def covered(starts: np.ndarray, lengths, total: int) -> np.ndarray:
    """Mask of places inside any of the spans."""
    steps = np.bincount(starts, minlength=total + 1) - np.bincount(starts + lengths, minlength=total + 1)
    return np.cumsum(steps[:total]) > 0


def joined(found: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts with one space between the words of each, and the words' places in it."""
    on = np.zeros(len(found.data) + 1, bool)
    on[:-1] = covered(found.start, found.end - found.start, len(found.data))
    keep = on[:-1].copy()
    gaps = found.end[found.end < len(found.data)]
    keep[gaps] = True
    place = np.zeros(len(found.data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    plain = np.where(on[:-1], found.data, 0x20)[keep].astype(np.uint8).tobytes()
    return plain, place[found.start], place[found.end]
