"""Elias-Fano n-gram trie: levels in memory-mapped files, looked up batch-wise.

Level 1 holds the words, sorted by hash; a word's place is its id.  An item of
level k is a word after an item of level k - 1 (its context).  Items are sorted
by (context, word id), so a context's successors are one run of the level.  The
runs' borders never fall, and are kept as an Elias-Fano sequence; a lookup reads
two borders and searches the word id between them.  Probabilities and back-off
weights are fixed-point logarithms of 16 bits.

Every level is cut into shards of consecutive contexts.  Tasks write the shards
as NumPy files to the shared folder and others map them from there; where the
folder is not a mounted one, they are read into memory through Arrow's file
systems.
"""

from __future__ import annotations

import io
import os
import uuid
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np

# Steps of a logarithm to base 10: the largest is -16.
STEP = 4096

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
# place of the r-th one of a byte
_NTH = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    for _rank, _bit in enumerate([b for b in range(8) if _byte >> b & 1]):
        _NTH[_byte, _rank] = _bit


def coded(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs * STEP), 0, 65535).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / -STEP


def elias_fano(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a sequence that never falls."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
    values = values.astype(np.uint64)
    ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(ones[-1]) if n else 0) // 64 * 8 + 8, np.uint8)
    np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
    words = _POP[high.reshape(-1, 8)].sum(axis=1, dtype=np.int64)
    ranks = np.cumsum(words) - words
    low = np.zeros((n * low_bits + 63) // 64 + 1, np.uint64)
    if low_bits:
        at = np.arange(n) * low_bits
        part = values & np.uint64((1 << low_bits) - 1)
        shift = (at & 63).astype(np.uint64)
        np.bitwise_or.at(low, at >> 6, part << shift)
        over = np.flatnonzero((at & 63) + low_bits > 64)
        np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - shift[over]))
    return {"high": high, "ranks": ranks, "low": low, "size": np.array([n, low_bits])}


class EliasFano:
    """Random access to the values of ``elias_fano``."""

    def __init__(self, high, ranks, low, size):
        self.high, self.ranks, self.low = high, ranks, low
        self.n, self.low_bits = int(size[0]), int(size[1])

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ranks, places, side="right") - 1
        rest = places - self.ranks[word]
        rows = self.high.reshape(-1, 8)[word]
        sums = np.cumsum(_POP[rows], axis=1, dtype=np.int64)
        byte = (sums <= rest[:, None]).sum(axis=1)
        every = np.arange(len(places))
        rest = rest - np.where(byte > 0, sums[every, np.maximum(byte - 1, 0)], 0)
        one = word * 64 + byte * 8 + _NTH[rows[every, byte], rest]
        value = (one - places) << self.low_bits
        if self.low_bits:
            at = places * self.low_bits
            shift = (at & 63).astype(np.uint64)
            part = self.low[at >> 6] >> shift
            over = shift > 0
            part[over] |= self.low[(at[over] >> 6) + 1] << (np.uint64(64) - shift[over])
            value |= (part & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)
        return value


# ---- files


def _local(folder: str) -> str | None:
    parts = urlsplit(folder)
    return parts.path if parts.scheme in ("", "file") else None


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write a file whole or not at all; a repeated task writes the same bytes."""
    place = _local(folder)
    if place is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        data = io.BytesIO()
        np.save(data, array)
        with store.open_output_stream(f"{path}/{name}.npy") as out:
            out.write(data.getvalue())
        return
    os.makedirs(place, exist_ok=True)
    part = f"{place}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, f"{place}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    place = _local(folder)
    if place is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{path}/{name}.npy") as data:
            return np.load(io.BytesIO(data.read()))
    array = np.load(f"{place}/{name}.npy", mmap_mode="r" if os.path.getsize(f"{place}/{name}.npy") > 4096 else None)
    # a plain view of the mapping: indexing a memmap object costs more than the lookup
    return np.asarray(array).view(np.ndarray)


@dataclass
class Shape:
    """What the driver knows of a trie: a few numbers for each shard."""

    folder: str
    tokens: int  # of the training texts
    bits: int  # leading hash bits that name a shard of level 1
    sizes: list[list[int]]  # items of each shard, by level
    per: list[int]  # contexts of a shard of level k + 2

    @property
    def vocabulary(self) -> int:
        return sum(self.sizes[0])


class Trie:
    """Mapped levels of a trie."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.bases = [np.concatenate([[0], np.cumsum(s)]).astype(np.int64) for s in shape.sizes]
        self._files: dict[str, np.ndarray] = {}

    def file(self, name: str) -> np.ndarray:
        if name not in self._files:
            self._files[name] = load(self.shape.folder, name)
        return self._files[name]

    def borders(self, level: int, shard: int) -> EliasFano:
        name = f"borders{level}-{shard}"
        if name not in self._files:
            self._files[name] = EliasFano(*(load(self.shape.folder, f"{name}-{k}") for k in ("high", "ranks", "low", "size")))
        return self._files[name]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for shard, n in enumerate(self.shape.sizes[0]):
            step = 64 - self.shape.bits
            low, high = np.searchsorted(hashes, np.array([shard << step], np.uint64))[0], len(hashes)
            if shard + 1 < len(self.shape.sizes[0]):
                high = np.searchsorted(hashes, np.array([(shard + 1) << step], np.uint64))[0]
            if not n or low == high:
                continue
            keys = self.file(f"keys-{shard}")
            near = np.minimum(np.searchsorted(keys, hashes[low:high]), n - 1)
            known = keys[near] == hashes[low:high]
            ids[low:high] = np.where(known, self.bases[0][shard] + near, -1)
            counts[low:high] = np.where(known, self.file(f"count1-{shard}")[near], 0)
        return ids, counts

    def _each(self, base: np.ndarray, items: np.ndarray):
        """(shard, which, local places) of items of a level."""
        shard = np.searchsorted(base, items, side="right") - 1
        for s, which in _split(shard):
            yield s, which, items[which] - base[s]

    def column(self, name: str, level: int, items: np.ndarray) -> np.ndarray:
        """Values of items, from files that are sharded as their level."""
        out = np.zeros(len(items), np.int64)
        for shard, which, places in self._each(self.bases[level - 1], items):
            out[which] = self.file(f"{name}{level}-{shard}")[places]
        return out

    def backoff(self, level: int, contexts: np.ndarray) -> np.ndarray:
        """Codes of the weights that contexts of a level give to shorter ones."""
        out = np.zeros(len(contexts), np.int64)
        shard = contexts // self.shape.per[level - 2]
        for s, which in _split(shard):
            if self.shape.sizes[level - 1][s]:
                out[which] = self.file(f"weight{level}-{s}")[contexts[which] - s * self.shape.per[level - 2]]
        return out

    def find(self, level: int, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Items of a level, -1 where there is none: successor search inside each context's run.

        Contexts come sorted.
        """
        out = np.full(len(contexts), -1, np.int64)
        per = self.shape.per[level - 2]
        shard = contexts // per
        cuts = np.flatnonzero(np.diff(shard, prepend=-1)) if len(shard) else shard
        for s, low, high in zip(shard[cuts], cuts, np.append(cuts[1:], len(shard))):
            if not self.shape.sizes[level - 1][s]:
                continue
            which = slice(low, high)
            borders, ids = self.borders(level, s), self.file(f"word{level}-{s}")
            at = contexts[which] - s * per
            new = np.diff(at, prepend=-1) != 0
            several, each = at[new], np.cumsum(new) - 1
            start, end = borders[several][each], borders[several + 1][each]
            place = _search(ids, start, end, words[which])
            out[which] = np.where(place >= 0, self.bases[level - 1][s] + place, -1)
        return out


def _split(shard: np.ndarray):
    """(shard, places) of the shards that occur; one sort, however many there are."""
    if not len(shard):
        return
    if shard.min() == shard.max():
        yield int(shard[0]), slice(None)
        return
    # short keys are sorted by radix
    keys = shard.astype(np.uint16) if shard.max() < 1 << 16 else shard
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order].astype(np.int64), prepend=-1))
    for low, high in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist()):
        yield int(shard[order[low]]), order[low:high]


def _search(ids: np.ndarray, low: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    low, high = low.copy(), end.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) >> 1
        less = ids[mid] < wanted[live]
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]
        live = live[low[live] < high[live]]
    hit = np.flatnonzero(low < end)
    hit = hit[ids[low[hit]] == wanted[hit]]
    out = np.full(len(low), -1, np.int64)
    out[hit] = low[hit]
    return out


_open: dict[str, Trie] = {}


def opened(shape: Shape) -> Trie:
    """The worker's mapping of a trie."""
    key = f"{shape.folder}/{len(shape.sizes)}"
    if key not in _open:
        _open.clear()
        _open[key] = Trie(shape)
    return _open[key]
