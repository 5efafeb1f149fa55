"""Benchmark decontamination as a prefix-filtered containment join.

Every item is cut into windows of ``WINDOW`` words; a shorter item is one
window.  A document contains a window only if it contains all its shingles (word
pairs), so the rarest one is a necessary prefix: shingles are ordered by the
number of documents that hold them, counted over the whole corpus, and windows
are indexed under their first shingle in that order.  A document's shingles are
looked up in the index; the shingle's place inside the window gives where the
window must start, the text's borders bound that place, a digest of the words
there filters, and the words themselves are compared last.

The index covers at most ``BLOCK_WORDS`` words of items, which bounds its
broadcast and what the driver reads.  Items are cut into chunks that overlap by
all but one word of a window, equal chunks of one item are one, and chunks are
numbered by running word totals; blocks are stretches of these totals.  So a long
item, or one id that many rows share, spreads over blocks.  Each block adds its
hits to the documents.  Documents are never shuffled, so a passage that a third
of them share is no hot key.

Null and empty texts have no words; items without words have no windows; an item
without id counts under the empty name; repeated items are one item, repeated
documents are judged each.  Extra columns pass through, clashing ones are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm import frames, words
from attestry.session import stored

WINDOW = 10
SHINGLE = 2
# Words of the items in one broadcast index.
BLOCK_WORDS = 1_000_000
# Words of a chunk of an item, and cells in which running totals of chunks are formed.
CHUNK = 4096
CELLS = 4096

_SCREEN = 1 << 22


def _find(data: np.ndarray, offsets: np.ndarray) -> words.Words:
    return words.find(words.LOWER[data], offsets, words.LETTERS)


@dataclass
class Windows:
    """Distinct windows of a block of items."""

    texts: list[list[str]]  # words of each window
    items: list[np.ndarray]  # of each window, places in names
    names: list[str]
    hashes: list[np.ndarray]  # of each window's words


def _windows(rows: list, window: int) -> Windows:
    """Windows of (id, text) rows."""
    names: dict[str, int] = {}
    owners: dict[tuple, set[int]] = {}
    for item, text in rows:
        name = names.setdefault("" if item is None else str(item), len(names))
        raw = (text or "").encode()
        data = np.frombuffer(raw, np.uint8)
        found = _find(data, np.array([0, len(data)]))
        spelled = found.strings(np.arange(len(found.start)))
        size = min(window, len(spelled))
        for at in range(len(spelled) - size + 1 if size else 0):
            owners.setdefault(tuple(spelled[at : at + size]), set()).add(name)
    texts = sorted(owners)
    codes = sorted({w for t in texts for w in t})
    raw = " ".join(codes).encode()
    data = np.frombuffer(raw, np.uint8)
    found = words.find(data, np.array([0, len(data)]), ~words.SPACE)
    number = dict(zip(codes, found.hashes().tolist()))
    hashes = [np.array([number[w] for w in t], np.uint64) for t in texts]
    items = [np.array(sorted(owners[t]), np.int64) for t in texts]
    return Windows([list(t) for t in texts], items, list(names), hashes)


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """Pairs of words; a single word is its own shingle."""
    return words.gram_hashes(hashes, min(SHINGLE, len(hashes)))


def _screen(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(_SCREEN, bool)
    bits[keys & np.uint64(_SCREEN - 1)] = True
    return bits


def _lookup(keys: np.ndarray, screen: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of grams that are keys, and which key."""
    at = np.flatnonzero(screen[grams & np.uint64(_SCREEN - 1)])
    near = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
    same = keys[near] == grams[at]
    return at[same], near[same]


def _frequencies(docs: DataFrame, text: str, keys: np.ndarray, single: bool) -> np.ndarray:
    """Documents of the whole corpus that hold each shingle of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        screen, total = _screen(known), np.zeros(len(known), np.int64)
        for batch in batches:
            for _, data, offsets in words.runs(batch, batch.schema.names[0]):
                found = _find(data, offsets)
                hashes = found.hashes()
                for size in (1, SHINGLE) if single else (SHINGLE,):
                    grams = words.gram_hashes(hashes, size)
                    at, key = _lookup(known, screen, grams)
                    inside = found.inside(size)[at]
                    owner = np.searchsorted(found.first, at[inside], side="right") - 1
                    total += np.bincount(np.unique(owner * len(known) + key[inside]) % len(known), minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])

    out = np.zeros(len(keys), np.int64)
    counts = frames.map_texts(docs.select(text), run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    for place, n in counts.toLocalIterator():  # at most a row for each word of the block
        out[place] = n
    return out


@dataclass
class Index:
    """Windows filed under their rarest shingle."""

    keys: np.ndarray  # sorted shingles
    first: np.ndarray  # entries of key i are first[i]:first[i + 1]
    offset: np.ndarray  # place of the shingle in the entry's window
    length: np.ndarray
    digest: np.ndarray
    texts: list[str]  # words of the entry's window, one space between
    items: list[np.ndarray]
    names: list[str]
    lengths: list[int]  # lengths that occur


def _index(windows: Windows, keys: np.ndarray, counts: np.ndarray) -> Index:
    entries = []
    for number, hashes in enumerate(windows.hashes):
        grams = _shingles(hashes)
        place = np.searchsorted(keys, grams)
        rank = np.lexsort((grams, counts[place]))[0]  # rarest, then by hash
        digest = words.gram_hashes(hashes, len(hashes))[0]
        entries.append((grams[rank], rank, len(hashes), digest, number))
    entries.sort(key=lambda e: e[0])
    used = np.array([e[0] for e in entries], np.uint64)
    cut = frames.starts_of(used)
    return Index(
        used[cut],
        np.append(cut, len(used)),
        np.array([e[1] for e in entries], np.int64),
        np.array([e[2] for e in entries], np.int64),
        np.array([e[3] for e in entries], np.uint64),
        [" ".join(windows.texts[e[4]]) for e in entries],
        [windows.items[e[4]] for e in entries],
        windows.names,
        sorted({e[2] for e in entries}),
    )


def _occurrences(index: Index, screen: np.ndarray, found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word places where windows of the index start, and which entries."""
    hashes = found.hashes()
    starts, entries = [], []
    plain = None
    for length in index.lengths:
        size = min(SHINGLE, length)
        at, key = _lookup(index.keys, screen, words.gram_hashes(hashes, size))
        count = index.first[key + 1] - index.first[key]
        before = np.cumsum(count) - count
        entry = np.arange(int(count.sum())) + np.repeat(index.first[key] - before, count)
        at = np.repeat(at, count)
        same = index.length[entry] == length
        at, entry = at[same], entry[same]
        # the window must lie inside the text
        start = at - index.offset[entry]
        owner = np.searchsorted(found.first, at, side="right") - 1
        bound = (start >= found.first[owner]) & (start + length <= found.first[owner + 1])
        start, entry = start[bound], entry[bound]
        digests = words.gram_hashes(hashes, length)
        same = digests[start] == index.digest[entry]
        start, entry = start[same], entry[same]
        if len(start) and plain is None:
            plain = found.data.tobytes()
        exact = np.zeros(len(start), bool)
        for i, (s, e) in enumerate(zip(start.tolist(), entry.tolist())):
            spans = zip(found.start[s : s + length].tolist(), found.end[s : s + length].tolist())
            exact[i] = b" ".join(plain[a:b] for a, b in spans).decode() == index.texts[e]
        starts.append(start[exact])
        entries.append(entry[exact])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(entries)


def _add_hits(docs: DataFrame, text: str, index: Index) -> DataFrame:
    """Widen ``__spans`` and ``__items`` by the block's hits."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def compute(batch, data, offsets):
        index = shared.value
        found = _find(data, offsets)
        if len(index.keys):
            start, entry = _occurrences(index, _screen_of(index), found)
        else:
            start = entry = np.zeros(0, np.int64)
        spans = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
        items = batch.column(batch.schema.get_field_index("__items")).to_pylist()
        owner = np.searchsorted(found.first, start, side="right") - 1
        order = np.lexsort((start, owner))
        for i in order.tolist():
            doc, low = int(owner[i]), int(start[i] - found.first[owner[i]])
            high = low + int(index.length[entry[i]])
            if spans[doc] and spans[doc][-1]["low"] <= low <= spans[doc][-1]["high"]:
                spans[doc][-1]["high"] = max(high, spans[doc][-1]["high"])
            else:
                spans[doc].append({"low": low, "high": high})
            items[doc] += [index.names[n] for n in index.items[entry[i]].tolist()]
        items = [sorted(set(i)) for i in items]
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        return {
            "__n_words": pa.array(found.counts),
            "__spans": pa.array(spans, kind),
            "__items": pa.array(items, pa.list_(pa.string())),
        }

    kinds = "__n_words long, __spans array<struct<low:int,high:int>>, __items array<string>"
    return frames.with_columns(docs, compute, kinds, text)


def _screen_of(index: Index) -> np.ndarray:
    """The index's bit screen, made once in each worker."""
    if not hasattr(index, "screen"):
        index.screen = _screen(index.keys)
    return index.screen


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, name, chunk, n_words): all windows of all items, in blocks of at most ``block_words`` words.

    A block holds one chunk at least, also where ``block_words`` is below a window.
    """
    chunk = max(window, min(CHUNK, block_words // 2))
    step = chunk - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in words.runs(batch, "text"):
                found = _find(data, offsets)
                plain, low, high = words.joined(found)
                names, chunks, counts = [], [], []
                for name, first, last in zip(part.column(0).to_pylist(), found.first[:-1].tolist(), found.first[1:].tolist()):
                    # a chunk for every ``step`` windows; an item below a window is one
                    for at in range(first, max(first + 1, last - window + 1) if last > first else first, step):
                        end = min(at + chunk, last)
                        names.append(name)
                        chunks.append(plain[low[at] : high[end - 1]].decode())
                        counts.append(end - at)
                columns = [pa.array(names, pa.string()), pa.array(chunks, pa.string()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "chunk", "n_words"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text")
    distinct = frames.map_texts(rows, run, "name string, chunk string, n_words long").distinct()
    key = F.xxhash64("name", "chunk")
    chunks = stored(distinct.select("*", key.alias("key"), F.pmod(key, F.lit(CELLS)).alias("cell")), "chunks")
    # a row for each cell
    behind = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = chunks.groupBy("cell").agg(F.sum("n_words").alias("n"))
    starts = sums.select("cell", F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("start"))
    inside = Window.partitionBy("cell").orderBy("key", "name", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("n_words").over(inside), F.lit(0))
    # what begins inside a stretch ends at most a chunk behind it
    stretch = max(1, block_words - chunk)
    return chunks.join(F.broadcast(starts), "cell").select(
        F.floor(before / stretch).alias("block"), "name", "chunk", "n_words"
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Documents with ``n_words``, ``n_hit``, ``n_items``, ``item_ids`` (sorted as strings),
    ``hit_spans`` (word spans) and ``contaminated``."""
    items = stored(blocks_of(benchmark, window, block_words), "items")
    blocks = sorted(r.block for r in items.select("block").distinct().collect())  # one number for each block
    added = ["n_words", "n_hit", "n_items", "item_ids", "hit_spans", "contaminated"]
    out = docs.drop(*added).withColumns(
        {
            "__n_words": F.lit(0).cast("long"),
            "__spans": F.array().cast("array<struct<low:int,high:int>>"),
            "__items": F.array().cast("array<string>"),
        }
    )
    for block in blocks:
        rows = items.where(F.col("block") == block).select("name", "chunk").collect()  # block_words at most
        windows = _windows(rows, window)
        grams = [_shingles(h) for h in windows.hashes]
        keys = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        single = any(len(h) == 1 for h in windows.hashes)
        counts = _frequencies(docs, text, keys, single) if len(keys) else np.zeros(0, np.int64)
        out = _add_hits(out, text, _index(windows, keys, counts))
        if block != blocks[-1]:
            out = stored(out, "hits")
    # blocks may hit the same words: merge their spans, which are sorted block by block
    merged = F.aggregate(
        F.array_sort("__spans"),
        F.array().cast("array<struct<low:int,high:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["high"] >= s["low"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["low"].alias("low"),
                        F.greatest(F.element_at(done, -1)["high"], s["high"]).alias("high"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    out = out.withColumn("hit_spans", merged if len(blocks) > 1 else F.col("__spans"))
    return (
        out.withColumn("n_words", F.col("__n_words"))
        .withColumn("item_ids", F.array_sort("__items"))
        .withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("n_hit", hit)
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop("__n_words", "__spans", "__items")
    )
