"""Removal of repeated passages by prefix-partitioned suffix trees.

Every window of ``WINDOW`` words is a suffix cut at that depth; it is repeated
when its leaf path in the suffix tree of the corpus is a deep internal node, one
with two leaves or more.  The tree is never built whole:

* A suffix is filed under a prefix that its own words choose: the smallest of
  the hashes of its ``GRAM``-word pieces, leftmost first (winnowing).  Equal
  windows choose the same piece at the same place, and neighbouring windows
  share it, so about one prefix entry stands for fourteen suffixes.
* Prefixes that occur once in the corpus have no internal node.  A bit screen
  of fixed size drops nearly all of them before their suffixes are shuffled.
* A prefix with more than ``GROUP`` occurrences is made longer, up to the whole
  window, so that every group fits in a task's memory.  Suffixes of long
  prefixes are counted by Spark with partial sums instead of being gathered.
* Inside a group the suffixes are sorted by label; runs of equal labels are the
  deep nodes, and the words below them are the repeats.

Labels are 64-bit digests over 64-bit word hashes and are compared only below
one 64-bit prefix.

A null, empty or short text has no window and stays as it is.  Repeated rows are
two documents, so all their windows repeat.  Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import frames, words
from attestry.session import stored

WINDOW = 35
GRAM = 8
# Bits of the screen: the size of its broadcast is SCREEN_BITS / 8 whatever the input.
SCREEN_BITS = 1 << 27
# Occurrences of a prefix that one task takes, and the most prefixes that are
# made longer; with more, GROUP grows to keep their list below this bound.
GROUP = 50_000
LONG_PREFIXES = 1_000_000

_CHUNK = 32_768  # bits of one bitmap aggregate
_PLACE = (1 << 28) - 1  # words of a run are numbered below this


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """128 bits that stand for a document's id and text."""
    return docs.withColumns(
        {"__k1": F.xxhash64("doc_id", text), "__k2": F.xxhash64(text, F.lit(1), "doc_id")}
    )


def _prefixes(found: words.Words, window: int, gram: int):
    """Runs of windows that share a prefix: its hash, its place, first and last window."""
    hashes = found.hashes()
    grams = words.gram_hashes(hashes, gram)
    width = window - gram + 1
    if len(grams) < width:
        none = np.zeros(0, np.int64)
        return hashes, np.zeros(0, np.uint64), none, none, none
    # the smallest hash of each window, leftmost first: the place fills the low bits
    small = (grams & ~np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        small = np.minimum(small[:-span], small[span:])
        span *= 2
    if span < width:
        small = np.minimum(small[: len(small) - (width - span)], small[width - span :])
    windows = np.flatnonzero(found.inside(window))
    place = (small[windows] & np.uint64(_PLACE)).astype(np.int64)
    first = frames.starts_of(place)
    last = np.append(first[1:], len(place)) - 1 if len(place) else first
    place = place[first]
    return hashes, grams[place], place, windows[first], windows[last]


def _counted(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in words.runs(batch, batch.schema.names[0]):
                prefix = _prefixes(words.find(data, offsets, ~words.SPACE), window, gram)[1]
                keys, n = np.unique(prefix, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["prefix", "n"])

    return run


def _screen(repeated: DataFrame) -> np.ndarray:
    """Bits of the prefixes that occur twice or more."""
    bit = F.pmod(F.col("prefix"), F.lit(SCREEN_BITS))
    chunks = repeated.groupBy(F.floor(bit / _CHUNK).alias("chunk")).agg(
        F.bitmap_construct_agg((bit % _CHUNK).cast("long")).alias("bits")
    )
    out = np.zeros(SCREEN_BITS // 8, np.uint8)
    for row in chunks.toLocalIterator():  # at most SCREEN_BITS / 8 bytes in all
        at = row.chunk * (_CHUNK // 8)
        out[at : at + _CHUNK // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _suffixes(window: int, gram: int, text: str, screen, long, take_long: bool):
    """Rows of prefixes that may repeat, with the labels of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = screen.value, long.value
        for batch in batches:
            for part, data, offsets in words.runs(batch, text):
                found = words.find(data, offsets, ~words.SPACE)
                hashes, prefix, place, low, high = _prefixes(found, window, gram)
                bit = prefix & np.uint64(SCREEN_BITS - 1)
                keep = (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if len(hot):
                    near = np.minimum(np.searchsorted(hot, prefix), len(hot) - 1)
                    keep &= (hot[near] == prefix) == take_long
                prefix, low, high = prefix[keep], low[keep], high[keep]
                count = high - low + 1
                before = np.cumsum(count) - count
                starts = np.arange(int(count.sum())) + np.repeat(low - before, count)
                labels = words.gram_hashes(hashes, window)[starts]
                owner = np.searchsorted(found.first, low, side="right") - 1
                places = low - found.first[owner]
                keys = [part.column(part.schema.get_field_index(k)).take(pa.array(owner)) for k in ("__k1", "__k2")]
                if take_long:
                    each = np.repeat(np.arange(len(count)), count)
                    columns = [pa.array(prefix[each].view(np.int64)), pa.array(labels.view(np.int64))]
                    columns += [k.take(pa.array(each)) for k in keys]
                    columns.append(pa.array((starts - np.repeat(low - places, count)).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(columns, names=["prefix", "label", "__k1", "__k2", "low"])
                    continue
                cuts = np.append(before, count.sum()).astype(np.int32) * 8
                packed = pa.Array.from_buffers(
                    pa.binary(), len(count), [None, pa.py_buffer(cuts), pa.py_buffer(labels.tobytes())]
                )
                columns = [pa.array(prefix.view(np.int64)), *keys, pa.array(places.astype(np.int32)), packed]
                yield pa.RecordBatch.from_arrays(columns, names=["prefix", "__k1", "__k2", "low", "labels"])

    return run


def _deep_nodes(window: int):
    """Word spans below nodes with two leaves or more, of groups sorted by prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in frames.sorted_groups(batches, 1):
            packed = group["labels"]
            _, cuts, data = packed.buffers()
            cuts = np.frombuffer(cuts, np.int32, len(packed) + 1, packed.offset * 4).astype(np.int64)
            labels = np.frombuffer(data, np.uint64, (cuts[-1] - cuts[0]) // 8, int(cuts[0]))
            count = np.diff(cuts) // 8
            row = np.repeat(np.arange(len(count)), count)
            tree = np.zeros(len(count), np.int64)
            tree[frames.starts_of(group["prefix"])] = 1
            tree = np.cumsum(tree)[row]
            order = np.lexsort((labels, tree))
            same = (labels[order][1:] == labels[order][:-1]) & (tree[order][1:] == tree[order][:-1])
            repeat = np.zeros(len(labels), bool)
            repeat[order[1:][same]] = repeat[order[:-1][same]] = True
            at = np.flatnonzero(repeat)
            if not len(at):
                continue
            start = group["low"][row[at]] + at - (np.cumsum(count) - count)[row[at]]
            new = np.ones(len(at), bool)
            new[1:] = (row[at][1:] != row[at][:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            rows = row[at][first]
            columns = [group["__k1"][rows], group["__k2"][rows], start[first], start[last] + window]
            kinds = (np.int64, np.int64, np.int32, np.int32)
            arrays = [pa.array(c.astype(k)) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["__k1", "__k2", "low", "high"])

    return run


def repeated_spans(
    docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP
) -> DataFrame:
    """(__k1, __k2, low, high): word spans of a document inside repeated windows."""
    spark = docs.sparkSession
    keyed = _keyed(docs.select("doc_id", text), text)
    counts = frames.map_texts(docs.select(text), _counted(window, gram), "prefix long, n long")
    repeated = stored(counts.groupBy("prefix").agg(F.sum("n").alias("n")).where("n > 1"), "prefixes")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    group = max(group, total // LONG_PREFIXES)
    long = np.sort(np.array([r[0] for r in repeated.where(F.col("n") > group).select("prefix").collect()], np.int64).view(np.uint64))
    screen, hot = spark.sparkContext.broadcast(_screen(repeated)), spark.sparkContext.broadcast(long)
    source = keyed.select(text, "__k1", "__k2")
    short = frames.map_texts(
        source,
        _suffixes(window, gram, text, screen, hot, False),
        "prefix long, __k1 long, __k2 long, low int, labels binary",
    )
    spans = (
        short.repartition("prefix")
        .sortWithinPartitions("prefix")
        .mapInArrow(_deep_nodes(window), "__k1 long, __k2 long, low int, high int")
    )
    if len(long):
        leaves = frames.map_texts(
            source,
            _suffixes(window, gram, text, screen, hot, True),
            "prefix long, label long, __k1 long, __k2 long, low int",
        )
        nodes = leaves.groupBy("prefix", "label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        deep = leaves.join(nodes, ["prefix", "label"], "left_semi")
        spans = spans.unionByName(deep.select("__k1", "__k2", "low", (F.col("low") + window).cast("int").alias("high")))
    return spans


def _span_lists(spans: DataFrame) -> DataFrame:
    """The spans of one document, each once: repeated rows of it give the same ones."""
    return spans.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("low", "high")).alias("__spans"))


def remove_repeats(
    docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP
) -> DataFrame:
    """Documents with ``n_words``, ``n_removed`` and ``kept_text``.

    ``kept_text`` is the text without the words of repeated windows and the
    white space behind them; a text without any is unchanged.
    """
    spans = repeated_spans(docs, text, window, gram, group)
    by_doc = _span_lists(spans)
    keyed = _keyed(docs.drop("n_words", "n_removed", "kept_text"), text)
    joined = keyed.join(by_doc, ["__k1", "__k2"], "left").drop("__k1", "__k2")

    def compute(batch, data, offsets):
        found = words.find(data, offsets, ~words.SPACE)
        lists = batch.column(batch.schema.get_field_index("__spans"))
        size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        owner = np.repeat(np.arange(len(size)), size)
        low = flat.field(0).to_numpy(zero_copy_only=False) + found.first[owner]
        high = flat.field(1).to_numpy(zero_copy_only=False) + found.first[owner]
        gone = words.covered(low, high - low, len(found.start))
        # a removed word goes with the white space up to the next word or the text's end
        after = np.append(found.start[1:], len(data))
        after = np.minimum(after, offsets[1:][found.owner()])
        cut = words.covered(found.start[gone], (after - found.start)[gone], len(data))
        kept = data[~cut].tobytes()
        ends = np.concatenate([[0], np.cumsum(~cut)])[offsets]
        texts = pa.Array.from_buffers(
            pa.string(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kept)]
        )
        whole = batch.column(batch.schema.get_field_index(text))
        if whole.null_count:
            texts = pa.array([None if w is None else t for w, t in zip(whole.to_pylist(), texts.to_pylist())], pa.string())
        return {
            "n_words": pa.array(found.counts),
            "n_removed": pa.array(words.per_text(gone, found.first)),
            "kept_text": texts,
        }

    return frames.with_columns(joined, compute, "n_words long, n_removed long, kept_text string", text).drop("__spans")
