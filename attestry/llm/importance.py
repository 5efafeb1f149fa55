"""Importance resampling towards a target corpus by hashed n-gram features.

Features of a text are its runs of one to three words, repeats counted; a
feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``.  A bucket's gain
is a floored log ratio of its smoothed shares in the target and in the source
corpus, a text's weight the sum of its features' gains, and a row's score its
weight plus Gumbel noise from its id, so the highest scores are a draw without
replacement.

Corpus counts come from segments: newlines separate words, so they cut a text
into lines.  Equal lines of all texts are one row with its occurrences; its
features are counted once and multiplied.  The n-grams that cross a newline
are counted text by text and added.  Every task adds into one array of buckets.

CRCs of n-grams are put together from those of their words: appending bytes is
linear over bits, so a table for each length moves a CRC past the next word.

Null and empty texts have no features, weight 0, and are never drawn (fewer
words than ``least_words``).  Repeated rows count and may be drawn each; equal
scores are ranked by id, null ids last, then arbitrarily among equal rows.  A
null id is hashed as the empty string.  Only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import frames, words
from attestry.session import stored

BUCKETS = 10_000
LEAST_WORDS = 20
# Part of the rows with enough words that is drawn, in percent.
PERCENT = 5
SEED = 42

# Words up to so many bytes go through the tables, longer ones are rare.
SHORT = 64
_ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def _apply(maps: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The linear map given by the images of the four bytes of a value."""
    out = maps[0][crc & 255]
    for k in (1, 2, 3):
        out = out ^ maps[k][(crc >> np.uint32(8 * k)) & 255]
    return out


_BYTE = _byte_table()
_BYTES = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])


def _after_zeros() -> np.ndarray:
    """Maps past 0, 1, 2, ... SHORT zero bytes."""
    out = [_BYTES]
    for _ in range(SHORT):
        out.append(_BYTE[out[-1] & 255] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


def _after_powers() -> list[np.ndarray]:
    """Maps past 1, 2, 4, ... zero bytes."""
    out = [_BYTE[_BYTES & 255] ^ (_BYTES >> np.uint32(8))]
    for _ in range(30):
        out.append(_apply(out[-1], out[-1]))
    return out


_ZEROS = _after_zeros()
_POWERS = _after_powers()


def _moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts moved past ``length`` more bytes."""
    near = np.minimum(length, SHORT)
    out = _ZEROS[near, 0, crc & 255]
    for k in (1, 2, 3):
        out = out ^ _ZEROS[near, k, (crc >> np.uint32(8 * k)) & 255]
    far = np.flatnonzero(length > SHORT)
    if len(far):
        rest, part = length[far] - SHORT, out[far]
        for j, maps in enumerate(_POWERS):
            on = (rest >> j) & 1 == 1
            part[on] = _apply(maps, part[on])
        out[far] = part
    return out


def _next(crc: np.ndarray, byte) -> np.ndarray:
    raw = crc ^ _ALL
    return _BYTE[(raw ^ byte) & 255] ^ (raw >> np.uint32(8)) ^ _ALL


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span."""
    length = end - start
    crc = np.zeros(len(start), np.uint32)
    left = np.flatnonzero(length <= SHORT)
    at = 0
    while len(left):
        crc[left] = _next(crc[left], data[start[left] + at])
        at += 1
        left = left[length[left] > at]
    for i in np.flatnonzero(length > SHORT).tolist():
        crc[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return crc


def _longer(crc: np.ndarray, follow: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of ``text + space + word`` from those of texts and words."""
    return _moved(_next(crc, np.uint32(0x20)), length) ^ follow


def _found(data: np.ndarray, offsets: np.ndarray) -> words.Words:
    return words.find(words.LOWER[data], offsets, words.LETTERS)


def features(found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every feature."""
    crc, length, owner = word_crcs(found.data, found.start, found.end), found.end - found.start, found.owner()
    two = np.flatnonzero(found.inside(2))
    pair = _longer(crc[two], crc[two + 1], length[two + 1])
    three = np.flatnonzero(found.inside(3))
    # a place that starts three words starts two
    triple = _longer(pair[np.searchsorted(two, three)], crc[three + 2], length[three + 2])
    crcs = np.concatenate([crc, pair, triple])
    return (crcs % BUCKETS).astype(np.int64), np.concatenate([owner, owner[two], owner[three]])


def crossing(found: words.Words) -> np.ndarray:
    """Buckets of the features that hold words of two lines or more."""
    line = np.searchsorted(np.flatnonzero(found.data == 0x0A), found.start)
    out = []
    for n in (2, 3):
        at = np.flatnonzero(found.inside(n))
        at = at[line[at] != line[at + n - 1]]
        crc = word_crcs(found.data, found.start[at], found.end[at])
        for k in range(1, n):
            follow = word_crcs(found.data, found.start[at + k], found.end[at + k])
            crc = _longer(crc, follow, found.end[at + k] - found.start[at + k])
        out.append(crc % BUCKETS)
    return np.concatenate(out).astype(np.int64)


def _rows_of(sums: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(sums)
    return pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["bucket", "n"])


def _line_features(batches):
    sums = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part, data, offsets in words.runs(batch, "line"):
            times = part.column(1).to_numpy()
            bucket, owner = features(_found(data, offsets))
            # whole numbers of a run stay exact in doubles
            sums += np.bincount(bucket, times[owner], BUCKETS).astype(np.int64)
    yield _rows_of(sums)


def _crossing_features(text: str):
    def task(batches):
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, offsets in words.runs(batch, text):
                sums += np.bincount(crossing(_found(data, offsets)), minlength=BUCKETS)
        yield _rows_of(sums)

    return task


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Features of a corpus in each bucket: ``BUCKETS`` sums reach the driver."""
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line")).where("line <> ''")
    lines = lines.groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    within = frames.map_texts(lines, _line_features, "bucket long, n long")
    across = frames.map_texts(docs.select(text), _crossing_features(text), "bucket long, n long")
    found = within.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed shares, target over source."""
    S, T = int(source.sum()), int(target.sum())
    over, under = float(S + BUCKETS), float(T + BUCKETS)
    ratios = [float(t + 1) * over / (float(s + 1) * under) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _weighed(docs: DataFrame, text: str, gain: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def compute(batch, data, offsets):
        found = _found(data, offsets)
        n, counts = len(offsets) - 1, found.counts
        bucket, owner = features(found)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(n + 1))
        return {
            "n_words": pa.array(counts),
            "n_features": pa.array(np.bincount(owner, minlength=n)),
            "weight": pa.array(words.per_text(shared.value[bucket[order]], cuts)),
        }

    return frames.with_columns(docs, compute, "n_words long, n_features long, weight long", text).drop(text)


def _ranked(rows: DataFrame, draws: int) -> DataFrame:
    """``rank`` of the first ``draws`` rows by falling score: ranges are sorted and their sizes carried."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("row")]
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    ordered = stored(sorted_rows.select("*", F.spark_partition_id().alias("part"), place.alias("place")), "draw-order")
    # one row for each range
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    carried = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, before long"))
    rank = F.col("before") + F.col("place") + 1
    return ordered.join(carried, "part").withColumn("rank", F.when(rank <= draws, rank)).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null where it is not drawn."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    gain = gains(bucket_counts(docs), bucket_counts(target.select(F.col(text).alias("text"))))
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = stored(_weighed(docs, "text", gain).withColumn("score", F.col("weight") + noise), "draw-scores")
    enough = weighed.where(F.col("n_words") >= LEAST_WORDS)
    drawn = _ranked(enough, percent * enough.count() // 100)
    rest = weighed.where(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
