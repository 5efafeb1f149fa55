"""Near-duplicate groups by SimHash and covering locality-sensitive hashing.

A fingerprint is the majority vote of its shingles' hash bits.  Covering masks
(Pagh): every bit gets a vector m of F_2^(r+1), and table v keeps the bits with
<m, v> = 1.  The at most r bits in which a pair differs span no more than r
dimensions, so some v is orthogonal to all of them and table v keeps none of
them: the pair collides there, always.

Only distinct fingerprints are hashed, so exact copies never meet.  Buckets
above ``BUCKET`` fingerprints are dealt again by covering masks over the bits
that their table dropped, which leaves few free bits and so few fingerprints.
A bucket gives a spanning forest of its links, not its pairs, and components
come from large-star/small-star rounds over links on the cluster.

Null, empty and white-space texts have fingerprint 0 and are linked like any
other; texts of fewer words than a shingle are one shingle; repeated rows share
a group; a group whose ids are all null has a null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm import frames, words
from attestry.operators.connected import components
from attestry.session import stored

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
# Distinct fingerprints of a bucket above which it is dealt again by finer masks.
BUCKET = 4096


def _fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    texts = len(offsets) - 1
    found = words.find(words.LOWER[data], offsets, ~words.SPACE)
    counts = found.counts
    raw, low, high = words.joined(found)
    # the last word of the shingle that starts at each word; short texts have one shingle
    at = np.flatnonzero(found.inside(shingle))
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    first = np.concatenate([at, found.first[short]])
    last = np.concatenate([at + shingle - 1, found.first[short] + counts[short] - 1])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    digest = xxhash.xxh64_intdigest
    spans = zip(low[first].tolist(), high[last].tolist())
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in spans), np.uint64, len(first))
    cuts = np.searchsorted(first, found.first)
    size = np.diff(cuts)
    out = np.zeros(texts, np.uint64)
    filled = np.flatnonzero(size)
    if len(filled):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, cuts[:-1][filled], axis=0, dtype=np.int32)
        major = votes * 2 > size[filled, None]
        out[filled] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Documents with their fingerprint as a signed 64-bit number."""

    def compute(batch, data, offsets):
        return {"fingerprint": pa.array(_fingerprints(data, offsets, shingle).view(np.int64))}

    return frames.with_columns(docs, compute, "fingerprint long", text)


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over some bits: any at most ``radius`` of them are all dropped by one mask."""
    vectors = 2 ** (radius + 1) - 1
    place = {b: 1 + i % vectors for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (place[b] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


TABLES = covering_masks(list(range(BITS)))


def _finer(table: int) -> list[int]:
    kept = TABLES[table]
    return [kept | m for m in covering_masks([b for b in range(BITS) if not kept >> b & 1])]


def _keys(masks: list[tuple[int, int]]) -> Column:
    """(table, kept bits) for each mask."""
    one = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in masks]
    return F.explode(F.array(*one))


def _forest(batches):
    """Links (a, b) that join the fingerprints of each bucket within the radius."""
    for group in frames.sorted_groups(batches, 2):
        cut = frames.starts_of(group["t"], group["key"])
        ends = np.append(cut[1:], len(group["t"]))
        several = ends - cut > 1
        a, b = [], []
        for low, high in zip(cut[several].tolist(), ends[several].tolist()):
            fps = group["fp"][low:high]
            label = np.arange(high - low)
            for i in range(len(fps) - 1):
                near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= RADIUS) + i + 1
                other = np.unique(label[near])
                other = other[other != label[i]]
                if len(other):
                    low_label = min(int(other[0]), int(label[i]))
                    gone = np.append(other, label[i])
                    a += [fps[i]] * len(other)
                    b += [fps[near[np.flatnonzero(label[near] == o)[0]]] for o in other]
                    label[np.isin(label, gone)] = low_label
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _in_buckets(rows: DataFrame) -> DataFrame:
    parts = rows.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return parts.mapInArrow(_forest, "a long, b long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that leave the same components
    as all pairs within the radius."""
    keyed = fps.select("fp", _keys(list(enumerate(TABLES))).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["t", "key"])
    plain = keyed.where(F.col("n") <= bucket)
    hot = keyed.where(F.col("n") > bucket).select("t", "fp")
    finer = F.lit(None)
    for table in range(len(TABLES)):
        masks = [(len(TABLES) * (table + 1) + i, m) for i, m in enumerate(_finer(table))]
        one = F.array(
            *[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in masks]
        )
        finer = F.when(F.col("t") == table, one).otherwise(finer)
    again = hot.select("fp", F.explode(finer).alias("k")).select("fp", "k.t", "k.key")
    return _in_buckets(plain.select("t", "key", "fp").unionByName(again.select("t", "key", "fp")))


def near_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints are computed once and kept in the shared folder with the ids.
    """
    marked = fingerprints(docs, text)
    ids = stored(marked.select("doc_id", "fingerprint"), "fingerprints")
    groups = group_roots(ids)
    return _with_group(ids, groups)


def group_roots(ids: DataFrame) -> DataFrame:
    """(fingerprint, component_id) of the distinct fingerprints."""
    fps = stored(ids.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps.select("fp")))
    joined = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.select("fp", "root").join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id", "root")


def _with_group(ids: DataFrame, groups: DataFrame) -> DataFrame:
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return ids.join(groups, "fingerprint").withColumn("fingerprint", digits).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id (nulls last)
    and then the smallest digest of id and text; all its columns stay."""
    keys = {"__k1": F.xxhash64("doc_id", text), "__k2": F.xxhash64(text, F.lit(1), "doc_id")}
    keyed = docs.withColumns(keys)
    ids = stored(fingerprints(keyed.select("doc_id", text, "__k1", "__k2"), text).drop(text), "fingerprints")
    groups = group_roots(ids.select("doc_id", "fingerprint")).select("fingerprint", "root")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "__k1", "__k2")
    first = ids.join(groups, "fingerprint").groupBy("root").agg(F.min(order).alias("best"))
    best = first.select("best.__k1", "best.__k2")
    # a repeated row has the keys of its twin
    return keyed.join(best, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).select(docs.columns)
