"""Balanced shards by sampled splitters.

Records lie on a line, by the hash of their text and then by row, so copies are
neighbours.  Boundaries on that line cut it into shards of equal bytes:

1. A size-weighted sample of records, of bounded expected number, gives quantile
   boundaries; the records are partitioned into these ranges, whose bytes are summed.
2. Shard i ought to begin at i parts of all bytes.  Where a range holds such a
   target and is overfull, it is subdivided by boundaries from a sample of its own
   records, and its parts are summed again, until the part is small or one record.
   Boundaries lie between texts as long as a range holds several; a group of
   copies that is overfull by itself is subdivided between its rows.
3. The end of the part that is nearer to the target becomes the shard's boundary,
   and the records are partitioned by these boundaries.
4. Records are numbered in ``BUCKETS`` buckets of a shard by hash of their row, so
   that neither a hot text nor many empty ones meet in one task.

So the sampled splitters decide where shards begin; exact sums only say which
ranges to subdivide.  The driver holds samples and sums of ranges, never records.
A boundary is off its target by at most ``OVERFULL / 2`` of a ``UNITS``-th of a
mean shard, or half of one larger record.  Copies stay together unless their
group is overfull.

Null and empty texts have size 1.  Null ids are a value like others.  Repeated
rows are records of their own.  An empty table gives no rows.  Extra columns are
not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import stored

SHARDS = 16
# Ranges of the whole line, parts of an overfull one, and sampled records expected for each of them.
RANGES = 256
PARTS = 64
SAMPLE = 32
# Parts of a mean shard, and how many of them make a range overfull that holds a target.
UNITS = 256
OVERFULL = 2.0
# Buckets of a shard in which its records are numbered.
BUCKETS = 1024
SEED = 0

# A hash and a row of its records; no row, -1, is before all of them.
Place = tuple[int, int]
START: Place = (-(1 << 63), -1)


@dataclass(frozen=True)
class Range:
    """Records from one place up to another; None is the end of the line."""

    low: Place
    high: Place | None
    before: int  # bytes on the line before it
    bytes: int
    records: int
    keys: tuple[int, int]  # smallest and largest that occur
    rows: tuple[int, int]


def _at_or_below(places: list[Place]) -> str:
    """Number of sorted places at or below a record, by bisection, as one SQL expression."""
    if not places:
        return "0"
    middle = len(places) // 2
    key, row = places[middle]
    # nothing lies ahead of the start, whose number has no literal
    ahead = "false" if places[middle] == START else f"key < {key}L"
    if row >= 0:
        ahead += f" or (key = {key}L and row < {row}L)"
    below, above = _at_or_below(places[:middle]), _at_or_below(places[middle + 1 :])
    return f"case when {ahead} then {below} else {middle + 1} + {above} end"


def _in_ranges(records: DataFrame, ends: list[tuple[Place, Place | None]]) -> DataFrame:
    """Records inside sorted, disjoint ranges, with the ``range`` they lie in."""
    places = sorted({p for pair in ends for p in pair if p is not None})
    owner = {low: i for i, (low, _) in enumerate(ends)}
    owners = ", ".join(str(owner.get(p, "null")) for p in places)
    return records.withColumn("range", F.expr(f"array(null, {owners})[{_at_or_below(places)}]")).where("range is not null")


def _sums(records: DataFrame, ends: list[tuple[Place, Place | None]]) -> dict[int, tuple]:
    grouped = _in_ranges(records, ends).groupBy("range")
    sums = [F.sum("size"), F.count(F.lit(1)), F.min("key"), F.max("key"), F.min("row"), F.max("row")]
    return {r[0]: tuple(r)[1:] for r in grouped.agg(*sums).collect()}  # a row for each range


def splitters(records: DataFrame, ranges: list[Range], parts: int, seed: int = SEED) -> list[list[Place]]:
    """Quantile boundaries inside each range, from a size-weighted sample of its records."""
    expected = parts * SAMPLE
    # a record's chance follows its bytes; its own row decides, so a lost task draws the same
    draw = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    chances = F.array(*[F.lit(expected / r.bytes) for r in ranges])
    inside = _in_ranges(records, [(r.low, r.high) for r in ranges])
    drawn = inside.where(draw < F.col("size") * chances[F.col("range")]).select("range", "key", "row", "size").collect()
    samples: list[list] = [[] for _ in ranges]
    for r in drawn:
        samples[r.range].append((r.key, r.row, r["size"]))
    return [_quantiles(sorted(s), r, parts) for s, r in zip(samples, ranges)]


def _quantiles(sample: list[tuple[int, int, int]], inside: Range, parts: int) -> list[Place]:
    """Places that part a range, before and behind the texts or rows at its quantiles."""
    # a record that is drawn stands for as many bytes as one with its chance has
    weights = [max(size, inside.bytes / (parts * SAMPLE)) for _, _, size in sample]
    total, behind, wanted = sum(weights), 0.0, 1
    one_text = inside.keys[0] == inside.keys[1]
    places: set[Place] = set()
    for (key, row, _), weight in zip(sample, weights):
        behind += weight
        if behind < total * wanted / parts:
            continue
        wanted = int(behind * parts / total) + 1
        if one_text:
            places |= {(key, r) for r in (row, row + 1) if inside.rows[0] < r <= inside.rows[1]}
        else:
            places |= {(k, -1) for k in (key, key + 1) if inside.keys[0] < k <= inside.keys[1]}
    return sorted(places)


def _subdivide(records: DataFrame, ranges: list[Range], parts: int, seed: int) -> list[Range]:
    """The parts of some ranges, with their sums."""
    cuts = splitters(records, ranges, parts, seed)
    ends = [[r.low, *places, r.high] for r, places in zip(ranges, cuts)]
    flat = [pair for e in ends for pair in zip(e, e[1:])]
    sums, out, number = _sums(records, flat), [], 0
    for r, e in zip(ranges, ends):
        before = r.before
        for low, high in zip(e, e[1:]):
            size, count, least, most, first, last = sums.get(number, (0, 0, 0, 0, 0, 0))
            out.append(Range(low, high, before, size, count, (least, most), (first, last)))
            before, number = before + size, number + 1
    return out


def borders(records: DataFrame, shards: int, seed: int = SEED) -> list[Place | None]:
    """Where the second and later shards begin; None is behind the last record."""
    known = _sums(records, [(START, None)]).get(0)
    if known is None:
        return [None] * (shards - 1)
    total, count, least, most, first, last = known
    slack = OVERFULL * max(1, total // (shards * UNITS))
    ranges = _subdivide(records, [Range(START, None, 0, total, count, (least, most), (first, last))], RANGES, seed)
    while True:
        holding = [
            next(r for r in ranges if r.before <= target < r.before + r.bytes)
            for target in (total * i / shards for i in range(1, shards))
        ]
        overfull = sorted({r for r in holding if r.records > 1 and r.bytes > slack}, key=lambda r: r.before)
        if not overfull:
            break
        # every turn draws anew, so a range that got no boundary gets another chance
        seed += 1
        kept = [r for r in ranges if r in set(holding) - set(overfull)]
        ranges = kept + _subdivide(records, overfull, PARTS, seed)
    targets = [total * i / shards for i in range(1, shards)]
    return [r.low if t - r.before <= r.before + r.bytes - t else r.high for t, r in zip(targets, holding)]


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot) of every record."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(body).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "records",
    )
    places = [p for p in borders(rows, shards, seed) if p is not None]
    bucket = F.pmod(F.xxhash64("row"), F.lit(BUCKETS))
    dealt = rows.select(
        "doc_id", "size", "text_crc32", "row", F.expr(_at_or_below(places)).alias("shard"), bucket.alias("bucket")
    )
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # a row for each bucket
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("row")
    numbered = dealt.withColumn("number", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("number")).alias("slot"),
    )
