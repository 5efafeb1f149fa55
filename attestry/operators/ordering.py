"""Ordered work inside groups that may hold a third of all rows.

A window over a whole key puts that key in one task.  ``ordered`` works by (key,
block) where a key is hot, a block being a stretch of the key's order (an hour, a
run of sequence numbers): one summary row for each block is carried across block
borders.  Other keys are one block.  Keys are told hot by counts of hash buckets,
so rows are shuffled once and nothing else that grows with the table is.  The
result equals that of an unsplit window.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import stored

_GROUP = "__group"
# Hash buckets of keys, and the rows of a bucket from which on its keys are hot
# (or four times the mean of all buckets, if that is more).
BUCKETS = 4096
HOT = 1 << 17


def _marked(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``__hot``, true where the key's bucket is crowded, else null."""
    bucketed = df.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    counts = bucketed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    limit = counts.agg(F.greatest(F.lit(HOT), F.sum("__n") * 4 / BUCKETS).alias("__limit"))
    hot = counts.join(F.broadcast(limit), F.col("__n") > F.col("__limit")).select("__bucket", F.lit(True).alias("__hot"))
    return bucketed.join(F.broadcast(hot), "__bucket", "left").drop("__bucket")


def ordered(
    df: DataFrame,
    keys: list[str],
    block: Column,
    order: list[Column],
    position: str | None = None,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    running_max: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add a 1..n position, the neighbours' values, running maxima and sums per key.

    ``block`` must grow with ``order``; a null block is one of its own, before
    all others.  Null keys are a key.  Full rows shuffle once, by (keys, block of
    a hot key); counts and border rows exist for hot keys only.
    """
    previous, following, running = dict(previous or {}), dict(following or {}), dict(running_max or {})
    total = dict(total or {})
    # a struct is never null, so null keys and blocks join their border rows
    at_block = F.when(F.col("__hot"), F.struct(block.alias("b"))).alias("at")
    rows = _marked(df, keys).withColumn(_GROUP, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], at_block))
    for name, value in {**previous, **following, **running}.items():
        rows = rows.withColumn(f"__v_{name}", value)
    at = F.struct(*order)

    summary = [F.count(F.lit(1)).alias("__n")]
    summary += [F.max_by(F.struct(f"__v_{n}"), at).alias(f"__edge_{n}") for n in previous]
    summary += [F.min_by(F.struct(f"__v_{n}"), at).alias(f"__edge_{n}") for n in following]
    summary += [F.max(f"__v_{n}").alias(f"__edge_{n}") for n in running]
    summary += [F.sum(value).alias(f"__edge_{n}") for n, value in total.items()]
    of_key = Window.partitionBy(*[f"{_GROUP}.k{i}" for i in range(len(keys))])
    blocks = of_key.orderBy(f"{_GROUP}.at")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        rows.where("__hot")
        .groupBy(_GROUP)
        .agg(*summary)
        .select(
            _GROUP,
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
            *[F.lag(f"__edge_{n}").over(blocks)[f"__v_{n}"].alias(f"__over_{n}") for n in previous],
            *[F.lead(f"__edge_{n}").over(blocks)[f"__v_{n}"].alias(f"__over_{n}") for n in following],
            *[F.max(f"__edge_{n}").over(before).alias(f"__over_{n}") for n in running],
            *[F.sum(f"__edge_{n}").over(of_key).alias(f"__over_{n}") for n in total],
        )
    )

    local = Window.partitionBy(_GROUP).orderBy(*order)
    so_far = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    work = {"__local": F.row_number().over(local)}
    work |= {f"__near_{n}": F.lag(f"__v_{n}").over(local) for n in previous}
    work |= {f"__near_{n}": F.lead(f"__v_{n}").over(local) for n in following}
    work |= {f"__near_{n}": F.max(f"__v_{n}").over(so_far) for n in running}
    work |= {f"__near_{n}": F.sum(value).over(Window.partitionBy(_GROUP)) for n, value in total.items()}
    if following:
        work["__last"] = F.lead(F.lit(1)).over(local).isNull()
    out = rows.withColumns(work).join(borders, _GROUP, "left")

    at_border = {n: F.col("__local") == 1 for n in previous} | {n: F.col("__last") for n in following}
    picks = [
        F.when(edge, F.col(f"__over_{n}")).otherwise(F.col(f"__near_{n}")).alias(n)
        for n, edge in at_border.items()
    ]
    picks += [F.greatest(f"__over_{n}", f"__near_{n}").alias(n) for n in running]
    picks += [F.coalesce(f"__over_{n}", f"__near_{n}").alias(n) for n in total]
    if position:
        picks.append((F.coalesce("__start", F.lit(0)) + F.col("__local")).cast("int").alias(position))
    kept = [c for c in df.columns if c not in {*at_border, *running, *total, position}]
    return out.select(*kept, *picks)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """1..n per key by one range-partitioned, sorted pass.

    Boundaries of (keys, order) come from a sample, so ranges hold about equal
    rows whatever the keys and times are: a hot key, or many rows of one time,
    spreads over many ranges.  Each range's rows of a key are counted, and the
    sums before it are carried in.  Null keys are a key; rows that are equal in
    all of ``order`` are numbered in any order.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    every = [*[F.col(k) for k in keys], *order, F.col("__tie")]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = tied.repartitionByRange(*every).sortWithinPartitions(*every).drop("__tie")
    placed = stored(ranged.select("*", F.spark_partition_id().alias("__part"), place.alias("__place")), "numbered")
    # a struct is never null, so null keys join their sums
    grouped = placed.withColumn(_GROUP, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "__part"))
    ranges = Window.partitionBy(*[f"{_GROUP}.k{i}" for i in range(len(keys))]).orderBy(f"{_GROUP}.__part")
    before = F.coalesce(F.sum("n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = grouped.groupBy(_GROUP).agg(F.count(F.lit(1)).alias("n"), F.min("__place").alias("first"))
    starts = sums.select(_GROUP, (before - F.col("first") + 1).alias("__start"))
    kept = [c for c in df.columns if c != name]
    return grouped.join(starts, _GROUP).select(*kept, (F.col("__start") + F.col("__place")).cast("int").alias(name))


def with_position(
    df: DataFrame, keys: list[str], block: Column, order: list[Column], name: str = "position"
) -> DataFrame:
    """1..n per key."""
    return ordered(df, keys, block, order, position=name)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    Spark keeps a single row per key and map task before the shuffle (window
    group limit), so a hot key sends one row per task.
    """
    top = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(top)).where("__rank = 1").drop("__rank")


def hour_of(ts: str) -> Column:
    return F.date_trunc("hour", F.col(ts))
