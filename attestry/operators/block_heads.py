"""Heads over fixed blocks of a session's evidence chain.

The chain itself is sequential.  Beside it, every ``BLOCK`` sequence numbers of a
session get a digest over their evidence hashes, and a head that binds the digest
to the one before it.  Blocks are independent of each other, so heads are built
and checked in parallel, without a walk, and a change is found by its block.

A block is at most ``BLOCK`` hashes.  Stored events may repeat a sequence number;
blocks with more rows are counted only and have no digest, so no group grows.
Null sessions are a session; null sequence numbers are block -1, which no intact
session has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators import chain

BLOCK = 1024


def _digests(events: DataFrame, size: int) -> DataFrame:
    """(key, events, block_digest) of every block; the digest is null where a block is overfull."""
    block = F.coalesce(F.floor((F.col("sequence") - 1) / size), F.lit(-1)).cast("long")
    recomputed = chain.link_hash(F.col("previous_event_hash"), F.col("sequence"), chain.evidence_body_digest())
    # an event whose content no longer gives its hash counts with both
    seal = F.when(recomputed.eqNullSafe(F.col("evidence_hash")), F.col("evidence_hash")).otherwise(
        F.concat_ws("!", F.coalesce("evidence_hash", F.lit("")), F.coalesce(recomputed, F.lit("")))
    )
    # a struct is never null, so null sessions join
    rows = events.select(
        F.struct("session_id", block.alias("block")).alias("key"), "sequence", "event_id", seal.alias("seal")
    )
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("events"))
    overfull = counts.where(F.col("events") > size).select("key")
    sealed = F.array_sort(F.collect_list(F.struct("sequence", "event_id", "seal")))
    digest = F.sha2(F.array_join(F.transform(sealed, lambda s: s["seal"]), ","), 256)
    whole = rows.join(overfull, "key", "left_anti").groupBy("key").agg(
        F.count(F.lit(1)).alias("events"), digest.alias("block_digest")
    )
    return whole.unionByName(
        counts.where(F.col("events") > size).withColumn("block_digest", F.lit(None).cast("string"))
    )


def _head(previous: Column, block: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.coalesce(previous, F.lit("")), block.cast("string"), digest), 256)


def _previous() -> Column:
    # a row for each block of a session
    return F.lag("block_digest").over(Window.partitionBy("session_id").orderBy("block"))


def block_heads(events: DataFrame, size: int = BLOCK) -> DataFrame:
    """(session_id, block, events, block_digest, block_head) of linked events."""
    blocks = _digests(events, size).select("key.session_id", "key.block", "events", "block_digest")
    return blocks.withColumn("block_head", _head(_previous(), F.col("block"), F.col("block_digest")))


def block_failures(events: DataFrame, heads: DataFrame, size: int = BLOCK) -> DataFrame:
    """(session_id, block, reason) of blocks that are not as their heads say."""
    known = heads.select(
        F.struct("session_id", "block").alias("key"),
        F.lit(True).alias("known"),
        F.col("block_digest").alias("digest"),
        (_head(_previous(), F.col("block"), F.col("block_digest")) != F.col("block_head")).alias("head_differs"),
    )
    found = _digests(events, size).withColumn("found", F.lit(True))
    reason = (
        F.when(F.col("known").isNull(), F.lit("unknown_block"))
        .when(F.col("found").isNull(), F.lit("missing_block"))
        .when(F.coalesce("head_differs", F.lit(True)), F.lit("block_head_mismatch"))
        .when(~F.col("block_digest").eqNullSafe(F.col("digest")), F.lit("block_mismatch"))
    )
    return (
        found.join(known, "key", "full")
        .select("key.session_id", "key.block", reason.alias("reason"))
        .where("reason is not null")
    )


def verify_by_blocks(
    events: DataFrame, sessions: DataFrame, heads: DataFrame, size: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """``chain.chain_verify`` that orders the events of changed sessions only.

    The heads are trusted to be those of a valid chain.  Sessions whose blocks all
    agree have no failing event; the others are checked event by event.
    """
    key = F.struct("session_id").alias("__session")
    changed = block_failures(events, heads, size).select(key).distinct()
    marked = events.withColumn("__session", key)
    suspects = marked.join(changed, "__session", "left_semi").drop("__session")
    intact = marked.join(changed, "__session", "left_anti").drop("__session")
    none = F.array().cast("array<string>")
    checked = chain.chain_failures(suspects).unionByName(intact.withColumn("failures", none))
    return chain.verdicts(checked, sessions)
