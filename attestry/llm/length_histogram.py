"""Exact token counts: a histogram of encoded lengths and its suffix sums.

Documents are encoded where they are read and only (length, documents) pairs are
shuffled, summed first in each task.  Suffix sums over the distinct lengths then
answer, for every context limit, how many documents and tokens are longer, what
is left when all are cut there, and which share of the documents fits.

The suffix sums run over blocks of lengths, so no task takes all of them: sums
inside a block, plus the totals of the blocks behind it.

Null and empty texts have length 0.  Repeated rows count each.  An empty table
has an empty histogram.  Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm import frames, tokens, words
from attestry.session import stored

VOCABULARY = "word_bpe_49k.json"
# Lengths of one block of suffix sums.
BLOCK = 1024


def lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length, summed in each run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.vocabulary(vocabulary)
        for batch in batches:
            for _, data, offsets in words.runs(batch, batch.schema.names[0]):
                found = tokens.units(data, offsets)
                sizes = words.per_text(encode(found, found.hashes()).size, found.first)
                size, n = np.unique(sizes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(n)], names=["n_tokens", "n_docs"])

    return frames.map_texts(docs.select(text), run, "n_tokens long, n_docs long", vocabularies=True)


def histogram(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each length L that occurs, from (n_tokens, n_docs) pairs.

    docs_from, tokens_from    documents of L tokens or more, and their tokens
    total_docs, total_tokens  of all documents
    truncated_tokens          tokens left if every document is cut at L
    share_up_to               share of documents of at most L tokens
    """
    # a row for each length, kept: both sums below read it, and the texts are encoded once
    counts = stored(pairs.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")
    counts = counts.withColumn("__block", F.floor(F.col("n_tokens") / block))
    blocks = counts.groupBy("__block").agg(
        F.sum("n_docs").alias("__docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("__tokens")
    )
    # a row for each block of lengths: the longest text bounds their number
    behind = Window.orderBy(F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_blocks = Window.orderBy(F.col("__block").desc()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    blocks = blocks.select(
        "__block",
        F.coalesce(F.sum("__docs").over(behind), F.lit(0)).alias("__docs_behind"),
        F.coalesce(F.sum("__tokens").over(behind), F.lit(0)).alias("__tokens_behind"),
        F.sum("__docs").over(all_blocks).alias("total_docs"),
        F.sum("__tokens").over(all_blocks).alias("total_tokens"),
    )
    inside = Window.partitionBy("__block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumns(
        {
            "__docs_in": F.sum("n_docs").over(inside),
            "__tokens_in": F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside),
        }
    ).join(blocks, "__block")
    docs_from = F.col("__docs_in") + F.col("__docs_behind")
    tokens_from = F.col("__tokens_in") + F.col("__tokens_behind")
    return summed.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - tokens_from + docs_from * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("total_docs") - docs_from + F.col("n_docs")) / F.col("total_docs")).alias("share_up_to"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_tokens, total_tokens) for any limits.

    A limit takes the smallest length of at least the limit: all documents from
    there on are cut to it, the shorter ones stay whole.
    """
    spark = hist.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    # the asked limits are few; each row of the histogram is tried against them
    tried = hist.select("*", F.explode(F.lit([int(x) for x in limits]).cast("array<long>")).alias("context_limit"))
    longer = tried.where(F.col("n_tokens") >= F.col("context_limit"))
    first = longer.groupBy("context_limit").agg(
        F.min_by(F.struct("docs_from", "tokens_from"), "n_tokens").alias("at")
    )
    over = tried.where(F.col("n_tokens") > F.col("context_limit")).groupBy("context_limit").agg(
        F.max("docs_from").alias("docs_over")
    )
    total = tried.groupBy("context_limit").agg(F.max("total_tokens").alias("total_tokens"))
    joined = wanted.join(total, "context_limit", "left").join(first, "context_limit", "left").join(over, "context_limit", "left")
    zero = F.lit(0).cast("long")
    total_tokens = F.coalesce("total_tokens", zero)
    return joined.select(
        "context_limit",
        F.coalesce("docs_over", zero).alias("docs_over"),
        (
            total_tokens
            - F.coalesce("at.tokens_from", zero)
            + F.coalesce(F.col("at.docs_from") * F.col("context_limit"), zero)
        ).alias("truncated_tokens"),
        total_tokens.alias("total_tokens"),
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least such a share of documents does not exceed."""
    tried = hist.select("n_tokens", "share_up_to", F.explode(F.lit([float(x) for x in shares]).cast("array<double>")).alias("share"))
    return tried.where(F.col("share_up_to") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
