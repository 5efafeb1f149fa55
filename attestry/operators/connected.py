"""Connected components of links on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import stored

# A round that changes nothing ends the loop; this only stops a broken one.
ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b) that is not its component's smallest, the root.

    Large-star and small-star rounds (Kiveris et al.): each joins neighbours to
    the smallest one near, and ends when only stars are left.  Every round is
    kept in the shared folder, so a lost executor costs a round at most.
    """
    now = stored(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    for _ in range(ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("xxhash64(b, a) >> 20"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # every row now points down from b to a smaller a
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        pairs = F.array(
            F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b"))
        )
        small = large.join(down, "b").select(F.explode(pairs).alias("e")).select("e.a", "e.b")
        now = stored(small.where("a <> b").distinct(), "links")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
