"""Stored registry tables: typed scan, conforming writes, schema evolution, upserts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import schemas
from attestry.operators import connected
from attestry.session import stored
from attestry.sources import merges


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order; missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def registry_write(df: DataFrame, root: str, table: str, mode: str = "overwrite") -> None:
    """Store a table; tenant tables are partitioned by tenant for pruned reads.

    Rebalancing gives files of even size and splits a hot tenant.
    """
    rows = conform(df, schemas.table_schema(table))
    if "tenant_id" in rows.columns:
        writer = rows.hint("rebalance", "tenant_id").write.partitionBy("tenant_id")
    else:
        writer = rows.write
    writer.mode(mode).option("compression", "zstd").parquet(f"{root}/{table}")


def registry_scan(spark: SparkSession, root: str, table: str) -> tuple[DataFrame, DataFrame]:
    """Typed scan without inference: (rows, rejected rows with the key columns they lack)."""
    df = spark.read.schema(schemas.table_schema(table)).parquet(f"{root}/{table}")
    keys = schemas.required_columns(table)
    ok = df.where(F.lit(True) if not keys else reduce(and_, [F.col(k).isNotNull() for k in keys]))
    lacking = F.concat_ws(",", *[F.when(F.col(k).isNull(), F.lit(k)) for k in keys])
    return ok, df.withColumn("missing_keys", lacking).where("missing_keys <> ''")


def schema_evolve(
    df: DataFrame, target: T.StructType, default_tenant: str, tenants: DataFrame
) -> DataFrame:
    """Add missing columns; give tenant-less rows the default tenant if it exists."""
    have = set(df.columns)
    added = {f.name: F.lit(None).cast(f.dataType) for f in target.fields if f.name not in have}
    out = df.withColumns(added) if added else df
    # at most one row: the default tenant itself
    exists = (
        tenants.where(F.col("tenant_id") == default_tenant)
        .limit(1)
        .select(F.lit(default_tenant).alias("__default"))
    )
    blank = F.coalesce(F.trim("tenant_id"), F.lit("")) == ""
    return (
        out.join(F.broadcast(exists), F.lit(True), "left")
        .withColumn("tenant_id", F.when(blank, F.coalesce("__default", "tenant_id")).otherwise(F.col("tenant_id")))
        .drop("__default")
    )


def _nodes(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.array("__key", "__alt")).alias("node")).where("node is not null").distinct()


def _reached(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Keys and alternative keys of the updates and of the target rows they lead to.

    The frontier starts with the updates' keys and grows by the keys of target
    rows that it meets, so all other rows are read but never linked.
    """
    pairs = stored(target.select("__key", "__alt"), "upsert-pairs")
    known = frontier = stored(_nodes(updates), "upsert-keys")
    while True:
        met = [pairs.join(frontier.withColumnRenamed("node", by), by, "left_semi") for by in ("__key", "__alt")]
        new = _nodes(met[0].select("__key", "__alt").unionByName(met[1].select("__key", "__alt")))
        frontier = stored(new.join(known, "node", "left_anti"), "upsert-keys")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def _roots(live: DataFrame) -> DataFrame:
    """The rows with ``__root``, the same for all rows that share keys.

    Rows of one alternative key are one set already; only keys that hold
    several alternative keys join sets, so only those go through the rounds.
    """
    links = live.where("__alt is not null").select("__key", "__alt").distinct()
    of_key = links.groupBy("__key").agg(F.min("__alt").alias("__first"), F.max("__alt").alias("__last"))
    bridges = links.join(of_key.where("__first <> __last"), "__key").where("__alt <> __first")
    roots = connected.components(bridges.select(F.col("__first").alias("a"), F.col("__alt").alias("b")))
    sets = live.join(of_key.select("__key", "__first"), "__key", "left").withColumn("__set", F.coalesce("__alt", "__first"))
    rooted = sets.join(roots.withColumnRenamed("node", "__set"), "__set", "left")
    return rooted.withColumn("__root", F.coalesce("root", "__set", "__key")).drop("root", "__set", "__first")


def keyed_upsert(
    target: DataFrame, updates: DataFrame, key: str, alt_keys: list[str], order: list[Column]
) -> DataFrame:
    """One record per identity after applying ``updates`` to ``target`` one after another.

    An update replaces the record with its key, else the record with the same
    alternative keys (whose key moves to the update's), else it is inserted.  A
    later update sees what the earlier ones left, so keys may move on and on.
    Alternative keys count only where none of them is null; updates of one
    place in the order are taken by key.

    Only the updates and the records that they reach are linked and folded, so
    an upsert costs what it touches plus one read of the target.  Each linked
    set is a stream sorted by order past its live records (``merges.fold``).
    """
    columns = target.columns
    names = [f"__o{i}" for i in range(len(order))]
    has_alt = reduce(and_, [F.col(k).isNotNull() for k in alt_keys])
    alt = F.when(has_alt, F.concat(F.lit("a"), F.sha2(F.to_json(F.struct(*alt_keys)), 256)))
    marks = {"__key": F.concat(F.lit("k"), F.col(key).cast("string")), "__alt": alt}
    new = stored(updates.select(*columns, *[o.alias(n) for o, n in zip(order, names)]).withColumns(marks), "upsert-new")
    old = target.select(*columns).withColumns(marks)
    known = _reached(old, new)
    for by in ("__key", "__alt"):
        old = old.join(known.select(F.col("node").alias(by), F.lit(True).alias(f"{by}_hit")), by, "left")
    hit = F.coalesce("__key_hit", "__alt_hit", F.lit(False))
    none = {n: F.lit(None).cast(new.schema[n].dataType) for n in names}
    met = old.where(hit).drop("__key_hit", "__alt_hit").withColumns(none).withColumn("__update", F.lit(False))
    live = stored(met.unionByName(new.withColumn("__update", F.lit(True))), "upsert-live")
    rows = _roots(live).select("__root", "__update", "__alt", *names, *columns).repartition("__root")
    in_order = ["__root", "__update", *[F.asc_nulls_last(n) for n in names], key, "__alt"]
    done = rows.sortWithinPartitions(*in_order).mapInArrow(merges.fold(columns, key), target.select(*columns).schema)
    return old.where(~hit).select(*columns).unionByName(done)


def missing_score_backfill(meta: DataFrame, score_column: str, scored: DataFrame, key: str) -> DataFrame:
    """Fill only absent scores; stored ones stay as they are.

    ``scored`` is the scoring operator over the records that lack a score.
    """
    fresh = scored.select(key, F.col(score_column).alias("__fresh"))
    return (
        meta.join(fresh, key, "left")
        .withColumn(score_column, F.coalesce(score_column, "__fresh"))
        .drop("__fresh")
    )
