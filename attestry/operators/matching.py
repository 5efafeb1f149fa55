"""Keyed lookups over a whole registry: hashes, files, bindings, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.operators import ordering


# Bits of the screen of known keys; words of 64 of them are broadcast, at most a million.
SCREEN_BITS = 1 << 26


def likely_members(df: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be one of ``known``, which has a column of that name.

    No row of a known key is lost; of others, about as many stay as bits of the
    screen are set, so an exact join has to follow.  The screen has a fixed size
    and rows stay where they are: no shuffle comes before a large table is cut.
    """
    place = F.pmod(F.xxhash64(key), F.lit(SCREEN_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    word = F.shiftright(place, 6)
    screen = known.where(F.col(key).isNotNull()).groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    return df.join(F.broadcast(screen), (word == F.col("__word")) & (F.col("__bits").bitwiseAND(bit) != 0), "left_semi")


def tenant_scope(df: DataFrame, tenant: str) -> DataFrame:
    """One tenant's rows; prunes partitions of a table stored by tenant."""
    return df.where(F.col("tenant_id") == F.lit(tenant))


def hash_match(requests: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Look a SHA-256 up across all tenants: (verdicts, matches).

    Assets are counted per digest before the join, so a digest shared by many
    assets meets its requests as one row and no pairs are formed.  The matches
    are one row per asset and digest, numbered by (created_at, asset_uid).
    """
    asked = requests.withColumn("sha256", text.stripped(F.col("sha256")))
    per_digest = assets.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(
            F.struct("asset_uid", "asset_id", "trust_score", "content_label"),
            F.struct("created_at", "asset_uid", "asset_id"),
        ).alias("only"),
    )
    one = F.col("n") == 1
    verdicts = asked.join(per_digest, "sha256", "left").select(
        *[c for c in requests.columns if c != "sha256"],
        "sha256",
        F.when(F.col("n").isNull(), "not_found").when(one, "verified").otherwise("ambiguous").alias("status"),
        F.col("n").isNotNull().alias("verified"),
        F.coalesce("n", F.lit(0)).alias("match_count"),
        F.when(one, F.col("only.asset_uid")).alias("asset_uid"),
        F.when(one, F.col("only.trust_score")).alias("trust_score"),
        F.when(one, F.col("only.content_label")).alias("content_label"),
    )
    found = assets.join(asked.select("sha256").distinct(), "sha256", "left_semi")
    matches = ordering.numbered(
        found.select("sha256", "asset_uid", "asset_id", "tenant_id", "created_at", "trust_score", "content_label"),
        ["sha256"],
        [F.col("created_at"), F.col("asset_uid"), F.col("asset_id")],
        "match_no",
    )
    return verdicts, matches


def file_match(files: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``hash_match``, and every candidate's second fingerprint must agree.

    ``files`` has file_id, sha256 and second_fingerprint.  All files with one
    digest have the same content, so candidates are judged once per digest.
    """
    content = files.groupBy("sha256").agg(F.min("second_fingerprint").alias("file_second"))
    candidates = (
        assets.join(content, "sha256")
        .withColumn(
            "hash_verified",
            F.coalesce(F.col("second_fingerprint") == F.col("file_second"), F.lit(True)),
        )
        .select("sha256", "asset_uid", "asset_id", "tenant_id", "created_at", "hash_verified")
    )
    per_digest = candidates.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or("hash_verified").alias("any_verified"),
        F.min("asset_uid").alias("first_uid"),
    )
    verdicts = files.join(per_digest, "sha256", "left").select(
        "file_id",
        "sha256",
        F.coalesce("n", F.lit(0)).alias("match_count"),
        F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"),
        F.coalesce("any_verified", F.lit(False)).alias("verified"),
        F.when(F.col("n") == 1, F.col("first_uid")).alias("asset_uid"),
    )
    return verdicts, candidates


def asset_binding_check(events: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registrations bound to a same-tenant asset and digest: (ok, rejected).

    ``events`` name their asset in asset_ref and may declare a SHA-256.
    """
    bound = events.where("event_type = 'asset_registered'")
    known = assets.select(
        F.col("asset_id").alias("asset_ref"), "tenant_id", F.col("sha256").alias("asset_sha256"), "asset_uid"
    )
    joined = bound.join(known, ["asset_ref", "tenant_id"], "left")
    declared = F.nullif("declared_sha256", F.lit(""))
    reason = (
        F.when(F.coalesce("asset_ref", F.lit("")) == "", F.lit("asset_missing"))
        .when(F.col("asset_sha256").isNull(), F.lit("asset_unknown"))
        .when(declared != F.col("asset_sha256"), F.lit("digest_differs"))
    )
    judged = joined.withColumn("reason", reason)
    ok = judged.where("reason is null").withColumn("sha256", F.col("asset_sha256"))
    return ok.drop("reason", "asset_sha256"), judged.where("reason is not null").drop("asset_sha256", "asset_uid")


def source_lineage_snapshot(starts: DataFrame, assets: DataFrame) -> DataFrame:
    """Source facts frozen into the first event of a transformation session."""
    source = assets.select(
        F.col("asset_id").alias("source_asset_id"),
        "tenant_id",
        F.col("asset_uid").alias("source_asset_uid"),
        F.col("sha256").alias("source_sha256"),
        F.col("ai_disclosure").alias("source_ai_disclosure"),
        F.col("ai_detection_score").alias("source_ai_detection_score"),
        F.col("content_label").alias("source_content_label"),
        F.col("filename").alias("source_filename"),
    )
    return starts.join(source, ["source_asset_id", "tenant_id"]).withColumns(
        {
            "event_type": F.lit("source_captured"),
            "checkpoint": F.lit("source_asset_linked"),
            "history_mutated": F.lit(False),
        }
    )


def name_key(col: Column) -> Column:
    """Trimmed lower case; stands in for case folding."""
    return F.lower(text.stripped(col))


def name_match_join(contributors: DataFrame, split_rows: DataFrame) -> DataFrame:
    """(asset_id, name_key, member, member_id): contributors and rights records of an asset
    whose name the other side bears too.

    The relation is given by its names: all contributors and records of one
    (asset, name) belong together.  Rows grow with the members, not their pairs.
    """
    side = lambda df, name, member: (
        df.where(text.clean_text(F.col(name)).isNotNull())
        .select(
            "asset_id",
            name_key(F.col(name)).alias("name_key"),
            F.lit(member.removesuffix("_id")).alias("member"),
            F.col(member).cast("string").alias("member_id"),
        )
        .distinct()
    )
    rows = side(contributors, "name", "contributor_id").unionByName(side(split_rows, "sheet_name", "sheet_id"))
    named = F.col("member") == "contributor"
    # flags are added by hash, texts would be sorted
    both = (
        rows.groupBy("asset_id", "name_key")
        .agg(F.bool_or(named).alias("named"), F.bool_or(~named).alias("listed"))
        .where("named and listed")
        .select("asset_id", "name_key")
    )
    return rows.join(both, ["asset_id", "name_key"], "left_semi")


def legacy_observation_fallback(assets: DataFrame, observations: DataFrame) -> DataFrame:
    """Persisted observations, plus the legacy score where no such row exists."""
    persisted = observations.select(
        "asset_id",
        F.col("observation_id").cast("string").alias("observation_id"),
        "provider",
        "model",
        "signal",
        "probability",
        "status",
    )
    covered = persisted.where("provider = 'sightengine' and model = 'genai'").select("asset_id").distinct()
    legacy = (
        assets.where("ai_detection_score is not null")
        .join(covered, "asset_id", "left_anti")
        .select(
            "asset_id",
            F.concat(F.lit("legacy:"), F.col("asset_id")).alias("observation_id"),
            F.lit("sightengine").alias("provider"),
            F.lit("genai").alias("model"),
            F.lit("synthetic_media_probability").alias("signal"),
            F.col("ai_detection_score").alias("probability"),
            F.lit("legacy_persisted_score").alias("status"),
        )
    )
    return persisted.unionByName(legacy)
