"""Stored-fact projections: identity, trust, AI, rights, readiness, reports.

Child rows (contributors, splits) stay rows of their own; an asset row carries
their totals only, so an asset with very many contributors is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import media, text

# The six human authorship forms.
HUMAN_FORMS = {
    "creative_direction": "human_creative_direction",
    "editing": "human_editing_present",
    "arrangement": "human_arrangement_present",
    "lyrics": "human_lyrics_present",
    "performance": "human_performance_present",
    "transformation": "human_transformation_present",
}


def human_form_count() -> Column:
    """How many of the six nullable flags are true."""
    total = F.lit(0)
    for column in HUMAN_FORMS.values():
        total = total + F.when(F.col(column), 1).otherwise(0)
    return total


def text_list(col: Column) -> Column:
    """JSON list of texts; anything else is an empty list."""
    return F.coalesce(
        F.when(
            F.schema_of_variant(F.try_parse_json(col)).startswith("ARRAY"), F.from_json(col, "array<string>")
        ),
        F.array().cast("array<string>"),
    )


def percent_of_score(score: Column) -> Column:
    return text.rounded(score * 100, 1)


def contributor_facts(contributors: DataFrame) -> DataFrame:
    """One normalised row per contributor, percentages zero-safe."""
    legacy = F.col("split_percentage") if "split_percentage" in contributors.columns else None
    return contributors.select(
        "asset_id",
        "contributor_id",
        text.clean_text(F.col("name")).alias("name"),
        text.clean_text(F.col("role")).alias("role"),
        text.clean_text(F.col("contribution_type")).alias("contribution_type"),
        text.zero_safe_percentage(F.col("creative_contribution_pct")).alias("creative_contribution_pct"),
        text.zero_safe_percentage(F.col("ownership_split_pct"), legacy).alias("ownership_split_pct"),
        text.zero_safe_percentage(F.col("ai_assisted_pct")).alias("ai_assisted_pct"),
        text.iso_plain(F.col("added_at")).alias("added_at"),
    )


def ownership_splits(contributors: DataFrame) -> DataFrame:
    """Contributors with an explicit ownership percentage."""
    return contributor_facts(contributors).where("ownership_split_pct is not null")


def ownership_totals(assets: DataFrame, contributors: DataFrame) -> DataFrame:
    """Explicit rights only: null total without rows, creator never implies owner."""
    per_asset = ownership_splits(contributors).groupBy("asset_id").agg(
        F.sum("ownership_split_pct").alias("total"), F.count(F.lit(1)).alias("split_count")
    )
    owner = text.clean_text(F.col("copyright_owner"))
    return assets.join(per_asset, "asset_id", "left").select(
        "asset_id",
        owner.alias("copyright_owner"),
        text.clean_text(F.col("license_type")).alias("license_type"),
        F.coalesce("split_count", F.lit(0)).alias("split_count"),
        text.rounded(F.col("total"), 4).alias("ownership_total_pct"),
        (owner.isNotNull() | F.col("split_count").isNotNull()).alias("ownership_declared"),
    )


def lenient_numeric_total(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Sum of the values that parse as numbers, null if none does."""
    return df.groupBy(*keys).agg(text.rounded(F.sum(text.as_number(F.col(col))), 4).alias("total"))


def canonical_facts(assets: DataFrame, contributors: DataFrame) -> DataFrame:
    """One nested fact row per asset."""
    rights = ownership_totals(assets, contributors).select(
        "asset_id",
        F.struct(
            "copyright_owner", "license_type", "split_count", "ownership_total_pct", "ownership_declared"
        ).alias("rights"),
    )
    evidence = [F.col(column).alias(form) for form, column in HUMAN_FORMS.items()]
    facts = assets.select(
        "asset_id",
        "tenant_id",
        F.struct(
            "asset_uid",
            "asset_id",
            "filename",
            "file_type",
            "asset_type",
            "file_size_bytes",
            "sha256",
            "second_fingerprint",
            "phash",
            text.clean_text(F.col("creator_name")).alias("creator_name"),
            text.iso_plain(F.col("created_at")).alias("created_at"),
            text.clean_text(F.col("registry_url")).alias("registry_url"),
        ).alias("identity"),
        F.struct(
            "trust_score",
            "content_label",
            text_list(F.col("label_reasons")).alias("label_reasons"),
            F.coalesce("total_verifications", F.lit(0)).alias("total_verifications"),
            "watermark_applied",
            "watermark_visible",
            "watermark_invisible",
        ).alias("trust"),
        F.struct(
            text.clean_text(F.col("ai_disclosure")).alias("disclosure"),
            F.col("ai_disclosure_complete").alias("disclosure_complete"),
            F.col("ai_tools").alias("declared_tools"),
            F.col("ai_modification_by_human").alias("modification_by_human"),
            F.col("ai_detection_score").alias("detection_score"),
            percent_of_score(F.col("ai_detection_score")).alias("detection_pct"),
        ).alias("ai"),
        F.struct(
            F.col("copyright_readiness_score").alias("score"),
            F.col("copyright_readiness_label").alias("label"),
            "certificate_class",
            F.struct(
                *evidence, text.clean_text(F.col("human_authorship_summary")).alias("summary")
            ).alias("human_authorship_evidence"),
            human_form_count().alias("confirmed_human_authorship_forms"),
        ).alias("copyright_readiness"),
    )
    return facts.join(rights, "asset_id")


def asset_list(assets: DataFrame, tenant: str, limit: int = 50) -> DataFrame:
    """One tenant's newest assets, with the total count of the tenant."""
    own = assets.where(F.col("tenant_id") == tenant)
    total = own.agg(F.count(F.lit(1)).alias("total_count"))
    page = (
        own.select(
            "asset_uid",
            "asset_id",
            "filename",
            "asset_type",
            "file_type",
            "trust_score",
            "content_label",
            "creator_name",
            "ai_disclosure",
            "certificate_class",
            "created_at",
            F.coalesce("total_verifications", F.lit(0)).alias("total_verifications"),
        )
        .orderBy(F.col("created_at").desc_nulls_last(), "asset_uid", "asset_id")
        .limit(limit)
    )
    # total is a single aggregate row
    return page.join(F.broadcast(total), F.lit(True), "left").withColumn(
        "created_at", text.iso_plain(F.col("created_at"))
    )


def newest_n(df: DataFrame, ts: str, n: int, tie: list[str]) -> DataFrame:
    return df.orderBy(F.col(ts).desc_nulls_last(), *tie).limit(n)


def public_registry_view(facts: DataFrame, session_summary: DataFrame) -> DataFrame:
    """Public-safe projection: no tenant, no stored paths."""
    return facts.join(session_summary, "asset_id", "left").select(
        "asset_id",
        "identity.asset_uid",
        "identity.filename",
        "identity.sha256",
        "identity.second_fingerprint",
        "identity.phash",
        "identity.creator_name",
        "identity.created_at",
        "identity.file_size_bytes",
        "identity.registry_url",
        "trust.trust_score",
        "trust.content_label",
        "trust.label_reasons",
        "trust.watermark_applied",
        "trust.watermark_visible",
        "trust.watermark_invisible",
        F.col("ai.detection_score").alias("ai_detection_score"),
        F.col("ai.disclosure").alias("ai_disclosure"),
        "rights.copyright_owner",
        "rights.license_type",
        "copyright_readiness.certificate_class",
        F.struct(
            "copyright_readiness.score", "copyright_readiness.label", "copyright_readiness.certificate_class"
        ).alias("copyright_readiness"),
        F.when(
            F.col("session_id").isNotNull(),
            F.struct("status", "privacy_mode", "event_count", "chain_valid", "ai_used", "location"),
        ).alias("session"),
    )


def asset_report(assets: DataFrame, facts: DataFrame, session_summary: DataFrame) -> DataFrame:
    """Private report: facts, type fallbacks and the session summary."""
    mime = F.coalesce(F.nullif("file_type", F.lit("")), media.guessed_type(F.col("filename")))
    kind = F.coalesce(
        F.nullif("asset_type", F.lit("")), F.substring_index(F.coalesce(mime, F.lit("file")), "/", 1)
    )
    paths = assets.select(
        "asset_id", mime.alias("mime_type"), kind.alias("resolved_asset_type"), "manifest_path"
    )
    session = session_summary.select("asset_id", F.struct("status", "chain_valid", "event_count").alias("session"))
    return facts.join(paths, "asset_id").join(session, "asset_id", "left")
