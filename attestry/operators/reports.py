"""Provenance continuity and the authorship report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.operators import asset_scores, certificates, facts, timeline

# Continuity weights and labels.
WEIGHTS = {
    "upload_event": 0.20,
    "certificate_event": 0.20,
    "all_hashes": 0.15,
    "watermark_event": 0.10,
    "manifest_present": 0.10,
    "ownership_declared": 0.10,
    "event_integrity": 0.10,
    "chain_continuous": 0.05,
}
PARTIAL_HASHES = 0.7
LABELS = [("complete", 0.80), ("partial", 0.55), ("minimal", 0.30)]


def event_facts(events: DataFrame) -> DataFrame:
    """Per asset: which event types exist, hashed events, order, key timestamps."""
    kind = F.col("event_type")
    stamp = lambda name: F.min(F.when(kind == name, F.col("timestamp")))
    per_asset = events.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.bool_or(kind == "upload").alias("has_upload"),
        F.bool_or(kind == "certificate_issued").alias("has_certificate_event"),
        F.bool_or(kind == "watermark").alias("has_watermark"),
        F.count_if(F.coalesce("event_hash", F.lit("")) != "").alias("hashed_events"),
        stamp("upload").alias("first_upload"),
        stamp("certificate_issued").alias("first_certificate_event"),
    )
    return per_asset.join(timeline.chronology_check(events), "asset_id", "left")


def provenance_continuity(
    assets: DataFrame, events: DataFrame, certs: DataFrame, contributors: DataFrame
) -> DataFrame:
    """Score 0..1 of the documented chain, with the gaps."""
    counted = certs.groupBy("asset_id").agg(F.count(F.lit(1)).alias("total_certificates"))
    rights = facts.ownership_totals(assets, contributors).select("asset_id", "ownership_declared")
    joined = (
        assets.select("asset_id", "sha256", "second_fingerprint", "phash", "manifest_path")
        .join(event_facts(events), "asset_id", "left")
        .join(counted, "asset_id", "left")
        .join(rights, "asset_id")
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    given = lambda name: F.coalesce(F.col(name) != "", F.lit(False))
    total = F.coalesce("total_events", F.lit(0))
    certified = yes(F.col("has_certificate_event")) | F.col("total_certificates").isNotNull()
    two = given("sha256") & given("second_fingerprint")
    three = two & given("phash")
    hashed = F.col("hashed_events") / F.col("total_events")
    ordered = yes(F.col("chronological"))
    w = {name: F.lit(value) for name, value in WEIGHTS.items()}
    parts = [
        F.when(yes(F.col("has_upload")), w["upload_event"]),
        F.when(certified, w["certificate_event"]),
        F.when(three, w["all_hashes"]).when(two, w["all_hashes"] * PARTIAL_HASHES),
        F.when(yes(F.col("has_watermark")), w["watermark_event"]),
        F.when(given("manifest_path"), w["manifest_present"]),
        F.when(F.col("ownership_declared"), w["ownership_declared"]),
        F.when(total > 0, w["event_integrity"] * hashed),
        F.when(ordered, w["chain_continuous"]),
    ]
    score = F.lit(0.0)
    for part in parts:
        score = score + F.coalesce(part, F.lit(0.0))
    gaps = F.array(
        F.when(~yes(F.col("has_upload")), F.lit("upload_event")),
        F.when(~certified, F.lit("certificate_event")),
        F.when(~two, F.lit("hashes")).when(~three, F.lit("perceptual_hash")),
        F.when(~given("manifest_path"), F.lit("manifest")),
        F.when(~F.col("ownership_declared"), F.lit("ownership")),
        F.when((total > 0) & (F.col("hashed_events") < total), F.lit("event_hashes")),
        F.when((F.col("timestamped_events") > 0) & ~ordered, F.lit("event_order")),
    )
    label = F
    for name, least in LABELS:
        label = label.when(F.col("continuity_score") >= least, name)
    return joined.select(
        "asset_id",
        text.rounded(F.least(F.lit(1.0), score), 4).alias("continuity_score"),
        F.filter(gaps, lambda g: g.isNotNull()).alias("gaps"),
        total.alias("total_events"),
        F.coalesce("total_certificates", F.lit(0)).alias("total_certificates"),
        "first_upload",
        "first_certificate_event",
    ).withColumn("continuity_label", label.otherwise("insufficient"))


def contributor_declaration() -> Column:
    creative = F.col("creative_contribution_pct")
    stated = F.when(creative.isNull(), F.lit("undeclared")).otherwise(F.concat(creative.cast("string"), F.lit("%")))
    return F.concat(
        F.lit("contributor="),
        F.coalesce("name", F.lit("")),
        F.lit(";role="),
        F.coalesce("role", F.lit("undeclared")),
        F.lit(";creative="),
        stated,
        F.lit("."),
    )


def human_contributors(contributors: DataFrame) -> DataFrame:
    """Human contributor rows with their declaration text."""
    return (
        facts.contributor_facts(contributors)
        .where("contribution_type = 'human'")
        .withColumn("declares", contributor_declaration())
    )


def copyright_report(
    assets: DataFrame, events: DataFrame, certs: DataFrame, contributors: DataFrame
) -> DataFrame:
    """One report row per asset.

    Lineage steps, chain steps and contributor rows are the child tables of
    ``lineage_steps``, ``transformation_chain`` and ``human_contributors``.
    """
    fact_rows = facts.canonical_facts(assets, contributors)
    continuity = provenance_continuity(assets, events, certs, contributors)
    latest = certificates.latest_certificate(certs).select(
        "asset_id",
        F.col("cert_id").alias("latest_cert_id"),
        F.col("certificate_class").alias("latest_certificate_class"),
        "first_issued_at",
        "latest_issued_at",
    )
    humans = (
        facts.contributor_facts(contributors)
        .groupBy("asset_id")
        .agg(F.count_if(F.col("contribution_type") == "human").alias("human_contributors"))
    )
    notes = assets.select("asset_id", "created_at", asset_scores.disclosure_note().alias("disclosure_note"))
    return (
        fact_rows.join(notes, "asset_id")
        .join(continuity, "asset_id")
        .join(latest, "asset_id", "left")
        .join(humans, "asset_id", "left")
        .select(
            "asset_id",
            F.lit("copyright_readiness_report").alias("report_type"),
            F.struct("identity", "trust", "ai", "rights", "copyright_readiness").alias("stored_facts"),
            "disclosure_note",
            F.coalesce("human_contributors", F.lit(0)).alias("human_contributors"),
            F.struct(
                text.iso_plain(F.col("created_at")).alias("asset_created_at"),
                text.iso_plain(F.col("first_upload")).alias("first_upload_event"),
                text.iso_plain(F.col("first_issued_at")).alias("first_certificate_issued"),
                text.iso_plain(F.col("latest_issued_at")).alias("latest_certificate_issued"),
                text.iso_plain(F.col("first_certificate_event")).alias("first_certificate_event"),
                F.col("total_events"),
                F.col("total_certificates"),
            ).alias("timestamps"),
            F.struct("latest_cert_id", "latest_certificate_class").alias("ownership_certificate"),
            F.struct("continuity_score", "continuity_label", "gaps").alias("provenance_continuity"),
        )
    )
