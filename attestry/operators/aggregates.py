"""Counts, sheets, counters, detector and session rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import detectors, text

SPLIT_TOLERANCE = 0.01
# Check types that count as a verification of an asset.
COUNTED_CHECKS = ["file_hash", "asset_id"]


def evidence_class_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("asset_id", "evidence_class").agg(F.count(F.lit(1)).alias("node_count"))


def _percentage_fault(name: str) -> Column:
    given = F.coalesce(text.stripped(F.col(name)), F.lit(""))
    number = text.as_number(F.col(name))
    return F.when(given == "", F.lit(None)).when(number.isNull(), F.lit(f"invalid {name}")).when(
        ~number.between(0, 100), F.lit(f"{name}_range")
    )


def split_sheet_validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason), one row per sheet.

    The first faulty contributor by position decides; then every row needs an
    ownership share, and shares must total 100.
    """
    ownership = F.col("ownership_split_pct")
    if "split_percentage" in rows.columns:
        ownership = F.coalesce(ownership, F.col("split_percentage"))
    fault = F.coalesce(
        F.when(text.clean_text(F.col("sheet_name")).isNull(), F.lit("name_missing")),
        _percentage_fault("creative_contribution_pct"),
        _percentage_fault("ownership_split_pct"),
        _percentage_fault("ai_assisted_pct"),
    )
    sheets = (
        rows.withColumn("fault", fault)
        .withColumn("share", text.as_number(ownership))
        .groupBy("sheet_id")
        .agg(
            F.count(F.lit(1)).alias("contributor_count"),
            F.count("share").alias("declared"),
            F.sum("share").alias("total"),
            F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("position"))).alias("fault"),
            F.min(F.when(F.col("fault").isNotNull(), F.col("position"))).alias("at"),
        )
    )
    reason = (
        F.when(
            F.col("fault").isNotNull(),
            F.concat(F.lit("contributor "), F.col("at").cast("string"), F.lit(" "), F.col("fault")),
        )
        .when(F.col("declared") != F.col("contributor_count"), F.lit("split_missing"))
        .when(F.abs(F.col("total") - 100.0) > SPLIT_TOLERANCE, F.lit("split_total"))
    )
    judged = sheets.select(
        "sheet_id", "contributor_count", text.rounded(F.col("total"), 4).alias("total"), reason.alias("reason")
    )
    return judged.where("reason is null"), judged.where("reason is not null")


def verification_counter_check(counters: DataFrame, logs: DataFrame) -> DataFrame:
    counted = (
        logs.where(F.col("check_type").isin(COUNTED_CHECKS))
        .groupBy("asset_id")
        .agg(F.count(F.lit(1)).alias("log_count"))
    )
    stored = F.coalesce("total_verifications", F.lit(0))
    found = F.coalesce("log_count", F.lit(0))
    return counters.join(counted, "asset_id", "left").select(
        "asset_id",
        stored.alias("stored_total"),
        found.alias("log_count"),
        F.when(stored == found, "pass").otherwise("fail").alias("status"),
    )


def detector_summary(observations: DataFrame) -> DataFrame:
    """Per asset; probabilities are never averaged, so there is no consensus.

    The provider set is a small dimension and is merged before the shuffle.
    """
    rank = F.max(detectors.risk_rank(F.col("risk")))
    return observations.groupBy("asset_id").agg(
        F.array_sort(F.collect_set("provider")).alias("providers"),
        F.count(F.lit(1)).alias("observation_count"),
        F.when(rank == 2, "high").when(rank == 1, "elevated").otherwise("low").alias("highest_risk"),
    ).withColumns({"provider_count": F.size("providers"), "consensus_score": F.lit(None).cast("double")})


def strongest_detector(assets: DataFrame, observations: DataFrame) -> DataFrame:
    """Primary synthetic signal: the legacy score, else the strongest observation."""
    best = observations.groupBy("asset_id").agg(
        F.min_by(
            F.struct("probability", "provider", "model", "signal"),
            F.struct(-F.col("probability"), "observed_at", "observation_id"),
        ).alias("best")
    )
    legacy = F.col("ai_detection_score").isNotNull()
    band = detectors.risk_band(F.coalesce("ai_detection_score", "best.probability"))
    return assets.select("asset_id", "ai_detection_score").join(best, "asset_id", "left").select(
        "asset_id",
        (legacy | F.col("best").isNotNull()).alias("available"),
        band["probability"].alias("probability"),
        band["pct"].alias("probability_pct"),
        F.coalesce(band["risk"], F.lit("unknown")).alias("risk"),
        F.when(legacy, "sightengine").otherwise(F.col("best.provider")).alias("provider"),
        F.when(legacy, "genai").otherwise(F.col("best.model")).alias("model"),
        F.when(legacy, "legacy_primary_detector_probability").otherwise(F.col("best.signal")).alias("signal"),
    )


PAYLOAD_SCHEMA = (
    "checkpoint string, workflow string, daw_name string, production_environment string, "
    "connected_production_hardware array<struct<name: string, category: string>>, "
    "process_only_environments array<string>, source_asset_uid string, source_ai_disclosure string, "
    "source_ai_detection_score double, source_content_label string, history_mutated boolean, "
    "transformations array<string>, statement string, final_provenance_disclosure string"
)


def with_payload(events: DataFrame) -> DataFrame:
    return events.withColumn("p", F.from_json("payload", PAYLOAD_SCHEMA))


def session_evidence_rollup(events: DataFrame, workflows: list[str]) -> DataFrame:
    """Per session: counts of automatic checkpoints and the last declared facts."""
    at = F.struct("sequence", "event_id")
    point = F.col("p.checkpoint")
    last = lambda value, cond: F.max_by(value, F.when(cond, at))
    declared = (point == "human_transformation_declared") & F.col("p.transformations").isNotNull()
    stated = (point == "human_transformation_declared") & F.col("p.statement").isNotNull()
    disclosed = (F.col("event_type") == "ai_tool_disclosed") & F.col("p.final_provenance_disclosure").isNotNull()
    is_start = F.col("event_type") == "session_started"
    environment = F.coalesce("p.daw_name", "p.production_environment", "source_name")
    lineage = F.struct(
        "p.source_asset_uid",
        "p.source_ai_disclosure",
        "p.source_ai_detection_score",
        "p.source_content_label",
        F.coalesce(~F.col("p.history_mutated"), F.lit(False)).alias("history_preserved"),
    )
    rolled = with_payload(events).groupBy("session_id").agg(
        F.min_by(F.struct(F.col("p.workflow").alias("workflow"), environment.alias("environment")), F.when(is_start, at)).alias(
            "start"
        ),
        F.count_if(point == "automatic_project_revision").alias("automatic_revisions"),
        F.count_if(point == "automatic_audio_export").alias("automatic_exports"),
        F.count_if(F.col("event_type").isin("contributor_declared", "contributor_attested")).alias(
            "contributor_declarations"
        ),
        F.coalesce(F.bool_or(point == "automatic_project_detected"), F.lit(False)).alias("automatic_project_detected"),
        last(lineage, point == "source_asset_linked").alias("source_lineage"),
        last(F.col("p.transformations"), declared).alias("transformations"),
        last(F.col("p.statement"), stated).alias("statement"),
        last(F.col("p.final_provenance_disclosure"), disclosed).alias("final_provenance_disclosure"),
    )
    return rolled.select(
        "session_id",
        F.when(F.col("start.workflow").isin(workflows), F.col("start.workflow")).alias("workflow"),
        F.col("start.environment").alias("production_environment"),
        "automatic_project_detected",
        "automatic_revisions",
        "automatic_exports",
        "contributor_declarations",
        (F.col("source_lineage").isNotNull() & (F.coalesce(F.size("transformations"), F.lit(0)) > 0)).alias("verified"),
        "source_lineage",
        "transformations",
        "statement",
        "final_provenance_disclosure",
    )


def first_seen_distinct(events: DataFrame, items: Column, key: list[str]) -> DataFrame:
    """Distinct items of a session's array column with where each was first seen.

    Duplicates are removed before the shuffle; (first_sequence, first_pos)
    gives the first-seen order.
    """
    return (
        events.select("session_id", "sequence", F.posexplode(items).alias("pos", "item"))
        .select("session_id", F.struct("sequence", "pos").alias("seen"), "item.*")
        .groupBy("session_id", *key)
        .agg(F.min("seen").alias("seen"))
        .select("session_id", *key, F.col("seen.sequence").alias("first_sequence"), F.col("seen.pos").alias("first_pos"))
    )


def hardware_items() -> Column:
    """Named hardware of a parsed payload; the category has a default."""
    named = F.filter("p.connected_production_hardware", lambda h: text.clean_text(h["name"]).isNotNull())
    return F.transform(
        named,
        lambda h: F.struct(
            text.stripped(h["name"]).alias("name"),
            F.coalesce(h["category"], F.lit("production_hardware")).alias("category"),
        ),
    )


def app_items() -> Column:
    named = F.filter("p.process_only_environments", lambda a: text.clean_text(a).isNotNull())
    return F.transform(named, lambda a: F.struct(text.stripped(a).alias("name")))


def set_gap(df: DataFrame, keys: list[str], value: str, expected: list[str], everyone: DataFrame) -> DataFrame:
    """Expected values that each key of ``everyone`` or ``df`` never shows, sorted.

    Only the expected values can matter, so at most that many are kept per key.
    """
    wanted = F.array(*[F.lit(e) for e in expected])
    rows = df.select(*keys, value).unionByName(everyone.select(*keys, F.lit(None).cast("string").alias(value)))
    seen = rows.groupBy(*keys).agg(
        F.collect_set(F.when(F.col(value).isin(expected), F.col(value))).alias("seen")
    )
    return seen.select(*keys, F.array_sort(F.array_except(wanted, F.col("seen"))).alias("missing"))
