"""Forensic signals per asset and the review verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators import aggregates


def _known(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def forensic_signals(
    assets: DataFrame,
    anomalies: DataFrame,
    credentials: DataFrame,
    sessions: DataFrame,
    observations: DataFrame,
) -> DataFrame:
    """One row per asset with the state and risk of every evidence source.

    Children are already one row per asset, or are aggregated to it before the
    join.  ``sessions`` is the public summary; ``observations`` are normalised.
    """
    detectors = aggregates.detector_summary(observations).select(
        "asset_id", "provider_count", "observation_count", "highest_risk"
    )
    primary = aggregates.strongest_detector(assets, observations).select(
        "asset_id",
        F.col("available").alias("synthetic_available"),
        F.col("probability").alias("synthetic_probability"),
        F.col("risk").alias("synthetic_risk"),
    )
    joined = (
        assets.select("asset_id", "watermark_applied", "watermark_visible", "watermark_invisible")
        .join(anomalies.select("asset_id", "anomaly_score"), "asset_id", "left")
        .join(
            credentials.select("asset_id", "validation_state", "manifest_present", "validation_error_count"),
            "asset_id",
            "left",
        )
        .join(
            sessions.select("asset_id", F.col("status").alias("session_status"), "chain_valid"), "asset_id", "left"
        )
        .join(detectors, "asset_id", "left")
        .join(primary, "asset_id")
    )
    score, state = F.col("anomaly_score"), F.coalesce("validation_state", F.lit("unknown"))
    session, valid = F.col("session_status"), F.col("chain_valid")
    return joined.select(
        "asset_id",
        score.isNotNull().alias("metadata_available"),
        "anomaly_score",
        F.when(score.isNull(), "unknown").when(score >= 60, "high").when(score >= 30, "elevated").otherwise("low").alias(
            "metadata_risk"
        ),
        # a missing source file keeps its own state, which counts as available
        (~state.isin("sdk_unavailable", "read_error", "unknown")).alias("credentials_available"),
        state.alias("credentials_state"),
        F.when(state == "invalid", "high")
        .when(state.isin("read_error", "sdk_unavailable"), "unknown")
        .when(F.col("validation_state").isNull(), "unknown")
        .when(_known(~F.col("manifest_present")), "neutral")
        .otherwise("low")
        .alias("credentials_risk"),
        F.coalesce(
            F.col("watermark_applied"), F.col("watermark_visible"), F.col("watermark_invisible")
        ).isNotNull().alias("watermark_available"),
        F.when(_known(F.col("watermark_applied")), "low").otherwise("neutral").alias("watermark_risk"),
        session.isNotNull().alias("session_available"),
        F.when(session.isNull(), "neutral")
        .when(_known(~valid) | (session == "integrity_failed"), "high")
        .when((session == "complete") & _known(valid), "low")
        .otherwise("elevated")
        .alias("session_risk"),
        F.coalesce("observation_count", F.lit(0)).alias("observation_count"),
        F.coalesce("provider_count", F.lit(0)).alias("provider_count"),
        F.coalesce("highest_risk", F.lit("unknown")).alias("detector_risk"),
        "synthetic_available",
        "synthetic_probability",
        "synthetic_risk",
    )


def forensic_verdict(signals: DataFrame) -> DataFrame:
    """Review priority with its reasons; sources are never averaged."""
    observed = F.col("observation_count") > 0

    def reasons(level: str, checks: list[tuple[Column, str]]) -> Column:
        return F.filter(F.array(*[F.when(c, F.lit(f"{name}_{level}")) for c, name in checks]), lambda r: r.isNotNull())

    def detector(level: str) -> list[tuple[Column, str]]:
        return [
            (observed & (F.col("detector_risk") == level), "detector_probability"),
            (~observed & (F.col("synthetic_risk") == level), "synthetic_probability"),
        ]

    high = reasons(
        "high",
        [
            (F.col("credentials_risk") == "high", "content_credentials"),
            (F.col("session_risk") == "high", "session_chain"),
            (F.col("metadata_risk") == "high", "metadata_anomaly"),
            *detector("high"),
        ],
    )
    elevated = reasons(
        "elevated",
        [
            (F.col("metadata_risk") == "elevated", "metadata_anomaly"),
            *detector("elevated"),
            (F.col("session_risk") == "elevated", "session_evidence"),
        ],
    )
    nothing = ~(
        F.col("metadata_available")
        | observed
        | F.col("synthetic_available")
        | F.col("credentials_available")
        | F.col("session_available")
    )
    return (
        signals.withColumn("__high", high)
        .withColumn("__elevated", elevated)
        .withColumn(
            "verdict",
            F.when(F.size("__high") > 0, "high_review_priority")
            .when(F.size("__elevated") > 0, "review_recommended")
            .when(nothing, "insufficient_evidence")
            .otherwise("no_major_flags"),
        )
        .withColumn(
            "reasons",
            F.when(F.size("__high") > 0, F.col("__high"))
            .when(F.size("__elevated") > 0, F.col("__elevated"))
            .when(nothing, F.array(F.lit("no_evidence_available")))
            .otherwise(F.array(F.lit("no_conflicts_found"))),
        )
        .drop("__high", "__elevated")
    )
