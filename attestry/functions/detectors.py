"""Detector probabilities: clamp, bands, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text

HIGH, ELEVATED = 0.80, 0.50


def risk_name(probability: Column) -> Column:
    return (
        F.when(probability >= HIGH, "high").when(probability >= ELEVATED, "elevated").when(probability.isNotNull(), "low")
    )


def risk_rank(risk: Column) -> Column:
    return F.when(risk == "high", 2).when(risk == "elevated", 1).otherwise(0)


def risk_band(probability: Column) -> Column:
    """struct(probability, pct, risk) of a clamped probability."""
    p = text.clamp01(probability)
    return F.when(
        probability.isNotNull(),
        F.struct(
            text.rounded(p, 4).alias("probability"),
            text.rounded(p * 100, 2).alias("pct"),
            risk_name(p).alias("risk"),
        ),
    )


def normalize_observations(observations: DataFrame, lower_provider: bool = False) -> DataFrame:
    """Rows with a numeric probability and non-blank provider, model and signal.

    A stored observation has a lower-case provider; an ad-hoc report keeps it.
    """
    provider = text.clean_text(F.col("provider"))
    cleaned = observations.withColumns(
        {
            "provider": F.lower(provider) if lower_provider else provider,
            "model": text.clean_text(F.col("model")),
            "signal": text.clean_text(F.col("signal")),
            "band": risk_band(text.as_number(F.col("probability"))),
            "status": F.coalesce(text.clean_text(F.col("status")), F.lit("available")),
            "details": F.when(
                F.schema_of_variant(F.try_parse_json("details")).startswith("OBJECT"), F.col("details")
            ).otherwise(F.lit("{}")),
        }
    ).where("band is not null and provider is not null and model is not null and signal is not null")
    return (
        cleaned.withColumn("probability", F.col("band.probability"))
        .withColumn("probability_pct", F.col("band.pct"))
        .withColumn("risk", F.col("band.risk"))
        .drop("band")
    )
