"""Ordered views over provenance events and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.operators import ordering
from attestry.operators.facts import HUMAN_FORMS

# Labels of the declared human forms.
FORM_LABELS = {
    "creative_direction": "human:creative_direction",
    "editing": "human:editing",
    "arrangement": "human:arrangement",
    "lyrics": "human:lyrics",
    "performance": "human:performance",
    "transformation": "human:transformation",
}
EVENT_ID_BLOCK = 65536


def latest_per_key(observations: DataFrame, latest_only: bool = True) -> DataFrame:
    """Latest observation per asset, provider, model and signal, or the full history."""
    if not latest_only:
        return observations
    return ordering.first_per_key(
        observations,
        ["asset_id", "provider", "model", "signal"],
        [F.col("observed_at").desc_nulls_last(), F.col("observation_id").desc()],
    )


def first_last_event(events: DataFrame, event_type: str, which: str, fields: list[str]) -> DataFrame:
    """First or last event of one type per session."""
    pick = F.min_by if which == "first" else F.max_by
    return (
        events.where(F.col("event_type") == event_type)
        .groupBy("session_id")
        .agg(pick(F.struct(*fields), F.struct("sequence", "event_id")).alias("event"))
        .select("session_id", "event.*")
    )


def lineage_steps(events: DataFrame) -> DataFrame:
    """Provenance events numbered by time."""
    return ordering.numbered(events, ["asset_id"], [F.col("timestamp"), F.col("event_id")], "step")


def chronology_check(events: DataFrame) -> DataFrame:
    """Per asset: do the non-null timestamps never decrease in recorded order?"""
    stepped = ordering.ordered(
        events.where("timestamp is not null").select("asset_id", "event_id", "timestamp"),
        ["asset_id"],
        F.floor(F.col("event_id") / EVENT_ID_BLOCK),
        [F.col("event_id")],
        previous={"before": F.col("timestamp")},
    )
    return stepped.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("timestamped_events"),
        F.bool_and(F.col("before").isNull() | (F.col("before") <= F.col("timestamp"))).alias("chronological"),
    )


def transformation_chain(assets: DataFrame, events: DataFrame) -> DataFrame:
    """Declared forms, watermark events and human AI modification as ordered rows."""
    forms = F.array(
        *[
            F.when(
                F.col(column),
                F.struct(F.lit(at).alias("step"), F.lit(form).alias("form"), F.lit(FORM_LABELS[form]).alias("label")),
            )
            for at, (form, column) in enumerate(HUMAN_FORMS.items(), start=1)
        ]
    )
    declared = assets.select(
        "asset_id", F.explode(F.filter(forms, lambda s: s.isNotNull())).alias("s")
    ).select(
        "asset_id",
        F.lit(1).alias("section"),
        "s.step",
        F.lit("declared_human").alias("step_type"),
        "s.form",
        "s.label",
        F.lit(None).cast("string").alias("tool"),
        F.lit(None).cast("string").alias("timestamp"),
        F.lit("creator_declaration").alias("source"),
    )
    marks = lineage_steps(events.where("event_type = 'watermark'")).select(
        "asset_id",
        F.lit(2).alias("section"),
        "step",
        F.lit("system_transformation").alias("step_type"),
        F.lit("watermark").alias("form"),
        F.coalesce(F.nullif("description", F.lit("")), F.lit("watermark")).alias("label"),
        F.col("tool_used").alias("tool"),
        text.iso_plain(F.col("timestamp")).alias("timestamp"),
        F.lit("provenance_event").alias("source"),
    )
    marks = marks.join(assets.select("asset_id"), "asset_id", "left_semi")
    modified = assets.where("ai_modification_by_human").select(
        "asset_id",
        F.lit(3).alias("section"),
        F.lit(1).alias("step"),
        F.lit("declared_human").alias("step_type"),
        F.lit("ai_modification").alias("form"),
        F.lit("ai_output_modified").alias("label"),
        F.lit(None).cast("string").alias("tool"),
        F.lit(None).cast("string").alias("timestamp"),
        F.lit("creator_declaration").alias("source"),
    )
    return declared.unionByName(marks).unionByName(modified)
