"""AI disclosure, locations and lists of declared names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.functions.media import literal_map

# Disclosure values and aliases.
DISCLOSURES = ["human", "ai_assisted", "ai_generated", "unknown"]
DISCLOSURE_ALIASES = {"ai": "ai_generated", "mixed": "ai_assisted", "assisted": "ai_assisted"}

LOCATION_LEVELS = ["none", "coarse", "precise_private"]

# Transformations a creator can declare.
TRANSFORMATIONS = [
    "re_recorded",
    "replayed",
    "rearranged",
    "edited",
    "lyrics_rewritten",
    "vocals_replaced",
    "instrumentation_replaced",
    "mix_rebuilt",
    "sound_design",
    "timing_changed",
    "pitch_changed",
    "structure_changed",
    "other",
]

# Evidence fields a creator can publish.
PUBLIC_FIELDS = [
    "production_environment",
    "connected_production_hardware",
    "additional_production_apps",
    "source_asset_uid",
    "transformation_statement",
]


def trimmed_names(col: Column) -> Column:
    """Trimmed, non-blank entries of an array, in order."""
    return F.filter(
        F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: text.stripped(x)),
        lambda x: F.coalesce(x != "", F.lit(False)),
    )


def normalize_ai_disclosure(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected with reason) from ai_disclosure_raw, is_ai_generated and ai_tools."""
    given = F.lower(text.clean_text(F.col("ai_disclosure_raw")))
    named = F.coalesce(F.try_element_at(literal_map(DISCLOSURE_ALIASES), given), given)
    tools = trimmed_names(F.col("ai_tools"))
    has_tools = F.size(tools) > 0
    flag = F.col("is_ai_generated")
    implied = (
        F.when(flag, F.lit("ai_generated"))
        .when(has_tools, F.lit("ai_assisted"))
        .when(~flag, F.lit("human"))
    )
    value = F.when(given.isNotNull(), named).otherwise(implied)
    reason = (
        F.when(~named.isin(DISCLOSURES), F.lit("unsupported ai_disclosure"))
        .when((value == "human") & has_tools, F.lit("human contradicts declared AI tools"))
        .when((value == "unknown") & has_tools, F.lit("unknown contradicts declared AI tools"))
    )
    judged = df.withColumns({"value": value, "tools": tools, "reason": reason})
    known = F.col("value").isin("human", "ai_assisted", "ai_generated")
    ok = judged.where("reason is null").select(
        *[c for c in df.columns],
        F.col("value").alias("disclosure"),
        F.when(known, F.col("value") == "ai_generated").alias("is_generated"),
        F.when(known, F.col("value") == "ai_assisted").alias("is_assisted"),
        F.coalesce(F.col("value").isin("ai_assisted", "ai_generated"), F.lit(False)).alias("is_disclosed"),
        "tools",
    )
    return ok, judged.where("reason is not null").select(*df.columns, "reason")


def location_check(location: Column) -> Column:
    """struct(ok, reason) of a location map."""
    level = F.coalesce(F.try_element_at(location, F.lit("level")), F.lit("none"))
    placed = F.map_contains_key(location, "latitude") & F.map_contains_key(location, "longitude")
    reason = F.when(
        ~level.isin(LOCATION_LEVELS), F.lit("location_level_unknown")
    ).when(
        (level == "precise_private") & ~placed,
        F.lit("location_place_missing"),
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def _unknown(name: str, allowed: list[str]) -> Column:
    return F.array_except(name, F.array(*[F.lit(a) for a in allowed]))


def opt_in_fields(settings: DataFrame, allowed: list[str] = PUBLIC_FIELDS) -> DataFrame:
    """Sorted distinct published fields; ``unsupported`` names the first unknown one."""
    fields = F.array_sort(F.array_distinct(trimmed_names(F.col("fields"))))
    return settings.withColumn("fields", fields).withColumn(
        "unsupported", F.try_element_at(_unknown("fields", allowed), F.lit(1))
    )


def published(field: str, value: Column, hidden: Column | None = None) -> Column:
    """``value`` if the creator opted in, else null (or ``hidden``)."""
    shown = F.array_contains("fields", field)
    return F.when(shown, value) if hidden is None else F.when(shown, value).otherwise(hidden)


def transformation_declare(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected with reason) of declared transformation lists."""
    names = F.array_distinct(F.transform(trimmed_names(F.col("transformations")), lambda x: F.lower(x)))
    first_unknown = F.try_element_at(_unknown("transformations", TRANSFORMATIONS), F.lit(1))
    judged = df.withColumn("transformations", names).withColumn(
        "reason",
        F.when(F.size("transformations") == 0, F.lit("at least one transformation is required")).when(
            first_unknown.isNotNull(), F.concat(F.lit("unsupported transformation: "), first_unknown)
        ),
    )
    ok = judged.where("reason is null").drop("reason")
    return ok, judged.where("reason is not null")
