"""Nested detector responses and content-credential stores, row by row.

A document is one row, so its classes, statuses and actions are read inside it:
no explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.functions.tags import levels_of

# Generator classes an attribution may name.
GENERATORS = [
    "ace_step",
    "duobao",
    "google",
    "heartmula",
    "loudly",
    "minimax",
    "mubert",
    "mureka",
    "musicgen",
    "riffusion",
    "stable_audio_open",
    "suno",
    "udio",
    "yue",
]


NODE = "array<struct<at: string, members: map<string, variant>, items: array<variant>>>"
OBJECT = "array<struct<at: string, class: string, score: string, rows: int>>"


def _opened(at: Column, value: Column) -> Column:
    """A value with its members or items, each taken out once; a scalar has neither."""
    get = F.try_variant_get
    return F.struct(
        at.alias("at"),
        get(value, "$", "map<string, variant>").alias("members"),
        get(value, "$", "array<variant>").alias("items"),
    )


def _children(nodes: Column) -> Column:
    """Objects and lists below those of a level, with places that sort in document order."""

    def inner(n: Column) -> Column:
        step = lambda i: F.concat(n["at"], F.lpad(i.cast("string"), 9, "0"))
        return F.transform(F.coalesce(F.map_values(n["members"]), n["items"]), lambda v, i: _opened(step(i), v))

    return _containers(F.flatten(F.transform(nodes, inner)))


def _containers(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n["members"].isNotNull() | n["items"].isNotNull())


def _objects(nodes: Column) -> Column:
    """Class, score and number of output rows of a level's objects that have any."""
    get = F.try_variant_get
    member = lambda n, name, kind: get(F.try_element_at(n["members"], F.lit(name)), "$", kind)
    is_object = lambda v: get(v, "$", "map<string, variant>").isNotNull()
    read = F.transform(
        F.filter(nodes, lambda n: n["members"].isNotNull()),
        lambda n: F.struct(
            n["at"].alias("at"),
            member(n, "class", "string").alias("class"),
            member(n, "score", "string").alias("score"),
            F.greatest(F.lit(0), F.size(F.filter(member(n, "output", "array<variant>"), is_object))).alias("rows"),
        ),
    )
    return F.filter(read, lambda o: (o["rows"] > 0) | (o["class"].isNotNull() & o["score"].isNotNull()))


def parse_response(responses: DataFrame, col: str = "response") -> DataFrame:
    """Add ``segments``, the number of output rows, and ``classes`` (class, score) in document order.

    A class row is any object with a class and a score; an output row is any
    object in a list named output, at any depth.  One fold opens a document level
    by level, as often as this document is deep; members of one object are
    visited by name.  Scalars leave the fold at once.
    """
    root = _containers(F.array(_opened(F.lit(""), F.try_parse_json(col)))).cast(NODE)
    walked = F.aggregate(
        levels_of(F.col(col)),
        F.struct(root.alias("level"), F.array().cast(OBJECT).alias("objects")),
        lambda at, _: F.struct(
            _children(at["level"]).alias("level"),
            F.concat(at["objects"], _objects(at["level"])).alias("objects"),
        ),
    )
    opened = responses.withColumn("__objects", walked["objects"])
    segments = F.aggregate("__objects", F.lit(0), lambda total, o: total + o["rows"])
    found = F.sort_array(F.filter("__objects", lambda o: o["class"].isNotNull() & o["score"].isNotNull()))
    numbers = F.transform(
        found,
        lambda c: F.struct(F.lower(text.stripped(c["class"])).alias("class"), text.as_number(c["score"]).alias("score")),
    )
    scored = F.transform(
        numbers,
        lambda c: F.struct(c["class"].alias("class"), F.when(c["score"].isNotNull(), text.clamp01(c["score"])).alias("score")),
    )
    return opened.withColumn("segments", segments).withColumn("classes", scored).drop("__objects")


def class_max(name: str) -> Column:
    """Highest clamped score of one class, null when none is numeric."""
    own = F.filter("classes", lambda c: c["class"] == name)
    return F.array_max(F.transform(own, lambda c: c["score"]))


def segment_count() -> Column:
    return F.col("segments")


def class_max_score(responses: DataFrame, name: str) -> DataFrame:
    return parse_response(responses).withColumns(
        {"probability": class_max(name), "segment_count": segment_count()}
    ).drop("segments", "classes")


def attribution() -> Column:
    """struct(class, score) of the best generator class; the first wins ties."""
    ranked = F.transform(
        "classes",
        lambda c, at: F.when(
            c["class"].isin(GENERATORS) & c["score"].isNotNull(),
            F.struct(c["score"].alias("score"), (-at).alias("at"), c["class"].alias("class")),
        ),
    )
    best = F.array_max(ranked)
    return F.when(
        best.isNotNull(),
        F.struct(best["class"].alias("class"), text.rounded(best["score"], 6).alias("score")),
    )


def top_attribution(responses: DataFrame) -> DataFrame:
    return parse_response(responses).withColumn("attribution", attribution()).drop("segments", "classes")


def music_observations(responses: DataFrame) -> DataFrame:
    """Music and cover observations, one row each, sharing count and attribution."""
    kinds = F.array(
        *[
            F.struct(
                F.lit("hive").alias("provider"),
                F.lit(model).alias("model"),
                F.lit(signal).alias("signal"),
                class_max(model).alias("probability"),
            )
            for model, signal in (
                ("ai_generated_music", "synthetic_music_probability"),
                ("ai_generated_music_cover", "synthetic_music_cover_probability"),
            )
        ]
    )
    parsed = parse_response(responses).withColumns(
        {"segment_count": segment_count(), "attribution": attribution(), "kinds": kinds}
    )
    return (
        parsed.withColumn("kind", F.explode(F.filter("kinds", lambda k: k["probability"].isNotNull())))
        .select(
            *[c for c in responses.columns if c != "response"],
            "kind.*",
            F.lit("available").alias("status"),
            "segment_count",
            "attribution",
        )
    )


# --- content-credential stores ------------------------------------------------

STATUSES = "array<variant>"
MANIFEST = (
    "struct<claim_generator: string, claimGenerator: string, title: string, format: string, "
    "instance_id: string, instanceId: string, ingredients: array<variant>, "
    "assertions: array<struct<label: string, data: struct<actions: array<variant>>>>, "
    "validation_status: array<variant>, "
    "validation_results: struct<activeManifest: variant, active_manifest: variant>>"
)
STORE_SCHEMA = (
    "active_manifest string, activeManifest string, validation_status array<variant>, "
    "validation_results struct<activeManifest: variant, active_manifest: variant>, "
    f"manifests map<string, {MANIFEST}>"
)


def parse_store(stores: DataFrame, col: str = "store") -> DataFrame:
    """Add the parsed store, the active label and the active manifest."""
    parsed = stores.withColumn("__store", F.from_json(col, STORE_SCHEMA))
    label = F.coalesce(
        F.nullif(F.col("__store.active_manifest"), F.lit("")), F.nullif(F.col("__store.activeManifest"), F.lit(""))
    )
    return parsed.withColumn("active_label", label).withColumn(
        "active", F.try_element_at(F.col("__store.manifests"), F.col("active_label"))
    )


def _statuses(items: Column) -> Column:
    """Normalised status structs of one list; texts become {code}."""
    get = F.try_variant_get
    shaped = F.transform(
        F.coalesce(items, F.array().cast(STATUSES)),
        lambda v: F.when(
            F.schema_of_variant(v) == "STRING",
            F.struct(
                get(v, "$", "string").alias("code"),
                F.lit(None).cast("boolean").alias("success"),
                F.lit(None).cast("string").alias("explanation"),
                F.lit(None).cast("string").alias("url"),
            ),
        ).when(
            F.schema_of_variant(v).startswith("OBJECT"),
            F.struct(
                get(v, "$.code", "string").alias("code"),
                get(v, "$.success", "boolean").alias("success"),
                get(v, "$.explanation", "string").alias("explanation"),
                get(v, "$.url", "string").alias("url"),
            ),
        ),
    )
    return F.filter(shaped, lambda s: s.isNotNull())


def _results(results: Column) -> list[Column]:
    """The lists of one validation_results block: a plain list, or three named ones."""
    active = F.coalesce(results["activeManifest"], results["active_manifest"])
    part = lambda path: F.try_variant_get(active, path, STATUSES)
    return [part("$"), part("$.success"), part("$.failure"), part("$.informational")]


def status_union_dedupe() -> Column:
    """All status lists of a store in order, each distinct status once."""
    lists = [F.col("__store.validation_status"), F.col("active.validation_status")]
    for block in (F.col("__store.validation_results"), F.col("active.validation_results")):
        lists += _results(block)
    return F.array_distinct(F.concat(*[_statuses(items) for items in lists]))


def manifest_actions() -> Column:
    """Action names of assertions whose label mentions actions."""
    own = F.filter(
        F.coalesce(F.col("active.assertions"), F.array()),
        lambda a: F.lower(a["label"]).contains("actions"),
    )
    names = F.flatten(
        F.transform(
            own,
            lambda a: F.transform(
                F.coalesce(a["data"]["actions"], F.array().cast(STATUSES)),
                lambda v: F.try_variant_get(v, "$.action", "string"),
            ),
        )
    )
    return F.filter(names, lambda n: F.coalesce(n != "", F.lit(False)))


def manifest_summary(stores: DataFrame) -> DataFrame:
    """Active manifest, validation state and counts of every store."""
    present = F.col("active").isNotNull()
    statuses = F.when(present, status_union_dedupe())
    count = lambda name: F.coalesce(F.size(F.col(f"active.{name}")), F.lit(0))
    return (
        parse_store(stores)
        .withColumn("validation_status", statuses)
        .withColumn("actions", F.when(present, manifest_actions()))
        .withColumn(
            "failures", F.filter("validation_status", lambda s: F.coalesce(~s["success"], F.lit(False)))
        )
        .select(
            *[c for c in stores.columns if c != "store"],
            present.alias("manifest_present"),
            F.when(present, F.col("active_label")).alias("active_manifest"),
            F.coalesce("active.claim_generator", "active.claimGenerator").alias("claim_generator"),
            F.col("active.title").alias("title"),
            F.when(present, F.greatest(count("ingredients"), F.lit(0))).otherwise(0).alias("ingredient_count"),
            F.when(present, F.greatest(count("assertions"), F.lit(0))).otherwise(0).alias("assertion_count"),
            "actions",
            F.when(~present, "not_present")
            .when(F.size("failures") > 0, "invalid")
            .otherwise("no_reported_errors")
            .alias("validation_state"),
            "validation_status",
            F.when(present, F.size("failures")).otherwise(0).alias("validation_error_count"),
        )
    )
