"""Streaming queries over the stored tables, and their batch counterparts.

Each streaming key runs its job over the whole table with ``availableNow``,
appends to a table in the shared folder and returns that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import digests
from attestry.plans.catalog import query
from attestry.plans.views import Views
from attestry.streaming import jobs

DEBOUNCE_S = 7200
STABILITY_S = 3600
WINDOW_S = 21600
LIMITS = {
    "view": jobs.parsed_limit("2 per 6 hours", jobs.ROUTE_LIMITS["upload"]),
    "click": jobs.parsed_limit("broken", "3/6 hours"),
    "purchase": jobs.parsed_limit(None, "1/6hour"),
}


def _event_stream(v: Views) -> DataFrame:
    jobs.use_rocksdb(v.spark)
    return jobs.table_stream(v.spark, f"{v.sf_dir}/events.parquet")


def _submitted(events: DataFrame) -> DataFrame:
    """Events as submitted session events, some of them not allowed."""
    e, u = F.col("event_id"), F.col("user_id")
    kind = (
        F.when(e % 97 == 0, "unknown_type")
        .when(e % 211 == 0, "session_closed")
        .when(F.col("event_type") == "signup", "session_started")
        .when(F.col("event_type") == "view", "work_saved")
        .when(F.col("event_type") == "click", "work_exported")
        .when(F.col("event_type") == "purchase", "ai_tool_disclosed")
        .otherwise("asset_registered")
    )
    none = F.lit(None).cast("string")
    return events.select(
        "event_id",
        F.concat(F.lit("S-"), u.cast("string")).alias("session_id"),
        F.concat(F.lit("as-"), u.cast("string")).alias("asset_id"),
        kind.alias("event_type"),
        F.col("ts").alias("occurred_at"),
        F.col("ts").alias("recorded_at"),
        F.lit("web").alias("source_type"),
        none.alias("source_name"),
        none.alias("creator_id"),
        F.lit(None).cast("boolean").alias("ai_used"),
        none.alias("privacy_mode"),
        none.alias("location_level"),
        none.alias("location_summary"),
        F.col("props").alias("payload"),
        (e % 2 == 0).alias("by_close"),
        F.when(e % 13 != 0, F.concat(F.lit("as-"), u.cast("string"))).alias("asset_ref"),
        F.concat(F.lit("src"), F.when(e % 17 == 0, 99).otherwise(u % 20).cast("string")).alias("tenant_id"),
        F.when(e % 7 == 0, F.lit("0" * 64)).alias("declared_sha256"),
    )


@query("evidence_log_stream")
def _evidence_log_stream(v: Views) -> DataFrame:
    # the tenants of the assets follow their numbers, as those of the events do
    assets = v.assets.withColumn("tenant_id", F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")))
    bound = jobs.bound_events(_submitted(_event_stream(v)), assets)
    return jobs.run_to_table(jobs.evidence_log_stream(bound), "evidence-log")


def _changes(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("project"), "event_id", F.col("ts").alias("at"), F.col("event_type").alias("signature"))


@query("debounced_revisions")
def _debounced_revisions(v: Views) -> DataFrame:
    return jobs.run_to_table(jobs.debounced_revisions(_changes(_event_stream(v)), DEBOUNCE_S), "revisions")


@query("debounced_revisions_batch")
def _debounced_revisions_batch(v: Views) -> DataFrame:
    return jobs.debounced_revisions_batch(_changes(v.table("events")), DEBOUNCE_S)


def _scans(events: DataFrame) -> DataFrame:
    u = F.col("user_id")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".wav", ".txt", ".MP3", ".flac")]), (u % 4 + 1).cast("int"))
    return events.select(
        "event_id",
        F.concat(F.lit("export-"), u.cast("string"), ending).alias("name"),
        F.col("ts").alias("at"),
        F.when(F.col("event_type") == "click", 0).otherwise(100).cast("long").alias("size"),
        F.date_trunc("day", F.col("ts")).alias("changed"),
    )


def _session_start():
    return F.lit("2024-01-03 00:00:00").cast("timestamp")


@query("stable_export")
def _stable_export(v: Views) -> DataFrame:
    return jobs.run_to_table(jobs.stable_export(_scans(_event_stream(v)), _session_start(), STABILITY_S), "exports")


@query("stable_export_batch")
def _stable_export_batch(v: Views) -> DataFrame:
    return jobs.stable_export_batch(_scans(v.table("events")), _session_start(), STABILITY_S)


def _calls(events: DataFrame) -> DataFrame:
    u = F.col("user_id")
    return events.select(
        F.col("event_id").alias("request_id"),
        jobs.limit_key(
            F.when(u % 3 != 0, F.concat(F.lit("key-"), (u % 10).cast("string"))),
            F.concat(F.lit("10.0.0."), (u % 5).cast("string")),
        ).alias("key"),
        F.col("event_type").alias("route"),
        F.col("ts").alias("at"),
    )


@query("fixed_window_limit")
def _fixed_window_limit(v: Views) -> DataFrame:
    counts = jobs.fixed_window_limit(_calls(_event_stream(v)), LIMITS, WINDOW_S)
    return jobs.run_upserted(counts, "windows", ["key", "route", "window_start"])


@query("fixed_window_limit_batch")
def _fixed_window_limit_batch(v: Views) -> DataFrame:
    return jobs.fixed_window_limit(_calls(v.table("events")), LIMITS, WINDOW_S)


@query("limited_requests")
def _limited_requests(v: Views) -> DataFrame:
    return jobs.limited_requests(_calls(v.table("events")), LIMITS, WINDOW_S).select(
        "request_id", "window_start", "nth", "allowed"
    )


def _detections(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("/projects/"), F.col("user_id").cast("string")).alias("path"),
        "event_id",
        F.col("ts").alias("at"),
        (F.col("event_type") == "error").alias("closes"),
    )


@query("project_session_reuse")
def _project_session_reuse(v: Views) -> DataFrame:
    return jobs.run_to_table(jobs.project_session_reuse(_detections(_event_stream(v))), "projects")


@query("project_session_reuse_batch")
def _project_session_reuse_batch(v: Views) -> DataFrame:
    return jobs.project_session_reuse_batch(_detections(v.table("events")))


def _submissions(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id", digests.asset_uid(F.col("source"), F.sha2("text", 256)).alias("asset_uid")
    )


@query("idempotent_registration")
def _idempotent_registration(v: Views) -> DataFrame:
    stream = _submissions(jobs.table_stream(v.spark, f"{v.sf_dir}/documents.parquet"))
    _, responses = jobs.registration_stream(stream, "doc_id", "registration")
    return responses.select("doc_id", "asset_uid", "registered_id", "registration_reused")


@query("idempotent_registration_batch")
def _idempotent_registration_batch(v: Views) -> DataFrame:
    return jobs.idempotent_registration(_submissions(v.table("documents")), [F.col("doc_id")])


@query("project_fingerprint")
def _project_fingerprint(v: Views) -> DataFrame:
    tree = v.table("documents").select(
        "source",
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        F.sha2("text", 256).alias("sha256"),
    )
    return jobs.project_fingerprint(tree, ["source"])
