"""Queries over sources, sinks and table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import schemas
from attestry.functions import text
from attestry.operators import metadata_scores
from attestry.plans.catalog import query
from attestry.plans.views import Views
from attestry.session import shared_dir
from attestry.sources import files, registry, sinks


def _store(v: Views, table: str, df: DataFrame) -> str:
    root = shared_dir(v.spark, "registry")
    registry.registry_write(df, root, table)
    return root


@query("registry_scan")
def _registry_scan(v: Views) -> DataFrame:
    root = _store(v, "assets", v.assets.withColumn("sha256", F.when(F.col("doc_id") % 101 != 7, F.col("sha256"))))
    ok, rejected = registry.registry_scan(v.spark, root, "assets")
    return ok.withColumn("missing_keys", F.lit(None).cast("string")).unionByName(rejected).select(
        "asset_id", "tenant_id", "asset_uid", "file_size_bytes", "trust_score", "human_lyrics_present", "missing_keys"
    )


def _tables(v: Views) -> dict[str, DataFrame]:
    """A filled version of each registry table; some rows lack a key."""
    i, provider = F.col("doc_id"), text.clean_text(F.col("provider"))
    return {
        "assets": v.assets.withColumn("sha256", F.when(i % 101 != 7, F.col("sha256"))),
        "provenance_events": v.provenance_events,
        "certificates": v.certificates,
        "contributors": v.stored_split_rows,
        "split_sessions": v.split_sessions,
        "verification_logs": v.verification_logs,
        "asset_metadata": v.metadata.select(F.col("asset_id").alias("id"), "asset_id", "asset_uid", "raw_tags"),
        "clients": v.applications.select(
            F.col("application_id").cast("string").alias("id"), F.lit("t").alias("tenant_id"), "email", "plan"
        ),
        "sessions": v.sessions,
        "session_events": v.session_inputs,
        "observations": v.observations.withColumns(
            {"provider": provider, "probability": text.as_number(F.col("probability"))}
        ),
        "passports": v.passports,
        "publications": v.sessions.select("session_id", "tenant_id", "asset_id"),
    }


@query("registry_tables")
def _registry_tables(v: Views) -> DataFrame:
    """All registry tables written, scanned and counted."""
    root, out = shared_dir(v.spark, "registry"), []
    for table, rows in _tables(v).items():
        registry.registry_write(rows, root, table)
        for kept, part in zip(("ok", "rejected"), registry.registry_scan(v.spark, root, table)):
            out.append(part.select(F.lit(table).alias("table"), F.lit(kept).alias("part")))
    return reduce(DataFrame.unionByName, out).groupBy("table").agg(
        F.count_if(F.col("part") == "ok").alias("ok"), F.count_if(F.col("part") == "rejected").alias("rejected")
    )


@query("registry_scan_events")
def _registry_scan_events(v: Views) -> DataFrame:
    root = _store(v, "provenance_events", v.provenance_events)
    events, _ = registry.registry_scan(v.spark, root, "provenance_events")
    return events.select(
        "event_id", "asset_id", text.iso_utc(F.col("timestamp")).alias("timestamp"), "event_hash"
    )


@query("bounded_binary_scan")
def _bounded_binary_scan(v: Views) -> DataFrame:
    """Documents as files, one for each run of ids; the first run is long."""
    root = shared_dir(v.spark, "files")
    run = F.greatest(F.lit(0), F.floor((F.col("doc_id") - 400) / 100))
    lines = v.table("documents").select("doc_id", run.alias("run"), "text")
    sorted_lines = lines.repartition("run").sortWithinPartitions("run", "doc_id")
    sorted_lines.select("run", "text").write.partitionBy("run").text(root)
    accepted, rejected = files.bounded_binary_scan(v.spark, root, max_mb=1, pattern="*.txt")
    found = accepted.drop("modificationTime").unionByName(rejected, allowMissingColumns=True)
    number = F.regexp_extract("path", r"run=(\d+)/", 1).cast("long")
    return found.select(number.alias("run"), "length", "sha256", "md5", "second_fingerprint", "reason")


def _submitted(v: Views) -> DataFrame:
    """events.props with malformed and non-object texts mixed in."""
    e = F.col("event_id")
    return v.table("events").select(
        "event_id",
        F.when(e % 10 == 0, F.lit("[1,2]"))
        .when(e % 10 == 1, F.lit('{"k": '))
        .when(e % 10 == 2, F.lit(""))
        .when(e % 10 == 3, F.lit('"text"'))
        .when(e % 10 == 4, F.lit(None))
        .otherwise(F.col("props"))
        .alias("body"),
    )


@query("json_object_gate")
def _json_object_gate(v: Views) -> DataFrame:
    ok, rejected = files.json_object_gate(_submitted(v), "body")
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


@query("json_column_decode")
def _json_column_decode(v: Views) -> DataFrame:
    decoded = files.json_column_decode(_submitted(v), "body", "struct<k: int>", F.struct(F.lit(-1).alias("k")))
    lists = files.json_column_decode(_submitted(v), "body", "array<int>", F.array().cast("array<int>"))
    return decoded.select("event_id", F.col("body.k").alias("k")).join(
        lists.select("event_id", F.size("body").alias("items")), "event_id"
    )


@query("document_sink")
def _document_sink(v: Views) -> DataFrame:
    path = shared_dir(v.spark, "documents")
    sinks.document_sink(sinks.manifest_json(v.assets), path, "manifests")
    sinks.document_sink(sinks.certificate_documents(v.certificates), path, "certificates")
    return sinks.read_documents(v.spark, path).select(
        "kind", "asset_id", "tenant_id", "document_hash", F.length("body").alias("length")
    )


@query("evidence_export")
def _evidence_export(v: Views) -> DataFrame:
    path = shared_dir(v.spark, "export")
    rows = sinks.export_rows(v.assets, v.provenance_events, v.certificates, v.stored_split_rows)
    sinks.export_all(rows, path)
    written = sinks.read_all(v.spark, path)
    return written.groupBy("artefact").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("asset_id").alias("assets"),
        F.count_if(F.coalesce(F.col("body"), F.lit("")) == "").alias("empty"),
    )


@query("append_only_sink")
def _append_only_sink(v: Views) -> DataFrame:
    path = shared_dir(v.spark, "observations")
    early = F.col("observation_id") % 3 == 0
    sinks.append_observations(v.observations.where(early), path, "1")
    sinks.append_observations(v.observations.where(~early), path, "2")
    # a replay of the second run changes nothing
    sinks.append_observations(v.observations.where(~early), path, "2")
    return sinks.read_observations(v.observations, path).select("observation_id", "run", "provider", "model", "probability", "status")


def _records(rows: DataFrame, asset_id: Column, version: Column) -> DataFrame:
    return rows.select(
        asset_id.alias("asset_id"), "asset_uid", "tenant_id", "doc_id", version.alias("version"), "metadata_sha256"
    )


@query("keyed_upsert")
def _keyed_upsert(v: Views) -> DataFrame:
    """Re-analysis of all assets: known keys, moved keys and new identities."""
    i = F.col("doc_id")
    digest = F.sha2(F.concat("asset_uid", "filename"), 256)
    target = _records(v.registered.withColumn("metadata_sha256", digest), F.col("asset_id"), F.lit(1))
    fresh = lambda prefix: F.concat(F.lit(prefix), i.cast("string"))
    key = F.when(i % 5 == 0, fresh("new-")).when(i % 3 == 0, fresh("re-")).otherwise(F.col("asset_id"))
    analysed = v.assets.withColumn(
        "asset_uid", F.when(i % 5 == 0, fresh("AU-new-")).otherwise(F.col("asset_uid"))
    ).withColumn("metadata_sha256", digest)
    updates = _records(analysed, key, F.lit(2))
    return registry.keyed_upsert(target, updates, "asset_id", ["asset_uid", "tenant_id"], [i]).select(
        "asset_id", "asset_uid", "tenant_id", "version", "metadata_sha256"
    )


@query("schema_evolve")
def _schema_evolve(v: Views) -> DataFrame:
    i = F.col("doc_id")
    narrow = v.assets.select(
        "asset_id",
        "sha256",
        F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, F.lit(" ")).otherwise(F.col("tenant_id")).alias("tenant_id"),
    )
    tenants = v.assets.select("tenant_id")
    wide = registry.schema_evolve(narrow, schemas.table_schema("assets"), "src4", tenants)
    again = registry.schema_evolve(wide, schemas.table_schema("assets"), "src4", tenants)
    absent = registry.schema_evolve(again, schemas.table_schema("assets"), "nobody", tenants)
    return absent.select(
        "asset_id",
        "tenant_id",
        "trust_score",
        "human_lyrics_present",
        F.lit(len(absent.columns)).alias("columns"),
    )


@query("missing_score_backfill")
def _missing_score_backfill(v: Views) -> DataFrame:
    meta = v.metadata.withColumn("metadata_trust_score", F.when(F.col("doc_id") % 3 == 0, F.lit(77)))
    legacy = meta.where("metadata_trust_score is null").drop("metadata_trust_score")
    scored = metadata_scores.metadata_trust_score(legacy)
    once = registry.missing_score_backfill(meta, "metadata_trust_score", scored, "asset_id")
    return once.select("asset_id", "metadata_trust_score")
