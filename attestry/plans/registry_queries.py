"""Queries over lookups, facts, aggregates, timelines and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import detectors, text
from attestry.operators import aggregates, block_heads, certificates, chain, facts, matching, timeline
from attestry.plans.catalog import query
from attestry.plans.views import Views
from attestry.session import stored


def _joined(col) -> Column:
    return F.array_join(col, "|")


def _requests(v: Views) -> DataFrame:
    i = F.col("doc_id")
    return v.assets.select(
        i.alias("request_id"),
        F.when(i % 16 == 0, F.sha2(F.concat(F.lit("unknown"), i.cast("string")), 256))
        .otherwise(F.col("sha256"))
        .alias("sha256"),
    )



# --- projections ------------------------------------------------------


@query("tenant_scope")
def _tenant_scope(v: Views) -> DataFrame:
    return matching.tenant_scope(v.assets, "src3").select("asset_id", "tenant_id", "sha256")


@query("asset_list")
def _asset_list(v: Views) -> DataFrame:
    return facts.asset_list(v.assets, "src7", 50)


@query("newest_n")
def _newest_n(v: Views) -> DataFrame:
    own = matching.tenant_scope(v.certificates, "src5")
    return facts.newest_n(own, "issued_at", 40, ["cert_id"]).select(
        "cert_id", "asset_id", text.iso_plain(F.col("issued_at")).alias("issued_at")
    )


@query("canonical_facts")
def _canonical_facts(v: Views) -> DataFrame:
    return facts.canonical_facts(v.assets, v.split_rows).select(
        "asset_id",
        "identity.creator_name",
        "identity.created_at",
        _joined("trust.label_reasons").alias("label_reasons"),
        "trust.total_verifications",
        "ai.disclosure",
        _joined("ai.declared_tools").alias("declared_tools"),
        "ai.detection_pct",
        "rights.copyright_owner",
        "rights.ownership_total_pct",
        "rights.ownership_declared",
        F.col("copyright_readiness.human_authorship_evidence.summary").alias("summary"),
        F.col("copyright_readiness.human_authorship_evidence.lyrics").alias("lyrics"),
        F.col("copyright_readiness.confirmed_human_authorship_forms").alias("forms"),
    )


@query("contributor_facts")
def _contributor_facts(v: Views) -> DataFrame:
    return facts.contributor_facts(v.split_rows)


@query("public_registry_view")
def _public_registry_view(v: Views) -> DataFrame:
    view = facts.public_registry_view(
        facts.canonical_facts(v.assets, v.split_rows),
        chain.public_session_summary(v.sessions, v.session_events),
    )
    return view.select(
        "asset_id",
        "asset_uid",
        "filename",
        "sha256",
        "creator_name",
        "copyright_owner",
        "ai_disclosure",
        F.col("copyright_readiness.score").alias("readiness_score"),
        F.col("session.status").alias("session_status"),
        F.col("session.privacy_mode").alias("privacy_mode"),
        F.col("session.chain_valid").alias("chain_valid"),
        F.col("session.location.level").alias("location_level"),
    )


@query("asset_report")
def _asset_report(v: Views) -> DataFrame:
    assets = v.assets.withColumn("file_type", F.when(F.col("doc_id") % 9 != 0, F.col("file_type")))
    report = facts.asset_report(
        assets,
        facts.canonical_facts(v.assets, v.split_rows),
        chain.public_session_summary(v.sessions, v.session_events),
    )
    return report.select(
        "asset_id",
        "mime_type",
        F.col("resolved_asset_type").alias("asset_type"),
        "manifest_path",
        F.col("rights.ownership_total_pct").alias("ownership_total_pct"),
        F.col("session.status").alias("session_status"),
        F.col("session.event_count").alias("session_events"),
    )


# --- joins ------------------------------------------------------------


@query("hash_match")
def _hash_match(v: Views) -> DataFrame:
    return matching.hash_match(_requests(v), v.registered)[0]


@query("hash_match_candidates")
def _hash_match_candidates(v: Views) -> DataFrame:
    return matching.hash_match(_requests(v), v.registered)[1].select("sha256", "asset_uid", "tenant_id", "match_no")


def _files(v: Views) -> tuple[DataFrame, DataFrame]:
    files = v.table("documents").select(
        F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("sha256"), F.sha2("text", 256).alias("second_fingerprint")
    )
    assets = v.registered.withColumn(
        "second_fingerprint", F.when(F.col("doc_id") % 37 == 0, F.lit("00")).otherwise(F.col("second_fingerprint"))
    )
    return files, assets


@query("file_match")
def _file_match(v: Views) -> DataFrame:
    return matching.file_match(*_files(v))[0]


@query("file_match_candidates")
def _file_match_candidates(v: Views) -> DataFrame:
    return matching.file_match(*_files(v))[1].select("sha256", "asset_uid", "tenant_id", "hash_verified")


@query("certificate_asset_join")
def _certificate_asset_join(v: Views) -> DataFrame:
    return certificates.certificate_asset_join(v.certificates, v.assets, "src3", 50).withColumn(
        "issued_at", text.iso_plain(F.col("issued_at"))
    )


@query("asset_binding_check")
def _asset_binding_check(v: Views) -> DataFrame:
    k, u = F.col("k"), F.col("user_id")
    own = v.assets.select(F.col("doc_id").alias("user_id"), F.col("sha256").alias("own_sha"))
    events = (
        v.session_inputs.join(own, "user_id", "left")
        .withColumn(
            "asset_ref",
            F.when(k % 13 == 0, F.lit(None))
            .when(k % 11 == 0, F.concat(F.lit("as-"), (u + 1).cast("string")))
            .otherwise(F.col("asset_id")),
        )
        .withColumn(
            "declared_sha256",
            F.when(k % 3 == 1, F.lit("0" * 64)).when(k % 3 == 2, F.col("own_sha")),
        )
        .select("event_id", "event_type", "tenant_id", "asset_ref", "declared_sha256")
    )
    ok, rejected = matching.asset_binding_check(events, v.assets)
    return ok.select("event_id", "sha256", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select("event_id", F.lit(None).cast("string").alias("sha256"), "reason")
    )


@query("source_lineage_snapshot")
def _source_lineage_snapshot(v: Views) -> DataFrame:
    i = F.col("doc_id")
    starts = v.assets.select(
        F.concat(F.lit("T-"), i.cast("string")).alias("session_id"),
        "tenant_id",
        F.concat(F.lit("as-"), F.when(i % 2 == 0, i).otherwise(F.floor(i / 2)).cast("string")).alias("source_asset_id"),
    )
    return matching.source_lineage_snapshot(starts, v.assets)


@query("name_match_join")
def _name_match_join(v: Views) -> DataFrame:
    named = stored(v.split_rows.select("asset_id", "sheet_id", "contributor_id", "name", "sheet_name"), "split-names")
    return matching.name_match_join(named, named)


def _persisted(v: Views) -> DataFrame:
    return timeline.latest_per_key(detectors.normalize_observations(v.observations, lower_provider=True))


@query("legacy_observation_fallback")
def _legacy_observation_fallback(v: Views) -> DataFrame:
    return matching.legacy_observation_fallback(v.assets, _persisted(v))


@query("certificate_fallback_lookup")
def _certificate_fallback_lookup(v: Views) -> DataFrame:
    i = F.col("doc_id")
    files = v.assets.select(
        "asset_id",
        F.when(i % 4 == 0, F.concat(F.lit('{"file":'), i.cast("string"), F.lit("}")))
        .when(i % 4 == 1, F.lit("{broken"))
        .alias("document"),
    )
    certs = v.certificates.withColumn("document", certificates.certificate_json())
    return certificates.certificate_fallback_lookup(files, certs)


# --- aggregates -------------------------------------------------------


@query("ownership_totals")
def _ownership_totals(v: Views) -> DataFrame:
    return facts.ownership_totals(v.assets, v.split_rows)


@query("lenient_numeric_total")
def _lenient_numeric_total(v: Views) -> DataFrame:
    p = F.col("position")
    mixed = v.split_rows.withColumn(
        "share",
        F.when(p % 4 == 0, F.lit(""))
        .when(p % 5 == 0, F.lit("half"))
        .when(F.col("sheet_id") % 9 == 0, F.lit("n/a"))
        .otherwise(F.format_string("%.4f", F.col("ownership_split_pct"))),
    )
    return facts.lenient_numeric_total(mixed, ["sheet_id"], "share")


@query("split_sheet_validate")
def _split_sheet_validate(v: Views) -> DataFrame:
    ok, rejected = aggregates.split_sheet_validate(v.split_rows)
    return ok.unionByName(rejected)


@query("verification_counter_check")
def _verification_counter_check(v: Views) -> DataFrame:
    return aggregates.verification_counter_check(v.verification_counters, v.verification_logs)


@query("detector_summary")
def _detector_summary(v: Views) -> DataFrame:
    return aggregates.detector_summary(detectors.normalize_observations(v.observations)).withColumn(
        "providers", _joined("providers")
    )


@query("human_form_count")
def _human_form_count(v: Views) -> DataFrame:
    return v.assets.select("asset_id", facts.human_form_count().alias("forms"))


@query("session_evidence_rollup")
def _session_evidence_rollup(v: Views) -> DataFrame:
    rolled = aggregates.session_evidence_rollup(v.workflow_events, ["Studio", "Auto detect"])
    return rolled.select(
        "session_id",
        "workflow",
        "production_environment",
        "automatic_project_detected",
        "automatic_revisions",
        "automatic_exports",
        "contributor_declarations",
        "verified",
        F.col("source_lineage.source_asset_uid").alias("source_asset_uid"),
        F.col("source_lineage.history_preserved").alias("history_preserved"),
        _joined("transformations").alias("transformations"),
        "statement",
        "final_provenance_disclosure",
    )


@query("first_seen_distinct")
def _first_seen_distinct(v: Views) -> DataFrame:
    events = aggregates.with_payload(v.workflow_events)
    hardware = aggregates.first_seen_distinct(events, aggregates.hardware_items(), ["name", "category"])
    apps = aggregates.first_seen_distinct(events, aggregates.app_items(), ["name"])
    return hardware.unionByName(apps.withColumn("category", F.lit("app")))


# --- ordered ----------------------------------------------------------


@query("latest_per_key")
def _latest_per_key(v: Views) -> DataFrame:
    return _persisted(v).select(
        "observation_id", "asset_id", "provider", "model", "probability", text.iso_utc(F.col("observed_at")).alias("observed_at")
    )


@query("latest_certificate")
def _latest_certificate(v: Views) -> DataFrame:
    return certificates.latest_certificate(v.certificates).select(
        "asset_id",
        "cert_id",
        "certificate_class",
        text.iso_plain(F.col("first_issued_at")).alias("first_issued_at"),
        text.iso_plain(F.col("latest_issued_at")).alias("latest_issued_at"),
        "certificate_count",
    )


@query("latest_session")
def _latest_session(v: Views) -> DataFrame:
    paired = v.sessions.withColumn("asset_id", F.concat(F.lit("as-"), F.floor(F.col("user_id") / 3).cast("string")))
    return chain.latest_session(paired, chain.PUBLIC_STATUSES).select("asset_id", "session_id", "status")


@query("first_last_event")
def _first_last_event(v: Views) -> DataFrame:
    first = timeline.first_last_event(v.session_events, "session_started", "first", ["event_id", "privacy_mode"])
    last = timeline.first_last_event(v.session_events, "ai_tool_disclosed", "last", ["event_id", "ai_used"])
    return first.withColumnRenamed("event_id", "start_event").join(
        last.withColumnRenamed("event_id", "disclosure_event"), "session_id", "full_outer"
    )


@query("lineage_steps")
def _lineage_steps(v: Views) -> DataFrame:
    return timeline.lineage_steps(v.provenance_events).select(
        "asset_id", "step", "event_id", "event_type", "tool_used", "event_hash"
    )


@query("chronology_check")
def _chronology_check(v: Views) -> DataFrame:
    e, ts = F.col("event_id"), F.col("timestamp")
    shuffled = v.provenance_events.withColumn(
        "timestamp", F.when(e % 499 == 0, ts - F.expr("interval 5 days")).when(e % 7 != 0, ts)
    )
    return timeline.chronology_check(shuffled)


@query("transformation_chain")
def _transformation_chain(v: Views) -> DataFrame:
    return timeline.transformation_chain(v.assets, v.provenance_events)


@query("strongest_detector")
def _strongest_detector(v: Views) -> DataFrame:
    assets = v.assets.withColumn("ai_detection_score", F.when(F.col("doc_id") % 3 == 0, F.col("ai_detection_score")))
    return aggregates.strongest_detector(assets, detectors.normalize_observations(v.observations))


@query("set_gap")
def _set_gap(v: Views) -> DataFrame:
    seen = detectors.normalize_observations(v.observations, lower_provider=True).withColumn(
        "provider", F.when(F.col("model") == "m1", F.col("provider"))
    )
    return aggregates.set_gap(seen, ["asset_id"], "provider", ["sightengine", "hive", "third"], v.assets).withColumn(
        "missing", _joined("missing")
    )


# --- sessions ---------------------------------------------------------


@query("chain_build")
def _chain_build(v: Views) -> DataFrame:
    return chain.chain_build(v.session_inputs).select("event_id", "session_id", "sequence", "previous_event_hash", "evidence_hash")


@query("chain_verify")
def _chain_verify(v: Views) -> DataFrame:
    return chain.chain_verify(v.session_events, v.sessions)[1]


@query("chain_failures")
def _chain_failures(v: Views) -> DataFrame:
    return chain.chain_verify(v.session_events, v.sessions)[0]


@query("chain_block_heads")
def _chain_block_heads(v: Views) -> DataFrame:
    return block_heads.block_heads(v.session_chain)


@query("chain_block_failures")
def _chain_block_failures(v: Views) -> DataFrame:
    heads = stored(block_heads.block_heads(v.session_chain), "block-heads")
    return block_heads.block_failures(v.session_events, heads)


@query("completion_check")
def _completion_check(v: Views) -> DataFrame:
    _, summary = chain.chain_verify(v.session_events, v.sessions)
    return chain.completion_check(v.session_events, summary).select(
        "session_id", "eligible", _joined("missing").alias("missing"), "event_count"
    )


@query("session_close")
def _session_close(v: Views) -> DataFrame:
    at = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    closed, closing = chain.session_close(v.sessions, v.session_events, at)
    return closed.join(closing.select("session_id", "sequence", "payload", "previous_event_hash"), "session_id").select(
        "session_id", "status", _joined("missing").alias("missing"), "sequence", "payload", "previous_event_hash"
    )


@query("public_session_summary")
def _public_session_summary(v: Views) -> DataFrame:
    return chain.public_session_summary(v.sessions, v.session_events).select(
        "asset_id",
        "session_id",
        "status",
        "privacy_mode",
        "event_count",
        "chain_valid",
        "started_at",
        "closed_at",
        "ai_used",
        F.col("location.level").alias("location_level"),
        F.col("location.public_summary").alias("location_summary"),
    )


@query("public_record")
def _public_record(v: Views) -> DataFrame:
    settings = v.sessions.select(
        "session_id",
        F.array(
            F.when(F.col("user_id") % 2 == 0, F.lit("production_environment")),
            F.when(F.col("user_id") % 3 == 0, F.lit("source_asset_uid")),
            F.when(F.col("user_id") % 5 == 0, F.lit("transformation_statement")),
        ).alias("fields"),
    )
    record, rows = chain.public_record(
        v.sessions, v.session_events, v.workflow_events, settings, ["Studio", "Auto detect"]
    )
    place = [F.col("location.level").alias("location_level"), F.col("location.public_summary").alias("location_summary")]
    records = record.select(F.lit("record").alias("kind"), "*", *place).withColumns(
        {"published_fields": _joined("published_fields"), "transformations": _joined("transformations")}
    )
    events = rows.select(
        F.lit("event").alias("kind"),
        "asset_id",
        "session_id",
        "event_id",
        "sequence",
        "event_type",
        text.iso_utc(F.col("occurred_at")).alias("occurred_at"),
        text.iso_utc(F.col("recorded_at")).alias("recorded_at"),
        "source_type",
        "ai_used",
        "previous_event_hash",
        "evidence_hash",
        *place,
    )
    return records.drop("location").unionByName(events, allowMissingColumns=True)


@query("public_record_timeline")
def _public_record_timeline(v: Views) -> DataFrame:
    settings = v.sessions.select("session_id", F.array().cast("array<string>").alias("fields"))
    _, rows = chain.public_record(v.sessions, v.session_events, v.workflow_events, settings, [])
    return rows.select(
        "asset_id", "session_id", "event_id", "sequence", "event_type", F.col("location.level").alias("location_level")
    )
