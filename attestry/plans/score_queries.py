"""Queries over scores, forensics, reports, integrity checks and the graph."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import detectors, responses, text
from attestry.operators import (
    aggregates,
    asset_scores,
    certificates,
    chain,
    facts,
    forensics,
    graph,
    integrity,
    metadata_scores,
    reports,
    timeline,
)
from attestry.plans.catalog import query
from attestry.plans.views import MAC_KEY, Views, provenance_event_digest, verification_log_digest
from attestry.session import stored
from attestry.sources import sinks

AS_OF_YEAR = 2026


def _joined(col) -> Column:
    return F.array_join(col, "|")


def _signals(v: Views) -> DataFrame:
    i = F.col("doc_id")
    known = F.col("ai_disclosure").isin("human", "ai_assisted", "ai_generated")
    level = F.element_at(
        F.array(*[F.lit(x) for x in ("substantial", "Moderate", "minor", "none", None)]), (i % 5 + 1).cast("int")
    )
    return v.assets.withColumns(
        {
            "has_second_fingerprint": F.when(i % 3 == 0, F.lit(True)),
            "invisible_wm_verified": F.col("watermark_invisible"),
            "invisible_wm_confidence": F.when(i % 4 == 0, 0.87).when(i % 4 == 1, 0.0),
            "has_phash": i % 4 == 1,
            "has_exif": F.when(i % 10 != 0, i % 3 != 0),
            "has_gps": i % 5 == 0,
            "has_creator_name": text.clean_text(F.col("creator_name")).isNotNull(),
            "has_creator_org": i % 6 == 0,
            "has_copyright": i % 4 == 2,
            "has_license_url": F.col("license_type").isNotNull(),
            "is_generated": F.when(known, F.col("ai_disclosure") == "ai_generated"),
            "is_assisted": F.when(known, F.col("ai_disclosure") == "ai_assisted"),
            "is_disclosed": F.coalesce(F.col("ai_disclosure").isin("ai_assisted", "ai_generated"), F.lit(False)),
            "transformation_level": level,
            "human_contribution_count": facts.human_form_count(),
            "has_daw": i % 7 == 3,
            "phash_collision": i % 41 == 0,
            "human_contributor_count": F.when(i % 4 != 0, i % 4).cast("int"),
        }
    )


@query("metadata_trust_score")
def _metadata_trust_score(v: Views) -> DataFrame:
    out = metadata_scores.metadata_trust_score(v.metadata)
    return out.select(
        "asset_id",
        "metadata_trust_score",
        "breakdown.*",
        _joined("explanations.missing_sections").alias("missing_sections"),
        _joined("explanations.consistency_failures").alias("consistency_failures"),
        _joined("explanations.attribution_signals").alias("attribution_signals"),
        F.col("explanations.timing").alias("timing"),
    )


def _anomalies(v: Views) -> DataFrame:
    return metadata_scores.metadata_anomaly_rules(v.metadata, AS_OF_YEAR)


def _stored_anomalies(v: Views) -> DataFrame:
    """Anomaly results; every sixth record is not scored yet."""
    return _anomalies(v).withColumn("anomaly_score", F.when(F.col("doc_id") % 6 != 0, F.col("anomaly_score")))


@query("metadata_anomaly_rules")
def _metadata_anomaly_rules(v: Views) -> DataFrame:
    return _anomalies(v).select(
        "asset_id",
        "anomaly_score",
        "anomaly_summary",
        _joined(F.transform("flags", lambda f: f["flag"])).alias("flags"),
        _joined(F.flatten(F.transform("flags", lambda f: f["affected_fields"]))).alias("affected_fields"),
    )


@query("asset_trust_score")
def _asset_trust_score(v: Views) -> DataFrame:
    return asset_scores.asset_trust_score(_signals(v)).select(
        "asset_id", "trust_score", _joined("reasons").alias("reasons")
    )


@query("content_label")
def _content_label(v: Views) -> DataFrame:
    scored = asset_scores.asset_trust_score(_signals(v))
    return scored.select("asset_id", asset_scores.content_label(F.col("trust_score")).alias("label"))


@query("copyright_readiness")
def _copyright_readiness(v: Views) -> DataFrame:
    return asset_scores.copyright_readiness(_signals(v)).select(
        "asset_id",
        "readiness_score",
        "readiness_label",
        _joined("factors_supporting").alias("supporting"),
        _joined("factors_limiting").alias("limiting"),
    )


@query("certificate_class")
def _certificate_class(v: Views) -> DataFrame:
    return _signals(v).select("asset_id", asset_scores.certificate_class().alias("certificate_class"))


def _documents(v: Views) -> tuple[DataFrame, DataFrame]:
    ready = asset_scores.copyright_readiness(_signals(v)).withColumn(
        "certificate_class", asset_scores.certificate_class()
    )
    return asset_scores.certificate_document(ready, v.split_rows)


@query("certificate_document")
def _certificate_document(v: Views) -> DataFrame:
    documents, _ = _documents(v)
    return documents.select(
        "asset_id",
        "cert_id",
        "certificate_class",
        "certificate_class_label",
        "subject_name",
        "copyright_owner",
        "license_type",
        F.col("copyright_readiness.readiness_score").alias("readiness_score"),
        _joined(
            F.transform(
                "section_a.contributions", lambda c: F.concat(c["type"], F.lit("="), c["present"].cast("string"))
            )
        ).alias("contributions"),
        F.col("section_a.summary").alias("summary"),
        _joined("section_b.ai_tools_used").alias("ai_tools_used"),
        F.col("section_b.ai_modification_by_human").alias("ai_modification_by_human"),
        F.col("section_b.ai_detection_pct").alias("ai_detection_pct"),
        F.col("section_c.label").alias("section_c_label"),
    )


@query("certificate_contributors")
def _certificate_contributors(v: Views) -> DataFrame:
    return _documents(v)[1]


@query("metadata_lock")
def _metadata_lock(v: Views) -> DataFrame:
    return certificates.metadata_lock(v.certificates, MAC_KEY).select("cert_id", "valid", "reason")


@query("provenance_continuity")
def _provenance_continuity(v: Views) -> DataFrame:
    return reports.provenance_continuity(v.assets, v.provenance_events, v.certificates, v.split_rows).select(
        "asset_id",
        "continuity_score",
        "continuity_label",
        _joined("gaps").alias("gaps"),
        "total_events",
        "total_certificates",
    )


@query("disclosure_note")
def _disclosure_note(v: Views) -> DataFrame:
    return v.assets.select("asset_id", asset_scores.disclosure_note().alias("note"))


def _credentials(v: Views) -> DataFrame:
    """Manifest summaries; some source files are gone, some were never read."""
    gone, read = F.col("doc_id") % 16 == 0, F.col("doc_id") % 10 != 7
    return responses.manifest_summary(v.manifest_stores).select(
        "asset_id",
        F.when(read, F.when(gone, "source_unavailable").otherwise(F.col("validation_state"))).alias("validation_state"),
        F.when(read & ~gone, F.col("manifest_present")).alias("manifest_present"),
        F.when(gone, 0).otherwise(F.col("validation_error_count")).alias("validation_error_count"),
    )


def _persisted(v: Views) -> DataFrame:
    return timeline.latest_per_key(detectors.normalize_observations(v.observations, lower_provider=True))


def _forensic(v: Views) -> DataFrame:
    return forensics.forensic_signals(
        v.assets,
        _stored_anomalies(v),
        _credentials(v),
        chain.public_session_summary(v.sessions, v.session_events),
        _persisted(v),
    )


@query("forensic_signals")
def _forensic_signals(v: Views) -> DataFrame:
    return _forensic(v)


@query("forensic_verdict")
def _forensic_verdict(v: Views) -> DataFrame:
    return forensics.forensic_verdict(_forensic(v)).select("asset_id", "verdict", _joined("reasons").alias("reasons"))


@query("passport_readiness")
def _passport_readiness(v: Views) -> DataFrame:
    out = asset_scores.passport_readiness(
        v.passports.withColumn("serial_number", text.clean_text(F.col("serial_number")))
    )
    return out.select(
        "passport_id",
        F.col("checks.passport_level_item").alias("level_item"),
        F.col("checks.gs1_syntax_validated").alias("identified"),
        F.col("checks.data_carrier_declared").alias("carrier"),
        F.size("gaps").alias("gaps"),
        "compliance_status",
    )


@query("copyright_report")
def _copyright_report(v: Views) -> DataFrame:
    out = reports.copyright_report(v.assets, v.provenance_events, v.certificates, v.stored_split_rows)
    return out.select(
        "asset_id",
        "report_type",
        F.col("stored_facts.identity.creator_name").alias("creator_name"),
        F.col("stored_facts.rights.ownership_total_pct").alias("ownership_total_pct"),
        "disclosure_note",
        "human_contributors",
        "timestamps.*",
        "ownership_certificate.latest_cert_id",
        "provenance_continuity.continuity_score",
        "provenance_continuity.continuity_label",
    )


@query("human_contributors")
def _human_contributors(v: Views) -> DataFrame:
    return reports.human_contributors(v.split_rows).select("contributor_id", "name", "role", "ownership_split_pct")


# --- integrity ----------------------------------------------------------


def _flat_facts(v: Views) -> DataFrame:
    return v.assets.withColumn("creator_name", text.clean_text(F.col("creator_name")))


def _issued(v: Views) -> DataFrame:
    """Certificates of the stored facts, with drift, missing rows and bad signatures."""
    i = F.col("doc_id")
    rows = v.assets.select(
        "doc_id",
        F.when(i % 25 != 0, F.concat(F.lit("ct-"), "asset_id")).alias("cert_id"),
        "asset_id",
        "asset_uid",
        "created_at",
        F.col("created_at").alias("issued_at"),
        "filename",
        F.when(i % 33 == 0, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"),
        "second_fingerprint",
        F.coalesce(text.clean_text(F.col("creator_name")), F.lit("Unknown")).alias("subject_name"),
        text.clean_text(F.col("creator_name")).alias("creator_name"),
        F.when(i % 13 == 0, F.lit("Former owner")).otherwise(F.coalesce("copyright_owner", F.lit(""))).alias(
            "copyright_owner"
        ),
        F.coalesce("license_type", F.lit("")).alias("license_type"),
        F.col("ai_disclosure"),
        "certificate_class",
    )
    # every third asset has an older certificate too, which no longer fits
    older = rows.where((i % 3 == 0) & F.col("cert_id").isNotNull()).withColumns(
        {
            "cert_id": F.concat(F.lit("cs-"), "asset_id"),
            "issued_at": F.col("issued_at") - F.make_dt_interval(days=F.lit(1)),
            "filename": F.lit("old.bin"),
            "copyright_owner": F.lit("First owner"),
        }
    )
    signed = certificates.lock_and_sign(rows.unionByName(older), MAC_KEY, "key-1")
    license_type = F.when(i % 27 == 0, F.lit("Other")).otherwise(F.col("metadata_lock.license_type"))
    return signed.withColumn("metadata_lock", F.col("metadata_lock").withField("license_type", license_type))


def _split_diffs(v: Views) -> DataFrame:
    stored = facts.ownership_splits(v.known_split_rows).withColumnRenamed("name", "owner_name")
    certified = v.known_split_rows.join(
        v.assets.where("certificate_class = 'live_split'").select("asset_id"), "asset_id", "left_semi"
    ).select(
        "asset_id",
        F.col("name").alias("owner_name"),
        "role",
        "ownership_split_pct",
        "creative_contribution_pct",
        "ai_assisted_pct",
    )
    return integrity.split_differences(stored, certified.where("ownership_split_pct is not null"))


def _certificate_diff(v: Views) -> DataFrame:
    return integrity.certificate_fact_diff(_flat_facts(v), _issued(v), _split_diffs(v), MAC_KEY)


@query("certificate_fact_diff")
def _certificate_fact_diff(v: Views) -> DataFrame:
    return _certificate_diff(v).withColumn("mismatches", _joined("mismatches"))


@query("split_differences")
def _split_differences(v: Views) -> DataFrame:
    return _split_diffs(v)


@query("manifest_fact_diff")
def _manifest_fact_diff(v: Views) -> DataFrame:
    return integrity.manifest_fact_diff(_flat_facts(v), v.manifests).withColumn("mismatches", _joined("mismatches"))


@query("integrity_report")
def _integrity_report(v: Views) -> DataFrame:
    counters = aggregates.verification_counter_check(v.verification_counters, v.verification_logs)
    counters = counters.join(v.assets.select("asset_id"), "asset_id", "left_semi")
    rows = [df.select("asset_id", "status") for df in (_certificate_diff(v), integrity.manifest_fact_diff(_flat_facts(v), v.manifests), counters)]
    return integrity.integrity_report(reduce(DataFrame.unionByName, rows))


@query("provenance_mismatch")
def _provenance_mismatch(v: Views) -> DataFrame:
    return integrity.provenance_mismatch(v.assets, v.manifests).withColumn("mismatches", _joined("mismatches"))


@query("tamper_audit")
def _tamper_audit(v: Views) -> DataFrame:
    events = integrity.tamper_audit(
        v.provenance_events, "provenance_events", "event_id", "event_hash", provenance_event_digest()
    )
    logs = integrity.tamper_audit(
        v.verification_logs, "verification_logs", "log_id", "log_hash", verification_log_digest()
    )
    splits = v.split_sessions.withColumn("body_hash", F.sha2("contributors_json", 256))
    sheets = integrity.tamper_audit(splits, "split_sessions", "session_id", "session_hash", F.col("body_hash"))
    # some manifests had a fact changed after they were hashed
    i = F.substring("asset_id", 4, 20).cast("long")
    changed = F.when(i % 71 == 0, F.replace("body", F.lit('"filename":"file-'), F.lit('"filename":"fake-'))).otherwise(F.col("body"))
    unhashed = F.regexp_replace("body", ',"manifest_hash":"[^"]*"', "")
    manifests = integrity.tamper_audit(
        sinks.manifest_json(v.assets).withColumn("body", changed), "manifests", "asset_id", "document_hash", F.sha2(unhashed, 256)
    )
    digest = F.sha2(F.concat_ws("|", "asset_uid", "filename"), 256)
    kept = v.metadata.select("asset_id", F.col("derived.metadata_sha256").alias("metadata_sha256"))
    described = v.assets.select("asset_id", "asset_uid", F.when(F.col("doc_id") % 83 == 0, "moved.bin").otherwise(F.col("filename")).alias("filename"))
    metadata = integrity.tamper_audit(
        kept.join(described, "asset_id"), "asset_metadata", "asset_id", "metadata_sha256", digest
    )
    quiet = [df.drop("stored_hash") for df in (sheets, manifests, metadata)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), quiet, events.unionByName(logs))


def _batch(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    requests = v.table("events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("as-"), (F.col("user_id") * 11).cast("string")).alias("asset_id"),
        F.col("ts").alias("requested_at"),
        F.concat(F.lit("10.0.0."), (F.col("event_id") % 9).cast("string")).alias("requester"),
    )
    return integrity.verify_batch(requests, v.assets, v.manifests)


@query("verify_batch")
def _verify_batch(v: Views) -> DataFrame:
    return _batch(v)[0].select("request_id", "asset_id", "verified", "manifest_valid", "result")


@query("verify_batch_logs")
def _verify_batch_logs(v: Views) -> DataFrame:
    return _batch(v)[1].drop("timestamp")


@query("verify_batch_deltas")
def _verify_batch_deltas(v: Views) -> DataFrame:
    return _batch(v)[2]


# --- graph --------------------------------------------------------------


def _registry(v: Views, sessions: DataFrame | None = None) -> graph.Registry:
    # children of unknown assets have no place in the graph
    return graph.Registry(
        assets=v.assets,
        contributors=v.known_split_rows,
        split_sessions=v.known_split_sessions,
        passports=v.passports,
        certificates=v.certificates,
        events=v.provenance_events,
        anomalies=_stored_anomalies(v),
        observations=_persisted(v),
        sessions=_public_sessions(v) if sessions is None else sessions,
    )


def _public_sessions(v: Views) -> DataFrame:
    return chain.public_session_summary(v.known_sessions, v.known_session_events)


def _unchecked_registry(v: Views) -> graph.Registry:
    """The registry for work that reads ids, types and classes of nodes: no chain is built or checked."""
    sessions = chain.public_sessions(v.unlinked_sessions, v.unlinked_events)
    unread = {"event_count": F.lit(None).cast("long"), "chain_valid": F.lit(None).cast("boolean")}
    return _registry(v, sessions.withColumns(unread))


@query("split_record")
def _split_record(v: Views) -> DataFrame:
    return graph.split_record(v.split_sessions).select(
        "session_id",
        "asset_id",
        "contributor_count",
        "ownership_total_pct",
        "locked_or_finalized",
        "session_hash_present",
        _joined(F.transform("contributors", lambda c: F.coalesce(F.trim(c["name"]), F.lit("")))).alias("names"),
    )


@query("evidence_nodes")
def _evidence_nodes(v: Views) -> DataFrame:
    part = lambda path: F.get_json_object("data", path)
    return graph.evidence_nodes(_registry(v)).select(
        "asset_id",
        "id",
        "type",
        "evidence_class",
        F.coalesce(
            part("$.sha256"), part("$.event_type"), part("$.provider"), part("$.certificate_hash"), part("$.brand_name"),
            part("$.license_type"), part("$.contributor_count"), part("$.contribution_type"), part("$.privacy_mode"),
            part("$.human_contributions.lyrics"), part("$.score"),
        ).alias("detail"),
    )


@query("evidence_edges")
def _evidence_edges(v: Views) -> DataFrame:
    reg = _unchecked_registry(v)
    return graph.evidence_edges(reg, graph.evidence_nodes(reg))


@query("evidence_class_counts")
def _evidence_class_counts(v: Views) -> DataFrame:
    return aggregates.evidence_class_counts(graph.evidence_nodes(_unchecked_registry(v)))


@query("graph_document")
def _graph_document(v: Views) -> DataFrame:
    # nodes are counted before they are written, so what took several shuffles is stored
    reg = replace(
        _registry(v, stored(_public_sessions(v).select("asset_id", "status", "privacy_mode", "event_count", "chain_valid"), "graph-sessions")),
        anomalies=stored(_stored_anomalies(v).select("asset_id", "anomaly_score", "flags"), "graph-anomalies"),
        observations=stored(_persisted(v).drop("details", "observed_at"), "graph-observations"),
    )
    documents = graph.registry_documents(reg, per_part=50)
    return documents.select(
        "asset_id",
        "part",
        "parts",
        "root_node_id",
        F.size("nodes").cast("long").alias("node_count"),
        F.size("edges").cast("long").alias("edge_count"),
        F.col("evidence_counts")["provenance"].alias("provenance_nodes"),
        F.to_json("nodes").alias("nodes"),
        F.to_json("edges").alias("edges"),
        F.to_json("evidence_counts").alias("evidence_counts"),
    )


@query("provider_expectations")
def _provider_expectations(v: Views) -> DataFrame:
    return integrity.provider_expectations(
        v.assets, _persisted(v), graph.evidence_nodes(_registry(v)), ["sightengine", "hive"]
    )
