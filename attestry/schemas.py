"""Fixed schemas of the registry tables and their not-null keys."""

from __future__ import annotations

from pyspark.sql import types as T

# DDL per table; timestamps are naive UTC, dynamic parts are JSON text.
_TABLES = {
    "assets": (
        "asset_uid string, asset_id string, tenant_id string, filename string, file_type string, asset_type string, "
        "original_path string, watermarked_path string, certificate_path string, manifest_path string, "
        "sha256 string, second_fingerprint string, phash string, trust_score double, content_label string, "
        "label_reasons string, ai_detection_score double, watermark_applied boolean, watermark_visible boolean, "
        "watermark_invisible boolean, creator_name string, copyright_owner string, license_type string, "
        "ai_disclosure string, file_size_bytes bigint, total_verifications int, registry_url string, "
        "created_at timestamp_ntz, human_creative_direction boolean, human_editing_present boolean, "
        "human_arrangement_present boolean, human_lyrics_present boolean, human_performance_present boolean, "
        "human_transformation_present boolean, copyright_readiness_score double, copyright_readiness_label string, "
        "certificate_class string, ai_disclosure_complete boolean, ai_tools array<string>, "
        "ai_modification_by_human boolean, human_authorship_summary string",
        ["asset_uid", "asset_id", "sha256"],
    ),
    "provenance_events": (
        "event_id bigint, asset_id string, event_type string, description string, tool_used string, "
        "human_or_ai string, actor_name string, timestamp timestamp_ntz, event_hash string",
        ["event_id", "asset_id", "event_type"],
    ),
    "certificates": (
        "cert_id string, asset_id string, certificate_hash string, issued_at timestamp_ntz, issuer string, "
        "subject_name string, certificate_class string, document string, signature string",
        ["cert_id", "asset_id"],
    ),
    "contributors": (
        "contributor_id string, asset_id string, name string, role string, contribution_type string, "
        "split_percentage double, creative_contribution_pct double, ownership_split_pct double, "
        "ai_assisted_pct double, wallet_address string, added_at timestamp_ntz",
        ["contributor_id", "asset_id"],
    ),
    "split_sessions": (
        "session_id string, asset_id string, tenant_id string, session_name string, status string, "
        "contributors_json string, created_at timestamp_ntz, locked_at timestamp_ntz, session_hash string",
        ["session_id"],
    ),
    "verification_logs": (
        "log_id string, asset_id string, check_type string, result string, details string, verified_by string, "
        "timestamp timestamp_ntz, log_hash string",
        ["log_id", "check_type", "result"],
    ),
    "asset_metadata": (
        "id string, asset_id string, asset_uid string, tenant_id string, engine_version string, extractor string, "
        "supported boolean, raw_tags map<string,string>, normalized string, derived string, warnings string, "
        "metadata_sha256 string, metadata_trust_score int, score_breakdown string, anomaly_score int, "
        "anomaly_flags string, analyzed_at timestamp_ntz",
        ["id", "asset_id"],
    ),
    "clients": (
        "id string, tenant_id string, company_name string, contact_name string, email string, status string, "
        "plan string, api_key_hash string, created_at timestamp_ntz, approved_at timestamp_ntz",
        ["id", "tenant_id", "email"],
    ),
    "sessions": (
        "session_id string, tenant_id string, asset_id string, status string, schema_version string, "
        "current_hash string, created_by string, started_at timestamp_ntz, closed_at timestamp_ntz, "
        "created_at timestamp_ntz",
        ["session_id", "tenant_id", "status"],
    ),
    "session_events": (
        "event_id bigint, session_id string, tenant_id string, asset_id string, sequence int, event_type string, "
        "occurred_at timestamp_ntz, recorded_at timestamp_ntz, evidence_hash string, previous_event_hash string, "
        "source_type string, source_name string, creator_id string, ai_used boolean, privacy_mode string, "
        "location_level string, location_summary string, payload string",
        ["event_id", "session_id", "sequence", "event_type"],
    ),
    "observations": (
        "observation_id bigint, asset_id string, tenant_id string, provider string, model string, signal string, "
        "probability double, status string, details string, observed_at timestamp_ntz",
        ["observation_id", "asset_id", "provider", "model", "signal"],
    ),
    "passports": (
        "passport_id string, asset_id string, tenant_id string, passport_level string, product_name string, "
        "brand_name string, gtin14 string, serial_number string, data_carrier_type string, canonical_uri string, "
        "resolver_uri string, regulatory_status string, created_at timestamp_ntz, updated_at timestamp_ntz",
        ["passport_id", "asset_id"],
    ),
    "publications": (
        "session_id string, tenant_id string, asset_id string, fields array<string>, updated_at timestamp_ntz",
        ["session_id", "tenant_id"],
    ),
}

TABLE_NAMES = list(_TABLES)


def table_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(_TABLES[table][0])


def required_columns(table: str) -> list[str]:
    return _TABLES[table][1]
