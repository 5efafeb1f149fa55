-- name: metadata_trust_score
-- uses: vmts
SELECT * FROM vmts

-- name: metadata_anomaly_rules
-- uses: vanoms
SELECT asset_id, anomaly_score, CASE WHEN n_flags = 0 THEN 'none' ELSE n_flags || ' flags: ' || listed || '.' END AS anomaly_summary,
  array_to_string(flags, '|') AS flags, coalesce(fields, '') AS affected_fields FROM vanoms

-- name: asset_trust_score
-- uses: vtrust
SELECT asset_id, score AS trust_score, reasons FROM vtrust

-- name: content_label
-- uses: vtrust
SELECT asset_id, CASE WHEN NOT s_mark OR s_collision THEN 'tampered' WHEN ai_detection_score >= 0.85 THEN CASE WHEN is_generated THEN 'ai_assisted' ELSE 'synthetic' END
  WHEN ai_detection_score >= 0.4 OR is_generated OR is_assisted THEN 'ai_assisted' WHEN score >= 0.65 THEN 'human_verified' ELSE 'unverified' END AS label FROM vtrust

-- name: copyright_readiness
-- uses: vready
SELECT asset_id, readiness_score, readiness_label,
  concat_ws('|', CASE WHEN h1 THEN 'form:creative_direction' END, CASE WHEN h2 THEN 'form:editing' END, CASE WHEN h3 THEN 'form:arrangement' END,
    CASE WHEN h4 THEN 'form:lyrics' END, CASE WHEN h5 THEN 'form:performance' END, CASE WHEN h6 THEN 'form:transformation' END,
    CASE WHEN detected AND is_disclosed THEN 'ai_disclosed' END, CASE WHEN NOT detected AND form_done THEN 'ai_form_complete' END,
    CASE WHEN modified THEN 'ai_output_modified' END, CASE WHEN contributor_n > 0 THEN contributor_n || '_human_contributors' END) AS supporting,
  concat_ws('|', CASE WHEN forms = 0 THEN 'no_human_forms' END, CASE WHEN detected AND NOT is_disclosed THEN 'ai_undisclosed' END,
    CASE WHEN unsupported THEN 'synthetic_unsupported' END) AS limiting
FROM vready

-- name: certificate_class
-- uses: vready
SELECT asset_id, class AS certificate_class FROM vready

-- name: certificate_document
-- uses: vready
SELECT asset_id, 'ct-' || asset_id AS cert_id, class AS certificate_class,
  CASE class WHEN 'standard' THEN 'Standard Authorship Certificate' WHEN 'hybrid_authorship' THEN 'Hybrid Authorship Certificate' WHEN 'live_split' THEN 'Live-Split Authorship Certificate'
    ELSE 'AI-Assisted Authorship Certificate' END AS certificate_class_label,
  coalesce(creator_clean, 'Unknown') AS subject_name, coalesce(copyright_owner, '') AS copyright_owner, coalesce(license_type, '') AS license_type, readiness_score,
  concat_ws('|', 'creative_direction=' || h1, 'editing=' || h2, 'arrangement=' || h3, 'lyrics=' || h4, 'performance=' || h5, 'transformation=' || h6) AS contributions,
  human_authorship_summary AS summary, CASE WHEN class <> 'standard' AND has_tool THEN 'tool-a' ELSE '' END AS ai_tools_used,
  CASE WHEN class <> 'standard' THEN ai_modification_by_human END AS ai_modification_by_human,
  CASE WHEN class <> 'standard' THEN floor(ai_detection_score * 100 * 10 + 0.5) / 10 END AS ai_detection_pct,
  CASE WHEN class = 'live_split' THEN 'Ownership Splits' ELSE 'Ownership Declarations' END AS section_c_label
FROM vready

-- name: certificate_contributors
-- uses: vready, v5
SELECT asset_id, contributor_id, name AS contributor_name, role, creative_contribution_pct, CASE WHEN class = 'live_split' THEN ownership_split_pct END AS ownership_split_pct,
  CASE WHEN class = 'live_split' THEN ai_assisted_pct END AS ai_assisted_pct, class = 'live_split' AS in_section_c
FROM v5 JOIN (SELECT asset_id, class FROM vready) USING (asset_id)

-- name: metadata_lock
SELECT cert_id, reason IS NULL AS valid, reason FROM (SELECT 'ct-' || o_orderkey AS cert_id,
  CASE WHEN o_orderkey % 50 = 0 THEN 'metadata hash mismatch' WHEN o_orderkey % 70 = 0 THEN 'signature mismatch' END AS reason FROM orders JOIN customer ON o_custkey = c_custkey)

-- name: provenance_continuity
-- uses: vcont
SELECT asset_id, score AS continuity_score, CASE WHEN score >= 0.8 THEN 'complete' WHEN score >= 0.55 THEN 'partial' WHEN score >= 0.3 THEN 'minimal' ELSE 'insufficient' END AS continuity_label,
  gaps, total_events, total_certificates FROM vcont

-- name: disclosure_note
-- uses: vnote
SELECT asset_id, note FROM vnote

-- name: forensic_signals
-- uses: vforensic
SELECT * FROM vforensic

-- name: forensic_verdict
-- uses: vforensic
SELECT asset_id, CASE WHEN high <> '' THEN 'high_review_priority' WHEN elevated <> '' THEN 'review_recommended' WHEN nothing THEN 'insufficient_evidence' ELSE 'no_major_flags' END AS verdict,
  CASE WHEN high <> '' THEN high WHEN elevated <> '' THEN elevated WHEN nothing THEN 'no_evidence_available' ELSE 'no_conflicts_found' END AS reasons
FROM (SELECT asset_id,
    concat_ws('|', CASE WHEN credentials_risk = 'high' THEN 'content_credentials_high' END, CASE WHEN session_risk = 'high' THEN 'session_chain_high' END,
      CASE WHEN metadata_risk = 'high' THEN 'metadata_anomaly_high' END, CASE WHEN observation_count > 0 AND detector_risk = 'high' THEN 'detector_probability_high' END,
      CASE WHEN observation_count = 0 AND synthetic_risk = 'high' THEN 'synthetic_probability_high' END) AS high,
    concat_ws('|', CASE WHEN metadata_risk = 'elevated' THEN 'metadata_anomaly_elevated' END, CASE WHEN observation_count > 0 AND detector_risk = 'elevated' THEN 'detector_probability_elevated' END,
      CASE WHEN observation_count = 0 AND synthetic_risk = 'elevated' THEN 'synthetic_probability_elevated' END, CASE WHEN session_risk = 'elevated' THEN 'session_evidence_elevated' END) AS elevated,
    NOT (metadata_available OR observation_count > 0 OR synthetic_available OR credentials_available OR session_available) AS nothing FROM vforensic)

-- name: passport_readiness
-- uses: v10
SELECT passport_id, passport_level = 'item' AS level_item, nullif(trim(serial_number), '') IS NOT NULL AS identified, data_carrier_type IS NOT NULL AS carrier,
  4 + CASE WHEN data_carrier_type IS NULL THEN 1 ELSE 0 END AS gaps, 'readiness_only' AS compliance_status FROM v10

-- name: copyright_report
-- uses: vcont, vnote, v5
SELECT c.asset_id, 'copyright_readiness_report' AS report_type, creator_clean AS creator_name, ownership_total_pct, note AS disclosure_note, coalesce(humans, 0) AS human_contributors,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS asset_created_at, strftime(first_upload, '%Y-%m-%dT%H:%M:%S.%f') AS first_upload_event,
  strftime(first_issued, '%Y-%m-%dT%H:%M:%S') AS first_certificate_issued, strftime(last_issued, '%Y-%m-%dT%H:%M:%S') AS latest_certificate_issued,
  strftime(first_certificate_event, '%Y-%m-%dT%H:%M:%S.%f') AS first_certificate_event, total_events, total_certificates, latest_cert_id, score AS continuity_score,
  CASE WHEN score >= 0.8 THEN 'complete' WHEN score >= 0.55 THEN 'partial' WHEN score >= 0.3 THEN 'minimal' ELSE 'insufficient' END AS continuity_label
FROM vcont c JOIN vnote USING (asset_id) LEFT JOIN (SELECT asset_id, count(*) AS humans FROM v5 WHERE contribution_type = 'human' GROUP BY 1) h USING (asset_id)

-- name: human_contributors
-- uses: v5
SELECT contributor_id, trim(name) AS name, role, ownership_split_pct FROM v5 WHERE contribution_type = 'human'

-- name: certificate_fact_diff
-- uses: vissued
SELECT asset_id, cert_id, CASE WHEN cert_id IS NOT NULL THEN array_to_string(bad, '|') END AS mismatches, 'signed_certificate' AS "check",
  CASE WHEN cert_id IS NULL THEN 'unavailable' WHEN len(bad) > 0 THEN 'fail' ELSE 'pass' END AS status FROM vissued

-- name: split_differences
-- uses: v1, v5
SELECT DISTINCT asset_id FROM v5 JOIN v1 USING (asset_id) WHERE ownership_split_pct IS NOT NULL AND certificate_class <> 'live_split'

-- name: manifest_fact_diff
-- uses: vmanifest
SELECT asset_id, CASE WHEN present THEN array_to_string(bad, '|') END AS mismatches, 'provenance_manifest' AS "check",
  CASE WHEN NOT present THEN 'unavailable' WHEN len(bad) > 0 THEN 'fail' ELSE 'pass' END AS status FROM vmanifest

-- name: integrity_report
-- uses: vissued, vmanifest, v7, v7c, v1
SELECT asset_id, bad AS mismatch_count, gone AS unavailable_count, CASE WHEN bad > 0 THEN 'review_required' WHEN gone > 0 THEN 'incomplete' ELSE 'consistent' END AS status
FROM (SELECT asset_id, count(*) FILTER (status = 'fail') AS bad, count(*) FILTER (status = 'unavailable') AS gone FROM (
  SELECT asset_id, CASE WHEN cert_id IS NULL THEN 'unavailable' WHEN len(bad) > 0 THEN 'fail' ELSE 'pass' END AS status FROM vissued
  UNION ALL SELECT asset_id, CASE WHEN NOT present THEN 'unavailable' WHEN len(bad) > 0 THEN 'fail' ELSE 'pass' END FROM vmanifest
  UNION ALL SELECT c.asset_id, CASE WHEN total_verifications = coalesce(n, 0) THEN 'pass' ELSE 'fail' END FROM v7c c
    LEFT JOIN (SELECT asset_id, count(*) AS n FROM v7 WHERE check_type IN ('file_hash','asset_id') GROUP BY 1) l USING (asset_id) WHERE c.asset_id IN (SELECT asset_id FROM v1)) GROUP BY 1)

-- name: provenance_mismatch
-- uses: v1, v1m
SELECT a.asset_id, CASE WHEN m.asset_id IS NOT NULL THEN concat_ws('|',
  CASE WHEN m.second_fingerprint <> a.second_fingerprint OR (m.second_fingerprint IS NOT NULL AND a.second_fingerprint IS NULL)
    THEN 'second_fingerprint:manifest=''' || m.second_fingerprint || ''';stored=' || coalesce('''' || a.second_fingerprint || '''', 'None') END,
  CASE WHEN m.filename <> a.filename THEN 'filename:manifest=''' || m.filename || ''';stored=''' || a.filename || '''' END) END AS mismatches
FROM v1 a LEFT JOIN v1m m USING (asset_id)

-- name: tamper_audit
-- uses: v2e, v7, v5s
SELECT 'provenance_events' AS "table", CAST(event_id AS VARCHAR) AS row_key, event_hash AS stored_hash, CASE WHEN event_hash IS NULL THEN 'missing' ELSE 'mismatch' END AS finding FROM v2e WHERE event_hash IS DISTINCT FROM true_hash
UNION ALL SELECT 'verification_logs', log_id, log_hash, 'mismatch' FROM v7 WHERE log_hash <> true_hash
UNION ALL SELECT 'split_sessions', session_id, NULL, CASE WHEN sheet_id % 7 = 0 THEN 'missing' ELSE 'mismatch' END FROM v5s WHERE sheet_id % 7 = 0 OR sheet_id % 19 = 0
UNION ALL SELECT 'manifests', 'as-' || doc_id, NULL, 'mismatch' FROM documents WHERE doc_id % 71 = 0
UNION ALL SELECT 'asset_metadata', 'as-' || doc_id, NULL, CASE WHEN doc_id % 27 = 0 THEN 'missing' ELSE 'mismatch' END FROM documents WHERE doc_id % 27 = 0 OR doc_id % 83 = 0

-- name: verify_batch
-- uses: vbatch
SELECT request_id, asset_id, verified, manifest_valid, CASE WHEN NOT verified THEN 'fail' WHEN NOT manifest_valid THEN 'warning' ELSE 'pass' END AS result FROM vbatch

-- name: verify_batch_logs
-- uses: vbatch
SELECT * EXCLUDE (t), sha256(to_json({'asset_id': asset_id, 'check_type': check_type, 'details': details, 'log_id': log_id, 'result': result, 'timestamp': t, 'verified_by': verified_by})::VARCHAR) AS log_hash
FROM (SELECT 'vb-' || request_id AS log_id, asset_id, 'asset_id' AS check_type, CASE WHEN NOT verified THEN 'fail' WHEN NOT manifest_valid THEN 'warning' ELSE 'pass' END AS result,
  CASE WHEN NOT verified THEN '{"reason":"not_found"}' ELSE to_json({'manifest_valid': manifest_valid, 'mismatches': mismatches})::VARCHAR END AS details,
  requester AS verified_by, strftime(requested_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS t FROM vbatch)

-- name: verify_batch_deltas
-- uses: vbatch
SELECT asset_id, count(*) AS delta FROM vbatch WHERE verified GROUP BY 1

-- name: split_record
-- uses: v5s
SELECT session_id, asset_id, CASE WHEN sheet_id % 19 = 0 THEN 0 ELSE n END AS contributor_count, CASE WHEN sheet_id % 19 <> 0 THEN floor(total * 10000 + 0.5) / 10000 END AS ownership_total_pct,
  sheet_id % 3 <> 0 AS locked_or_finalized, sheet_id % 7 <> 0 AS session_hash_present, CASE WHEN sheet_id % 19 = 0 THEN '' ELSE names END AS names FROM v5s

-- name: evidence_nodes
-- uses: vnodes
SELECT asset_id, id, type, evidence_class, detail FROM vnodes

-- name: evidence_edges
-- uses: vedges
SELECT asset_id, source, target, relation FROM vedges

-- name: evidence_class_counts
-- uses: vnodes
SELECT asset_id, evidence_class, count(*) AS node_count FROM vnodes GROUP BY 1, 2

-- name: graph_document
-- uses: vparts, ventries
SELECT asset_id, CAST(part AS INT) AS part, parts, 'asset:' || asset_id AS root_node_id, node_count, edge_count, provenance_nodes, nodes, edges, evidence_counts
FROM (SELECT asset_id, part, count(node) AS node_count, count(edge) AS edge_count,
    '[' || coalesce(string_agg(node, ',' ORDER BY a, b, c) FILTER (node IS NOT NULL), '') || ']' AS nodes,
    '[' || coalesce(string_agg(edge, ',' ORDER BY a, b, c) FILTER (edge IS NOT NULL), '') || ']' AS edges
  FROM (SELECT *, CAST('0x' || left(md5(key), 8) AS BIGINT) % parts AS part FROM ventries JOIN vparts USING (asset_id)) GROUP BY 1, 2)
JOIN vparts USING (asset_id)

-- name: provider_expectations
-- uses: v1, v4l, vnodes
SELECT asset_id, "check", CASE "check" WHEN 'expected_providers_present' THEN coalesce(n, 0) = 2 WHEN 'probabilities_in_range' THEN n IS NOT NULL
  WHEN 'observations_available' THEN coalesce(available, false) WHEN 'graph_root_matches' THEN true ELSE coalesce(g, 0) = 2 END AS ok
FROM v1 CROSS JOIN (VALUES ('expected_providers_present'), ('probabilities_in_range'), ('observations_available'), ('graph_root_matches'), ('graph_has_providers')) c("check")
LEFT JOIN (SELECT asset_id, count(DISTINCT provider) AS n, bool_and(status = 'available') AS available FROM v4l GROUP BY 1) USING (asset_id)
LEFT JOIN (SELECT asset_id, count(DISTINCT provider) AS g FROM vnodes WHERE provider IS NOT NULL GROUP BY 1) USING (asset_id)
