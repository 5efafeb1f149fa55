-- name: tenant_scope
-- uses: v1
SELECT asset_id, tenant_id, sha256 FROM v1 WHERE tenant_id = 'src3'

-- name: asset_list
-- uses: v1
SELECT asset_uid, asset_id, filename, asset_type, file_type, trust_score, content_label, creator_name, ai_disclosure, certificate_class,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, coalesce(total_verifications, 0) AS total_verifications,
  (SELECT count(*) FROM v1 WHERE tenant_id = 'src7') AS total_count
FROM v1 WHERE tenant_id = 'src7' ORDER BY v1.created_at DESC, asset_uid, asset_id LIMIT 50

-- name: newest_n
-- uses: v6
SELECT cert_id, asset_id, strftime(issued_at, '%Y-%m-%dT%H:%M:%S') AS issued_at FROM v6 WHERE tenant_id = 'src5' ORDER BY v6.issued_at DESC, cert_id LIMIT 40

-- name: canonical_facts
-- uses: vfacts
SELECT asset_id, creator_clean AS creator_name, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at,
  CASE WHEN doc_id % 5 = 0 THEN 'declared|hashed' ELSE '' END AS label_reasons, coalesce(total_verifications, 0) AS total_verifications,
  ai_disclosure AS disclosure, CASE WHEN has_tool THEN 'tool-a' ELSE '' END AS declared_tools,
  floor(ai_detection_score * 100 * 10 + 0.5) / 10 AS detection_pct, copyright_owner, ownership_total_pct, ownership_declared,
  summary, h4 AS lyrics, forms FROM vfacts

-- name: contributor_facts
-- uses: v5
SELECT asset_id, contributor_id, trim(name) AS name, role, contribution_type, creative_contribution_pct, ownership_split_pct, ai_assisted_pct,
  strftime(added_at, '%Y-%m-%dT%H:%M:%S') AS added_at FROM v5

-- name: public_registry_view
-- uses: vfacts, v3u
SELECT f.asset_id, asset_uid, filename, sha256, creator_clean AS creator_name, copyright_owner, ai_disclosure, copyright_readiness_score AS readiness_score,
  u.status AS session_status, u.privacy_mode, u.chain_valid, u.loc_level AS location_level
FROM vfacts f LEFT JOIN v3u u USING (asset_id)

-- name: asset_report
-- uses: vfacts, v3u
SELECT f.asset_id, coalesce(CASE WHEN doc_id % 9 <> 0 THEN file_type END, [NULL,'image/jpeg','application/pdf','audio/x-wav'][doc_id % 4 + 1]) AS mime_type,
  coalesce(asset_type, split_part(coalesce(CASE WHEN doc_id % 9 <> 0 THEN file_type END, [NULL,'image/jpeg','application/pdf','audio/x-wav'][doc_id % 4 + 1], 'file'), '/', 1)) AS asset_type,
  manifest_path, ownership_total_pct, u.status AS session_status, u.event_count AS session_events FROM vfacts f LEFT JOIN v3u u USING (asset_id)

-- name: hash_match
-- uses: v1, v1r
SELECT r.doc_id AS request_id, r.sha256,
  CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'verified' ELSE 'ambiguous' END AS status,
  n IS NOT NULL AS verified, coalesce(n, 0) AS match_count,
  CASE WHEN n = 1 THEN m.asset_uid END AS asset_uid, CASE WHEN n = 1 THEN m.trust_score END AS trust_score,
  CASE WHEN n = 1 THEN m.content_label END AS content_label
FROM (SELECT doc_id, CASE WHEN doc_id % 16 = 0 THEN sha256('unknown' || doc_id) ELSE sha256 END AS sha256 FROM v1) r
LEFT JOIN (SELECT sha256, count(*) AS n, min(asset_uid) AS asset_uid, min(trust_score) AS trust_score, min(content_label) AS content_label FROM v1r GROUP BY 1) m USING (sha256)

-- name: hash_match_candidates
-- uses: v1, v1r
SELECT sha256, asset_uid, tenant_id, row_number() OVER (PARTITION BY sha256 ORDER BY created_at, asset_uid) AS match_no
FROM v1r WHERE sha256 IN (SELECT sha256 FROM v1 WHERE doc_id % 16 <> 0)

-- name: file_match
-- uses: v1, v1r
SELECT d.doc_id AS file_id, d.sha256, n AS match_count, n > 1 AS ambiguous, ok AS verified, CASE WHEN n = 1 THEN uid END AS asset_uid
FROM v1 d JOIN (SELECT sha256, count(*) AS n, bool_or(coalesce(CASE WHEN doc_id % 37 = 0 THEN '00' ELSE second_fingerprint END = sha256, true)) AS ok, min(asset_uid) AS uid FROM v1r GROUP BY 1) m USING (sha256)

-- name: file_match_candidates
-- uses: v1r
SELECT sha256, asset_uid, tenant_id, coalesce(CASE WHEN doc_id % 37 = 0 THEN '00' ELSE second_fingerprint END = sha256, true) AS hash_verified FROM v1r

-- name: certificate_asset_join
-- uses: v6, v1
SELECT cert_id, asset_id, a.filename AS asset_filename, subject_name, c.certificate_class, trust_score, content_label,
  strftime(issued_at, '%Y-%m-%dT%H:%M:%S') AS issued_at, certificate_hash, signature_algorithm, public_key_id, count(*) OVER () AS total_count
FROM v6 c JOIN v1 a USING (asset_id) WHERE a.tenant_id = 'src3' ORDER BY c.issued_at DESC, cert_id LIMIT 50

-- name: asset_binding_check
-- uses: v3i, v1
SELECT event_id, CASE WHEN reason IS NULL THEN sha END AS sha256, reason FROM (
  SELECT e.event_id, a.sha256 AS sha, CASE WHEN ref IS NULL THEN 'asset_missing' WHEN a.sha256 IS NULL THEN 'asset_unknown'
    WHEN declared <> a.sha256 THEN 'digest_differs' END AS reason
  FROM (SELECT s.event_id, s.tenant_id, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN 'as-' || (user_id + 1) ELSE s.asset_id END AS ref,
      CASE WHEN k % 3 = 1 THEN repeat('0', 64) WHEN k % 3 = 2 THEN o.sha256 END AS declared
    FROM v3i s LEFT JOIN v1 o ON o.doc_id = s.user_id WHERE event_type = 'asset_registered') e
  LEFT JOIN v1 a ON a.asset_id = e.ref AND a.tenant_id = e.tenant_id)

-- name: source_lineage_snapshot
-- uses: v1
SELECT 'T-' || s.doc_id AS session_id, s.tenant_id, a.asset_id AS source_asset_id, a.asset_uid AS source_asset_uid, a.sha256 AS source_sha256,
  a.ai_disclosure AS source_ai_disclosure, a.ai_detection_score AS source_ai_detection_score, a.content_label AS source_content_label, a.filename AS source_filename,
  'source_captured' AS event_type, 'source_asset_linked' AS checkpoint, false AS history_mutated
FROM v1 s JOIN v1 a ON a.doc_id = CASE WHEN s.doc_id % 2 = 0 THEN s.doc_id ELSE s.doc_id // 2 END AND a.tenant_id = s.tenant_id

-- name: name_match_join
-- uses: v5
SELECT DISTINCT asset_id, lower(trim(name)) AS name_key, 'contributor' AS member, contributor_id AS member_id FROM v5
WHERE (asset_id, lower(trim(name))) IN (SELECT (asset_id, lower(trim(sheet_name))) FROM v5 WHERE trim(sheet_name) <> '')
UNION ALL SELECT DISTINCT asset_id, lower(trim(sheet_name)), 'sheet', CAST(sheet_id AS VARCHAR) FROM v5
WHERE trim(sheet_name) <> '' AND (asset_id, lower(trim(sheet_name))) IN (SELECT (asset_id, lower(trim(name))) FROM v5)

-- name: legacy_observation_fallback
-- uses: v1, v4l
SELECT asset_id, CAST(observation_id AS VARCHAR) AS observation_id, provider, model, signal, probability, status FROM v4l
UNION ALL
SELECT asset_id, 'legacy:' || asset_id, 'sightengine', 'genai', 'synthetic_media_probability', ai_detection_score, 'legacy_persisted_score'
FROM v1 WHERE ai_detection_score IS NOT NULL AND asset_id NOT IN (SELECT asset_id FROM v4l WHERE provider = 'sightengine' AND model = 'genai')

-- name: certificate_fallback_lookup
-- uses: v1, v6l
SELECT coalesce(f.asset_id, c.asset_id) AS asset_id, coalesce(f.doc, c.doc) AS document, CASE WHEN f.doc IS NOT NULL THEN 'file' ELSE 'row' END AS origin
FROM (SELECT asset_id, '{"file":' || doc_id || '}' AS doc FROM v1 WHERE doc_id % 4 = 0) f
FULL JOIN (SELECT asset_id, to_json({'asset_id': asset_id, 'cert_id': cert_id, 'certificate_class': certificate_class, 'certificate_hash': certificate_hash,
    'issued_at': strftime(issued_at, '%Y-%m-%dT%H:%M:%S'), 'metadata_hash': metadata_hash, 'public_key_id': public_key_id, 'signature': signature,
    'signature_algorithm': signature_algorithm, 'subject_name': subject_name})::VARCHAR AS doc FROM v6l) c ON c.asset_id = f.asset_id

-- name: ownership_totals
-- uses: vfacts
SELECT asset_id, copyright_owner, license_type, split_count, ownership_total_pct, ownership_declared FROM vfacts

-- name: lenient_numeric_total
-- uses: v5
SELECT sheet_id, floor(sum(CASE WHEN position % 4 = 0 OR position % 5 = 0 OR sheet_id % 9 = 0 THEN NULL ELSE round(ownership_split_pct, 4) END) * 10000 + 0.5) / 10000 AS total FROM v5 GROUP BY 1

-- name: split_sheet_validate
-- uses: v5
SELECT sheet_id, n AS contributor_count, floor(total * 10000 + 0.5) / 10000 AS total,
  CASE WHEN bad IS NOT NULL THEN 'contributor ' || bad || ' ' || fault
    WHEN declared <> n THEN 'split_missing' WHEN abs(total - 100) > 0.01 THEN 'split_total' END AS reason
FROM (SELECT sheet_id, count(*) AS n, count(ownership_split_pct) AS declared, sum(ownership_split_pct) AS total,
    min(position) FILTER (fault IS NOT NULL) AS bad, min_by(fault, position) FILTER (fault IS NOT NULL) AS fault
  FROM (SELECT *, CASE WHEN trim(sheet_name) = '' THEN 'name_missing' WHEN ownership_split_pct > 100 THEN 'ownership_split_pct_range' END AS fault FROM v5) GROUP BY 1)

-- name: verification_counter_check
-- uses: v7, v7c
SELECT c.asset_id, total_verifications AS stored_total, coalesce(n, 0) AS log_count, CASE WHEN total_verifications = coalesce(n, 0) THEN 'pass' ELSE 'fail' END AS status
FROM v7c c LEFT JOIN (SELECT asset_id, count(*) AS n FROM v7 WHERE check_type IN ('file_hash','asset_id') GROUP BY 1) l USING (asset_id)

-- name: detector_summary
-- uses: v4n
SELECT asset_id, array_to_string(list_sort(list(DISTINCT provider)), '|') AS providers, count(*) AS observation_count,
  CASE max(CASE risk WHEN 'high' THEN 2 WHEN 'elevated' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'elevated' ELSE 'low' END AS highest_risk,
  count(DISTINCT provider) AS provider_count, CAST(NULL AS DOUBLE) AS consensus_score FROM v4n GROUP BY 1

-- name: human_form_count
-- uses: vfacts
SELECT asset_id, forms FROM vfacts

-- name: session_evidence_rollup
-- uses: v3r
SELECT session_id, workflow, production_environment, automatic_project_detected, automatic_revisions, automatic_exports, contributor_declarations,
  source_asset_uid IS NOT NULL AND transformations IS NOT NULL AS verified, source_asset_uid, history_preserved, transformations, statement, final_provenance_disclosure FROM v3r

-- name: first_seen_distinct
-- uses: v3w
SELECT session_id, name, category, min({'s': sequence, 'p': pos}).s AS first_sequence, min({'s': sequence, 'p': pos}).p AS first_pos
FROM (SELECT session_id, 'Device ' || (k % 4) AS name, CASE WHEN k % 8 < 4 THEN 'keyboard' ELSE 'production_hardware' END AS category, sequence, 0 AS pos FROM v3w WHERE k % 6 = 4
  UNION ALL SELECT session_id, 'App ' || (k % 3), 'app', sequence, 0 FROM v3w WHERE k % 6 = 4
  UNION ALL SELECT session_id, 'App 0', 'app', sequence, 1 FROM v3w WHERE k % 6 = 4) GROUP BY 1, 2, 3

-- name: latest_per_key
-- uses: v4l
SELECT observation_id, asset_id, provider, model, probability, strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS observed_at FROM v4l

-- name: latest_certificate
-- uses: v6, v6l
SELECT asset_id, cert_id, certificate_class, strftime(a, '%Y-%m-%dT%H:%M:%S') AS first_issued_at, strftime(b, '%Y-%m-%dT%H:%M:%S') AS latest_issued_at, n AS certificate_count
FROM v6l JOIN (SELECT asset_id, min(issued_at) AS a, max(issued_at) AS b, count(*) AS n FROM v6 GROUP BY 1) USING (asset_id)

-- name: latest_session
-- uses: v3s
SELECT 'as-' || (user_id // 3) AS asset_id, session_id, status FROM v3s WHERE status IN ('complete','incomplete','integrity_failed')
QUALIFY row_number() OVER (PARTITION BY user_id // 3 ORDER BY closed_at DESC NULLS LAST, created_at DESC NULLS LAST, session_id) = 1

-- name: first_last_event
-- uses: v3e
SELECT coalesce(a.session_id, b.session_id) AS session_id, start_event, privacy_mode, disclosure_event, ai_used
FROM (SELECT session_id, event_id AS start_event, privacy_mode FROM v3e WHERE event_type = 'session_started' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sequence) = 1) a
FULL JOIN (SELECT session_id, event_id AS disclosure_event, ai_used FROM v3e WHERE event_type = 'ai_tool_disclosed' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sequence DESC) = 1) b ON a.session_id = b.session_id

-- name: lineage_steps
-- uses: v2e
SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY "timestamp", event_id) AS step, event_id, event_type, tool_used, event_hash FROM v2e

-- name: chronology_check
-- uses: v2e
SELECT asset_id, count(*) AS timestamped_events, bool_and(before IS NULL OR before <= t) AS chronological
FROM (SELECT asset_id, t, lag(t) OVER (PARTITION BY asset_id ORDER BY event_id) AS before
  FROM (SELECT asset_id, event_id, CASE WHEN event_id % 499 = 0 THEN "timestamp" - INTERVAL 5 DAY WHEN event_id % 7 <> 0 THEN "timestamp" END AS t FROM v2e) WHERE t IS NOT NULL) GROUP BY 1

-- name: transformation_chain
-- uses: v1, v2e
SELECT asset_id, 1 AS section, step, 'declared_human' AS step_type, form, label, CAST(NULL AS VARCHAR) AS tool, CAST(NULL AS VARCHAR) AS "timestamp", 'creator_declaration' AS source
FROM (SELECT asset_id, 1 AS step, 'creative_direction' AS form, 'human:creative_direction' AS label FROM v1 WHERE h1
  UNION ALL SELECT asset_id, 2, 'editing', 'human:editing' FROM v1 WHERE h2
  UNION ALL SELECT asset_id, 3, 'arrangement', 'human:arrangement' FROM v1 WHERE h3
  UNION ALL SELECT asset_id, 4, 'lyrics', 'human:lyrics' FROM v1 WHERE h4
  UNION ALL SELECT asset_id, 5, 'performance', 'human:performance' FROM v1 WHERE h5
  UNION ALL SELECT asset_id, 6, 'transformation', 'human:transformation' FROM v1 WHERE h6)
UNION ALL
SELECT asset_id, 2, row_number() OVER (PARTITION BY asset_id ORDER BY "timestamp", event_id), 'system_transformation', 'watermark', coalesce(description, 'watermark'), tool_used,
  strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f'), 'provenance_event' FROM v2e WHERE event_type = 'watermark' AND asset_id IN (SELECT asset_id FROM v1)
UNION ALL
SELECT asset_id, 3, 1, 'declared_human', 'ai_modification', 'ai_output_modified', NULL, NULL, 'creator_declaration' FROM v1 WHERE ai_modification_by_human

-- name: strongest_detector
-- uses: v1, v4n
SELECT asset_id, legacy IS NOT NULL OR b.probability IS NOT NULL AS available, p AS probability, floor(p * 100 * 100 + 0.5) / 100 AS probability_pct,
  CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.5 THEN 'elevated' WHEN p IS NOT NULL THEN 'low' ELSE 'unknown' END AS risk,
  CASE WHEN legacy IS NOT NULL THEN 'sightengine' ELSE provider END AS provider, CASE WHEN legacy IS NOT NULL THEN 'genai' ELSE model END AS model,
  CASE WHEN legacy IS NOT NULL THEN 'legacy_primary_detector_probability' ELSE signal END AS signal
FROM (SELECT a.asset_id, legacy, b.provider, b.model, b.signal, b.probability, coalesce(legacy, b.probability) AS p
  FROM (SELECT asset_id, CASE WHEN doc_id % 3 = 0 THEN ai_detection_score END AS legacy FROM v1) a
  LEFT JOIN (SELECT * FROM v4n QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY probability DESC, observed_at, observation_id) = 1) b USING (asset_id)) b

-- name: set_gap
-- uses: v1, v4n
SELECT asset_id, array_to_string(list_filter(['hive','sightengine','third'], lambda e: NOT list_contains(seen, e)), '|') AS missing
FROM (SELECT asset_id, coalesce(list(DISTINCT lower(provider)) FILTER (model = 'm1'), []) AS seen
  FROM (SELECT asset_id, provider, model FROM v4n UNION ALL SELECT asset_id, NULL, NULL FROM v1) GROUP BY 1)

-- name: chain_build
-- uses: v3c
SELECT event_id, session_id, sequence, previous_event_hash, evidence_hash FROM v3c

-- name: chain_verify
-- uses: v3v
SELECT session_id, event_count, head_hash, head_mismatch, event_failures, failure_count, valid FROM v3v

-- name: chain_failures
-- uses: v3p, v3v
SELECT * FROM v3p UNION ALL SELECT session_id, head_event_id, 'session_head_mismatch' FROM v3v WHERE head_mismatch

-- name: chain_block_heads
-- uses: v3h
SELECT * FROM v3h

-- name: chain_block_failures
-- uses: v3h, v3f
SELECT coalesce(h.session_id, e.session_id) AS session_id, coalesce(h.block, e.block) AS block,
  CASE WHEN h.session_id IS NULL THEN 'unknown_block' WHEN e.session_id IS NULL THEN 'missing_block' ELSE 'block_mismatch' END AS reason
FROM v3h h FULL JOIN (
  SELECT session_id, (sequence - 1) // 1024 AS block,
    sha256(string_agg(CASE WHEN recomputed = evidence_hash THEN evidence_hash ELSE evidence_hash || '!' || recomputed END, ',' ORDER BY sequence, event_id)) AS seen
  FROM v3f GROUP BY ALL) e ON e.session_id = h.session_id AND e.block = h.block
WHERE seen IS DISTINCT FROM block_digest

-- name: completion_check
-- uses: v3x
SELECT session_id, len(missing) = 0 AS eligible, array_to_string(missing, '|') AS missing, event_count FROM v3x

-- name: session_close
-- uses: v3x, v3s
SELECT session_id, CASE WHEN event_failures > 0 THEN 'integrity_failed' WHEN len(missing) = 0 THEN 'complete' ELSE 'incomplete' END AS status,
  array_to_string(missing, '|') AS missing, event_count + 1 AS sequence,
  '{"eligible_for_complete":' || (len(missing) = 0) || ',"missing":[' || array_to_string(list_transform(missing, lambda m: '"' || m || '"'), ',') || ']}' AS payload,
  head_hash AS previous_event_hash
FROM v3x JOIN v3s USING (session_id) WHERE v3s.status = 'recording'

-- name: public_session_summary
-- uses: v3u
SELECT asset_id, session_id, status, privacy_mode, event_count, chain_valid, strftime(started_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS started_at,
  strftime(closed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS closed_at, ai_used, loc_level AS location_level, loc_summary AS location_summary FROM v3u

-- name: public_record
-- uses: v3u, v3r, v3e
SELECT 'record' AS kind, asset_id, session_id, status, privacy_mode, event_count, chain_valid, strftime(started_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS started_at,
  strftime(closed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS closed_at, ai_used, loc_level AS location_level, loc_summary AS location_summary,
  concat_ws('|', CASE WHEN u % 2 = 0 THEN 'production_environment' END, CASE WHEN u % 3 = 0 THEN 'source_asset_uid' END, CASE WHEN u % 5 = 0 THEN 'transformation_statement' END) AS published_fields,
  workflow, CASE WHEN u % 2 = 0 THEN production_environment END AS production_environment, automatic_project_detected, automatic_revisions, automatic_exports, contributor_declarations,
  source_asset_uid IS NOT NULL AND transformations IS NOT NULL AS verified, CASE WHEN u % 3 = 0 THEN source_asset_uid END AS source_asset_uid, history_preserved,
  coalesce(transformations, '') AS transformations, CASE WHEN u % 5 = 0 THEN statement END AS statement, final_provenance_disclosure,
  NULL AS event_id, NULL AS sequence, NULL AS event_type, NULL AS occurred_at, NULL AS recorded_at, NULL AS source_type, NULL AS previous_event_hash, NULL AS evidence_hash
FROM (SELECT *, CAST(substr(session_id, 3) AS BIGINT) AS u FROM v3u) JOIN v3r USING (session_id)
UNION ALL BY NAME
SELECT 'event' AS kind, u.asset_id, session_id, e.ai_used, location_level,
  CASE location_level WHEN 'precise_private' THEN 'private' WHEN 'coarse' THEN nullif(location_summary, '') ELSE location_summary END AS location_summary,
  event_id, sequence, event_type, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS occurred_at, strftime(recorded_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS recorded_at,
  source_type, previous_event_hash, evidence_hash
FROM v3e e JOIN v3u u USING (session_id)

-- name: public_record_timeline
-- uses: v3u, v3e
SELECT u.asset_id, session_id, event_id, sequence, event_type, location_level FROM v3e e JOIN v3u u USING (session_id)
