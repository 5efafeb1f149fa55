-- name: registry_scan
-- uses: v1
SELECT asset_id, tenant_id, asset_uid, file_size_bytes, trust_score, h4 AS human_lyrics_present, CASE WHEN doc_id % 101 = 7 THEN 'sha256' END AS missing_keys FROM v1

-- name: registry_tables
-- uses: v5s, v4, v6
SELECT 'assets' AS "table", count(*) FILTER (doc_id % 101 <> 7) AS ok, count(*) FILTER (doc_id % 101 = 7) AS rejected FROM documents
UNION ALL SELECT unnest(['provenance_events', 'verification_logs', 'session_events']), count(*), 0 FROM events
UNION ALL SELECT 'certificates', count(*), 0 FROM v6
UNION ALL SELECT 'contributors', count(*), 0 FROM lineitem
UNION ALL SELECT 'split_sessions', count(*), 0 FROM v5s
UNION ALL SELECT 'asset_metadata', count(*), 0 FROM documents
UNION ALL SELECT 'clients', count(*), 0 FROM customer
UNION ALL SELECT unnest(['sessions', 'publications']), count(DISTINCT user_id), 0 FROM events
UNION ALL SELECT 'observations', count(*) FILTER (trim(provider) <> ''), count(*) FILTER (trim(provider) = '') FROM v4
UNION ALL SELECT 'passports', count(*), 0 FROM part

-- name: bounded_binary_scan
SELECT run, length, CASE WHEN ok THEN sha256(body) END AS sha256, CASE WHEN ok THEN md5(body) END AS md5, CASE WHEN ok THEN sha256(body) END AS second_fingerprint,
  CASE WHEN NOT ok THEN 'file is larger than 1 MB' END AS reason
FROM (SELECT *, length <= 1048576 AS ok FROM (SELECT run, body, CAST(strlen(body) AS BIGINT) AS length FROM (
  SELECT greatest(0, CAST(floor((doc_id - 400) / 100) AS BIGINT)) AS run, string_agg(text || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1)))

-- name: registry_scan_events
-- uses: v2e
SELECT event_id, asset_id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') AS "timestamp", event_hash FROM v2e

-- name: json_object_gate
SELECT event_id, CASE event_id % 10 WHEN 0 THEN '[1,2]' WHEN 1 THEN '{"k": ' WHEN 2 THEN '{}' WHEN 3 THEN '"text"' WHEN 4 THEN '{}' ELSE props END AS body,
  CASE event_id % 10 WHEN 0 THEN 'not_an_object' WHEN 1 THEN 'not_json' WHEN 3 THEN 'not_an_object' END AS reason FROM events

-- name: json_column_decode
SELECT event_id, CASE WHEN event_id % 10 < 5 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END AS items FROM events

-- name: document_sink
-- uses: v1, v6
SELECT kind, asset_id, tenant_id, CASE kind WHEN 'manifests' THEN h ELSE sha256(body) END AS document_hash, length(CASE kind WHEN 'manifests' THEN replace(body, ',"manifest_version"', ',"manifest_hash":"' || h || '","manifest_version"') ELSE body END) AS length
FROM (SELECT 'manifests' AS kind, asset_id, tenant_id, body, sha256(body) AS h FROM (SELECT asset_id, tenant_id, to_json({'ai_disclosure': ai_disclosure, 'asset_id': asset_id, 'asset_uid': asset_uid,
    'certificate_class': certificate_class, 'content_label': content_label, 'copyright_owner': copyright_owner, 'created_at': strftime(created_at, '%Y-%m-%dT%H:%M:%S'),
    'creator_name': creator_name, 'file_type': file_type, 'filename': filename, 'license_type': license_type, 'manifest_version': '1.1', 'phash': phash,
    'second_fingerprint': second_fingerprint, 'sha256': sha256})::VARCHAR AS body FROM v1)
  UNION ALL SELECT 'certificates', asset_id, tenant_id, to_json({'asset_id': asset_id, 'cert_id': cert_id, 'certificate_class': certificate_class, 'certificate_hash': certificate_hash,
    'issued_at': strftime(issued_at, '%Y-%m-%dT%H:%M:%S'), 'metadata_hash': metadata_hash, 'public_key_id': public_key_id, 'signature': signature,
    'signature_algorithm': signature_algorithm, 'subject_name': subject_name})::VARCHAR, NULL FROM v6)

-- name: evidence_export
-- uses: v1, v2e, v5
SELECT artefact, n AS "rows", a AS assets, 0 AS empty FROM (
  SELECT unnest(['readme','stored_facts','certificate','provenance_manifest','timestamps','authorship_summary']) AS artefact, count(*) AS n, count(*) AS a FROM v1
  UNION ALL SELECT 'contributor_declarations', count(*), count(DISTINCT asset_id) FROM v5 WHERE contribution_type = 'human' AND asset_id IN (SELECT asset_id FROM v1)
  UNION ALL SELECT 'audit_history', count(*), count(DISTINCT asset_id) FROM v2e WHERE asset_id IN (SELECT asset_id FROM v1)
  UNION ALL SELECT 'workflow_analysis', count(*), count(DISTINCT asset_id) FROM (
    SELECT asset_id, unnest(list_filter([h1, h2, h3, h4, h5, h6, ai_modification_by_human], lambda x: x)) FROM v1
    UNION ALL SELECT asset_id, true FROM v2e WHERE event_type = 'watermark' AND asset_id IN (SELECT asset_id FROM v1)))

-- name: append_only_sink
-- uses: v4n
SELECT observation_id, CASE WHEN observation_id % 3 = 0 THEN 1 ELSE 2 END AS run, lower(provider) AS provider, model, probability, status FROM v4n

-- name: keyed_upsert
-- uses: v1r, u8
SELECT asset_id, asset_uid, tenant_id, version, sha256(asset_uid || filename) AS metadata_sha256 FROM (
  SELECT asset_id, asset_uid, tenant_id, 2 AS version, filename FROM u8
  UNION ALL
  SELECT asset_id, asset_uid, tenant_id, 1, filename FROM v1r WHERE asset_id NOT IN (SELECT asset_id FROM u8)
    AND asset_uid NOT IN (SELECT asset_uid FROM u8 WHERE asset_id NOT IN (SELECT asset_id FROM v1r)))

-- name: schema_evolve
-- uses: v1
SELECT asset_id, CASE WHEN doc_id % 5 < 2 THEN 'src4' ELSE tenant_id END AS tenant_id, CAST(NULL AS DOUBLE) AS trust_score, CAST(NULL AS BOOLEAN) AS human_lyrics_present, 41 AS columns FROM v1

-- name: missing_score_backfill
-- uses: vmts
SELECT asset_id, CASE WHEN CAST(substr(asset_id, 4) AS BIGINT) % 3 = 0 THEN 77 ELSE metadata_trust_score END AS metadata_trust_score FROM vmts
