-- name: v1
SELECT doc_id, source AS tenant_id, sha256(text) AS sha256, md5(text) AS md5,
  'AU-' || upper(left(md5(source), 8)) || upper(left(sha256(source || ':' || sha256(text)), 16)) AS asset_uid,
  'as-' || doc_id AS asset_id,
  'file-' || doc_id || '.' || ['txt','jpg','pdf','wav'][doc_id % 4 + 1] AS filename,
  ['text/plain','image/jpeg','application/pdf','audio/x-wav'][doc_id % 4 + 1] AS file_type,
  ['txt','jpg','pdf','wav'][doc_id % 4 + 1] AS extension,
  CASE WHEN doc_id % 6 <> 5 THEN ['text','image','application','audio'][doc_id % 4 + 1] END AS asset_type,
  strlen(text) AS file_size_bytes,
  CASE WHEN doc_id % 43 <> 0 THEN sha256(text) END AS second_fingerprint,
  CASE WHEN doc_id % 4 = 1 THEN left(md5(text), 16) END AS phash,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS created_at,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '   ' ELSE 'Creator ' || (doc_id % 23) END AS creator_name,
  CASE WHEN doc_id % 5 <> 0 THEN 'Owner ' || (doc_id % 31) END AS copyright_owner,
  CASE WHEN doc_id % 4 <> 0 THEN 'License ' || (doc_id % 3) END AS license_type,
  ['human','ai','mixed','unknown',NULL,'AI_GENERATED'][doc_id % 6 + 1] AS ai_disclosure_raw,
  ['human','ai_generated','ai_assisted','unknown',NULL,'ai_generated'][doc_id % 6 + 1] AS ai_disclosure,
  doc_id % 3 = 0 AS has_tool,
  CASE WHEN doc_id % 9 <> 0 THEN (doc_id * 37 % 101) / 100.0::DOUBLE END AS ai_detection_score,
  CASE WHEN (doc_id+1) % 4 <> 0 THEN (doc_id+1) % 3 = 0 END AS h1,
  CASE WHEN (doc_id+2) % 4 <> 0 THEN (doc_id+2) % 3 = 0 END AS h2,
  CASE WHEN (doc_id+3) % 4 <> 0 THEN (doc_id+3) % 3 = 0 END AS h3,
  CASE WHEN (doc_id+4) % 4 <> 0 THEN (doc_id+4) % 3 = 0 END AS h4,
  CASE WHEN (doc_id+5) % 4 <> 0 THEN (doc_id+5) % 3 = 0 END AS h5,
  CASE WHEN (doc_id+6) % 4 <> 0 THEN (doc_id+6) % 3 = 0 END AS h6,
  CASE WHEN doc_id % 10 <> 0 THEN doc_id % 3 = 0 END AS ai_disclosure_complete,
  CASE WHEN doc_id % 5 <> 0 THEN doc_id % 2 = 0 END AS ai_modification_by_human,
  CASE WHEN doc_id % 8 = 0 THEN '  ' ELSE ' Summary ' || (doc_id % 13) END AS human_authorship_summary,
  doc_id % 2 = 0 AS watermark_applied, doc_id % 4 = 0 AS watermark_visible,
  CASE WHEN doc_id % 12 <> 0 THEN doc_id % 6 = 2 END AS watermark_invisible,
  CASE WHEN doc_id % 14 <> 0 THEN doc_id % 5 END AS total_verifications,
  (doc_id * 53 % 101) / 100.0::DOUBLE AS trust_score,
  ['unverified','human_verified','ai_assisted','synthetic'][doc_id % 4 + 1] AS content_label,
  ['["declared","hashed"]','[]','{broken',NULL,'{"not":"list"}'][doc_id % 5 + 1] AS label_reasons,
  (doc_id * 29 % 101) / 100.0::DOUBLE AS copyright_readiness_score,
  ['strong','moderate','limited','insufficient'][doc_id % 4 + 1] AS copyright_readiness_label,
  ['standard','hybrid_authorship','live_split','ai_assisted'][doc_id % 4 + 1] AS certificate_class,
  CASE WHEN doc_id % 10 <> 0 THEN 'manifests/' || doc_id END AS manifest_path,
  'registry/' || doc_id AS registry_url
FROM documents

-- name: v1r
-- uses: v1
SELECT * FROM v1 QUALIFY row_number() OVER (PARTITION BY asset_uid ORDER BY doc_id) = 1

-- name: v1m
-- uses: v1
SELECT doc_id, asset_id, tenant_id, asset_uid,
  CASE WHEN doc_id % 47 = 0 THEN 'renamed.bin' ELSE filename END AS filename,
  CASE WHEN doc_id % 59 = 0 THEN NULL ELSE sha256 END AS sha256,
  CASE WHEN doc_id % 61 = 0 THEN '00' ELSE second_fingerprint END AS second_fingerprint,
  phash, creator_name,
  CASE WHEN doc_id % 13 = 0 THEN coalesce(copyright_owner, '') || ' changed' ELSE copyright_owner END AS copyright_owner,
  license_type, ai_disclosure,
  trust_score + CASE WHEN doc_id % 67 = 0 THEN 0.01::DOUBLE ELSE 0.00001::DOUBLE END AS trust_score,
  content_label
FROM v1 WHERE manifest_path IS NOT NULL

-- name: v2
-- uses: v1
SELECT doc_id, asset_id, asset_uid, tenant_id,
  file_type AS f_mime, extension AS f_ext, file_size_bytes AS f_size,
  upper(extension) AS c_format,
  CASE WHEN doc_id % 17 = 0 THEN 'image/png' ELSE file_type END AS c_mime,
  CASE WHEN doc_id % 37 = 0 THEN 'png' ELSE extension END AS c_ext,
  CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN 'abc123' ELSE sha256 END AS h_sha,
  CASE WHEN doc_id % 41 <> 0 THEN md5 END AS h_md5,
  CASE WHEN doc_id % 8 <> 0 THEN (CASE WHEN doc_id % 29 = 0 THEN '2999' ELSE '2024' END) || ':06:01 12:00:00' END AS t_created,
  CASE WHEN doc_id % 8 <> 0 THEN (CASE WHEN doc_id % 6 = 0 THEN '2024:01:01 08:00:00' ELSE '2024:07:01 08:00:00' END) END AS t_modified,
  CASE WHEN doc_id % 8 <> 0 AND doc_id % 10 = 0 THEN '2024:06:01 12:00:00' END AS t_digitized,
  CASE WHEN doc_id % 2 <> 0 THEN 'Canon' END AS make,
  CASE WHEN doc_id % 6 = 1 THEN 'EOS' END AS model,
  CASE WHEN doc_id % 31 = 0 THEN 95.0::DOUBLE WHEN doc_id % 3 = 0 THEN 48.5::DOUBLE END AS lat,
  CASE WHEN doc_id % 4 <> 0 THEN 2.25::DOUBLE END AS lon,
  nullif(trim(creator_name), '') AS creator,
  CASE WHEN doc_id % 3 = 0 THEN '(c) 2024' END AS copyright,
  CASE WHEN doc_id % 14 = 0 THEN 'Adobe Photoshop' WHEN doc_id % 5 = 0 THEN 'Studio' END AS software,
  CASE WHEN doc_id % 4 = 3 THEN 'PCM' END AS codec_audio,
  CASE WHEN doc_id % 9 = 0 THEN 'Desk' END AS byline,
  CASE WHEN doc_id % 4 = 3 THEN 'Song ' || doc_id END AS a_title,
  CASE WHEN doc_id % 8 = 3 THEN 'Singer' END AS a_artist,
  CASE WHEN doc_id % 5 = 0 THEN '48.5' END AS r_gpslat,
  CASE WHEN doc_id % 4 = 1 THEN '640' END AS r_width,
  CASE WHEN doc_id % 4 = 1 THEN '480' END AS r_height,
  CASE WHEN doc_id % 27 <> 0 THEN sha256(asset_uid || '|' || filename) END AS d_sha
FROM v1

-- name: v2e
SELECT *, CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 997 = 0 THEN repeat('0', 64) ELSE true_hash END AS event_hash
FROM (
  SELECT *, sha256(to_json({'actor_name': actor_name, 'asset_id': asset_id, 'description': description, 'event_id': event_id,
      'event_type': event_type, 'human_or_ai': human_or_ai,
      'timestamp': strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ'), 'tool_used': tool_used})::VARCHAR) AS true_hash
  FROM (
    SELECT event_id, 'as-' || user_id AS asset_id, user_id,
      CASE event_type WHEN 'signup' THEN 'upload' WHEN 'view' THEN 'verify' WHEN 'click' THEN 'watermark'
        WHEN 'purchase' THEN 'certificate_issued' WHEN 'error' THEN 'refresh' ELSE 'other' END AS event_type,
      ts AS "timestamp",
      CASE WHEN event_id % 3 = 0 THEN 'step ' || props END AS description,
      CASE WHEN event_id % 4 <> 0 THEN 'tool-' || (event_id % 4) END AS tool_used,
      ['human','ai','system'][event_id % 3 + 1] AS human_or_ai,
      'actor-' || (event_id % 17) AS actor_name
    FROM events))

-- name: v3i
SELECT event_id, user_id, session_id, tenant_id, asset_id, sequence, event_type, occurred_at, recorded_at,
  'web' AS source_type, 'Studio ' || (event_id % 5) AS source_name, 'creator-' || user_id AS creator_id, k,
  CASE WHEN event_type = 'ai_tool_disclosed' THEN k % 2 = 0 END AS ai_used,
  CASE WHEN event_type = 'session_started' THEN ['private','proof','public',NULL][user_id % 4 + 1] END AS privacy_mode,
  CASE WHEN event_type = 'session_started' THEN ['none','coarse','precise_private'][user_id % 3 + 1] END AS location_level,
  CASE WHEN event_type = 'session_started' AND user_id % 3 = 1 AND user_id % 2 = 0 THEN 'Region ' || (user_id % 7) END AS location_summary,
  props AS payload
FROM (
  SELECT *, CASE WHEN sequence = 1 THEN 'session_started' WHEN raw_type = 'signup' THEN 'source_captured'
      WHEN raw_type = 'view' THEN 'work_saved' WHEN raw_type = 'click' THEN 'work_exported'
      WHEN raw_type = 'purchase' THEN 'ai_tool_disclosed' ELSE 'asset_registered' END AS event_type
  FROM (
    SELECT event_id, user_id, 'S-' || user_id AS session_id, 'src' || (user_id % 20) AS tenant_id, 'as-' || user_id AS asset_id,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
      event_type AS raw_type, ts AS occurred_at, ts AS recorded_at,
      CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props
    FROM events))

-- name: v3b
-- uses: v3i
SELECT *, sha256(to_json({'ai_used': ai_used, 'asset_id': asset_id, 'creator_id': creator_id, 'event_id': event_id, 'event_type': event_type,
  'location_level': location_level, 'location_summary': location_summary,
  'occurred_at': strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ'), 'payload': payload, 'privacy_mode': privacy_mode,
  'recorded_at': strftime(recorded_at, '%Y-%m-%dT%H:%M:%S.%fZ'), 'schema_version': '1.0',
  'session_id': session_id, 'source_name': source_name, 'source_type': source_type})::VARCHAR) AS body_digest
FROM v3i

-- name: v3l
-- uses: v3b
SELECT session_id, sequence, CAST(NULL AS VARCHAR) AS previous_event_hash, sha256(':1:' || body_digest) AS evidence_hash
FROM v3b WHERE sequence = 1
UNION ALL
SELECT b.session_id, b.sequence, l.evidence_hash, sha256(l.evidence_hash || ':' || b.sequence || ':' || b.body_digest)
FROM v3l l JOIN v3b b ON b.session_id = l.session_id AND b.sequence = l.sequence + 1

-- name: v3c
-- uses: v3b, v3l
SELECT b.*, l.previous_event_hash, l.evidence_hash FROM v3b b JOIN v3l l USING (session_id, sequence)

-- name: v3h
-- uses: v3c
SELECT *, sha256(coalesce(lag(block_digest) OVER (PARTITION BY session_id ORDER BY block), '') || ':' || block || ':' || block_digest) AS block_head
FROM (SELECT session_id, (sequence - 1) // 1024 AS block, count(*) AS events, sha256(string_agg(evidence_hash, ',' ORDER BY sequence)) AS block_digest
  FROM v3c GROUP BY ALL)

-- name: v3e
-- uses: v3c
SELECT * EXCLUDE (payload, body_digest), CASE WHEN user_id % 10 = 0 AND sequence = 3 THEN '{"k": 999}' ELSE payload END AS payload
FROM v3c WHERE NOT (user_id % 15 = 0 AND sequence = 2)

-- name: v3s
-- uses: v3c
SELECT user_id, session_id, tenant_id, asset_id,
  CASE WHEN user_id % 8 = 0 THEN 'recording' WHEN user_id % 5 = 1 THEN 'incomplete'
    WHEN user_id % 10 = 0 THEN 'integrity_failed' ELSE 'complete' END AS status,
  CASE WHEN user_id % 25 = 0 THEN repeat('f', 64) ELSE max_by(evidence_hash, sequence) END AS current_hash,
  min(occurred_at) AS started_at, min(occurred_at) AS created_at,
  CASE WHEN user_id % 8 <> 0 THEN max(occurred_at) END AS closed_at, max(occurred_at) AS last_at
FROM v3c GROUP BY user_id, session_id, tenant_id, asset_id

-- name: v3f
-- uses: v3e
SELECT e.*, row_number() OVER w AS expected, lag(evidence_hash) OVER w AS stored_previous,
  sha256(coalesce(previous_event_hash, '') || ':' || sequence || ':' || sha256(to_json({'ai_used': ai_used, 'asset_id': asset_id, 'creator_id': creator_id, 'event_id': event_id, 'event_type': event_type,
  'location_level': location_level, 'location_summary': location_summary,
  'occurred_at': strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ'), 'payload': payload, 'privacy_mode': privacy_mode,
  'recorded_at': strftime(recorded_at, '%Y-%m-%dT%H:%M:%S.%fZ'), 'schema_version': '1.0',
  'session_id': session_id, 'source_name': source_name, 'source_type': source_type})::VARCHAR)) AS recomputed
FROM v3e e WINDOW w AS (PARTITION BY session_id ORDER BY sequence, event_id)

-- name: v3p
-- uses: v3f
SELECT session_id, event_id, 'sequence_gap' AS reason FROM v3f WHERE sequence <> expected
UNION ALL SELECT session_id, event_id, 'previous_hash_mismatch' FROM v3f WHERE previous_event_hash IS DISTINCT FROM stored_previous
UNION ALL SELECT session_id, event_id, 'evidence_hash_mismatch' FROM v3f WHERE recomputed <> evidence_hash

-- name: v3v
-- uses: v3p, v3e, v3s
SELECT s.session_id, coalesce(n, 0) AS event_count, head_hash, head_event_id,
  n IS NOT NULL AND s.current_hash IS DISTINCT FROM head_hash AS head_mismatch,
  coalesce(bad, 0) AS event_failures,
  coalesce(bad, 0) + CASE WHEN n IS NOT NULL AND s.current_hash IS DISTINCT FROM head_hash THEN 1 ELSE 0 END AS failure_count,
  coalesce(bad, 0) + CASE WHEN n IS NOT NULL AND s.current_hash IS DISTINCT FROM head_hash THEN 1 ELSE 0 END = 0 AS valid
FROM v3s s
LEFT JOIN (SELECT session_id, count(*) AS n, max_by(evidence_hash, sequence) AS head_hash, max_by(event_id, sequence) AS head_event_id
  FROM v3e GROUP BY 1) e USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS bad FROM v3p GROUP BY 1) p USING (session_id)

-- name: v3x
-- uses: v3e, v3v
SELECT v.*,
  list_filter([
    CASE WHEN coalesce(first_type, '') <> 'session_started' THEN 'session_started' END,
    CASE WHEN NOT coalesce(has_creation, false) THEN 'creation_evidence' END,
    CASE WHEN NOT coalesce(has_disclosure, false) THEN 'ai_disclosure' END,
    CASE WHEN NOT coalesce(has_asset, false) THEN 'asset_registered' END,
    CASE WHEN NOT valid THEN 'valid_evidence_chain' END], lambda m: m IS NOT NULL) AS missing
FROM v3v v LEFT JOIN (
  SELECT session_id, min_by(event_type, sequence) AS first_type,
    bool_or(event_type IN ('source_captured','work_saved','work_exported')) AS has_creation,
    bool_or(event_type = 'ai_tool_disclosed') AS has_disclosure, bool_or(event_type = 'asset_registered') AS has_asset
  FROM v3e GROUP BY 1) USING (session_id)

-- name: v3u
-- uses: v3e, v3s, v3v
SELECT asset_id, s.session_id, status, event_count, valid AS chain_valid, started_at, closed_at, ai_used, loc_level, loc_summary,
  CASE WHEN mode IN ('private','proof','public') THEN mode ELSE 'proof' END AS privacy_mode
FROM (SELECT * FROM v3s WHERE status IN ('complete','incomplete','integrity_failed')
      QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY closed_at DESC NULLS LAST, created_at DESC NULLS LAST, session_id) = 1) s
JOIN v3v v ON v.session_id = s.session_id
LEFT JOIN (SELECT session_id, arg_min_null(privacy_mode, sequence) FILTER (event_type = 'session_started') AS mode,
    arg_min_null(ai_used, -sequence) FILTER (event_type = 'ai_tool_disclosed') AS ai_used,
    arg_min_null(location_level, sequence) FILTER (location_level IN ('coarse','precise_private')) AS loc_level,
    arg_min_null(CASE WHEN location_level = 'precise_private' THEN 'private' ELSE nullif(location_summary, '') END, sequence)
      FILTER (location_level IN ('coarse','precise_private')) AS loc_summary
  FROM v3e GROUP BY 1) f ON f.session_id = s.session_id
WHERE coalesce(mode, 'proof') <> 'private'

-- name: v4
SELECT event_id AS observation_id, 'as-' || user_id AS asset_id, 'src' || (user_id % 20) AS tenant_id, user_id,
  CASE WHEN event_type IN ('view','click') THEN 'Sightengine ' WHEN event_type IN ('signup','purchase') THEN 'hive' ELSE '  ' END AS provider,
  CASE WHEN event_id % 3 = 0 THEN 'genai' ELSE 'm' || (event_id % 2) END AS model,
  'synthetic_media_probability' AS signal,
  CASE WHEN event_id % 53 = 0 THEN 'bad' WHEN event_id % 61 = 0 THEN '0.5f' WHEN event_id % 67 = 0 THEN ' 5d' ELSE printf('%.4f', value / 100) END AS probability,
  CASE WHEN event_id % 59 = 0 THEN 'degraded' END AS status, props AS details, ts AS observed_at
FROM events

-- name: v4n
-- uses: v4
SELECT observation_id, asset_id, tenant_id, trim(provider) AS provider, model, signal, p AS probability,
  floor(p * 100 * 100 + 0.5) / 100 AS probability_pct,
  CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.5 THEN 'elevated' ELSE 'low' END AS risk,
  coalesce(status, 'available') AS status, details, observed_at
FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, try_cast(probability AS DOUBLE))) AS p FROM v4
  WHERE try_cast(probability AS DOUBLE) IS NOT NULL AND trim(provider) <> '')

-- name: v4l
-- uses: v4n
SELECT * REPLACE (lower(provider) AS provider) FROM v4n
QUALIFY row_number() OVER (PARTITION BY asset_id, lower(provider), model, signal ORDER BY observed_at DESC, observation_id DESC) = 1

-- name: v5
SELECT l_orderkey AS sheet_id, 'as-' || l_orderkey AS asset_id, l_orderkey || '-' || position AS contributor_id, position,
  CASE WHEN position = 1 AND l_orderkey % 41 = 0 THEN '  ' WHEN position % 2 = 0 THEN '  ' || upper('Supplier ' || l_suppkey) || ' '
    ELSE 'Supplier ' || l_suppkey END AS sheet_name,
  'Supplier ' || l_suppkey AS name,
  ['Producer', NULL, 'Writer'][position % 3 + 1] AS role,
  CASE WHEN l_returnflag = 'R' THEN 'ai' ELSE 'human' END AS contribution_type,
  CASE WHEN position = 1 AND l_orderkey % 33 = 0 THEN NULL WHEN position = 1 AND l_orderkey % 20 = 0 THEN share + 1 ELSE share END AS ownership_split_pct,
  floor(l_discount * 100 * 100 + 0.5) / 100 AS creative_contribution_pct,
  CASE WHEN position = 1 THEN 0.0::DOUBLE ELSE floor(l_tax * 100 * 100 + 0.5) / 100 END AS ai_assisted_pct,
  l_shipdate AS added_at
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS position,
    floor(100.0::DOUBLE * l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) * 10000 + 0.5) / 10000 AS share
  FROM lineitem)

-- name: v6
SELECT * REPLACE (CASE WHEN o_orderkey % 50 = 0 THEN 'Someone else' ELSE lock_owner END AS lock_owner,
  CASE WHEN o_orderkey % 70 = 0 THEN reverse(signature) ELSE signature END AS signature)
FROM (SELECT *, sha256(opad || unhex(sha256(ipad || encode(certificate_hash)))) AS signature, 'HMAC-SHA256' AS signature_algorithm, 'key-1' AS public_key_id
  FROM (SELECT *, sha256(to_json({'ai_disclosure': NULL, 'asset_id': asset_id, 'asset_uid': NULL, 'copyright_owner': lock_owner, 'creator_name': subject_name, 'filename': filename, 'license_type': NULL, 'second_fingerprint': NULL, 'sha256': NULL})::VARCHAR) AS metadata_hash,
    sha256(to_json({'asset_id': asset_id, 'cert_id': cert_id, 'certificate_class': certificate_class,
      'issued_at': strftime(issued_at, '%Y-%m-%dT%H:%M:%S'), 'subject_name': subject_name})::VARCHAR) AS certificate_hash
  FROM (SELECT o_orderkey, 'ct-' || o_orderkey AS cert_id, 'as-' || o_custkey AS asset_id, o_custkey, 'src' || c_nationkey AS tenant_id,
      o_orderdate AS issued_at, c_name AS subject_name, o_orderpriority AS certificate_class,
      'Owner ' || (o_custkey % 31) AS lock_owner, 'file-' || o_custkey AS filename,
      unhex('4453515f4542444f1b455f51585f58511b5d534f3636363636363636363636363636363636363636363636363636363636363636363636363636363636363636') AS ipad, unhex('2e393b352f282e25712f353b3235323b713739255c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c') AS opad
    FROM orders JOIN customer ON o_custkey = c_custkey)))

-- name: v6l
-- uses: v6
SELECT * FROM v6 QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY issued_at DESC NULLS LAST, cert_id DESC) = 1

-- name: v7
SELECT *, CASE WHEN event_id % 499 = 0 THEN repeat('0', 64) ELSE true_hash END AS log_hash
FROM (SELECT *, sha256(to_json({'asset_id': asset_id, 'check_type': check_type, 'details': details, 'log_id': log_id, 'result': result,
    'timestamp': strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ')})::VARCHAR) AS true_hash
  FROM (SELECT 'lg-' || event_id AS log_id, event_id, 'as-' || user_id AS asset_id, user_id,
      CASE event_type WHEN 'view' THEN 'file_hash' WHEN 'click' THEN 'asset_id' ELSE 'manifest' END AS check_type,
      ['pass','warning','fail'][event_id % 3 + 1] AS result, props AS details, ts AS "timestamp" FROM events))

-- name: v7c
SELECT 'as-' || user_id AS asset_id,
  count(*) FILTER (event_type IN ('view','click')) + CASE WHEN user_id % 6 = 0 THEN 1 ELSE 0 END AS total_verifications
FROM events GROUP BY user_id

-- name: v8r
SELECT user_id || ':' || (event_id // 1024) AS response_id, 'as-' || user_id AS asset_id, event_id AS seg, value,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events

-- name: v8c
-- uses: v8r
SELECT response_id, asset_id, seg, pos, class, try_cast(score AS DOUBLE) AS raw, greatest(0.0::DOUBLE, least(1.0::DOUBLE, try_cast(score AS DOUBLE))) AS score
FROM (
  SELECT response_id, asset_id, seg, 0 AS pos, 'ai_generated' AS class, printf('%.4f', value / 100) AS score FROM v8r
  UNION ALL SELECT response_id, asset_id, seg, 1, 'suno', printf('%.2f', k / 100) FROM v8r
  UNION ALL SELECT response_id, asset_id, seg, 2, 'udio', printf('%.2f', (k * 7 % 100) / 100) FROM v8r
  UNION ALL SELECT response_id, asset_id, seg, 3, 'other', 'n/a' FROM v8r
  UNION ALL SELECT response_id, asset_id, seg, 4, 'ai_generated_music', CASE WHEN k % 2 = 0 THEN printf('%.2f', k / 100) ELSE 'bad' END FROM v8r
  UNION ALL SELECT response_id, asset_id, seg, 5, 'ai_generated_music_cover', CASE WHEN k % 5 = 0 THEN printf('%.2f', (k * 3 % 100) / 100) ELSE 'bad' END FROM v8r
  UNION ALL SELECT DISTINCT response_id, asset_id, CAST(NULL AS BIGINT), 0, 'ai_generated', '0.9995' FROM v8r WHERE (seg // 1024) % 2 = 1)

-- name: v9
SELECT c_custkey AS application_id, 'C' || (c_custkey % 1000) || '@Example.com' AS email,
  ['founder','creator','label','enterprise','gold'][c_custkey % 5 + 1] AS plan, c_name AS company_name
FROM customer

-- name: v10
SELECT p_partkey, 'pp-' || p_partkey AS passport_id, 'as-' || p_partkey AS asset_id,
  CASE WHEN p_partkey % 21 = 0 THEN left(g, 6) || 'X' || substr(g, 8, 7) WHEN p_partkey % 13 = 0 THEN ' ' || g || ' ' ELSE g END AS gtin14,
  CASE WHEN p_partkey % 44 = 0 THEN '  ' WHEN p_partkey % 30 = 0 THEN rpad('SN-' || p_partkey, 21, '9')
    WHEN p_partkey % 7 = 0 THEN 'SN ' || p_partkey || '/~*é' WHEN p_partkey % 53 = 0 THEN 'SN' || chr(9) || p_partkey
    ELSE 'SN-' || p_partkey END AS serial_number,
  ['qr','data_matrix','nfc','other',NULL][p_size % 5 + 1] AS data_carrier_type,
  CASE WHEN p_partkey % 17 = 0 THEN 'batch' ELSE 'item' END AS passport_level,
  p_brand AS brand_name, p_name AS product_name
FROM (SELECT *, body || ((list_sum(list_transform(range(1, 14), lambda p: CAST(substr(body, p, 1) AS INTEGER) * CASE WHEN p % 2 = 1 THEN 3 ELSE 1 END)) * 9
     + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END) % 10) AS g
  FROM (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS body FROM part))

-- name: v10c
-- uses: v10
SELECT *, CASE WHEN gtin_reason IS NULL THEN gtin END AS gtin_ok, CASE WHEN serial_reason IS NULL THEN serial END AS serial_ok
FROM (SELECT *, CASE WHEN NOT regexp_full_match(gtin, '[0-9]{14}') THEN 'gtin_not_14_digits'
    WHEN (list_sum(list_transform(range(1, 14), lambda p: CAST(try_cast(substr(gtin, p, 1) AS INTEGER) AS INTEGER) * CASE WHEN p % 2 = 1 THEN 3 ELSE 1 END)) * 9) % 10
      <> try_cast(substr(gtin, 14, 1) AS INTEGER) THEN 'gtin_check_digit' END AS gtin_reason,
  CASE WHEN serial = '' THEN 'serial_empty' WHEN length(serial) > 20 THEN 'serial_too_long'
    WHEN contains(serial, chr(9)) THEN 'serial_control_character' END AS serial_reason
  FROM (SELECT *, trim(gtin14) AS gtin, trim(serial_number) AS serial FROM v10))

-- name: v8m
SELECT doc_id, 'as-' || doc_id AS asset_id,
  '{"' || CASE WHEN doc_id % 2 = 0 THEN 'active_manifest' ELSE 'activeManifest' END || '":' || CASE WHEN doc_id % 12 = 0 THEN 'null' ELSE '"m' || doc_id || '"' END
  || ',"validation_status":["claim.seen",{"code":"c' || (doc_id % 3) || '","success":' || CASE WHEN doc_id % 9 = 0 THEN 'false' ELSE 'true' END
  || '},"claim.seen"],"manifests":{"m' || doc_id || '":{"claim_generator":"gen-' || (doc_id % 4) || '","title":"t","ingredients":['
  || CASE WHEN doc_id % 5 = 0 THEN '{}' ELSE '' END || '],"assertions":[{"label":"c2pa.actions","data":{"actions":[{"action":"c2pa.created"},{"action":"a' || (doc_id % 6)
  || '"},{"note":"none"}]}},{"label":"hash","data":{"actions":[{"action":"hidden"}]}}],"validation_status":[{"code":"c' || (doc_id % 3) || '","success":'
  || CASE WHEN doc_id % 9 = 0 THEN 'false' ELSE 'true' END || '}]}}}' AS store
FROM documents

-- name: v3w
-- uses: v3i
SELECT * EXCLUDE (payload),
  ['automatic_project_revision','automatic_audio_export','source_asset_linked','human_transformation_declared','automatic_project_detected',NULL][k % 6 + 1] AS checkpoint,
  CASE WHEN sequence = 1 THEN ['Studio','Auto detect','Other'][user_id % 3 + 1] END AS workflow,
  CASE WHEN sequence = 1 AND user_id % 2 = 0 THEN 'Workstation' END AS daw_name,
  CASE WHEN k % 6 = 2 THEN 'AU-' || k END AS source_asset_uid,
  CASE WHEN k % 6 = 2 THEN k % 4 = 0 END AS history_mutated,
  CASE WHEN k % 6 = 3 AND k % 5 <> 0 THEN 'edited|t' || (k % 4) END AS transformations,
  CASE WHEN k % 6 = 3 AND k % 2 = 1 THEN 'statement ' || k END AS statement,
  CASE WHEN k % 3 = 0 AND event_type = 'ai_tool_disclosed' THEN 'final ' || k END AS final_disclosure
FROM v3i

-- name: v3r
-- uses: v3w
SELECT session_id,
  CASE WHEN max(workflow) IN ('Studio','Auto detect') THEN max(workflow) END AS workflow,
  coalesce(max(daw_name), max(source_name) FILTER (sequence = 1)) AS production_environment,
  count(*) FILTER (checkpoint = 'automatic_project_detected') > 0 AS automatic_project_detected,
  count(*) FILTER (checkpoint = 'automatic_project_revision') AS automatic_revisions,
  count(*) FILTER (checkpoint = 'automatic_audio_export') AS automatic_exports,
  0 AS contributor_declarations,
  max_by(source_asset_uid, sequence) FILTER (checkpoint = 'source_asset_linked') AS source_asset_uid,
  max_by(NOT history_mutated, sequence) FILTER (checkpoint = 'source_asset_linked') AS history_preserved,
  max_by(transformations, sequence) FILTER (transformations IS NOT NULL) AS transformations,
  max_by(statement, sequence) FILTER (statement IS NOT NULL) AS statement,
  max_by(final_disclosure, sequence) FILTER (final_disclosure IS NOT NULL) AS final_provenance_disclosure
FROM v3w GROUP BY 1

-- name: vfacts
-- uses: v1, v5
SELECT v1.*, nullif(trim(creator_name), '') AS creator_clean, nullif(trim(human_authorship_summary), '') AS summary,
  t.total AS ownership_total_pct, copyright_owner IS NOT NULL OR t.asset_id IS NOT NULL AS ownership_declared, coalesce(t.n, 0) AS split_count,
  coalesce(h1, false)::INT + coalesce(h2, false)::INT + coalesce(h3, false)::INT + coalesce(h4, false)::INT + coalesce(h5, false)::INT + coalesce(h6, false)::INT AS forms
FROM v1 LEFT JOIN (SELECT asset_id, count(*) AS n, floor(sum(ownership_split_pct) * 10000 + 0.5) / 10000 AS total
  FROM v5 WHERE ownership_split_pct IS NOT NULL GROUP BY 1) t USING (asset_id)

-- name: v5s
-- uses: v5
SELECT 'LS-' || sheet_id || '-' || ((position - 1) // 256) AS session_id, sheet_id, asset_id, count(*) AS n,
  sum(round(ownership_split_pct, 4)) AS total, string_agg(trim(sheet_name), '|' ORDER BY position) AS names,
  list({'position': position, 'name': sheet_name, 'role': role, 'contribution_type': contribution_type, 'ownership_split_pct': printf('%.4f', ownership_split_pct),
    'wallet_address': CASE WHEN position % 2 = 0 THEN 'wallet' END} ORDER BY position) AS body
FROM v5 GROUP BY sheet_id, asset_id, (position - 1) // 256

-- name: vsig
-- uses: vfacts
SELECT *, CASE WHEN doc_id % 3 = 0 THEN true END AS s_second, watermark_invisible AS s_mark,
  CASE WHEN doc_id % 4 = 0 THEN 0.87::DOUBLE ELSE 1.0::DOUBLE END AS s_conf, doc_id % 4 = 1 AS s_phash,
  CASE WHEN doc_id % 10 <> 0 THEN doc_id % 3 <> 0 END AS s_exif, doc_id % 5 = 0 AS s_gps, creator_clean IS NOT NULL AS s_creator, doc_id % 6 = 0 AS s_org,
  doc_id % 4 = 2 AS s_copyright, license_type IS NOT NULL AS s_license,
  CASE WHEN ai_disclosure IN ('human','ai_assisted','ai_generated') THEN ai_disclosure = 'ai_generated' END AS is_generated,
  CASE WHEN ai_disclosure IN ('human','ai_assisted','ai_generated') THEN ai_disclosure = 'ai_assisted' END AS is_assisted,
  coalesce(ai_disclosure IN ('ai_assisted','ai_generated'), false) AS is_disclosed,
  ['substantial','moderate','minor',NULL,NULL][doc_id % 5 + 1] AS s_level, doc_id % 7 = 3 AS s_daw, doc_id % 41 = 0 AS s_collision,
  doc_id % 4 AS contributor_n
FROM vfacts

-- name: vtrust
-- uses: vsig
SELECT *, floor(greatest(0e0, least(1e0, 5e-1 + CASE WHEN s_second THEN 5e-2 ELSE 0e0 END
    + CASE WHEN s_mark THEN 1e-1 WHEN NOT s_mark THEN -3e-1 ELSE 0e0 END + CASE WHEN s_phash THEN 3e-2 ELSE 0e0 END
    + CASE WHEN s_exif THEN 8e-2 WHEN NOT s_exif THEN -3e-2 ELSE 0e0 END + CASE WHEN s_gps THEN 6e-2 ELSE 0e0 END
    + CASE WHEN s_creator THEN 6e-2 ELSE 0e0 END + CASE WHEN s_org THEN 5e-2 ELSE 0e0 END + CASE WHEN s_copyright THEN 5e-2 ELSE 0e0 END
    + CASE WHEN s_license THEN 4e-2 ELSE 0e0 END
    + CASE WHEN ai_detection_score >= 0.9 THEN -25e-2 WHEN ai_detection_score >= 0.7 THEN -15e-2 WHEN ai_detection_score >= 0.4 THEN -5e-2 WHEN ai_detection_score < 0.2 THEN 5e-2 ELSE 0e0 END
    + CASE WHEN is_generated THEN -5e-2 ELSE 0e0 END
    + CASE s_level WHEN 'substantial' THEN 12e-2 WHEN 'moderate' THEN 7e-2 WHEN 'minor' THEN 3e-2 ELSE 0e0 END
    + CASE WHEN forms > 0 THEN least(forms * 3e-2, 1e-1) ELSE 0e0 END + CASE WHEN s_daw THEN 4e-2 ELSE 0e0 END)) * 10000 + 0.5) / 10000 AS score,
  concat_ws('|', CASE WHEN s_second THEN 'second_fingerprint' END,
    CASE WHEN s_mark THEN 'hidden_mark_ok:' || CAST(floor(s_conf * 100) AS BIGINT) || '' WHEN NOT s_mark THEN 'hidden_mark_failed' END,
    CASE WHEN s_phash THEN 'perceptual_hash' END,
    CASE WHEN s_exif THEN 'exif' WHEN NOT s_exif THEN 'no_exif' END,
    CASE WHEN s_gps THEN 'gps' END, CASE WHEN s_creator THEN 'creator_name' END,
    CASE WHEN s_org THEN 'creator_organisation' END, CASE WHEN s_copyright THEN 'copyright_notice' END,
    CASE WHEN s_license THEN 'license_url' END,
    CASE WHEN ai_detection_score >= 0.9 THEN 'ai_confident:' WHEN ai_detection_score >= 0.7 THEN 'ai_likely:'
      WHEN ai_detection_score >= 0.4 THEN 'ai_possible:' WHEN ai_detection_score < 0.2 THEN 'ai_low:' END
      || CAST(floor(ai_detection_score * 100) AS BIGINT),
    CASE WHEN is_generated THEN 'disclosed:ai_generated' WHEN is_assisted THEN 'disclosed:ai_assisted' END,
    CASE s_level WHEN 'substantial' THEN 'transformation:substantial' WHEN 'moderate' THEN 'transformation:moderate'
      WHEN 'minor' THEN 'transformation:minor' END,
    CASE WHEN forms > 0 THEN forms || '_human_signals' END, CASE WHEN s_daw THEN 'workstation' END) AS reasons
FROM vsig

-- name: vready
-- uses: vsig
SELECT *, CASE WHEN readiness_score >= 0.75 THEN 'strong' WHEN readiness_score >= 0.5 THEN 'moderate' WHEN readiness_score >= 0.25 THEN 'limited' ELSE 'insufficient' END AS readiness_label,
  CASE WHEN contributor_n > 1 THEN 'live_split' WHEN NOT (detected OR has_tool OR is_disclosed) THEN 'standard'
    WHEN modified AND coalesce(h1, false) THEN 'ai_assisted' WHEN forms > 0 THEN 'hybrid_authorship' ELSE 'ai_assisted' END AS class
FROM (SELECT *, floor(greatest(0e0, least(1e0, 0e0
    + CASE WHEN h1 THEN 12e-2 ELSE 0e0 END + CASE WHEN h2 THEN 12e-2 ELSE 0e0 END + CASE WHEN h3 THEN 12e-2 ELSE 0e0 END
    + CASE WHEN h4 THEN 12e-2 ELSE 0e0 END + CASE WHEN h5 THEN 12e-2 ELSE 0e0 END + CASE WHEN h6 THEN 12e-2 ELSE 0e0 END
    + CASE WHEN forms = 0 THEN -1e-1 ELSE 0e0 END
    + CASE WHEN detected AND is_disclosed THEN 8e-2 WHEN detected THEN -2e-1 WHEN form_done THEN 5e-2 ELSE 0e0 END
    + CASE WHEN modified THEN 8e-2 ELSE 0e0 END + CASE WHEN unsupported THEN -2e-1 ELSE 0e0 END
    + CASE WHEN contributor_n > 0 THEN least(contributor_n * 3e-2, 9e-2) ELSE 0e0 END)) * 10000 + 0.5) / 10000 AS readiness_score
  FROM (SELECT *, coalesce(ai_detection_score, 0) >= 0.85 AND forms = 0 AND NOT modified AS unsupported FROM (
    SELECT *, coalesce(ai_detection_score, 0) >= 0.4 AS detected, coalesce(ai_disclosure_complete, false) AS form_done, coalesce(ai_modification_by_human, false) AS modified FROM vsig)))

-- name: vanom
-- uses: v2
SELECT *, list_filter([
  CASE WHEN t_created > t_modified THEN 'timestamp_order_reversed' END,
  CASE WHEN t_created LIKE '2999%' THEN 'timestamp_future' END,
  CASE WHEN f_mime IN ('image/jpeg','application/pdf') AND t_created IS NULL THEN 'timestamp_missing' END,
  CASE WHEN f_mime = 'image/jpeg' AND make IS NULL AND model IS NULL AND lat IS NULL AND lon IS NULL THEN 'exif_stripped' END,
  CASE WHEN coalesce(make, model, creator, copyright, software, a_artist) IS NULL THEN 'creator_missing' END,
  CASE WHEN f_mime = 'image/jpeg' AND r_gpslat IS NOT NULL AND lat IS NULL AND lon IS NULL THEN 'gps_removed' END,
  CASE WHEN f_mime <> c_mime THEN 'mime_mismatch' END,
  CASE WHEN f_ext <> c_ext THEN 'extension_mismatch' END,
  CASE WHEN coalesce(length(h_sha), 0) <> 64 THEN 'hash_missing' END,
  CASE WHEN h_sha = 'abc123' THEN 'hash_malformed' END,
  CASE WHEN lat > 90 THEN 'gps_impossible_coordinates' END,
  CASE WHEN (lat IS NULL) <> (lon IS NULL) THEN 'gps_partial' END,
  CASE WHEN software = 'Adobe Photoshop' AND coalesce(make, model) IS NULL THEN 'software_conflict' END], lambda f: f IS NOT NULL) AS flags
FROM v2

-- name: vanoms
-- uses: vanom
SELECT vanom.*, coalesce(points, 0) AS raw_points, CAST(least(100, coalesce(points, 0)) AS INTEGER) AS anomaly_score, coalesce(n, 0) AS n_flags, listed, fields
FROM vanom LEFT JOIN (
  SELECT asset_id, sum(CASE severity WHEN 'High' THEN 30 WHEN 'Medium' THEN 15 ELSE 5 END) AS points, count(*) AS n,
    string_agg(flag || ' (' || severity || ')', ', ' ORDER BY rank) AS listed,
    string_agg(field, '|' ORDER BY rank) AS fields
  FROM (SELECT asset_id, unnest(flags) AS flag FROM vanom) f JOIN (VALUES
    (1, 'timestamp_order_reversed', 'Medium', 'timestamps.created|timestamps.modified'), (2, 'timestamp_future', 'High', 'timestamps.created'),
    (3, 'timestamp_missing', 'Low', 'timestamps'), (4, 'exif_stripped', 'High', 'camera|exif|gps'),
    (5, 'creator_missing', 'Medium', 'camera.make|copyright.creator|software.editing_software|audio_tags.artist'),
    (6, 'gps_removed', 'Low', 'gps.latitude|gps.longitude'), (7, 'mime_mismatch', 'High', 'file.mime_type|container.mime_type'),
    (8, 'extension_mismatch', 'Medium', 'file.extension|container.extension'), (9, 'hash_missing', 'Medium', 'hashes.sha256'),
    (10, 'hash_malformed', 'High', 'hashes.sha256'), (11, 'gps_impossible_coordinates', 'High', 'gps.latitude|gps.longitude'),
    (12, 'gps_partial', 'Low', 'gps.latitude|gps.longitude'), (13, 'software_conflict', 'Medium', 'software.editing_software|camera.make')) r(rank, flag, severity, field) USING (flag)
  GROUP BY 1) USING (asset_id)

-- name: vcont
-- uses: vfacts, v2e, v6
SELECT asset_id, f.creator_clean, f.ownership_total_pct, coalesce(total_events, 0) AS total_events, coalesce(total_certificates, 0) AS total_certificates, created_at, first_upload, first_certificate_event,
  ai_disclosure, ai_detection_score, first_issued, last_issued, latest_cert_id,
  floor(least(1e0, 0e0 + CASE WHEN has_upload THEN 2e-1 ELSE 0e0 END + CASE WHEN has_cert OR total_certificates IS NOT NULL THEN 2e-1 ELSE 0e0 END
    + CASE WHEN second_fingerprint IS NOT NULL AND phash IS NOT NULL THEN 15e-2 WHEN second_fingerprint IS NOT NULL THEN 15e-2 * 7e-1 ELSE 0e0 END
    + CASE WHEN has_mark THEN 1e-1 ELSE 0e0 END + CASE WHEN manifest_path IS NOT NULL THEN 1e-1 ELSE 0e0 END + CASE WHEN ownership_declared THEN 1e-1 ELSE 0e0 END
    + CASE WHEN total_events > 0 THEN 1e-1 * (hashed / total_events) ELSE 0e0 END + CASE WHEN chronological THEN 5e-2 ELSE 0e0 END) * 10000 + 0.5) / 10000 AS score,
  concat_ws('|', CASE WHEN NOT coalesce(has_upload, false) THEN 'upload_event' END, CASE WHEN NOT coalesce(has_cert, false) AND total_certificates IS NULL THEN 'certificate_event' END,
    CASE WHEN second_fingerprint IS NULL THEN 'hashes' WHEN phash IS NULL THEN 'perceptual_hash' END, CASE WHEN manifest_path IS NULL THEN 'manifest' END,
    CASE WHEN NOT ownership_declared THEN 'ownership' END, CASE WHEN hashed < total_events THEN 'event_hashes' END, CASE WHEN NOT chronological THEN 'event_order' END) AS gaps
FROM vfacts f
LEFT JOIN (SELECT asset_id, count(*) AS total_events, count(event_hash) AS hashed, bool_or(event_type = 'upload') AS has_upload, bool_or(event_type = 'certificate_issued') AS has_cert,
    bool_or(event_type = 'watermark') AS has_mark, bool_and(before IS NULL OR before <= "timestamp") AS chronological,
    min("timestamp") FILTER (event_type = 'upload') AS first_upload, min("timestamp") FILTER (event_type = 'certificate_issued') AS first_certificate_event
  FROM (SELECT *, lag("timestamp") OVER (PARTITION BY asset_id ORDER BY event_id) AS before FROM v2e) GROUP BY 1) e USING (asset_id)
LEFT JOIN (SELECT asset_id, count(*) AS total_certificates, min(issued_at) AS first_issued, max(issued_at) AS last_issued, arg_max(cert_id, {'t': issued_at, 'c': cert_id}) AS latest_cert_id FROM v6 GROUP BY 1) c USING (asset_id)

-- name: vforensic
-- uses: v1, vanoms, v3u, v4l
SELECT a.asset_id, n.anomaly_score IS NOT NULL AS metadata_available, n.anomaly_score,
  CASE WHEN n.anomaly_score IS NULL THEN 'unknown' WHEN n.anomaly_score >= 60 THEN 'high' WHEN n.anomaly_score >= 30 THEN 'elevated' ELSE 'low' END AS metadata_risk,
  state <> 'unknown' AS credentials_available, state AS credentials_state,
  CASE state WHEN 'invalid' THEN 'high' WHEN 'unknown' THEN 'unknown' WHEN 'not_present' THEN 'neutral' ELSE 'low' END AS credentials_risk,
  true AS watermark_available, CASE WHEN watermark_applied THEN 'low' ELSE 'neutral' END AS watermark_risk,
  u.status IS NOT NULL AS session_available,
  CASE WHEN u.status IS NULL THEN 'neutral' WHEN NOT chain_valid OR u.status = 'integrity_failed' THEN 'high' WHEN u.status = 'complete' AND chain_valid THEN 'low' ELSE 'elevated' END AS session_risk,
  coalesce(o.n, 0) AS observation_count, coalesce(o.providers, 0) AS provider_count, coalesce(o.risk, 'unknown') AS detector_risk,
  p IS NOT NULL AS synthetic_available, p AS synthetic_probability,
  CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.5 THEN 'elevated' WHEN p IS NOT NULL THEN 'low' ELSE 'unknown' END AS synthetic_risk
FROM (SELECT v1.*, o.*  EXCLUDE (asset_id, n, providers, risk), coalesce(ai_detection_score, best) AS p,
    CASE WHEN doc_id % 10 = 7 THEN 'unknown' WHEN doc_id % 16 = 0 THEN 'source_unavailable' WHEN doc_id % 12 = 0 THEN 'not_present' WHEN doc_id % 9 = 0 THEN 'invalid' ELSE 'no_reported_errors' END AS state
  FROM v1 LEFT JOIN (SELECT asset_id, 0 AS n, 0 AS providers, '' AS risk, max(probability) AS best FROM v4l GROUP BY 1) o USING (asset_id)) a
LEFT JOIN (SELECT asset_id, anomaly_score FROM vanoms WHERE doc_id % 6 <> 0) n USING (asset_id)
LEFT JOIN v3u u USING (asset_id)
LEFT JOIN (SELECT asset_id, count(*) AS n, count(DISTINCT provider) AS providers, CASE WHEN max(probability) >= 0.8 THEN 'high' WHEN max(probability) >= 0.5 THEN 'elevated' ELSE 'low' END AS risk FROM v4l GROUP BY 1) o USING (asset_id)

-- name: vissued
-- uses: v1
SELECT asset_id, CASE WHEN doc_id % 25 <> 0 THEN 'ct-' || asset_id END AS cert_id,
  list_filter([CASE WHEN doc_id % 33 = 0 THEN 'sha256' END, CASE WHEN nullif(trim(creator_name), '') IS NULL THEN 'creator_name' END,
    CASE WHEN doc_id % 13 = 0 THEN 'copyright_owner' END, CASE WHEN splits THEN 'ownership_splits' END, CASE WHEN doc_id % 33 = 0 THEN 'metadata_lock.sha256' END,
    CASE WHEN doc_id % 13 = 0 THEN 'metadata_lock.copyright_owner' END, CASE WHEN doc_id % 27 = 0 THEN 'metadata_lock.license_type' END,
    CASE WHEN doc_id % 27 = 0 THEN 'signature' END], lambda x: x IS NOT NULL) AS bad
FROM (SELECT *, certificate_class <> 'live_split' AND asset_id IN (SELECT 'as-' || l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 OR l_orderkey % 33 <> 0) AS splits FROM v1)

-- name: vmanifest
-- uses: v1, v1m
SELECT v1.asset_id, v1m.asset_id IS NOT NULL AS present, list_filter([
    CASE WHEN doc_id % 47 = 0 THEN 'filename' END, CASE WHEN doc_id % 59 = 0 THEN 'sha256' END, CASE WHEN doc_id % 61 = 0 THEN 'second_fingerprint' END,
    CASE WHEN doc_id % 13 = 0 THEN 'copyright_owner' END, CASE WHEN doc_id % 67 = 0 THEN 'trust_score' END], lambda x: x IS NOT NULL) AS bad
FROM v1 LEFT JOIN (SELECT asset_id FROM v1m) v1m USING (asset_id)

-- name: vbatch
-- uses: v1, v1m
SELECT event_id AS request_id, 'as-' || (user_id * 11) AS asset_id, ts AS requested_at, '10.0.0.' || (event_id % 9) AS requester,
  a.asset_id IS NOT NULL AS verified, CASE WHEN m.asset_id IS NOT NULL THEN m.bad = 0 END AS manifest_valid, m.bad AS mismatches
FROM events e LEFT JOIN v1 a ON a.doc_id = e.user_id * 11
LEFT JOIN (SELECT asset_id, (doc_id % 47 = 0)::INT + (doc_id % 61 = 0)::INT AS bad FROM v1m) m ON m.asset_id = a.asset_id

-- name: vnodes
-- uses: v1, v5, v5s, v10, v6, v2e, vanoms, v4l, v3u
SELECT asset_id, 'asset:' || asset_id AS id, 'asset' AS type, 'cryptographic_identity' AS evidence_class, sha256 AS detail, NULL AS provider FROM v1
UNION ALL SELECT asset_id, 'declaration:' || asset_id, 'creator_declaration', 'declaration', CAST(h4 AS VARCHAR), NULL FROM v1
UNION ALL SELECT asset_id, 'rights:' || asset_id, 'rights_claim', 'rights_claim', license_type, NULL FROM v1 WHERE copyright_owner IS NOT NULL OR license_type IS NOT NULL
UNION ALL SELECT asset_id, 'contributor:' || contributor_id, 'contributor', 'attribution', contribution_type, NULL FROM v5 WHERE asset_id IN (SELECT asset_id FROM v1)
UNION ALL SELECT asset_id, 'rights-record:live-split:' || session_id, 'live_split_record', 'rights_record', CAST(CASE WHEN sheet_id % 19 = 0 THEN 0 ELSE n END AS VARCHAR), NULL FROM v5s WHERE asset_id IN (SELECT asset_id FROM v1)
UNION ALL SELECT asset_id, 'dpp:' || passport_id, 'digital_product_passport', 'product_passport_record', brand_name, NULL FROM v10 WHERE asset_id IN (SELECT asset_id FROM v1)
UNION ALL SELECT asset_id, 'certificate:' || cert_id, 'certificate', 'certificate_attestation', certificate_hash, NULL FROM v6 WHERE asset_id IN (SELECT asset_id FROM v1)
UNION ALL SELECT asset_id, 'provenance:' || event_id, 'provenance_event', 'provenance', event_type, NULL FROM v2e WHERE asset_id IN (SELECT asset_id FROM v1)
UNION ALL SELECT asset_id, 'forensic:metadata:' || asset_id, 'forensic_observation', 'forensic_observation', CAST(anomaly_score AS VARCHAR), NULL FROM vanoms WHERE doc_id % 6 <> 0
UNION ALL SELECT asset_id, 'forensic:synthetic:' || observation_id, 'forensic_observation', 'forensic_observation', provider, provider FROM v4l WHERE asset_id IN (SELECT asset_id FROM v1)
UNION ALL SELECT asset_id, 'forensic:synthetic:legacy:' || asset_id, 'forensic_observation', 'forensic_observation', 'sightengine', 'sightengine' FROM v1
  WHERE ai_detection_score IS NOT NULL AND asset_id NOT IN (SELECT asset_id FROM v4l WHERE provider = 'sightengine' AND model = 'genai')
UNION ALL SELECT asset_id, 'session:' || asset_id, 'session_summary', 'creation_process_evidence', privacy_mode, NULL FROM v3u WHERE asset_id IN (SELECT asset_id FROM v1)

-- name: vedges
-- uses: vnodes, v1, v5, v5s
SELECT asset_id, id AS source, 'asset:' || asset_id AS target, CASE type WHEN 'creator_declaration' THEN 'declares_about' WHEN 'rights_claim' THEN 'claims_rights_in'
  WHEN 'contributor' THEN 'attributed_to' WHEN 'live_split_record' THEN 'records_rights_for' WHEN 'digital_product_passport' THEN 'documents_product_identity_for'
  WHEN 'certificate' THEN 'attests_to' WHEN 'provenance_event' THEN 'records_event_for' WHEN 'forensic_observation' THEN 'observes' ELSE 'binds_creation_process_to' END AS relation
FROM vnodes WHERE type <> 'asset'
UNION ALL SELECT s.asset_id, 'rights-record:live-split:' || session_id, 'rights:' || s.asset_id, 'documents_declared_rights' FROM v5s s JOIN v1 USING (asset_id) WHERE copyright_owner IS NOT NULL OR license_type IS NOT NULL
UNION ALL SELECT DISTINCT asset_id, 'contributor:' || contributor_id, 'name:' || asset_id || ':' || lower(trim(name)), 'named' FROM v5
WHERE asset_id IN (SELECT asset_id FROM v1) AND (asset_id, lower(trim(name))) IN (SELECT (asset_id, lower(trim(sheet_name))) FROM v5 WHERE trim(sheet_name) <> '' AND sheet_id % 19 <> 0)
UNION ALL SELECT DISTINCT asset_id, 'rights-record:live-split:LS-' || sheet_id || '-' || ((position - 1) // 256), 'name:' || asset_id || ':' || lower(trim(sheet_name)), 'lists_name' FROM v5
WHERE trim(sheet_name) <> '' AND sheet_id % 19 <> 0 AND asset_id IN (SELECT asset_id FROM v1) AND (asset_id, lower(trim(sheet_name))) IN (SELECT (asset_id, lower(trim(name))) FROM v5)

-- name: vdata
-- uses: v1, v5, v5s, v10, v6, v2e, vanoms, v4l, v3u
SELECT asset_id, 'asset:' || asset_id AS id, '{' || concat_ws(',', '"asset_uid":' || to_json(asset_uid), '"asset_id":' || to_json(asset_id), '"filename":' || to_json(filename), '"file_type":' || to_json(file_type), '"asset_type":' || to_json(asset_type), '"file_size_bytes":' || to_json(file_size_bytes), '"sha256":' || to_json(sha256), '"second_fingerprint":' || to_json(second_fingerprint), '"phash":' || to_json(phash), '"created_at":' || to_json(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ'))) || '}' AS data FROM v1
UNION ALL SELECT asset_id, 'declaration:' || asset_id, '{' || concat_ws(',', '"creator_name":' || to_json(creator_name), '"ai_disclosure":' || to_json(ai_disclosure), '"ai_disclosure_complete":' || to_json(ai_disclosure_complete), '"ai_tools":' || CASE WHEN has_tool THEN '["tool-a"]' ELSE '[]' END, '"ai_modification_by_human":' || to_json(ai_modification_by_human), '"human_authorship_summary":' || to_json(human_authorship_summary), '"human_contributions":' || '{' || concat_ws(',', '"creative_direction":' || to_json(h1), '"editing":' || to_json(h2), '"arrangement":' || to_json(h3), '"lyrics":' || to_json(h4), '"performance":' || to_json(h5), '"transformation":' || to_json(h6)) || '}') || '}' FROM v1
UNION ALL SELECT asset_id, 'rights:' || asset_id, '{' || concat_ws(',', '"copyright_owner":' || to_json(copyright_owner), '"license_type":' || to_json(license_type), '"copyright_readiness_score":' || to_json(copyright_readiness_score), '"copyright_readiness_label":' || to_json(copyright_readiness_label)) || '}' FROM v1 WHERE copyright_owner IS NOT NULL OR license_type IS NOT NULL
UNION ALL SELECT asset_id, 'contributor:' || contributor_id, '{' || concat_ws(',', '"contributor_id":' || to_json(contributor_id), '"name":' || to_json(name), '"role":' || to_json(role), '"contribution_type":' || to_json(contribution_type), '"creative_contribution_pct":' || to_json(creative_contribution_pct), '"ownership_split_pct":' || CASE WHEN ownership_split_pct > 0 AND ownership_split_pct < 0.001 THEN CAST(round(ownership_split_pct * 10000) AS INT) || '.0E-4' ELSE CAST(to_json(ownership_split_pct) AS VARCHAR) END, '"ai_assisted_pct":' || to_json(ai_assisted_pct), '"added_at":' || to_json(strftime(added_at, '%Y-%m-%dT%H:%M:%S.%fZ'))) || '}' FROM v5 WHERE asset_id IN (SELECT asset_id FROM v1)
UNION ALL SELECT asset_id, 'rights-record:live-split:' || session_id, '{' || concat_ws(',', '"session_id":' || to_json(session_id), '"status":' || to_json(CASE sheet_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'locked' ELSE 'finalized' END), '"session_hash":' || to_json(CASE WHEN sheet_id % 7 <> 0 THEN sha256('[' || array_to_string(list_transform(body, lambda c: '{' || concat_ws(',', '"position":' || to_json(c.position), '"name":' || to_json(c.name), '"role":' || to_json(c.role), '"contribution_type":' || to_json(c.contribution_type), '"ownership_split_pct":' || to_json(coalesce(c.ownership_split_pct, 'null')), '"wallet_address":' || to_json(c.wallet_address)) || '}'), ',') || ']') END), '"contributor_count":' || to_json(CASE WHEN sheet_id % 19 = 0 THEN 0 ELSE n END), '"ownership_total_pct":' || CASE WHEN ownership_total_pct > 0 AND ownership_total_pct < 0.001 THEN CAST(round(ownership_total_pct * 10000) AS INT) || '.0E-4' ELSE CAST(to_json(ownership_total_pct) AS VARCHAR) END, '"contributors":' || CASE WHEN sheet_id % 19 = 0 THEN '[]' ELSE '[' || array_to_string(list_transform(body, lambda c: '{' || concat_ws(',', '"name":' || to_json(c.name), '"role":' || to_json(c.role), '"contribution_type":' || to_json(c.contribution_type), '"ownership_split_pct":' || to_json(coalesce(c.ownership_split_pct, 'null'))) || '}'), ',') || ']' END, '"locked_or_finalized":' || to_json(sheet_id % 3 <> 0), '"session_hash_present":' || to_json(sheet_id % 7 <> 0)) || '}'
  FROM (SELECT *, CASE WHEN sheet_id % 19 <> 0 THEN floor(total * 10000 + 0.5) / 10000 END AS ownership_total_pct FROM v5s WHERE asset_id IN (SELECT asset_id FROM v1))
UNION ALL SELECT asset_id, 'dpp:' || passport_id, '{' || concat_ws(',', '"passport_id":' || to_json(passport_id), '"passport_level":' || to_json(passport_level), '"product_name":' || to_json(product_name), '"brand_name":' || to_json(brand_name), '"gtin14":' || to_json(gtin14), '"serial_number":' || to_json(serial_number), '"data_carrier_type":' || to_json(data_carrier_type), '"compliance_status":' || to_json('readiness_only'), '"checks":' || to_json({'asset_bound': true, 'passport_level_item': coalesce(passport_level = 'item', false), 'standardized_instance_identifier_declared': coalesce(gtin14 <> '' AND serial_number <> '', false), 'gs1_syntax_validated': coalesce(gtin14 <> '' AND serial_number <> '', false), 'gs1_identifier_license_or_brand_entitlement_verified': false, 'data_carrier_declared': coalesce(data_carrier_type <> '', false), 'physical_data_carrier_presence_verified': false, 'backup_copy_provider_configured': false, 'product_specific_delegated_act_profile_applied': false}), '"gaps":' || to_json(list_filter([CASE WHEN coalesce(gtin14 <> '' AND serial_number <> '', false) THEN 'identifier entitlement not verified' ELSE 'no standardized item identifier' END, CASE WHEN NOT coalesce(data_carrier_type <> '', false) THEN 'no data carrier declared' END, 'physical data carrier not verified', 'no backup copy provider', 'no product-specific requirements'], lambda g: g IS NOT NULL))) || '}' FROM v10 WHERE asset_id IN (SELECT asset_id FROM v1)
UNION ALL SELECT asset_id, 'certificate:' || cert_id, '{' || concat_ws(',', '"cert_id":' || to_json(cert_id), '"certificate_hash":' || to_json(certificate_hash), '"issued_at":' || to_json(strftime(issued_at, '%Y-%m-%dT%H:%M:%S.%fZ')), '"subject_name":' || to_json(subject_name), '"certificate_class":' || to_json(certificate_class), '"signature_algorithm":' || to_json(signature_algorithm), '"public_key_id":' || to_json(public_key_id)) || '}' FROM v6 WHERE asset_id IN (SELECT asset_id FROM v1)
UNION ALL SELECT asset_id, 'provenance:' || event_id, '{' || concat_ws(',', '"event_id":' || to_json(event_id), '"event_type":' || to_json(event_type), '"description":' || to_json(description), '"tool_used":' || to_json(tool_used), '"human_or_ai":' || to_json(human_or_ai), '"actor_name":' || to_json(actor_name), '"timestamp":' || to_json(strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ')), '"event_hash":' || to_json(event_hash)) || '}' FROM v2e WHERE asset_id IN (SELECT asset_id FROM v1)
UNION ALL SELECT asset_id, 'forensic:metadata:' || asset_id, '{' || concat_ws(',', '"signal":' || '"metadata_anomaly"', '"score":' || to_json(anomaly_score), '"flags":' || '[' || array_to_string(list_transform(flags, lambda f: CASE f
    WHEN 'timestamp_order_reversed' THEN '{"flag":"timestamp_order_reversed","category":"Timestamp","severity":"Medium","points":15,"affected_fields":["timestamps.created","timestamps.modified"],"recommended_action":"check the edit history and the device clock"}'
    WHEN 'timestamp_future' THEN '{"flag":"timestamp_future","category":"Timestamp","severity":"High","points":30,"affected_fields":["timestamps.created"],"recommended_action":"reject or verify again"}'
    WHEN 'timestamp_missing' THEN '{"flag":"timestamp_missing","category":"Timestamp","severity":"Low","points":5,"affected_fields":["timestamps"],"recommended_action":"ask for the original file if time matters"}'
    WHEN 'exif_stripped' THEN '{"flag":"exif_stripped","category":"Metadata Stripping","severity":"High","points":30,"affected_fields":["camera","exif","gps"],"recommended_action":"ask for the original capture"}'
    WHEN 'creator_missing' THEN '{"flag":"creator_missing","category":"Creator","severity":"Medium","points":15,"affected_fields":["camera.make","copyright.creator","software.editing_software","audio_tags.artist"],"recommended_action":"attach attribution before certification"}'
    WHEN 'gps_removed' THEN '{"flag":"gps_removed","category":"GPS","severity":"Low","points":5,"affected_fields":["gps.latitude","gps.longitude"],"recommended_action":"confirm that the location was removed on purpose"}'
    WHEN 'mime_mismatch' THEN '{"flag":"mime_mismatch","category":"Container","severity":"High","points":30,"affected_fields":["file.mime_type","container.mime_type"],"recommended_action":"reject or verify the file type again"}'
    WHEN 'extension_mismatch' THEN '{"flag":"extension_mismatch","category":"Container","severity":"Medium","points":15,"affected_fields":["file.extension","container.extension"],"recommended_action":"verify the true format"}'
    WHEN 'hash_missing' THEN '{"flag":"hash_missing","category":"Hash","severity":"Medium","points":15,"affected_fields":["hashes.sha256"],"recommended_action":"recompute and store the SHA-256"}'
    WHEN 'hash_malformed' THEN '{"flag":"hash_malformed","category":"Hash","severity":"High","points":30,"affected_fields":["hashes.sha256"],"recommended_action":"recompute the affected hash"}'
    WHEN 'gps_impossible_coordinates' THEN '{"flag":"gps_impossible_coordinates","category":"GPS","severity":"High","points":30,"affected_fields":["gps.latitude","gps.longitude"],"recommended_action":"reject the location"}'
    WHEN 'gps_partial' THEN '{"flag":"gps_partial","category":"GPS","severity":"Low","points":5,"affected_fields":["gps.latitude","gps.longitude"],"recommended_action":"treat the location as unreliable"}'
    WHEN 'software_conflict' THEN '{"flag":"software_conflict","category":"Software","severity":"Medium","points":15,"affected_fields":["software.editing_software","camera.make"],"recommended_action":"investigate the origin"}' END), ',') || ']') || '}' FROM vanoms WHERE doc_id % 6 <> 0
UNION ALL SELECT asset_id, 'forensic:synthetic:' || observation_id, '{' || concat_ws(',', '"signal":' || to_json(signal), '"probability":' || CASE WHEN probability > 0 AND probability < 0.001 THEN CAST(round(probability * 10000) AS INT) || '.0E-4' ELSE CAST(to_json(probability) AS VARCHAR) END, '"provider":' || to_json(provider), '"model":' || to_json(model), '"status":' || to_json(status)) || '}' FROM v4l WHERE asset_id IN (SELECT asset_id FROM v1)
UNION ALL SELECT asset_id, 'forensic:synthetic:legacy:' || asset_id, '{' || concat_ws(',', '"signal":' || '"synthetic_media_probability"', '"probability":' || CASE WHEN ai_detection_score > 0 AND ai_detection_score < 0.001 THEN CAST(round(ai_detection_score * 10000) AS INT) || '.0E-4' ELSE CAST(to_json(ai_detection_score) AS VARCHAR) END, '"provider":' || '"sightengine"', '"model":' || '"genai"', '"status":' || '"legacy_persisted_score"') || '}' FROM v1
  WHERE ai_detection_score IS NOT NULL AND asset_id NOT IN (SELECT asset_id FROM v4l WHERE provider = 'sightengine' AND model = 'genai')
UNION ALL SELECT asset_id, 'session:' || asset_id, '{' || concat_ws(',', '"status":' || to_json(status), '"privacy_mode":' || to_json(privacy_mode), '"event_count":' || to_json(event_count), '"chain_valid":' || to_json(chain_valid)) || '}' FROM v3u WHERE asset_id IN (SELECT asset_id FROM v1)

-- name: vparts
-- uses: vnodes, vedges
SELECT asset_id, CAST(ceil((n + e) / 50) AS INT) AS parts, p AS provenance_nodes, evidence_counts
FROM (SELECT asset_id, CAST(sum(k) AS BIGINT) AS n, max(k) FILTER (evidence_class = 'provenance') AS p, '{' || string_agg('"' || evidence_class || '":' || k, ',' ORDER BY evidence_class) || '}' AS evidence_counts
  FROM (SELECT asset_id, evidence_class, count(*) AS k FROM vnodes GROUP BY 1, 2) GROUP BY 1)
JOIN (SELECT asset_id, count(*) AS e FROM vedges GROUP BY 1) USING (asset_id)

-- name: ventries
-- uses: vnodes, vdata, vedges
SELECT asset_id, id AS key, id AS a, type AS b, data AS c, CAST(NULL AS VARCHAR) AS edge,
  CAST('{"id":' || to_json(id) || ',"type":"' || type || '","evidence_class":"' || evidence_class || '","data":' || to_json(data) || '}' AS VARCHAR) AS node
FROM vnodes JOIN vdata USING (asset_id, id)
UNION ALL SELECT asset_id, CASE WHEN target = 'asset:' || asset_id THEN source ELSE source || '|' || target || '|' || relation END, source, target, relation,
  CAST('{"source":' || to_json(source) || ',"target":' || to_json(target) || ',"relation":"' || relation || '"}' AS VARCHAR), CAST(NULL AS VARCHAR) FROM vedges

-- name: vnote
-- uses: v1
SELECT asset_id, CASE WHEN ai_detection_score IS NULL THEN CASE ai_disclosure
      WHEN 'ai_generated' THEN 'ai_generated:no_detector' WHEN 'ai_assisted' THEN 'ai_assisted:no_detector'
      WHEN 'human' THEN 'human:no_detector' WHEN 'unknown' THEN 'unknown:no_detector'
      ELSE 'no_statement' END
    WHEN NOT uses AND ai_detection_score >= 0.85 THEN 'high_undeclared'
    WHEN NOT uses AND ai_detection_score >= 0.4 THEN 'possible_undeclared'
    WHEN ai_detection_score >= 0.4 THEN 'declared_and_detected'
    WHEN uses THEN 'declared_below_threshold'
    WHEN ai_disclosure = 'human' THEN 'human_with_signal'
    ELSE 'signal_only' END AS note
FROM (SELECT *, coalesce(ai_disclosure IN ('ai_generated','ai_assisted'), false) AS uses FROM v1)

-- name: vmts
-- uses: v2
SELECT asset_id, completeness + consistency + hash_integrity + container + creator_points + timestamp_points AS metadata_trust_score,
  completeness, consistency, hash_integrity, container, creator_points AS creator, timestamp_points AS timestamps,
  missing_sections, consistency_failures, attribution_signals, timing
FROM (SELECT asset_id,
    CAST(round_even((14 - len(missing)) / 14e0 * 25, 0) AS INT) AS completeness,
    CAST(round_even((5 - len(failures)) / 5e0 * 20, 0) AS INT) AS consistency,
    CAST(round_even((CASE WHEN sha_ok THEN 5e-1 ELSE 0e0 END + CASE WHEN h_md5 IS NOT NULL THEN 25e-2 ELSE 0e0 END + CASE WHEN d_sha IS NOT NULL THEN 25e-2 ELSE 0e0 END) * 20, 0) AS INT) AS hash_integrity,
    CAST(round_even((4e-1 + 3e-1 + CASE WHEN f_mime = c_mime OR f_ext = c_ext THEN 3e-1 ELSE 0e0 END) * 15, 0) AS INT) AS container,
    CAST(round_even(least(1e0, len(signals) / 2e0) * 10, 0) AS INT) AS creator_points,
    CAST(round_even(CASE WHEN t_created IS NULL THEN 0e0 WHEN t_created <= t_modified THEN 1e0 ELSE 75e-2 END * 10, 0) AS INT) AS timestamp_points,
    array_to_string(missing, '|') AS missing_sections, array_to_string(failures, '|') AS consistency_failures, array_to_string(signals, '|') AS attribution_signals,
    CASE WHEN t_created IS NULL THEN 'no timestamps' WHEN t_created <= t_modified THEN 'created before modified' ELSE 'created later than modified' END AS timing
  FROM (SELECT *, coalesce(length(h_sha), 0) = 64 AS sha_ok,
    list_filter([CASE WHEN h_sha IS NULL AND h_md5 IS NULL THEN 'hashes' END, CASE WHEN codec_audio IS NULL THEN 'codec' END, CASE WHEN t_created IS NULL THEN 'timestamps' END,
      CASE WHEN make IS NULL AND model IS NULL THEN 'camera' END, CASE WHEN creator IS NULL AND copyright IS NULL THEN 'copyright' END,
      CASE WHEN software IS NULL THEN 'software' END, CASE WHEN make IS NULL THEN 'exif' END, CASE WHEN a_title IS NULL AND a_artist IS NULL THEN 'audio_tags' END,
      CASE WHEN creator IS NULL THEN 'xmp' END, CASE WHEN byline IS NULL THEN 'iptc' END], lambda x: x IS NOT NULL) AS missing,
    list_filter([CASE WHEN f_ext <> c_ext THEN 'extension_differs' END, CASE WHEN f_mime <> c_mime THEN 'mime_differs' END,
      CASE WHEN f_size <= 0 THEN 'size_invalid' END, CASE WHEN coalesce(length(h_sha), 0) <> 64 THEN 'sha256_invalid' END], lambda x: x IS NOT NULL) AS failures,
    list_filter([CASE WHEN creator IS NOT NULL OR copyright IS NOT NULL THEN 'copyright/creator' END, CASE WHEN make IS NOT NULL OR model IS NOT NULL THEN 'camera device' END,
      CASE WHEN software IS NOT NULL THEN 'software/tool' END, CASE WHEN creator IS NOT NULL THEN 'XMP rights' END, CASE WHEN a_artist IS NOT NULL THEN 'audio artist' END], lambda x: x IS NOT NULL) AS signals
  FROM v2))

-- name: s1
-- uses: v1
SELECT event_id, refused, 'S-' || user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, kind, event_id % 2 = 0 AS by_close,
  sha256(to_json({'ai_used': CAST(NULL AS BOOLEAN), 'asset_id': 'as-' || user_id, 'creator_id': CAST(NULL AS VARCHAR), 'event_id': event_id, 'event_type': kind,
    'location_level': CAST(NULL AS VARCHAR), 'location_summary': CAST(NULL AS VARCHAR), 'occurred_at': strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), 'payload': CASE WHEN kind = 'asset_registered' AND refused IS NULL THEN '{"asset_id":"as-' || user_id || '","given":' || coalesce(props, 'null') || ',"sha256":"' || sha || '"}' ELSE props END,
    'privacy_mode': CAST(NULL AS VARCHAR), 'recorded_at': strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), 'schema_version': '1.0', 'session_id': 'S-' || user_id,
    'source_name': CAST(NULL AS VARCHAR), 'source_type': 'web'})::VARCHAR) AS body
FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'unknown_type' WHEN event_id % 211 = 0 THEN 'session_closed' WHEN event_type = 'signup' THEN 'session_started'
    WHEN event_type = 'view' THEN 'work_saved' WHEN event_type = 'click' THEN 'work_exported' WHEN event_type = 'purchase' THEN 'ai_tool_disclosed' ELSE 'asset_registered' END AS kind,
    CASE WHEN kind = 'asset_registered' THEN CASE WHEN event_id % 13 = 0 THEN 'asset_missing' WHEN sha IS NULL OR event_id % 17 = 0 THEN 'asset_unknown' WHEN event_id % 7 = 0 THEN 'digest_differs' END END AS refused
  FROM events LEFT JOIN (SELECT doc_id, sha256 AS sha FROM v1) a ON a.doc_id = user_id)

-- name: s1r
-- uses: s1
SELECT *, CASE WHEN kind = 'unknown_type' THEN 'type_unknown' WHEN closed_before THEN 'after_close'
  WHEN kind = 'session_started' AND earlier > 0 THEN 'second_start' WHEN kind = 'session_closed' AND NOT by_close THEN 'close_reserved' ELSE refused END AS reason
FROM (SELECT *, coalesce(bool_or(kind = 'session_closed' AND by_close) OVER w, false) AS closed_before,
    coalesce(sum(CASE WHEN kind = 'unknown_type' OR (kind = 'session_closed' AND NOT by_close) OR refused IS NOT NULL THEN 0 ELSE 1 END) OVER w, 0) AS earlier
  FROM s1 WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))

-- name: s1l
-- uses: s1r
SELECT session_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS sequence, false AS accepted, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS head FROM s1r WHERE pos = 1
UNION ALL
SELECT r.session_id, r.event_id, r.pos, CASE WHEN r.reason IS NULL THEN l.sequence + 1 ELSE l.sequence END, r.reason IS NULL, r.reason, l.head,
  CASE WHEN r.reason IS NULL THEN sha256(coalesce(l.head, '') || ':' || (l.sequence + 1) || ':' || r.body) ELSE l.head END
FROM s1l l JOIN s1r r ON r.session_id = l.session_id AND r.pos = l.pos + 1

-- name: s3
SELECT project, since AS changed_at, since + 7200000000 AS emitted_at, signature FROM (
  SELECT *, lag(signature) OVER (PARTITION BY project ORDER BY since, event_id) AS emitted FROM (
    SELECT *, lead(since) OVER (PARTITION BY project ORDER BY since, event_id) AS next FROM (
      SELECT user_id AS project, event_id, epoch_us(ts) AS since, event_type AS signature, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    WHERE before IS NULL OR before <> signature)
  WHERE before IS NULL OR CASE WHEN next IS NOT NULL THEN next - since >= 7200000000
    ELSE (since + 7200000000 + 999) // 1000 * 1000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) END)
WHERE before IS NOT NULL AND emitted <> signature

-- name: s4
SELECT path, min(t) AS emitted_at, min_by(size, (t, event_id)) AS size FROM (
  SELECT *, max(start) OVER (PARTITION BY path ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM (
    SELECT *, CASE WHEN lag(size) OVER w IS NULL OR lag(size) OVER w <> size OR lag(changed) OVER w <> changed THEN t END AS start FROM (
      SELECT event_id, 'export-' || user_id || ['.wav','.txt','.MP3','.flac'][user_id % 4 + 1] AS path, epoch_us(ts) AS t, CASE WHEN event_type = 'click' THEN 0 ELSE 100 END AS size, date_trunc('day', ts) AS changed
      FROM events WHERE user_id % 4 <> 1 AND date_trunc('day', ts) >= TIMESTAMP '2024-01-03 00:00:00') WINDOW w AS (PARTITION BY path ORDER BY t, event_id)))
WHERE size > 0 AND t - since >= 3600000000 GROUP BY 1

-- name: s5
SELECT event_id AS request_id, CASE WHEN user_id % 3 <> 0 THEN 'tenant-key:' || left(sha256('key-' || (user_id % 10)), 24) ELSE 'ip:10.0.0.' || (user_id % 5) END AS key,
  event_type AS route, ts, epoch_us(ts) // 21600000000 AS w, CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 1 END AS lim
FROM events

-- name: s5w
-- uses: s5
SELECT key, route, w * 21600000000 AS window_start, count(*) AS requests, coalesce(count(*) > min(lim), false) AS over_limit FROM s5 GROUP BY 1, 2, 3

-- name: s6
SELECT sha256('/projects/' || user_id) AS project_key, event_id, session_started, start IS NULL AS reused FROM (
  SELECT *, max(start) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_started FROM (
    SELECT *, CASE WHEN event_type <> 'error' AND coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'error', true) THEN epoch_us(ts) END AS start FROM events))
WHERE event_type <> 'error'

-- name: u8
-- uses: v1
SELECT * FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'new-' || doc_id WHEN doc_id % 3 = 0 THEN 're-' || doc_id ELSE asset_id END AS asset_id,
  CASE WHEN doc_id % 5 = 0 THEN 'AU-new-' || doc_id ELSE asset_uid END AS asset_uid, tenant_id, doc_id, filename FROM v1)
QUALIFY row_number() OVER (PARTITION BY asset_uid, tenant_id ORDER BY doc_id DESC) = 1
