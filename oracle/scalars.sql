-- name: content_digests
SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha256(text) AS second_fingerprint FROM documents

-- name: asset_uid
-- uses: v1
SELECT doc_id, tenant_id, asset_uid FROM v1

-- name: tenant_uid
-- uses: v9
SELECT application_id, email,
  CASE WHEN reason IS NULL THEN slug || CASE WHEN nth > 1 THEN '_' || lpad(CAST(nth - 1 AS VARCHAR), 4, '0') ELSE '' END END AS tenant_id, reason
FROM (SELECT *, row_number() OVER (PARTITION BY slug, reason IS NULL ORDER BY application_id) AS nth
  FROM (SELECT v9.*, 'tn_' || upper(left(md5(lower(email)), 8)) AS slug,
      CASE WHEN email IN (SELECT 'C' || s_suppkey || '@Example.com' FROM supplier) OR application_id > first_application THEN 'email_known'
        WHEN plan NOT IN ('founder','creator','label','enterprise') THEN 'plan_unknown' END AS reason
    FROM v9 LEFT JOIN (SELECT email, min(application_id) AS first_application FROM v9 WHERE plan <> 'gold' GROUP BY 1) USING (email)))

-- name: record_digest
-- uses: v2e
SELECT event_id, true_hash AS digest FROM v2e

-- name: keyed_mac
-- uses: v6
SELECT cert_id, CASE WHEN o_orderkey % 70 = 0 THEN reverse(signature) ELSE signature END AS mac FROM v6

-- name: clean_text
-- uses: v1
SELECT asset_id, nullif(trim(creator_name), '') AS creator_name, nullif(trim(human_authorship_summary), '') AS summary FROM v1

-- name: zero_safe_percentage
-- uses: v5
SELECT contributor_id, ai_assisted_pct AS assisted,
  CASE WHEN ownership_split_pct IS NULL THEN creative_contribution_pct
    WHEN position % 5 = 0 OR position % 7 = 0 THEN NULL ELSE round(ownership_split_pct, 4) END AS ownership
FROM v5

-- name: normalize_ai_disclosure
-- uses: v1
SELECT asset_id, CASE WHEN reason IS NULL THEN value END AS disclosure,
  CASE WHEN reason IS NULL AND value IN ('human','ai_assisted','ai_generated') THEN value = 'ai_generated' END AS is_generated,
  CASE WHEN reason IS NULL AND value IN ('human','ai_assisted','ai_generated') THEN value = 'ai_assisted' END AS is_assisted,
  CASE WHEN reason IS NULL THEN coalesce(value IN ('ai_assisted','ai_generated'), false) END AS is_disclosed,
  CASE WHEN reason IS NULL THEN CASE WHEN tools THEN 'tool-a' ELSE '' END END AS tools, reason
FROM (SELECT *, CASE WHEN value NOT IN ('human','ai_assisted','ai_generated','unknown') THEN 'unsupported ai_disclosure'
    WHEN value = 'human' AND tools THEN 'human contradicts declared AI tools'
    WHEN value = 'unknown' AND tools THEN 'unknown contradicts declared AI tools' END AS reason
  FROM (SELECT asset_id, tools, CASE WHEN given IS NOT NULL THEN CASE given WHEN 'ai' THEN 'ai_generated' WHEN 'mixed' THEN 'ai_assisted' ELSE given END
      WHEN flag THEN 'ai_generated' WHEN tools THEN 'ai_assisted' WHEN NOT flag THEN 'human' END AS value
    FROM (SELECT asset_id, lower(CASE WHEN doc_id % 29 = 0 THEN 'robot' WHEN doc_id % 5 = 4 THEN NULL ELSE ai_disclosure_raw END) AS given,
        CASE WHEN doc_id % 7 = 1 THEN true WHEN doc_id % 7 = 2 THEN false END AS flag,
        has_tool AND doc_id % 4 <> 0 AS tools FROM v1)))

-- name: risk_band
-- uses: v4
SELECT observation_id, p AS probability, floor(p * 100 * 100 + 0.5) / 100 AS pct,
  CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.5 THEN 'elevated' WHEN p IS NOT NULL THEN 'low' END AS risk
FROM (SELECT observation_id, CASE WHEN d IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, d)) END AS p
  FROM (SELECT observation_id, try_cast(probability AS DOUBLE) AS d FROM v4))

-- name: normalize_observations
-- uses: v4n
SELECT observation_id, provider, model, signal, probability, probability_pct, risk, status, details FROM v4n

-- name: hex_valid
-- uses: v2
SELECT asset_id, coalesce(regexp_full_match(h_sha, '[0-9a-f]{64}'), false) AS sha_ok,
  coalesce(regexp_full_match(h_md5, '[0-9a-f]{32}'), false) AS md5_ok FROM v2

-- name: populated_predicates
-- uses: v2
SELECT asset_id, true AS populated_gps, lat IS NOT NULL OR lon IS NOT NULL AS meaningful_gps,
  make IS NOT NULL OR model IS NOT NULL AS populated_camera, make IS NOT NULL OR model IS NOT NULL AS meaningful_camera,
  make IS NOT NULL AS populated_exif, make IS NOT NULL AS meaningful_exif,
  t_created IS NOT NULL AS populated_timestamps, t_created IS NOT NULL AS meaningful_timestamps,
  creator IS NOT NULL OR copyright IS NOT NULL AS populated_copyright, creator IS NOT NULL OR copyright IS NOT NULL AS meaningful_copyright,
  codec_audio IS NOT NULL AS populated_codec, codec_audio IS NOT NULL AS meaningful_codec,
  h_sha IS NOT NULL OR h_md5 IS NOT NULL AS populated_hashes, h_sha IS NOT NULL OR h_md5 IS NOT NULL AS meaningful_hashes
FROM v2

-- name: first_tag
-- uses: v2
SELECT asset_id, coalesce(creator, byline) AS creator, software, r_gpslat AS latitude, make FROM v2

-- name: tag_group_partition
-- uses: v2
SELECT asset_id, concat_ws(';', CASE WHEN t_created IS NOT NULL THEN 'CreateDate=' || t_created END, CASE WHEN make IS NOT NULL THEN 'Make=' || make END) AS exif,
  coalesce('By-line=' || byline, '') AS iptc, coalesce('Creator=' || creator, '') AS xmp, coalesce('Title=' || a_title, '') AS audio_tags
FROM v2

-- name: normalize_sections
-- uses: v2
SELECT asset_id, c_format AS format, r_width || 'x' || r_height AS resolution, f_mime AS container_mime, f_ext AS container_extension,
  t_created AS created, make, r_gpslat AS latitude, 'false' AS gps, coalesce(creator, byline) AS creator, software AS editing_software,
  CAST(NULL AS VARCHAR) AS codec_audio FROM v2

-- name: normalize_audio_tags
-- uses: v1
SELECT asset_id, CASE WHEN doc_id % 3 = 0 THEN 'Fallback' ELSE 'Song ' || (doc_id % 50) END AS title,
  CASE WHEN doc_id % 5 = 0 THEN 'note' END AS comment, CASE WHEN doc_id % 4 = 0 THEN 'Band' END AS album_artist,
  CAST(1990 + doc_id % 30 AS VARCHAR) AS year, CAST(NULL AS VARCHAR) AS artist,
  4 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS raw_tags FROM v1

-- name: flatten_nested
-- uses: v8m
SELECT asset_id, replace(substr(fullkey, 3), '"', '') AS path, CASE WHEN type = 'NULL' THEN NULL ELSE json_extract_string(store, fullkey) END AS value
FROM v8m, json_tree(v8m.store) WHERE type NOT IN ('OBJECT', 'ARRAY')

-- name: classify_media
-- uses: v1
SELECT asset_id, extension, coalesce(mime, guess, 'application/octet-stream') AS mime_type, family IS NOT NULL AS supported, family
FROM (SELECT asset_id, CASE WHEN doc_id % 9 = 0 THEN 'application/custom' END AS mime,
    ['jpg','mp4','gz','','docx','flac','png',''][doc_id % 8 + 1] AS extension,
    ['image/jpeg','video/mp4',NULL,NULL,'application/vnd.openxmlformats-officedocument.wordprocessingml.document','audio/flac','image/png',NULL][doc_id % 8 + 1] AS guess,
    ['image','video',NULL,NULL,'document','audio','image',NULL][doc_id % 8 + 1] AS family FROM v1)

-- name: layer_split
-- uses: v2
SELECT asset_id, f_mime AS mime_type, 'table' AS extractor,
  len(list_filter([make, byline, creator, a_title, r_gpslat, t_created, r_width, r_height, software], lambda x: x IS NOT NULL)) AS raw_tags,
  sha256(to_json({
    'audio_tags': {'artist': a_artist, 'title': a_title}, 'camera': {'make': make, 'model': model}, 'codec': {'audio': codec_audio},
    'container': {'extension': c_ext, 'format': c_format, 'mime_type': c_mime}, 'copyright': {'copyright': copyright, 'creator': creator},
    'exif': CASE WHEN make IS NULL THEN '{}'::JSON ELSE json_object('Make', make) END,
    'file': {'extension': f_ext, 'mime_type': f_mime, 'sha256': sha256_file, 'size': CAST(f_size AS VARCHAR)},
    'gps': {'gps': 'false', 'latitude': CAST(lat AS VARCHAR), 'longitude': CAST(lon AS VARCHAR)},
    'hashes': {'md5': h_md5, 'sha256': h_sha},
    'iptc': CASE WHEN byline IS NULL THEN '{}'::JSON ELSE json_object('By-line', byline) END,
    'software': {'editing_software': software, 'export_application': CAST(NULL AS VARCHAR)}, 'technical': {'format': c_format},
    'timestamps': {'created': t_created, 'digitized': t_digitized, 'encoded': CAST(NULL AS VARCHAR), 'modified': t_modified},
    'xmp': CASE WHEN creator IS NULL THEN '{}'::JSON ELSE json_object('creator', creator) END})::VARCHAR) AS metadata_sha256
FROM (SELECT v2.*, d.sha AS sha256_file FROM v2 JOIN (SELECT doc_id, sha256(text) AS sha FROM documents) d USING (doc_id))

-- name: gtin14_check
-- uses: v10c
SELECT passport_id, gtin AS value, gtin_reason IS NULL AS valid, gtin_reason AS reason FROM v10c

-- name: serial_check
-- uses: v10c
SELECT passport_id, serial AS value, serial_reason IS NULL AS valid, serial_reason AS reason FROM v10c

-- name: resolver_origin_check
SELECT page_id, CASE WHEN given <> '' AND reason IS NULL THEN 'https://' || regexp_extract(given, '^https://([^/?#]*)', 1) END AS url,
  CASE WHEN given <> '' THEN reason END AS reason
FROM (SELECT page_id, given, CASE WHEN NOT regexp_matches(given, '^https://[^/?#]') THEN 'origin_not_https'
    WHEN regexp_matches(given, '^https://[^/?#]*@') OR regexp_matches(given, '[?#].') THEN 'origin_has_extras'
    WHEN regexp_matches(given, '^https://[^/?#]+/') THEN 'origin_has_path' END AS reason
  FROM (SELECT page_id, rtrim(trim(CASE WHEN page_id % 10 = 0 THEN ' ' || replace(o, 'http:', 'https:') || '/ '
      WHEN page_id % 10 = 1 THEN regexp_replace(o, '^https?://', 'https://user:pw@')
      WHEN page_id % 10 = 2 THEN replace(o, 'http:', 'https:') || '?q=1' WHEN page_id % 10 = 3 THEN ' ' ELSE url END), '/') AS given
    FROM (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS o FROM pages)))

-- name: item_uri
-- uses: v10c
SELECT passport_id, 'https://id.gs1.org/01/' || gtin_ok || '/21/' || url_encode(serial_ok) AS uri FROM v10c WHERE gtin_ok IS NOT NULL AND serial_ok IS NOT NULL

-- name: iso_utc
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS evidence_form,
  CASE WHEN event_id % 2 = 0 OR ts = date_trunc('second', ts) THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS fact_form
FROM events

-- name: dictionary_match
SELECT *, CASE app WHEN 'Logic Pro' THEN '.logicx' WHEN 'Ableton Live' THEN '.als' WHEN 'Akai MPC Desktop / MPC Beats' THEN '.xpj' END AS project_extensions,
  ['standalone_mpc','standalone_groovebox',NULL,NULL][p_partkey % 4 + 1] AS hardware_category
FROM (SELECT p_partkey, (SELECT min_by(profile, n) FROM (VALUES (1, 'Logic Pro', 'logic pro'), (2, 'Ableton Live', 'ableton live'), (3, 'Akai MPC Desktop / MPC Beats', 'mpc')) t(n, profile, token)
    WHERE contains(['logic pro x','mpc software','ableton live 12','serato dj pro',lower(p_name),lower(p_name)][p_partkey % 6 + 1], token)) AS app,
  CASE WHEN p_partkey % 6 = 3 THEN 'Serato DJ Pro' END AS process_only,
  ['Akai MPC Live II','Native Instruments Maschine+',NULL,NULL][p_partkey % 4 + 1] AS hardware
FROM part)

-- name: manifest_actions
-- uses: v8m
SELECT asset_id, CASE WHEN doc_id % 12 = 0 THEN '' ELSE 'c2pa.created|a' || (doc_id % 6) END AS actions FROM v8m

-- name: manifest_summary
-- uses: v8m
SELECT asset_id, p AS manifest_present, CASE WHEN p THEN 'm' || doc_id END AS active_manifest, CASE WHEN p THEN 'gen-' || (doc_id % 4) END AS claim_generator,
  CASE WHEN p THEN 't' END AS title, CASE WHEN p AND doc_id % 5 = 0 THEN 1 ELSE 0 END AS ingredient_count, CASE WHEN p THEN 2 ELSE 0 END AS assertion_count,
  CASE WHEN p THEN 'c2pa.created|a' || (doc_id % 6) END AS actions,
  CASE WHEN NOT p THEN 'not_present' WHEN doc_id % 9 = 0 THEN 'invalid' ELSE 'no_reported_errors' END AS validation_state,
  CASE WHEN p THEN 2 END AS status_count, CASE WHEN p AND doc_id % 9 = 0 THEN 1 ELSE 0 END AS validation_error_count
FROM (SELECT *, doc_id % 12 <> 0 AS p FROM v8m)

-- name: status_union_dedupe
-- uses: v8m
SELECT asset_id, 0 AS position, 'claim.seen' AS code, CAST(NULL AS BOOLEAN) AS success FROM v8m
UNION ALL SELECT asset_id, 1, 'c' || (doc_id % 3), doc_id % 9 <> 0 FROM v8m

-- name: location_check
SELECT event_id, reason IS NULL AS ok, reason FROM (
  SELECT event_id, CASE WHEN k % 5 = 3 THEN 'location_level_unknown'
    WHEN k % 5 = 2 AND (k % 3 = 0 OR k % 7 = 0) THEN 'location_place_missing' END AS reason
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))

-- name: class_max_score
-- uses: v8c
SELECT response_id, max(score) FILTER (class = 'ai_generated' AND raw IS NOT NULL) AS probability, count(DISTINCT seg) AS segment_count FROM v8c GROUP BY 1

-- name: top_attribution
-- uses: v8c
SELECT response_id, class AS top_class, score FROM v8c WHERE class IN ('suno','udio')
QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY score DESC, seg, pos) = 1

-- name: music_observations
-- uses: v8c
SELECT m.response_id, m.class AS model, CASE m.class WHEN 'ai_generated_music' THEN 'synthetic_music_probability' ELSE 'synthetic_music_cover_probability' END AS signal,
  m.probability, s.n AS segment_count, t.class AS top_class
FROM (SELECT response_id, class, max(score) AS probability FROM v8c WHERE class IN ('ai_generated_music','ai_generated_music_cover') AND raw IS NOT NULL GROUP BY 1, 2) m
JOIN (SELECT response_id, count(DISTINCT seg) AS n FROM v8c GROUP BY 1) s USING (response_id)
JOIN (SELECT response_id, class FROM v8c WHERE class IN ('suno','udio') QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY score DESC, seg, pos) = 1) t USING (response_id)

-- name: opt_in_fields
SELECT event_id, array_to_string(f, '|') AS fields, CASE WHEN event_id % 11 = 0 THEN 'wallets' END AS unsupported,
  CASE WHEN list_contains(f, 'production_environment') THEN 'Env ' || user_id END AS production_environment
FROM (SELECT event_id, user_id, list_filter([CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'production_environment' END,
    CASE WHEN event_id % 2 = 0 THEN 'transformation_statement' END, CASE WHEN event_id % 11 = 0 THEN 'wallets' END], lambda x: x IS NOT NULL) AS f FROM events)

-- name: transformation_declare
SELECT event_id, array_to_string(t, '|') AS transformations, reason IS NULL AND event_id % 4 = 0 AS verified, reason
FROM (SELECT *, CASE WHEN len(t) = 0 THEN 'at least one transformation is required' WHEN event_id % 13 = 0 THEN 'unsupported transformation: painted' END AS reason
  FROM (SELECT event_id, list_filter([CASE WHEN event_id % 2 = 0 THEN 'edited' END, CASE WHEN event_id % 3 = 0 THEN 'replayed' END,
    CASE WHEN event_id % 5 = 0 AND event_id % 2 <> 0 THEN 'edited' END, CASE WHEN event_id % 13 = 0 THEN 'painted' END], lambda x: x IS NOT NULL) AS t FROM events))

-- name: public_event_redaction
-- uses: v3e
SELECT event_id, session_id, sequence, event_type, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS occurred_at, ai_used, location_level,
  CASE WHEN location_level = 'precise_private' THEN 'private' WHEN location_level = 'coarse' THEN nullif(location_summary, '') ELSE location_summary END AS location_summary
FROM v3e
