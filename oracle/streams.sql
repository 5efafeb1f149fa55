-- name: evidence_log_stream
-- uses: s1l
SELECT session_id, event_id, accepted, reason, CASE WHEN accepted THEN sequence END AS sequence, CASE WHEN accepted THEN before END AS previous_event_hash, CASE WHEN accepted THEN head END AS evidence_hash FROM s1l WHERE pos > 0

-- name: debounced_revisions
-- uses: s3
SELECT project, changed_at, emitted_at, signature FROM s3

-- name: debounced_revisions_batch
-- uses: s3
SELECT project, changed_at, emitted_at, signature FROM s3

-- name: stable_export
-- uses: s4
SELECT path, emitted_at, size FROM s4

-- name: stable_export_batch
-- uses: s4
SELECT path, emitted_at, size FROM s4

-- name: fixed_window_limit
-- uses: s5w
SELECT * FROM s5w

-- name: fixed_window_limit_batch
-- uses: s5w
SELECT * FROM s5w

-- name: limited_requests
-- uses: s5
SELECT request_id, w * 21600 AS window_start, nth, coalesce(nth <= lim, true) AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY key, route, w ORDER BY ts, request_id) AS nth FROM s5)

-- name: project_session_reuse
-- uses: s6
SELECT * FROM s6

-- name: project_session_reuse_batch
-- uses: s6
SELECT * FROM s6

-- name: idempotent_registration
-- uses: v1, v1r
SELECT v1.doc_id, asset_uid, v1r.doc_id AS registered_id, v1.doc_id <> v1r.doc_id AS registration_reused FROM v1 JOIN (SELECT asset_uid, doc_id FROM v1r) v1r USING (asset_uid)

-- name: idempotent_registration_batch
-- uses: v1r
SELECT doc_id, asset_uid FROM v1r

-- name: project_fingerprint
SELECT source, sha256(string_agg(branch || digest, '' ORDER BY branch)) AS fingerprint, CAST(sum(n) AS BIGINT) AS file_count, CAST(sum(b) AS BIGINT) AS total_bytes
FROM (SELECT source, left(leaf, 3) AS branch, sha256(string_agg(leaf || digest, '' ORDER BY leaf)) AS digest, sum(n) AS n, sum(b) AS b
  FROM (SELECT source, leaf, sha256(string_agg(digest, '' ORDER BY digest)) AS digest, count(*) AS n, sum(size) AS b
    FROM (SELECT source, left(sha256('doc/' || doc_id), 6) AS leaf, strlen(text) AS size, sha256(strlen(text) || '|' || sha256(text) || '|doc/' || doc_id) AS digest FROM documents) GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1
