"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import (
    chat,
    decontamination,
    frames,
    html_text,
    importance,
    length_histogram,
    lm_score,
    ngram_join,
    packing,
    quality,
    sharding,
    simhash,
    substring,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return frames.with_words_sha256(cleaned.drop("text"), "kept_text", "kept_sha256").drop("kept_text")


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    bands = quality.fit_bands(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, bands).drop("text", "lang")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op1_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op4_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.score_corpus(docs, least=1).drop("text")


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.histogram(length_histogram.lengths(table(spark, sf_dir, "documents")))


# A conversation whose texts try to close their turn and open another.
HOSTILE = r"\### Assistant: </turn> ok"


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    hostile = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HOSTILE).alias("text"),
    )
    return chat.digests(rows.unionByName(hostile))


ORACLE_SQL["op3_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
marked AS (
  SELECT *, row_number() OVER w = 1 OR lag(role) OVER w <> role AS opens,
    length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS chars,
    length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS role_chars
  FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, ''
    ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN opens THEN role_chars + 14 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM marked
GROUP BY conv_id
"""


@query
def op6_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


ORACLE_SQL["op1_prefix_join"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
),
windows AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT *, least(10, len(ws)) AS n FROM items WHERE len(ws) > 0), unnest(range(1, len(ws) - n + 2)) t(i)
),
places AS (
  SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(ws) - n + 2)) t(i)
),
hits AS (SELECT r, i, n, item FROM places JOIN windows USING (n, k)),
words AS (SELECT DISTINCT r, j FROM (SELECT DISTINCT r, i, n FROM hits), unnest(range(i, i + n)) t(j))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs
LEFT JOIN (SELECT r, count(*) AS n_hit FROM words GROUP BY r) USING (r)
LEFT JOIN (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r) USING (r)
"""

ORACLE_SQL["op2_substring"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
windows AS (
  SELECT r, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS k FROM docs, unnest(range(1, len(ws) - 33)) t(i)
),
repeated AS (SELECT r, i FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
words AS (
  SELECT r, j, word, coalesce(max(hit) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM (SELECT r, j, ws[j] AS word FROM docs, unnest(range(1, len(ws) + 1)) t(j))
  LEFT JOIN (SELECT r, i AS j, 1 AS hit FROM repeated) USING (r, j)
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN (
  SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (gone = 0) AS kept FROM words GROUP BY r
) USING (r)
"""


@query
def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_ngram_join"] = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
shingles AS (
  SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS k
  FROM docs, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(i) WHERE len(ws) > 0
),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
links AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS o FROM shingles x JOIN shingles y USING (k) WHERE x.r <> y.r GROUP BY ALL)
  JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE 100 * o >= 80 * (p.n + q.n - o)
),
reached(r, other) AS (
  SELECT r, r FROM docs UNION SELECT reached.r, links.b FROM reached JOIN links ON reached.other = links.a
),
least AS (SELECT reached.r, min(doc_id) AS component_id FROM reached JOIN docs ON docs.r = reached.other GROUP BY reached.r)
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id
FROM docs JOIN least USING (r) LEFT JOIN sizes USING (r)
"""


@query
def op12_segment_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op12_segment_resampling"] = r"""
WITH RECURSIVE texts AS (
  SELECT 0 AS target, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
),
split AS (
  SELECT target, r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts
),
grams AS (
  SELECT target, r, array_to_string(ws[i:i + n - 1], ' ') AS f
  FROM split, unnest([1, 2, 3]) s(n), unnest(range(1, len(ws) - n + 2)) t(i)
),
names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM grams)),
bits(i, k, v) AS (
  SELECT i, 0, CAST(i AS UBIGINT) FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END FROM bits WHERE k < 8
),
steps AS (SELECT list(v ORDER BY i) AS l FROM bits WHERE k = 8),
crc(h, p, c) AS (
  SELECT h, 0, CAST(4294967295 AS UBIGINT) FROM names
  UNION ALL
  SELECT h, p + 1, xor(l[CAST(xor(c & 255, CAST('0x' || h[2 * p + 1:2 * p + 2] AS UBIGINT)) AS BIGINT) + 1], c >> 8)
  FROM crc, steps WHERE 2 * p < len(h)
),
buckets AS (
  SELECT f, CAST(xor(c, CAST(4294967295 AS UBIGINT)) % 10000 AS BIGINT) AS bucket
  FROM names JOIN crc ON crc.h = names.h AND 2 * p = len(names.h)
),
counted AS (SELECT target, r, bucket, count(*) AS n FROM grams JOIN buckets USING (f) GROUP BY ALL),
sums AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (target = 0), 0) AS s, coalesce(sum(n) FILTER (target = 1), 0) AS t
  FROM range(10000) x(b) LEFT JOIN counted ON bucket = b GROUP BY b
),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM sums) + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM sums) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM sums
),
weights AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN gains USING (bucket) WHERE target = 0 GROUP BY r),
scored AS (
  SELECT doc_id, len(ws) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT)
      AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (r) WHERE target = 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
    5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS draws
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= draws THEN place END AS rank FROM ranked
"""


@query
def op13_polarisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
