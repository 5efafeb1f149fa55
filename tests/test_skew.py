"""Hot keys: split results equal unsplit ones, and plans stay free of traps."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as contract
from attestry.operators import chain, graph, integrity, matching, ordering, timeline
from attestry.plans.views import Views
from attestry.session import stored
from attestry.streaming import jobs


@pytest.fixture
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(chain, "SEQUENCE_BLOCK", 7)


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds a third of the rows; blocks have holes."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 200).alias("key"),
        (F.col("id") * 7919 % 3001).alias("at"),
        (F.col("id") % 5).alias("value"),
    )


def test_split_equals_plain_window(skewed, tiny_blocks):
    got = ordering.ordered(
        skewed,
        ["key"],
        F.floor(F.col("at") / 10),
        [F.col("at")],
        position="n",
        previous={"before": F.col("value")},
        following={"after": F.col("value")},
        running_max={"top": F.when(F.col("value") < 3, F.col("value"))},
    )
    w = Window.partitionBy("key").orderBy("at")
    want = skewed.select(
        "*",
        F.row_number().over(w).alias("n"),
        F.lag("value").over(w).alias("before"),
        F.lead("value").over(w).alias("after"),
        F.max(F.when(F.col("value") < 3, F.col("value"))).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ).alias("top"),
    )
    columns = ["key", "at", "value", "n", "before", "after", "top"]
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    assert rows(got) == rows(want)


def test_null_keys_and_null_blocks_keep_their_borders(spark):
    rows = spark.range(400).select(
        F.when(F.col("id") % 4 != 0, F.col("id") % 2).alias("key"),
        F.when(F.col("id") >= 100, F.col("id")).alias("at"),
        F.col("id"),
    )
    got = ordering.ordered(
        rows, ["key"], F.floor(F.col("at") / 50), [F.col("at"), F.col("id")], "n",
        previous={"before": F.col("id")}, following={"after": F.col("id")}, running_max={"top": F.col("id")},
    )
    w = Window.partitionBy("key").orderBy("at", "id")
    want = rows.select(
        "key", "at", "id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"),
        F.max("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("top"), F.row_number().over(w).alias("n"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize(
    "key",
    ["chain_verify", "chain_failures", "lineage_steps", "chronology_check", "limited_requests",
     "debounced_revisions_batch", "stable_export_batch", "project_session_reuse_batch"],
)
def test_queries_with_every_key_split(spark, sf_dir, tiny_blocks, key):
    import compare

    twin = contract.oracle_sql()[key]
    assert compare.compare(contract.queries()[key](spark, sf_dir), compare.duck(sf_dir), twin) == []


def test_one_session_with_all_events(spark, sf_dir, tiny_blocks):
    events = (
        Views(spark, sf_dir)
        .session_inputs.drop("sequence")
        .withColumns({"session_id": F.lit("S"), "user_id": F.lit(1), "event_type": F.lit("work_saved")})
    )
    built = chain.chain_build(events)
    n = events.count()
    sessions = built.groupBy("session_id").agg(F.max_by("evidence_hash", "sequence").alias("current_hash"))
    _, summary = chain.chain_verify(built, sessions)
    row = summary.first()
    assert (row["event_count"], row["valid"]) == (n, True)
    broken = built.withColumn("payload", F.when(F.col("sequence") == 100, F.lit("{}")).otherwise(F.col("payload")))
    failures, _ = chain.chain_verify(broken, sessions)
    assert [r["reason"] for r in failures.collect()] == ["evidence_hash_mismatch"]


def test_block_heads_of_a_hot_session(spark, sf_dir, tiny_blocks):
    """A third of the events in one session; heads find the changed blocks and spare the rest a walk."""
    from attestry.operators import block_heads

    inputs = Views(spark, sf_dir).session_inputs.drop("sequence")
    hot = inputs.withColumn("session_id", F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.col("session_id")))
    built = stored(chain.chain_build(hot), "built")
    heads = stored(block_heads.block_heads(built, 16), "heads")
    assert heads.agg(F.max("events")).first()[0] == 16
    assert heads.where("session_id = 'hot'").count() == -(-built.where("session_id = 'hot'").count() // 16)
    assert block_heads.block_failures(built, heads, 16).count() == 0
    at = F.col("sequence")
    is_hot = F.col("session_id") == "hot"
    changed = (
        built.where(~(is_hot & (at == 40)))  # block 2
        .withColumn("payload", F.when(is_hot & (at == 100), F.lit("{}")).otherwise(F.col("payload")))  # block 6
        .withColumn("evidence_hash", F.when(is_hot & (at == 200), F.lit("ff")).otherwise(F.col("evidence_hash")))  # block 12
        .where(~(is_hot & at.between(305, 320)))  # block 19
    )
    # one sequence number many times over: counted, not collected
    changed = changed.union(changed.where(is_hot & (at == 10)).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("again"))
    extra = changed.where(is_hot & (at == 1)).withColumn("sequence", F.lit(None).cast("int")).withColumn("session_id", F.lit(None).cast("string"))
    found = block_heads.block_failures(changed.union(extra), heads, 16).collect()
    assert {tuple(r) for r in found} == {
        ("hot", 0, "block_mismatch"), ("hot", 2, "block_mismatch"), ("hot", 6, "block_mismatch"),
        ("hot", 12, "block_mismatch"), ("hot", 19, "missing_block"), (None, -1, "unknown_block"),
    }
    forged = heads.withColumn("block_digest", F.when(is_hot & (F.col("block") == 3), F.lit("00")).otherwise(F.col("block_digest")))
    assert {tuple(r) for r in block_heads.block_failures(built, forged, 16).collect()} == {
        ("hot", 3, "block_head_mismatch"), ("hot", 4, "block_head_mismatch")
    }
    sessions = built.groupBy("session_id").agg(F.max_by("evidence_hash", "sequence").alias("current_hash"))
    plain = chain.chain_verify(changed, sessions)
    spared = block_heads.verify_by_blocks(changed, sessions, heads, 16)
    for one, two in zip(plain, spared):
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    none = built.limit(0)
    assert block_heads.block_heads(none).count() == 0 and block_heads.block_failures(none, heads.limit(0)).count() == 0


def test_input_order_does_not_matter(spark, sf_dir):
    events = Views(spark, sf_dir).session_inputs
    one = chain.chain_build(events).select("event_id", "evidence_hash")
    two = chain.chain_build(events.orderBy(F.rand(7))).select("event_id", "evidence_hash")
    assert one.exceptAll(two).count() == 0


def test_hot_digest_forms_no_pairs(spark):
    assets = spark.range(2000).select(
        F.lit("h").alias("sha256"),
        F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("asset_uid"),
        F.col("id").cast("string").alias("asset_id"),
        F.lit("t").alias("tenant_id"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit(0.5).alias("trust_score"),
        F.lit("x").alias("content_label"),
    )
    requests = spark.range(2000).select(F.col("id").alias("request_id"), F.lit("h").alias("sha256"))
    verdicts, matches = matching.hash_match(requests, assets)
    assert verdicts.count() == 2000 and verdicts.where("status = 'ambiguous' and match_count = 2000").count() == 2000
    assert matches.count() == 2000 and matches.agg(F.max("match_no")).first()[0] == 2000


def test_split_multisets(spark):
    schema = "asset_id string, owner_name string, role string, ownership_split_pct double, creative_contribution_pct double, ai_assisted_pct double"
    stored = spark.createDataFrame([("a", "x", None, 50.0, 1.0, 0.0)] * 2 + [("b", "x", "r", 1.0, None, None)], schema)
    certified = spark.createDataFrame([("a", "x", None, 50.0, 1.0, 0.0), ("b", "x", "r", 1.0, None, None)], schema)
    assert [r[0] for r in integrity.split_differences(stored, certified).collect()] == ["a"]
    assert integrity.split_differences(stored, stored).count() == 0


def test_graph_parts_cover_a_large_asset(spark):
    nodes = spark.range(5000).select(
        F.lit("a").alias("asset_id"), F.concat(F.lit("n:"), F.col("id").cast("string")).alias("id"),
        F.lit("provenance_event").alias("type"), F.lit("provenance").alias("evidence_class"), F.lit("{}").alias("data"),
    )
    edges = nodes.select("asset_id", F.col("id").alias("source"), F.lit("asset:a").alias("target"), F.lit("r").alias("relation"))
    parts = graph.graph_document(nodes, edges, 100)
    rows = parts.select(F.size("nodes").alias("n"), F.size("edges").alias("e"), "parts").collect()
    assert sum(r["n"] for r in rows) == 5000 and sum(r["e"] for r in rows) == 5000
    # parts follow nodes and edges together
    assert rows[0]["parts"] == 100 and max(r["n"] + r["e"] for r in rows) < 200


def test_graph_parts_follow_edges(spark):
    nodes = spark.range(100).select(
        F.lit("a").alias("asset_id"), F.concat(F.lit("n:"), F.col("id").cast("string")).alias("id"),
        F.lit("provenance_event").alias("type"), F.lit("provenance").alias("evidence_class"), F.lit("{}").alias("data"),
    )
    edges = spark.range(5000).select(
        F.lit("a").alias("asset_id"), F.concat(F.lit("n:"), F.col("id").cast("string")).alias("source"),
        F.lit("asset:a").alias("target"), F.lit("r").alias("relation"),
    )
    rows = graph.graph_document(nodes, edges, 50).select(F.size("nodes").alias("n"), F.size("edges").alias("e"), "parts").collect()
    assert rows[0]["parts"] == 102 and sum(r["e"] for r in rows) == 5000 and max(r["n"] + r["e"] for r in rows) < 100


def test_fingerprint_ignores_listing_order_and_sees_changes(spark):
    files = spark.range(500).select(
        F.lit("p").alias("project"),
        F.concat(F.lit("f/"), F.col("id").cast("string")).alias("path"),
        (F.col("id") + 1).alias("size"),
        F.sha2(F.col("id").cast("string"), 256).alias("sha256"),
    )
    digest = lambda df: df.first()["fingerprint"]
    one = digest(jobs.project_fingerprint(files, ["project"]))
    assert one == digest(jobs.project_fingerprint(files.orderBy(F.rand(3)).repartition(7), ["project"]))
    changed = files.withColumn("size", F.when(F.col("size") == 250, 0).otherwise(F.col("size")))
    assert one != digest(jobs.project_fingerprint(changed, ["project"]))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_filtered(spark, sf_dir):
    plan = _plan(contract.queries()["tenant_scope"](spark, sf_dir))
    assert "EqualTo(source,src3)" in plan
    facts = _plan(contract.queries()["latest_per_key"](spark, sf_dir))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in facts
    assert "WindowGroupLimit" in facts


def test_chronology_of_one_hot_asset(spark, tiny_blocks):
    events = spark.range(1000).select(
        F.lit("a").alias("asset_id"), F.col("id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("timestamp"),
    )
    assert timeline.chronology_check(events).first()["chronological"]
    late = events.withColumn(
        "timestamp", F.when(F.col("event_id") == 700, F.lit("2023-01-01").cast("timestamp_ntz")).otherwise(F.col("timestamp"))
    )
    assert not timeline.chronology_check(late).first()["chronological"]


def test_one_key_and_one_time_are_numbered_in_many_ranges(spark):
    rows = spark.range(1_000_000).select(
        F.lit("hot").alias("key"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"), (F.col("id") * 7919 % 1_000_003).alias("id")
    )
    got = ordering.numbered(rows, ["key"], [F.col("at"), F.col("id")], "n")
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("at", "id")))
    digest = lambda df: df.agg(F.count("*"), F.sum(F.expr("xxhash64(id, n) >> 24")), F.max("n"), F.min("n")).first()
    assert digest(got) == digest(want)
    ranges = rows.repartitionByRange("key", "at", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 600_000


def test_numbers_of_null_keys_and_repeated_rows(spark):
    rows = spark.range(900).select(
        F.when(F.col("id") % 4 != 0, F.col("id") % 3).alias("key"), (F.col("id") % 50).alias("at"), F.lit("x").alias("n")
    )
    got = ordering.numbered(rows, ["key"], [F.col("at")], "n")
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("at")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ordering.numbered(rows.limit(0), ["key"], [F.col("at")]).count() == 0


@pytest.mark.parametrize("hot", [0, 200, 1 << 17])
def test_hot_keys_alone_go_by_blocks(spark, skewed, monkeypatch, hot):
    """Totals, positions and neighbours are the same with all, one or none of the keys split."""
    monkeypatch.setattr(ordering, "HOT", hot)
    rows = skewed.withColumn("key", F.when(F.col("key") != 7, F.col("key")))
    got = ordering.ordered(
        rows, ["key"], F.floor(F.col("at") / 10), [F.col("at")], "n",
        previous={"before": F.col("value")}, following={"after": F.col("value")},
        running_max={"top": F.col("value")}, total={"sum": F.col("value")},
    )
    w = Window.partitionBy("key").orderBy("at")
    want = rows.select(
        "key", "at", "value", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"),
        F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("top"),
        F.sum("value").over(Window.partitionBy("key")).alias("sum"), F.row_number().over(w).alias("n"),
    ).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    marks = ordering._marked(rows, ["key"]).where("__hot").select("key").distinct().count()
    assert marks == {0: rows.select("key").distinct().count(), 200: 1, 1 << 17: 0}[hot]


def test_split_rows_shuffle_their_lines_once(spark, sf_dir):
    """Positions and sheet totals come from one exchange of the lines; only counts meet besides."""
    frame = Views(spark, sf_dir).split_rows
    frame.collect()
    wide = [line for line in _plan(frame).split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning(__group" in line]
    assert len(wide) <= 1


@pytest.mark.parametrize("key", ["split_sheet_validate", "limited_requests", "chronology_check", "debounced_revisions_batch"])
def test_queries_with_many_hot_keys(spark, sf_dir, tiny_blocks, monkeypatch, key):
    import compare

    monkeypatch.setattr(ordering, "HOT", 0)
    twin = contract.oracle_sql()[key]
    assert compare.compare(contract.queries()[key](spark, sf_dir), compare.duck(sf_dir), twin) == []
