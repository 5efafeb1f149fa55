"""Sources, sinks and maintenance on small fixtures."""

import hashlib

import pytest
from pyspark.sql import functions as F

from attestry import schemas
from attestry.plans.views import Views
from attestry.session import shared_dir
from attestry.sources import files, registry, sinks


def test_size_limit_is_inclusive(spark, tmp_path):
    limit = 1024 * 1024
    for name, size in (("at", limit), ("over", limit + 1), ("small", 3)):
        (tmp_path / name).write_bytes(b"x" * size)
    accepted, rejected = files.bounded_binary_scan(spark, str(tmp_path), max_mb=1)
    got = {r["name"]: r["sha256"] for r in accepted.collect()}
    assert got == {n: hashlib.sha256(b"x" * s).hexdigest() for n, s in (("at", limit), ("small", 3))}
    assert [r["name"] for r in rejected.collect()] == ["over"]
    with pytest.raises(ValueError):
        files.bounded_binary_scan(spark, str(tmp_path), max_mb=0)


def test_scan_of_the_tables_equals_the_files(spark, sf_dir):
    from pathlib import Path

    accepted, _ = files.bounded_binary_scan(spark, sf_dir, max_mb=50, pattern="*.parquet")
    want = {p.name: (p.stat().st_size, hashlib.md5(p.read_bytes()).hexdigest()) for p in Path(sf_dir).glob("*.parquet")}
    assert {r["name"]: (r["length"], r["md5"]) for r in accepted.collect()} == want


def test_shared_dir_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = shared_dir(spark, "x")
    assert path != shared_dir(spark, "x")
    assert not root or path.startswith(root)


def test_thirteen_tables_have_keys():
    assert len(schemas.TABLE_NAMES) == 13
    for table in schemas.TABLE_NAMES:
        assert set(schemas.required_columns(table)) <= set(schemas.table_schema(table).fieldNames())


def test_tenant_partitions_are_pruned(spark, sf_dir):
    root = shared_dir(spark, "registry")
    registry.registry_write(Views(spark, sf_dir).assets, root, "assets")
    scan = registry.registry_scan(spark, root, "assets")[0].where("tenant_id = 'src3'").select("asset_id", "tenant_id")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "ReadSchema: struct<asset_uid:string,asset_id:string,sha256:string>" in plan


def test_replayed_run_appends_nothing(spark, sf_dir):
    path, rows = shared_dir(spark, "obs"), Views(spark, sf_dir).observations
    sinks.append_observations(rows, path, "1")
    once = sinks.read_observations(rows, path).count()
    sinks.append_observations(rows, path, "1")
    assert sinks.read_observations(rows, path).count() == once > 0
    sinks.append_observations(rows, path, "2")
    assert sinks.read_observations(rows, path).count() == 2 * once


def test_a_run_lost_half_way_leaves_earlier_rows(spark, sf_dir):
    path, rows = shared_dir(spark, "obs"), Views(spark, sf_dir).observations
    assert sinks.read_observations(rows, path).count() == 0
    sinks.append_observations(rows, path, "1")
    before = sinks.read_observations(rows, path)
    once = before.count()
    broken = rows.withColumn("asset_id", F.when(F.col("observation_id") > 100, F.raise_error(F.lit("lost"))).otherwise(F.col("asset_id")))
    for run in ("1", "2"):
        with pytest.raises(Exception, match="lost"):
            sinks.append_observations(broken, path, run)
    after = sinks.read_observations(rows, path)
    assert after.count() == once and after.exceptAll(before).count() == 0


def test_documents_stay_until_new_ones_are_whole(spark):
    path = shared_dir(spark, "documents")
    old = spark.createDataFrame([("a", "t", "h1", "{}"), ("b", None, "h2", "{}")], "asset_id string, tenant_id string, document_hash string, body string")
    sinks.document_sink(old, path, "manifests")
    broken = old.withColumn("body", F.when(F.col("asset_id") == "b", F.raise_error(F.lit("lost"))).otherwise("{}"))
    with pytest.raises(Exception, match="lost"):
        sinks.document_sink(broken, path, "manifests")
    assert {r.document_hash for r in sinks.read_documents(spark, path).collect()} == {"h1", "h2"}
    sinks.document_sink(old.limit(0), path, "certificates")
    sinks.document_sink(old.withColumn("document_hash", F.lit("h3")).limit(1), path, "manifests")
    assert [(r.kind, r.document_hash) for r in sinks.read_documents(spark, path).collect()] == [("manifests", "h3")]


UPSERT = "asset_id string, asset_uid string, tenant_id string, version int"


def _upsert(spark, target, updates):
    out = registry.keyed_upsert(
        spark.createDataFrame(target, UPSERT),
        spark.createDataFrame(updates, UPSERT),
        "asset_id",
        ["asset_uid", "tenant_id"],
        [F.col("version")],
    )
    return sorted(tuple(r) for r in out.collect())


def test_upsert_rules(spark):
    target = [("a1", "u1", "t", 0), ("a2", "u2", "t", 0), ("a3", "u3", "t", 0)]
    # by key, by identity with a moved key, insert
    assert _upsert(spark, target, [("a1", "u1", "t", 1), ("b2", "u2", "t", 1), ("c", "u9", "t", 1)]) == [
        ("a1", "u1", "t", 1), ("a3", "u3", "t", 0), ("b2", "u2", "t", 1), ("c", "u9", "t", 1),
    ]
    # the key match wins over an identity match elsewhere
    assert _upsert(spark, target, [("a1", "u2", "t", 1)]) == [("a1", "u2", "t", 1), ("a2", "u2", "t", 0), ("a3", "u3", "t", 0)]
    # records without an identity never match each other
    assert len(_upsert(spark, target, [("n1", None, "t", 1), ("n2", None, "t", 1)])) == 5


def test_upserts_follow_moved_keys(spark):
    assert _upsert(spark, [("k1", "a0", "t", 0)], [("k1", "a1", "t", 1), ("k2", "a1", "t", 2)]) == [("k2", "a1", "t", 2)]
    # the moved key is gone, so a later update of it is a record of its own
    moved = [("k1", "a1", "t", 1), ("k2", "a1", "t", 2), ("k1", "a3", "t", 3)]
    assert _upsert(spark, [("k1", "a0", "t", 0)], moved) == [("k1", "a3", "t", 3), ("k2", "a1", "t", 2)]


def test_upsert_with_one_alternative_key(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id string, asset_id string, version int")
    out = registry.keyed_upsert(
        rows(("p1", "a", 0), ("p2", "b", 0)), rows(("p9", "a", 1), ("p3", None, 1)), "id", ["asset_id"], [F.col("version")]
    )
    assert sorted(map(tuple, out.collect()), key=str) == [("p2", "b", 0), ("p3", None, 1), ("p9", "a", 1)]


def test_upsert_is_idempotent(spark):
    target, updates = [("a1", "u1", "t", 0)], [("b1", "u1", "t", 1)]
    once = _upsert(spark, target, updates)
    assert _upsert(spark, once, updates) == once


def test_gate_and_decode(spark):
    df = spark.createDataFrame([('{"k":1}',), ("[1]",), ("",), ("{x",), (None,), ("3",)], "body string")
    ok, rejected = files.json_object_gate(df, "body")
    assert ok.count() == 3
    assert sorted(r["reason"] for r in rejected.collect()) == ["not_an_object", "not_an_object", "not_json"]
    lists = files.json_column_decode(df, "body", "array<int>", F.array().cast("array<int>"))
    assert sorted(len(r["body"]) for r in lists.collect()) == [0, 0, 0, 0, 0, 1]


def test_backfill_without_the_default_tenant_changes_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", " "), ("c", "t")], "asset_id string, tenant_id string")
    tenants = spark.createDataFrame([("t",)], "tenant_id string")
    out = registry.schema_evolve(df, schemas.table_schema("assets"), "demo", tenants)
    assert [r["tenant_id"] for r in out.orderBy("asset_id").collect()] == [None, " ", "t"]
    out = registry.schema_evolve(df, schemas.table_schema("assets"), "t", tenants)
    assert [r["tenant_id"] for r in out.orderBy("asset_id").collect()] == ["t", "t", "t"]


def test_export_is_ranged_by_asset(spark):
    rows = spark.range(2000).select(F.format_string("as-%05d", "id").alias("asset_id"), F.sha2(F.col("id").cast("string"), 256).alias("body"))
    path = shared_dir(spark, "export")
    sinks.evidence_export({"history": rows}, path, files=4)
    back = spark.read.parquet(f"{path}/history").withColumn("file", F.input_file_name())
    spans = sorted(tuple(r) for r in back.groupBy("file").agg(F.min("asset_id"), F.max("asset_id")).drop("file").collect())
    assert len(spans) == 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert sinks.read_export(spark, path, ["history"]).count() == 2000


def test_whole_export_is_one_commit(spark, sf_dir):
    v, path = Views(spark, sf_dir), shared_dir(spark, "export")
    rows = sinks.export_rows(v.assets, v.provenance_events, v.certificates, v.stored_split_rows)
    assert sinks.read_all(spark, path).count() == 0
    sinks.export_all(rows, path, files=6)
    back = sinks.read_all(spark, path)
    n = back.count()
    assert {r.artefact for r in back.select("artefact").distinct().collect()} == {
        "readme", "stored_facts", "certificate", "provenance_manifest", "timestamps", "authorship_summary",
        "contributor_declarations", "workflow_analysis", "audit_history",
    }
    per_asset = back.where("artefact in ('readme', 'certificate', 'provenance_manifest')").groupBy("asset_id").count()
    assert per_asset.where("count <> 3").count() == 0 and per_asset.count() == v.assets.count()
    # no artefact's folder is written by more tasks than there are ranges, and ranges do not overlap
    files = back.where("artefact = 'audit_history'").withColumn("file", F.input_file_name())
    spans = sorted(tuple(r) for r in files.groupBy("file").agg(F.min("asset_id"), F.max("asset_id")).drop("file").collect())
    assert len(spans) <= 6 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    broken = spark.range(50).select(
        F.lit("readme").alias("artefact"),
        F.col("id").cast("string").alias("asset_id"),
        F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise("{}").alias("body"),
    )
    with pytest.raises(Exception, match="lost"):
        sinks.export_all(broken, path)
    assert sinks.read_all(spark, path).count() == n


RECORD = "id string, uid string, tenant string, doc long, version int, at long"


def plain_upsert(target, updates):
    """One update after the other over a dictionary."""
    records = {r[0]: r for r in target}
    for row in sorted(updates, key=lambda r: r[5]):
        key, alt = row[0], row[1:3]
        if key not in records and None not in alt:
            holders = sorted(k for k, r in records.items() if r[1:3] == alt)
            if holders:
                del records[holders[0]]
        records[key] = row
    return sorted(records.values(), key=repr)


def upserted(spark, target, updates):
    frame = lambda rows: spark.createDataFrame(rows, RECORD).repartition(4)
    got = registry.keyed_upsert(frame(target), frame(updates), "id", ["uid", "tenant"], [F.col("at")])
    return sorted(map(tuple, got.collect()), key=repr)


def test_a_hot_alternative_key_and_moved_keys(spark):
    target = [(f"r{i}", f"u{i}" if i % 7 else None, "t", i, 1, 0) for i in range(300)]
    target += [(f"twin{i}", "same", "t", i, 1, 0) for i in range(5)]
    hot = [(f"hot{i}", "same", "t", i, 2, 3 * i) for i in range(500)]
    chain = [(f"move{i}", f"u{i // 2}", "t", i, 2, 3 * i + 1) for i in range(500)]
    # each of these takes the key of the record before and its own alternative key
    chain += [(f"step{(i + 1) // 2}", f"link{i // 2}", "t", i, 2, 3 * i + 2) for i in range(500)]
    assert upserted(spark, target, hot + chain) == plain_upsert(target, hot + chain)


def test_untouched_rows_are_not_linked(spark, monkeypatch):
    linked, seen = registry.connected.components, []
    monkeypatch.setattr(registry.connected, "components", lambda edges: seen.append(edges.count()) or linked(edges))
    target = [(f"r{i}", f"u{i}", "t", i, 1, 0) for i in range(1000)]
    updates = [("r5", "u6", "t", 0, 2, 1), ("new", "u9", "t", 0, 2, 2), ("other", "z", "t", 0, 2, 3)]
    assert upserted(spark, target, updates) == plain_upsert(target, updates)
    # r5 holds two alternative keys; all others are one set by theirs
    assert seen == [1]
    assert upserted(spark, [], updates) == plain_upsert([], updates)
    assert upserted(spark, target, []) == plain_upsert(target, [])


def test_a_set_keeps_its_live_records_only(spark):
    """Batches of one set: what is carried does not grow with its updates."""
    import pyarrow as pa

    from attestry.sources import merges

    held = []

    def batches():
        for b in range(200):
            n = 500
            ids = [f"k{b * n + i}" for i in range(n)]
            yield pa.RecordBatch.from_pydict(
                {"__root": ["r"] * n, "__update": [True] * n, "__alt": ["a"] * n, "id": ids, "v": list(range(n))}
            )
            held.append(pa.total_allocated_bytes())

    out = pa.Table.from_batches(list(merges.fold(["id", "v"], "id")(batches())))
    assert out.column("id").to_pylist() == ["k99999"]
    assert max(held[100:]) < 2 * max(held[:100])


def test_registry_tables_derive_split_rows_once(spark, sf_dir):
    from attestry.plans import io_queries
    from attestry.plans.views import Views

    views = Views(spark, sf_dir)
    assert io_queries._tables(views)["contributors"] is views.stored_split_rows
