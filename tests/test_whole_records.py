"""Queries whose result holds the whole documents or records, not sums over them."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from attestry import session
from attestry.operators import chain, graph, matching
from attestry.plans import score_queries
from attestry.plans.views import Views

EVENTS = 130


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three assets, one of them with many events; one order, part and customer of asset 1."""
    at = dt.datetime(2024, 1, 1)
    rows = {
        "documents": ("doc_id long, text string, lang string, source string, n_chars long", [(i, f"text {i}", "en", "s", 6) for i in (1, 2, 3)]),
        "events": (
            "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
            [
                (e, at + dt.timedelta(minutes=e), 1 if e < EVENTS else 2 + e % 2, ["view", "purchase"][e % 2], 5.0, '{"k": %d}' % e)
                for e in range(EVENTS + 4)
            ],
        ),
        "customer": ("c_custkey long, c_name string, c_nationkey int", [(1, "Ann", 4)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string", [(1, 1, at, "1-URGENT")]),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz",
            [(1, 5, 7, 1, 1.0, 30.0, 0.1, 0.0, "R", at), (1, 6, 8, 2, 1.0, 70.0, 0.0, 0.0, "N", at)],
        ),
        "part": ("p_partkey long, p_name string, p_brand string, p_size int", [(1, "thing", "brand", 3)]),
    }
    path = tmp_path_factory.mktemp("tables")
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_graph_documents_hold_their_nodes_and_edges(spark, tables):
    documents = contract.queries()["graph_document"](spark, tables).collect()
    assert all(r.root_node_id == f"asset:{r.asset_id}" and 0 <= r.part < r.parts for r in documents)
    nodes = [(r.asset_id, r.part, n) for r in documents for n in json.loads(r.nodes)]
    edges = [(r.asset_id, r.part, e) for r in documents for e in json.loads(r.edges)]
    wanted = contract.queries()["evidence_nodes"](spark, tables).collect()
    assert sorted((a, n["id"], n["type"], n["evidence_class"]) for a, _, n in nodes) == sorted((r[0], r[1], r[2], r[3]) for r in wanted)
    wanted = contract.queries()["evidence_edges"](spark, tables).collect()
    assert sorted((a, e["source"], e["target"], e["relation"]) for a, _, e in edges) == sorted(tuple(r) for r in wanted)
    # the edge of a node to its asset lies beside it
    place = {(a, n["id"]): part for a, part, n in nodes}
    assert all(place[a, e["source"]] == part for a, part, e in edges if e["target"] == f"asset:{a}")
    data = {n["id"]: json.loads(n["data"]) for _, _, n in nodes}
    assert data["asset:as-2"]["sha256"] == hashlib.sha256(b"text 2").hexdigest()
    assert data["provenance:5"]["timestamp"] == "2024-01-01T00:05:00.000000Z"
    assert [c["name"] for c in data["rights-record:live-split:LS-1-0"]["contributors"]] == ["Supplier 7", "  SUPPLIER 8 "]
    counts = {r.asset_id: json.loads(r.evidence_counts) for r in documents}
    assert counts["as-1"]["provenance"] == EVENTS and sum(sum(c.values()) for c in counts.values()) == len(nodes)


def test_public_records_come_with_their_timeline(spark, tables):
    rows = contract.queries()["public_record"](spark, tables).collect()
    records = [r for r in rows if r.kind == "record"]
    events = [r for r in rows if r.kind == "event"]
    # session 1 is a proof, 2 a public one; 3 keeps its own mode
    assert {r.session_id for r in records} == {"S-1", "S-2", "S-3"} and all(r.started_at and r.closed_at for r in records)
    assert {r.session_id: r.event_count for r in records} == {s: sum(e.session_id == s for e in events) for s in ("S-1", "S-2", "S-3")}
    first = [e for e in events if e.session_id == "S-1" and e.sequence == 1]
    assert [(e.event_id, e.event_type, e.occurred_at) for e in first] == [(0, "session_started", "2024-01-01T00:00:00.000000Z")]
    # only the place that may be shown, and the links of the chain
    assert [(e.location_level, e.location_summary, len(e.evidence_hash)) for e in first] == [("coarse", None, 64)]
    assert not {"payload", "source_name", "creator_id"} & set(rows[0].asDict())


def test_graph_documents_store_no_nodes(spark, tables, monkeypatch):
    """Nodes are counted and written, not stored in between; events of unknown assets build no chain."""
    made = []
    monkeypatch.setattr(graph, "stored", lambda df, purpose: made.append((purpose, df.columns)) or session.stored(df, purpose))
    monkeypatch.setattr(score_queries, "stored", graph.stored)
    views = Views(spark, tables)
    assert score_queries._graph_document(views).count() > 0
    assert made and not any({"node", "data"} & set(columns) for _, columns in made)
    assert "known_session_chain" in views.__dict__ and not {"session_chain", "stored_session_inputs"} & set(views.__dict__)


def test_sessions_of_known_assets(spark, sf_dir):
    views = Views(spark, sf_dir)
    known = views.assets.where("doc_id < 5").select("asset_id")
    some = Views(spark, sf_dir)
    some.__dict__["assets"] = some.assets.where("doc_id < 5")
    wanted = chain.public_session_summary(views.sessions, views.session_events).join(known, "asset_id", "left_semi")
    got = chain.public_session_summary(some.known_sessions, some.known_session_events).join(known, "asset_id", "left_semi")
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.select(got.columns).collect()))
    assert 0 < wanted.count() and some.known_session_chain.count() < views.session_chain.count()


def test_likely_members_lose_none(spark):
    rows = spark.range(20_000).selectExpr("if(id % 7 = 0, null, concat('k', id)) as key", "id")
    known = rows.where("id % 10 = 3").select("key")
    kept = matching.likely_members(rows, "key", known)
    assert known.join(kept, "key", "left_anti").where("key is not null").count() == 0
    assert kept.columns == rows.columns and kept.count() < 4_000
    assert matching.likely_members(rows, "key", known.limit(0)).count() == 0


def test_large_assets_get_several_parts(spark, tables):
    """Parts follow nodes and their edges together, as where both are given."""
    views = Views(spark, tables)
    rows = graph.registry_documents(score_queries._registry(views), per_part=20).select("asset_id", "parts", F.size("nodes").alias("n"), F.size("edges").alias("e")).collect()
    for asset in {r.asset_id for r in rows}:
        own = [r for r in rows if r.asset_id == asset]
        assert {r.parts for r in own} == {-(-sum(r.n + r.e for r in own) // 20)}
    assert max(r.n + r.e for r in rows) < 60
