"""Work for known assets leaves the rest of the registry out before its ordered passes."""

import pytest
from pyspark.sql import functions as F

from attestry.operators import chain, matching
from attestry.plans import score_queries
from attestry.plans.views import Views


def _same(one, two):
    assert one.columns == two.columns
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_known_split_rows(spark, sf_dir):
    """The same rows as those filtered after the ordered pass."""
    views = Views(spark, sf_dir)
    later = views.split_rows.join(views.assets.select("asset_id"), "asset_id", "left_semi")
    _same(views.known_split_rows, later.select(views.known_split_rows.columns))
    assert 0 < views.known_split_rows.count() < views.split_rows.count()


@pytest.mark.parametrize("query", ["_evidence_edges", "_evidence_class_counts"])
def test_ids_need_no_chain(spark, sf_dir, query):
    """Neither the hash chains nor the split rows of unknown assets are made."""
    views = Views(spark, sf_dir)
    assert getattr(score_queries, query)(views).columns
    assert not {"session_chain", "stored_split_rows"} & set(views.__dict__)


@pytest.mark.parametrize("query", ["_certificate_fact_diff", "_integrity_report", "_evidence_nodes"])
def test_known_sheets_only(spark, sf_dir, query):
    views = Views(spark, sf_dir)
    assert getattr(score_queries, query)(views).columns
    assert "stored_split_rows" not in views.__dict__


def test_unchecked_sessions(spark, sf_dir):
    """The sessions of the summary, whose chains are checked."""
    views = Views(spark, sf_dir)
    plain = chain.public_sessions(views.unlinked_sessions, views.unlinked_events)
    checked = chain.public_session_summary(views.sessions, views.session_events)
    some = ["asset_id", "session_id", "status", "privacy_mode", "ai_used"]
    assert plain.count() > 0
    _same(plain.select(some), checked.select(some))


def test_names_are_matched_without_sorted_aggregates(spark):
    contributors = spark.createDataFrame(
        [("a", "1", "Ann"), ("a", "2", " ANN "), ("a", "3", "Bob"), ("b", "4", "Cid"), (None, "5", "Eve")],
        "asset_id string, contributor_id string, name string",
    )
    sheets = spark.createDataFrame(
        [("a", 7, "ann"), ("a", 7, "Ann"), ("a", 8, "Dan"), ("b", 9, "  "), (None, 9, "eve")],
        "asset_id string, sheet_id long, sheet_name string",
    )
    out = matching.name_match_join(contributors, sheets)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert {tuple(r) for r in out.collect()} == {
        ("a", "ann", "contributor", "1"), ("a", "ann", "contributor", "2"), ("a", "ann", "sheet", "7"),
    }
    assert out.where(F.col("name_key").isNull()).count() == 0
