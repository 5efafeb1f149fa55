"""Streams over several micro-batches equal their batch counterparts."""

import pytest
from pyspark.sql import functions as F

from attestry.operators import chain
from attestry.plans import stream_queries as q
from attestry.session import shared_dir
from attestry.streaming import jobs


@pytest.fixture(scope="module")
def sliced(spark, sf_dir):
    """events as four files in time order."""
    jobs.use_rocksdb(spark)
    path = shared_dir(spark, "slices")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cuts = events.agg(F.percentile("event_id", [0.25, 0.5, 0.75]).alias("c")).first()["c"]
    bounds = [-1, *cuts, float("inf")]
    for low, high in zip(bounds, bounds[1:]):
        part = events.where((F.col("event_id") > low) & (F.col("event_id") <= high))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def _same(one, two):
    assert one.columns == two.columns
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_revisions(spark, sf_dir, sliced):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = jobs.run_to_table(jobs.debounced_revisions(q._changes(jobs.table_stream(spark, sliced, 1)), 7200), "t")
    batch = jobs.debounced_revisions_batch(q._changes(events), 7200)
    assert batch.count() > 0
    _same(stream, batch)


def test_exports(spark, sf_dir, sliced):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = q._session_start()
    stream = jobs.run_to_table(jobs.stable_export(q._scans(jobs.table_stream(spark, sliced, 1)), start, 3600), "t")
    _same(stream, jobs.stable_export_batch(q._scans(events), start, 3600))


def test_project_sessions(spark, sf_dir, sliced):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = jobs.run_to_table(jobs.project_session_reuse(q._detections(jobs.table_stream(spark, sliced, 1))), "t")
    _same(stream, jobs.project_session_reuse_batch(q._detections(events)))


def test_evidence_log_equals_batch_chain(spark, sf_dir, sliced):
    """Events that are all allowed get the same chain as the batch build."""
    allowed = lambda df: q._submitted(df).withColumns(
        {"event_type": F.lit("work_saved"), "by_close": F.lit(False)}
    )
    stream = jobs.run_to_table(jobs.evidence_log_stream(allowed(jobs.table_stream(spark, sliced, 1))), "t")
    batch = chain.chain_build(allowed(spark.read.parquet(f"{sf_dir}/events.parquet")))
    columns = ["event_id", "sequence", "previous_event_hash", "evidence_hash"]
    assert stream.where("accepted").count() == batch.count()
    _same(stream.select(columns), batch.select(columns))


def test_refusals(spark):
    rows = [
        (1, "session_started"), (2, "session_started"), (3, "work_saved"), (4, "nonsense"),
        (5, "session_closed"), (6, "session_closed"), (7, "work_saved"),
    ]
    path = shared_dir(spark, "refusals")
    none = F.lit(None).cast("string")
    events = spark.createDataFrame(rows, "event_id bigint, event_type string").select(
        "event_id", "event_type", F.lit("s").alias("session_id"), F.lit("a").alias("asset_id"),
        *[F.timestamp_seconds(F.col("event_id")).alias(c) for c in ("occurred_at", "recorded_at")],
        *[none.alias(c) for c in ("source_type", "source_name", "creator_id", "privacy_mode", "location_level", "location_summary", "payload")],
        F.lit(None).cast("boolean").alias("ai_used"), (F.col("event_id") == 6).alias("by_close"),
    )
    events.coalesce(1).write.parquet(path)
    jobs.use_rocksdb(spark)
    out = jobs.run_to_table(jobs.evidence_log_stream(jobs.table_stream(spark, path, 1)), "t")
    got = {r["event_id"]: (r["reason"], r["sequence"]) for r in out.collect()}
    assert got == {
        1: (None, 1), 2: ("second_start", None), 3: (None, 2), 4: ("type_unknown", None),
        5: ("close_reserved", None), 6: (None, 3), 7: ("after_close", None),
    }


def test_registration_over_slices(spark, sf_dir):
    path = shared_dir(spark, "docs")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    again = documents.withColumn("doc_id", F.col("doc_id") + 1_000_000)
    documents.coalesce(1).write.mode("append").parquet(path)
    again.coalesce(1).write.mode("append").parquet(path)
    registry, responses = jobs.registration_stream(q._submissions(jobs.table_stream(spark, path, 1)), "doc_id", "t")
    distinct = q._submissions(documents).select("asset_uid").distinct().count()
    assert registry.count() == distinct
    assert responses.where("doc_id >= 1000000 and not registration_reused").count() == 0
    assert responses.count() == 2 * documents.count()


def test_limits(spark):
    assert jobs.parsed_limit("7/minute", "20/minute") == (7, 60)
    assert jobs.parsed_limit("5/second", "20/minute") == (5, 1)
    assert jobs.parsed_limit("20 per 2 hours", "1/minute") == (20, 7200)
    for bad in (None, "", "x/minute", "7/parsec", "7"):
        assert jobs.parsed_limit(bad, "20/minute") == (20, 60)
    row = spark.range(1).select(
        jobs.limit_key(F.lit(" key "), F.lit("1.2.3.4")), jobs.limit_key(F.lit(" "), F.lit("1.2.3.4"))
    ).first()
    assert row[0].startswith("tenant-key:") and len(row[0]) == 35 and row[1] == "ip:1.2.3.4"


def test_open_windows_have_rows(spark, sf_dir, sliced):
    """Over several micro-batches every window, open ones too, has its last count."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    limits = q.LIMITS | {"error": jobs.Rate(1, 60), "signup": jobs.Rate(5, 86400)}
    counts = jobs.fixed_window_limit(q._calls(jobs.table_stream(spark, sliced, 1)), limits, q.WINDOW_S)
    stream = jobs.run_upserted(counts, "t", ["key", "route", "window_start"])
    batch = jobs.fixed_window_limit(q._calls(events), limits, q.WINDOW_S)
    _same(stream, batch)
    assert stream.agg(F.sum("requests")).first()[0] == events.count()


def test_registration_in_a_session_of_its_own(spark, sf_dir):
    import __spark_entry__ as contract

    fresh = spark.newSession()
    fresh.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = contract.queries()["idempotent_registration"](fresh, sf_dir)
    assert got.where("not registration_reused").count() == got.select("asset_uid").distinct().count() > 0


class _Calls:
    """A keyed state that counts what a processor asks of it."""

    def __init__(self, value=None):
        self.value, self.timers, self.calls = value, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


@pytest.mark.parametrize("changes", [10, 1000])
def test_debounce_calls_do_not_grow_with_the_changes(changes):
    """A key's changes inside a micro-batch ask its state a fixed number of times and give no empty frames."""
    import pandas as pd

    from attestry.streaming import processors

    state = _Calls()
    debounce = processors.Debounce(1_000_000)
    debounce.init(state)
    rows = pd.DataFrame(
        {"at": range(changes), "event_id": range(changes), "signature": ["ab"[i % 2] for i in range(changes)]}
    )
    assert list(debounce.handleInputRows((1,), iter([rows]), None)) == []
    assert state.calls == 3 and len(state.timers) == 1
    later = rows.assign(at=rows["at"] + 5_000_000)
    state.calls = 0
    out = list(debounce.handleInputRows((1,), iter([later]), None))
    assert [len(frame) for frame in out] == [1]
    assert state.calls == 4 and len(state.timers) == 1
