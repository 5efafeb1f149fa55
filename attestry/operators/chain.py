"""Session evidence chains: build, verify, complete, close and publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import digests, text
from attestry.operators import links, matching, ordering
from attestry.session import stored

SCHEMA_VERSION = "1.0"
# Session event types, public statuses, privacy modes.
EVENT_TYPES = [
    "session_started",
    "source_captured",
    "work_saved",
    "work_exported",
    "ai_tool_disclosed",
    "contributor_declared",
    "contributor_attested",
    "asset_registered",
    "session_closed",
]
CREATION_TYPES = ["source_captured", "work_saved", "work_exported"]
PUBLIC_STATUSES = ["complete", "incomplete", "integrity_failed"]
PRIVACY_MODES = ["private", "proof", "public"]

# Rows of one verification block; a longer session spans several blocks.
SEQUENCE_BLOCK = 65536


def evidence_body_digest() -> Column:
    """Digest of everything an event states except its place in the chain."""
    return digests.record_digest(
        {
            "event_id": F.col("event_id"),
            "session_id": F.col("session_id"),
            "asset_id": F.col("asset_id"),
            "event_type": F.col("event_type"),
            "occurred_at": text.iso_utc(F.col("occurred_at")),
            "recorded_at": text.iso_utc(F.col("recorded_at")),
            "source_type": F.col("source_type"),
            "source_name": F.col("source_name"),
            "creator_id": F.col("creator_id"),
            "ai_used": F.col("ai_used"),
            "privacy_mode": F.col("privacy_mode"),
            "location_level": F.col("location_level"),
            "location_summary": F.col("location_summary"),
            "payload": F.col("payload"),
            "schema_version": F.lit(SCHEMA_VERSION),
        }
    )


def link_hash(previous: Column, sequence: Column, body_digest: Column) -> Column:
    parts = F.concat_ws(":", F.coalesce(previous, F.lit("")), sequence.cast("string"), body_digest)
    return F.sha2(parts, 256)


def number_events(events: DataFrame) -> DataFrame:
    return ordering.with_position(
        events,
        ["session_id"],
        ordering.hour_of("recorded_at"),
        [F.col("recorded_at"), F.col("event_id")],
        "sequence",
    )


def chain_build(events: DataFrame) -> DataFrame:
    """Sequence, previous hash and evidence hash for whole sessions.

    A hash chain is sequential per session.  The wide part (canonical JSON and
    its digest) runs in parallel over all rows; only (session, sequence, digest)
    rows are sorted and streamed past one carried hash, never gathered into an
    array, so the length of a session is bounded by sorting space alone.
    """
    if "sequence" not in events.columns:
        events = number_events(events)
    hashed = (
        events.select("event_id", "session_id", "sequence", evidence_body_digest().alias("body_digest"))
        .repartition("session_id")
        .sortWithinPartitions("session_id", "sequence")
        .mapInPandas(
            links.fold, "event_id bigint, previous_event_hash string, evidence_hash string"
        )
    )
    # hashes meet their events as bytes, half as long
    hashes = ("previous_event_hash", "evidence_hash")
    joined = events.join(hashed.select("event_id", *[F.unhex(c).alias(c) for c in hashes]), "event_id")
    return joined.withColumns({c: F.lower(F.hex(c)) for c in hashes})


def chain_failures(events: DataFrame) -> DataFrame:
    """Every stored event with the list of its chain failures.

    Links are checked against the stored hash before them, so rows are
    independent and a session can be split into blocks of sequence numbers.
    """
    block = F.floor((F.col("sequence") - 1) / SEQUENCE_BLOCK)
    recomputed = link_hash(F.col("previous_event_hash"), F.col("sequence"), evidence_body_digest())
    # told before the rows are dealt, so that they need not carry what they state
    checked = ordering.ordered(
        events.withColumn("__changed", recomputed != F.col("evidence_hash")),
        ["session_id"],
        block,
        [F.col("sequence"), F.col("event_id")],
        position="expected_sequence",
        previous={"stored_previous": F.col("evidence_hash")},
    )
    reasons = F.array(
        F.when(F.col("sequence") != F.col("expected_sequence"), F.lit("sequence_gap")),
        F.when(
            ~F.col("previous_event_hash").eqNullSafe(F.col("stored_previous")),
            F.lit("previous_hash_mismatch"),
        ),
        F.when(F.col("__changed"), F.lit("evidence_hash_mismatch")),
    )
    return checked.withColumn("failures", F.filter(reasons, lambda r: r.isNotNull())).drop(
        "expected_sequence", "stored_previous", "__changed"
    )


def chain_verify(events: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(failure rows, one summary per session)."""
    return verdicts(chain_failures(events), sessions)


def verdicts(checked: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from events with their ``failures``."""
    per_event = checked.select(
        "session_id", "event_id", F.explode("failures").alias("reason")
    )
    summary = _chain_summary(checked, sessions)
    heads = summary.where("head_mismatch").select(
        "session_id",
        F.col("head_event_id").alias("event_id"),
        F.lit("session_head_mismatch").alias("reason"),
    )
    return per_event.unionByName(heads), summary.drop("head_event_id")


def _chain_summary(checked: DataFrame, sessions: DataFrame) -> DataFrame:
    per_session = checked.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.size("failures")).alias("event_failures"),
        F.max_by(F.struct("event_id", "evidence_hash"), F.struct("sequence", "event_id")).alias("head"),
    )
    joined = sessions.select("session_id", "current_hash").join(per_session, "session_id", "left")
    mismatch = F.col("head").isNotNull() & ~F.col("current_hash").eqNullSafe(F.col("head.evidence_hash"))
    failures = F.coalesce("event_failures", F.lit(0)) + F.when(mismatch, 1).otherwise(0)
    return joined.select(
        "session_id",
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.col("head.evidence_hash").alias("head_hash"),
        F.col("head.event_id").alias("head_event_id"),
        mismatch.alias("head_mismatch"),
        F.coalesce("event_failures", F.lit(0)).alias("event_failures"),
        failures.alias("failure_count"),
        (failures == 0).alias("valid"),
    )


def completion_check(events: DataFrame, chain: DataFrame) -> DataFrame:
    """Missing parts per session, in fixed order."""
    seen = events.groupBy("session_id").agg(
        F.min_by("event_type", F.struct("sequence", "event_id")).alias("first_type"),
        F.bool_or(F.col("event_type").isin(CREATION_TYPES)).alias("has_creation"),
        F.bool_or(F.col("event_type") == "ai_tool_disclosed").alias("has_disclosure"),
        F.bool_or(F.col("event_type") == "asset_registered").alias("has_asset"),
    )
    absent = lambda col: ~F.coalesce(col, F.lit(False))
    missing = F.array(
        F.when(absent(F.col("first_type") == "session_started"), F.lit("session_started")),
        F.when(absent(F.col("has_creation")), F.lit("creation_evidence")),
        F.when(absent(F.col("has_disclosure")), F.lit("ai_disclosure")),
        F.when(absent(F.col("has_asset")), F.lit("asset_registered")),
        F.when(~F.col("valid"), F.lit("valid_evidence_chain")),
    )
    return (
        chain.join(seen, "session_id", "left")
        .withColumn("missing", F.filter(missing, lambda m: m.isNotNull()))
        .withColumn("eligible", F.size("missing") == 0)
        .select("session_id", "eligible", "missing", "valid", "event_count", "head_hash", "event_failures")
    )


def session_close(sessions: DataFrame, events: DataFrame, closed_at: Column) -> tuple[DataFrame, DataFrame]:
    """Close every recording session: (updated sessions, closing events).

    The closing event becomes the new head, so a wrong stored head leaves the
    session incomplete, while a broken event leaves it integrity_failed.
    """
    open_sessions = sessions.where("status = 'recording'")
    open_events = events.join(open_sessions.select("session_id"), "session_id", "left_semi")
    _, chain = chain_verify(open_events, open_sessions)
    checked = completion_check(open_events, chain)
    quoted = F.transform("missing", lambda m: F.concat(F.lit('"'), m, F.lit('"')))
    payload = F.concat(
        F.lit('{"eligible_for_complete":'),
        F.col("eligible").cast("string"),
        F.lit(',"missing":['),
        F.array_join(quoted, ","),
        F.lit("]}"),
    )
    closing = (
        open_sessions.withColumn("at", closed_at)
        .join(checked, "session_id")
        .select(
            F.xxhash64("session_id", F.lit("close")).alias("event_id"),
            "session_id",
            "tenant_id",
            "asset_id",
            (F.col("event_count") + 1).cast("int").alias("sequence"),
            F.lit("session_closed").alias("event_type"),
            F.col("at").alias("occurred_at"),
            F.col("at").alias("recorded_at"),
            F.lit("web").alias("source_type"),
            F.lit(None).cast("string").alias("source_name"),
            F.lit(None).cast("string").alias("creator_id"),
            F.lit(None).cast("boolean").alias("ai_used"),
            F.lit(None).cast("string").alias("privacy_mode"),
            F.lit(None).cast("string").alias("location_level"),
            F.lit(None).cast("string").alias("location_summary"),
            payload.alias("payload"),
            F.col("head_hash").alias("previous_event_hash"),
            "eligible",
            "missing",
            "event_failures",
        )
        .withColumn("evidence_hash", link_hash(F.col("previous_event_hash"), F.col("sequence"), evidence_body_digest()))
    )
    status = (
        F.when(F.col("event_failures") > 0, "integrity_failed")
        .when(F.col("eligible"), "complete")
        .otherwise("incomplete")
    )
    closed = closing.select(
        "session_id",
        status.alias("status"),
        F.col("evidence_hash").alias("current_hash"),
        F.col("recorded_at").alias("closed_at"),
        "missing",
    )
    return closed, closing.drop("eligible", "missing", "event_failures")


def safe_location(level: Column, summary: Column) -> Column:
    """Public form of a location: precise ones are hidden, coarse keep a summary."""
    return (
        F.when(level == "precise_private", F.struct(level.alias("level"), F.lit("private").alias("public_summary")))
        .when(level == "coarse", F.struct(level.alias("level"), F.nullif(summary, F.lit("")).alias("public_summary")))
    )


def public_event_facts(events: DataFrame) -> DataFrame:
    """Per session: resolved privacy mode, first location, last AI disclosure."""
    at = F.struct("sequence", "event_id")
    only = lambda cond, col: F.when(cond, col)
    started = F.col("event_type") == "session_started"
    located = F.col("location_level").isin("coarse", "precise_private")
    disclosed = F.col("event_type") == "ai_tool_disclosed"
    mode = F.col("start.privacy_mode")
    return (
        events.groupBy("session_id")
        .agg(
            F.min_by(F.struct("privacy_mode"), only(started, at)).alias("start"),
            F.min_by(F.struct("location_level", "location_summary"), only(located, at)).alias("place"),
            F.max_by(F.struct("ai_used"), only(disclosed, at)).alias("disclosure"),
        )
        .select(
            "session_id",
            F.when(mode.isin(PRIVACY_MODES), mode).otherwise(F.lit("proof")).alias("privacy_mode"),
            safe_location(F.col("place.location_level"), F.col("place.location_summary")).alias("location"),
            F.col("disclosure.ai_used").alias("ai_used"),
        )
    )


def latest_session(sessions: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Latest session per asset by closing time, then creation time."""
    if statuses is not None:
        sessions = sessions.where(F.col("status").isin(statuses))
    return ordering.first_per_key(
        sessions,
        ["asset_id"],
        [F.col("closed_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("session_id")],
    )


def _publishable(latest: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions with their public facts, but those that were started as private."""
    return (
        latest.join(public_event_facts(events), "session_id", "left")
        .withColumn("privacy_mode", F.coalesce("privacy_mode", F.lit("proof")))
        .where("privacy_mode <> 'private'")
    )


def public_sessions(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """The sessions of ``public_session_summary`` where no chain has to be checked: hashes are not read."""
    latest = latest_session(sessions, PUBLIC_STATUSES)
    return _publishable(latest, matching.likely_members(events, "session_id", latest))


def public_session_summary(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Public-safe state of the latest public session of every asset.

    A session started as private yields no row.
    """
    latest = latest_session(sessions, PUBLIC_STATUSES)
    # events of other sessions that stay meet no session below
    own = matching.likely_members(events, "session_id", latest)
    _, chain = chain_verify(own, latest)
    return _publishable(latest.join(chain.select("session_id", "event_count", "valid"), "session_id"), own).select(
        "asset_id",
        "session_id",
        "status",
        "privacy_mode",
        "event_count",
        F.col("valid").alias("chain_valid"),
        text.iso_utc(F.col("started_at")).alias("started_at"),
        text.iso_utc(F.col("closed_at")).alias("closed_at"),
        "ai_used",
        "location",
        F.lit(True).alias("asset_bound"),
    )


def public_event_redaction(events: DataFrame) -> DataFrame:
    """Timeline without payload, source name and creator; only safe locations."""
    level, summary = F.col("location_level"), F.col("location_summary")
    kept = safe_location(level, summary)
    return events.withColumn(
        "location",
        F.coalesce(kept, F.when(level.isNotNull(), F.struct(level.alias("level"), summary.alias("public_summary")))),
    ).drop("payload", "source_name", "creator_id", "location_level", "location_summary", "privacy_mode")


def public_record(
    sessions: DataFrame,
    events: DataFrame,
    workflow_events: DataFrame,
    publications: DataFrame,
    workflows: list[str],
) -> tuple[DataFrame, DataFrame]:
    """(one public record per asset, its redacted timeline rows).

    The record adds the evidence rollup to the session summary; optional
    fields show only where the creator opted in.  The summary is stored, as
    records, rollup and timeline read it.
    """
    from attestry.functions import disclosure
    from attestry.operators import aggregates

    summary = stored(public_session_summary(sessions, events), "public-sessions")
    shown = summary.select("session_id")
    rollup = aggregates.session_evidence_rollup(
        workflow_events.join(shown, "session_id", "left_semi"), workflows
    )
    settings = disclosure.opt_in_fields(publications).select(
        "session_id",
        F.array_intersect("fields", F.array(*[F.lit(f) for f in disclosure.PUBLIC_FIELDS])).alias("fields"),
    )
    nothing = F.array().cast("array<string>")
    record = (
        summary.join(rollup, "session_id", "left")
        .join(settings, "session_id", "left")
        .withColumn("fields", F.coalesce("fields", nothing))
        .select(
            "asset_id",
            "session_id",
            "status",
            "privacy_mode",
            "event_count",
            "chain_valid",
            "started_at",
            "closed_at",
            "ai_used",
            "location",
            F.col("fields").alias("published_fields"),
            "workflow",
            disclosure.published("production_environment", F.col("production_environment")).alias(
                "production_environment"
            ),
            "automatic_project_detected",
            "automatic_revisions",
            "automatic_exports",
            "contributor_declarations",
            "verified",
            disclosure.published("source_asset_uid", F.col("source_lineage.source_asset_uid")).alias("source_asset_uid"),
            F.col("source_lineage.history_preserved").alias("history_preserved"),
            F.coalesce("transformations", nothing).alias("transformations"),
            disclosure.published("transformation_statement", F.col("statement")).alias("statement"),
            "final_provenance_disclosure",
        )
    )
    timeline = public_event_redaction(events).join(
        summary.select("session_id", F.col("asset_id").alias("bound")), "session_id"
    )
    return record, timeline.where(F.col("bound") == F.col("asset_id")).drop("bound")
