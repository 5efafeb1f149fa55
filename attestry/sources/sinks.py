"""Documents, exports and append-only logs as partitioned datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import detectors, digests, text
from attestry.operators import certificates, reports, timeline
from attestry.session import stored
from attestry.sources import commits


def manifest_json(assets: DataFrame) -> DataFrame:
    """(asset_id, tenant_id, body) manifests that carry their own hash."""
    fields = {
        name: F.col(name).cast("string")
        for name in (
            "asset_uid", "asset_id", "filename", "file_type", "sha256", "second_fingerprint", "phash",
            "content_label", "creator_name", "copyright_owner", "license_type", "ai_disclosure", "certificate_class",
        )
    }
    fields["manifest_version"] = F.lit("1.1")
    fields["created_at"] = text.iso_plain(F.col("created_at"))
    hashed = assets.withColumn("__hash", digests.record_digest(fields))
    body = digests.canonical_json(fields | {"manifest_hash": F.col("__hash")})
    return hashed.select("asset_id", "tenant_id", F.col("__hash").alias("document_hash"), body.alias("body"))


def certificate_documents(certs: DataFrame) -> DataFrame:
    body = certificates.certificate_json()
    return certs.select(
        "asset_id", "tenant_id", F.sha2(body, 256).alias("document_hash"), body.alias("body")
    )


DOCUMENT = "asset_id string, document_hash string, body string, tenant_id string, kind string"

def document_sink(documents: DataFrame, path: str, kind: str) -> None:
    """One JSON line per document, in folders by tenant.

    The documents of a kind are replaced by one commit, so the earlier ones stay
    readable until the new ones are whole.  Rebalancing gives files of even size
    and splits a hot tenant.
    """
    commits.commit(documents.hint("rebalance", "tenant_id"), path, f"kind={kind}", "json", ("tenant_id",))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Committed documents of all kinds."""
    return commits.committed(spark, path, DOCUMENT, "json")


def _valid(observations: DataFrame) -> DataFrame:
    return detectors.normalize_observations(observations, lower_provider=True).select(
        "observation_id", "asset_id", "tenant_id", "provider", "model", "signal", "probability", "status", "details", "observed_at"
    )


def append_observations(observations: DataFrame, path: str, run: str) -> None:
    """Append valid observations of one run; earlier runs are never touched.

    A replayed run commits its rows anew, and readers see the last commit of
    each run, so it adds nothing; a run lost half-way is not seen at all.
    """
    commits.commit(_valid(observations), path, f"run={run}")


def read_observations(observations: DataFrame, path: str) -> DataFrame:
    """Committed rows with their ``run``; ``observations`` gives the types of its columns."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in _valid(observations).schema]
    return commits.committed(observations.sparkSession, path, ", ".join([*fields, "run int"]))


def export_rows(assets: DataFrame, events: DataFrame, certs: DataFrame, contributors: DataFrame) -> DataFrame:
    """(artefact, asset_id, body) rows of the nine export artefacts.

    The six artefacts of one row for each asset are bodies of one joined row, opened
    at last, so what they share is computed once.  Histories and contributor lists
    are one row per entry, so an asset with a long history spreads over many rows
    instead of one document.
    """
    as_json = lambda *cols: F.to_json(F.struct(*cols))
    entries = lambda name, rows, *cols: rows.select(F.lit(name).alias("artefact"), "asset_id", as_json(*cols).alias("body"))
    known = assets.select("asset_id")
    report = reports.copyright_report(assets, events, certs, contributors)
    latest = certificates.latest_certificate(certs).select("asset_id", certificates.certificate_json().alias("latest"))
    manifest = manifest_json(assets).select("asset_id", F.col("body").alias("manifest"))
    rebuilt = assets.select("asset_id", F.col("manifest_path").isNull().alias("rebuilt"))
    readme = F.concat_ws(
        "\n",
        F.lit("rights summary"),
        F.concat(F.lit("asset_uid="), F.col("stored_facts.identity.asset_uid")),
        F.concat(F.lit("filename="), F.col("stored_facts.identity.filename")),
        F.concat(F.lit("owner="), F.coalesce("stored_facts.rights.copyright_owner", F.lit("undeclared"))),
        F.concat(F.lit("license="), F.coalesce("stored_facts.rights.license_type", F.lit("undeclared"))),
        F.lit("names of creators say nothing about ownership"),
    )
    stub = as_json(F.lit("certificate_missing").alias("error"), "asset_id")
    noted = as_json(F.lit("manifest_rebuilt").alias("note"), F.col("manifest").alias("body"))
    bodies = {
        "readme": readme,
        "stored_facts": as_json("stored_facts"),
        "certificate": F.coalesce("latest", stub),
        "provenance_manifest": F.when(F.col("rebuilt"), noted).otherwise(F.col("manifest")),
        "timestamps": as_json("timestamps"),
        "authorship_summary": as_json("stored_facts.copyright_readiness", "disclosure_note", "provenance_continuity"),
    }
    artefacts = F.array(*[F.struct(F.lit(name).alias("artefact"), body.alias("body")) for name, body in bodies.items()])
    wide = report.join(latest, "asset_id", "left").join(manifest, "asset_id", "left").join(rebuilt, "asset_id", "left")
    opened = wide.select("asset_id", F.explode(artefacts).alias("one")).select("one.artefact", "asset_id", "one.body")
    lists = [
        entries(
            "contributor_declarations",
            reports.human_contributors(contributors.join(known, "asset_id", "left_semi")),
            "contributor_id", "name", "role", "declares",
        ),
        entries(
            "workflow_analysis",
            timeline.transformation_chain(assets, events),
            "section", "step", "step_type", "form", "label", "source",
        ),
        entries(
            "audit_history",
            timeline.lineage_steps(events.join(known, "asset_id", "left_semi")),
            "step", "event_id", "event_type", "description", "tool_used", "actor_name", "human_or_ai", "event_hash",
        ),
    ]
    return reduce(DataFrame.unionByName, lists, opened)


EXPORT = "asset_id string, body string, artefact string"


def export_all(rows: DataFrame, path: str, files: int | None = None) -> None:
    """All artefacts by one write, in folders by artefact, ranged and sorted by asset.

    The rows are stored before they are ranged, as ranging samples its input and
    would evaluate it twice.  An export is one commit: a reader sees the earlier
    one until this one is whole.
    """
    keys = [F.col("artefact"), F.col("asset_id"), F.xxhash64("body")]
    once = stored(rows, "export-rows")
    ranged = once.repartitionByRange(files, *keys) if files else once.repartitionByRange(*keys)
    commits.commit(ranged.sortWithinPartitions("artefact", "asset_id"), path, "export=all", by=("artefact",))


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """(artefact, asset_id, body) rows of the last whole export."""
    return commits.committed(spark, path, EXPORT).select("artefact", "asset_id", "body")


def evidence_export(artefacts: dict[str, DataFrame], path: str, files: int | None = None) -> None:
    """One Parquet dataset per artefact, ranged and sorted by asset.

    A folder per asset would not survive a large registry.  Files hold ranges of
    ids and row groups are sorted, so their statistics lead a reader to one
    asset.  ``files`` sets the number of ranges; an asset with a long history
    spreads over several, as rows are ranged by asset and content.
    """
    for name, rows in artefacts.items():
        keys = [F.col("asset_id"), F.xxhash64("body")]
        ranged = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
        ranged.sortWithinPartitions("asset_id").write.mode("overwrite").parquet(f"{path}/{name}")


def read_export(spark, path: str, names: list[str]) -> DataFrame:
    """(artefact, asset_id, body) rows of a written export."""
    schema = "asset_id string, body string"
    parts = [spark.read.schema(schema).parquet(f"{path}/{n}").select(F.lit(n).alias("artefact"), "asset_id", "body") for n in names]
    return reduce(DataFrame.unionByName, parts)
