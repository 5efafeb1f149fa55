"""Record-to-record checks, tamper audits, batch verification, expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import digests, text
from attestry.operators import certificates, ordering

FLOAT_TOLERANCE = 0.0001


def _differs(expected: Column, observed: Column, number: bool = False) -> Column:
    if not number:
        return ~expected.eqNullSafe(observed)
    near = F.abs(expected - observed) <= FLOAT_TOLERANCE
    return ~F.coalesce(near, expected.isNull() & observed.isNull())


def _mismatches(checks: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda m: m.isNotNull())


def _status(present: Column, mismatches: str) -> Column:
    return F.when(~present, "unavailable").when(F.size(mismatches) > 0, "fail").otherwise("pass")


def split_differences(stored: DataFrame, certified: DataFrame) -> DataFrame:
    """Assets whose stored and certified splits are not the same multiset.

    Each distinct split row counts +1 on one side and -1 on the other; sums are
    combined before the shuffle, so neither side is ever gathered or paired.
    """
    fields = ["owner_name", "role", "ownership_split_pct", "creative_contribution_pct", "ai_assisted_pct"]

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(
            "asset_id",
            text.clean_text(F.col("owner_name")).alias("owner_name"),
            text.clean_text(F.col("role")).alias("role"),
            *[text.zero_safe_percentage(F.col(f)).alias(f) for f in fields[2:]],
            F.lit(sign).alias("sign"),
        )

    return (
        side(stored, 1)
        .unionByName(side(certified, -1))
        .groupBy("asset_id", *fields)
        .agg(F.sum("sign").alias("surplus"))
        .where("surplus <> 0")
        .select("asset_id")
        .distinct()
    )


def certificate_fact_diff(
    facts: DataFrame, certs: DataFrame, split_diffs: DataFrame, key: bytes
) -> DataFrame:
    """Latest certificate of each asset against the facts: ten fields, eight lock fields, signature.

    ``facts`` are flat (asset_id, asset_uid, filename, sha256, ...); ``certs``
    carry the certified fields and the metadata_lock struct.
    """
    c = lambda name: F.col(f"c.{name}")
    order = [F.col("issued_at").desc_nulls_last(), F.col("cert_id").desc_nulls_last()]
    latest = ordering.first_per_key(certs.where("cert_id is not null"), ["asset_id"], order)
    judged = certificates.metadata_lock(latest, key).withColumnRenamed("valid", "signature_valid")
    joined = (
        facts.alias("f")
        .join(judged.alias("c"), F.col("f.asset_id") == F.col("c.asset_id"), "left")
        .join(
            split_diffs.withColumn("splits_differ", F.lit(True)).alias("d"),
            F.col("f.asset_id") == F.col("d.asset_id"),
            "left",
        )
    )
    clean = lambda name: text.clean_text(c(name))
    f = lambda name: F.col(f"f.{name}")
    locked = c("metadata_lock").isNotNull()
    lock = lambda name: F.col(f"c.metadata_lock.{name}")
    checks = {
        "asset_uid": _differs(f("asset_uid"), c("asset_uid")),
        "asset_id": _differs(f("asset_id"), c("asset_id")),
        "filename": _differs(f("filename"), c("filename")),
        "sha256": _differs(f("sha256"), c("sha256")),
        "second_fingerprint": _differs(f("second_fingerprint"), c("second_fingerprint")),
        # the certified subject of an unnamed creator is "Unknown", the fact is null
        "creator_name": _differs(f("creator_name"), clean("subject_name")),
        "copyright_owner": _differs(f("copyright_owner"), clean("copyright_owner")),
        "license_type": _differs(f("license_type"), clean("license_type")),
        "ai_disclosure": _differs(f("ai_disclosure"), clean("ai_disclosure")),
        "ownership_splits": F.coalesce("d.splits_differ", F.lit(False)),
    }
    for name in ("asset_uid", "asset_id", "sha256", "second_fingerprint"):
        checks[f"metadata_lock.{name}"] = locked & _differs(f(name), lock(name))
    for name in ("creator_name", "copyright_owner", "license_type", "ai_disclosure"):
        checks[f"metadata_lock.{name}"] = locked & _differs(f(name), text.clean_text(lock(name)))
    checks["signature"] = ~F.coalesce(c("signature_valid"), F.lit(False))
    present = c("cert_id").isNotNull()
    return (
        joined.select(
            f("asset_id").alias("asset_id"),
            c("cert_id").alias("cert_id"),
            F.when(present, _mismatches(checks)).alias("mismatches"),
        )
        .withColumn("check", F.lit("signed_certificate"))
        .withColumn("status", _status(F.col("cert_id").isNotNull(), "mismatches"))
    )


def manifest_fact_diff(facts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Stored facts against the manifest copy, twelve fields."""
    m, f = (lambda n: F.col(f"m.{n}")), (lambda n: F.col(f"f.{n}"))
    clean = lambda name: text.clean_text(m(name))
    exact = ["asset_uid", "asset_id", "filename", "sha256", "second_fingerprint", "phash"]
    checks = {name: _differs(f(name), m(name)) for name in exact}
    checks |= {
        name: _differs(f(name), clean(name))
        for name in ("creator_name", "copyright_owner", "license_type", "ai_disclosure")
    }
    checks["trust_score"] = _differs(f("trust_score"), m("trust_score"), number=True)
    checks["content_label"] = _differs(f("content_label"), m("content_label"))
    present = m("asset_id").isNotNull()
    return (
        facts.alias("f")
        .join(manifests.alias("m"), F.col("f.asset_id") == F.col("m.asset_id"), "left")
        .select(
            f("asset_id").alias("asset_id"),
            present.alias("present"),
            F.when(present, _mismatches(checks)).alias("mismatches"),
        )
        .withColumn("check", F.lit("provenance_manifest"))
        .withColumn("status", _status(F.col("present"), "mismatches"))
        .drop("present")
    )


def integrity_report(checks: DataFrame) -> DataFrame:
    """Per asset: review_required, incomplete or consistent, with counts."""
    return (
        checks.groupBy("asset_id")
        .agg(
            F.count_if(F.col("status") == "fail").alias("mismatch_count"),
            F.count_if(F.col("status") == "unavailable").alias("unavailable_count"),
        )
        .withColumn(
            "status",
            F.when(F.col("mismatch_count") > 0, "review_required")
            .when(F.col("unavailable_count") > 0, "incomplete")
            .otherwise("consistent"),
        )
    )


def provenance_mismatch(assets: DataFrame, manifests: DataFrame) -> DataFrame:
    """Four identity fields; a field the manifest lacks is tolerated.

    Assets without a readable manifest have a null list.
    """
    fields = ["asset_uid", "sha256", "second_fingerprint", "filename"]

    def check(name: str) -> Column:
        stored, copied = F.col(f"a.{name}"), F.col(f"m.{name}")
        shown = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
        note = F.concat(F.lit(f"{name}:manifest="), shown(copied), F.lit(";stored="), shown(stored))
        return F.when(copied.isNotNull() & ~copied.eqNullSafe(stored), note)

    notes = F.filter(F.array(*[check(n) for n in fields]), lambda n: n.isNotNull())
    return (
        assets.select("asset_id", *fields)
        .alias("a")
        .join(manifests.select("asset_id", *fields).alias("m"), F.col("a.asset_id") == F.col("m.asset_id"), "left")
        .select(
            F.col("a.asset_id").alias("asset_id"),
            F.when(F.col("m.asset_id").isNotNull(), notes).alias("mismatches"),
        )
    )


def tamper_audit(df: DataFrame, table: str, key: str, stored: str, recomputed: Column) -> DataFrame:
    """Rows whose stored hash is missing or differs from the recomputed one."""
    return df.where(~F.col(stored).eqNullSafe(recomputed)).select(
        F.lit(table).alias("table"),
        F.col(key).cast("string").alias("row_key"),
        F.col(stored).alias("stored_hash"),
        F.when(F.col(stored).isNull(), "missing").otherwise("mismatch").alias("finding"),
    )


def verify_batch(
    requests: DataFrame, assets: DataFrame, manifests: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, hashed log rows, counter deltas) of a batch of asset lookups.

    ``requests`` have request_id, asset_id, requested_at and requester.
    """
    state = provenance_mismatch(assets, manifests).select(
        "asset_id", F.lit(True).alias("known"), (F.size("mismatches") == 0).alias("manifest_valid"), "mismatches"
    )
    results = requests.join(state, "asset_id", "left").select(
        *requests.columns,
        F.coalesce("known", F.lit(False)).alias("verified"),
        F.when(F.col("mismatches").isNotNull(), F.col("manifest_valid")).alias("manifest_valid"),
        "mismatches",
    )
    results = results.withColumn(
        "result",
        F.when(~F.col("verified"), "fail")
        .when(F.coalesce(~F.col("manifest_valid"), F.lit(False)), "warning")
        .otherwise("pass"),
    )
    details = F.when(
        F.col("verified"),
        F.to_json(F.struct("manifest_valid", F.size("mismatches").alias("mismatches")), {"ignoreNullFields": "false"}),
    ).otherwise(F.lit('{"reason":"not_found"}'))
    logs = results.select(
        F.concat(F.lit("vb-"), F.col("request_id").cast("string")).alias("log_id"),
        "asset_id",
        F.lit("asset_id").alias("check_type"),
        "result",
        details.alias("details"),
        F.col("requester").alias("verified_by"),
        F.col("requested_at").alias("timestamp"),
    )
    logs = logs.withColumn(
        "log_hash",
        digests.record_digest(
            {name: F.col(name) for name in logs.columns if name != "timestamp"}
            | {"timestamp": text.iso_utc(F.col("timestamp"))}
        ),
    )
    deltas = results.where("verified").groupBy("asset_id").agg(F.count(F.lit(1)).alias("delta"))
    return results, logs, deltas


def provider_expectations(
    assets: DataFrame, observations: DataFrame, nodes: DataFrame, expected: list[str]
) -> DataFrame:
    """(asset_id, check, ok) data-quality rows for every asset.

    ``observations`` are the persisted rows, ``nodes`` the evidence graph.
    """
    wanted = F.col("provider").isin(expected)
    seen = observations.groupBy("asset_id").agg(
        F.count_distinct(F.when(wanted, F.col("provider"))).alias("providers"),
        F.bool_and(F.when(wanted, F.col("probability").between(0, 1))).alias("in_range"),
        F.bool_and(F.when(wanted, F.col("status") == "available")).alias("all_available"),
    )
    graph = nodes.groupBy("asset_id").agg(
        F.bool_or((F.col("id") == F.concat(F.lit("asset:"), F.col("asset_id"))) & (F.col("type") == "asset")).alias("root"),
        F.count_distinct(
            F.when(
                (F.col("evidence_class") == "forensic_observation")
                & F.get_json_object("data", "$.provider").isin(expected),
                F.get_json_object("data", "$.provider"),
            )
        ).alias("graph_providers"),
    )
    count = F.lit(len(expected))
    joined = assets.select("asset_id").join(seen, "asset_id", "left").join(graph, "asset_id", "left")
    checks = {
        "expected_providers_present": F.coalesce("providers", F.lit(0)) == count,
        "probabilities_in_range": F.coalesce("in_range", F.lit(False)),
        "observations_available": F.coalesce("all_available", F.lit(False)),
        "graph_root_matches": F.coalesce("root", F.lit(False)),
        "graph_has_providers": F.coalesce("graph_providers", F.lit(0)) == count,
    }
    rows = F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok")) for n, ok in checks.items()])
    return joined.select("asset_id", F.inline(rows))
