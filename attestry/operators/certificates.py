"""Certificates: metadata lock, signature checks, documents, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import digests, text
from attestry.operators import ordering

ALGORITHM = "HMAC-SHA256"

# Certificate classes with their labels.
CLASS_LABELS = {
    "standard": "Standard Authorship Certificate",
    "hybrid_authorship": "Hybrid Authorship Certificate",
    "live_split": "Live-Split Authorship Certificate",
    "ai_assisted": "AI-Assisted Authorship Certificate",
}


# Facts a metadata lock holds.
LOCK_FIELDS = [
    "asset_uid",
    "asset_id",
    "filename",
    "sha256",
    "second_fingerprint",
    "creator_name",
    "copyright_owner",
    "license_type",
    "ai_disclosure",
]


def _lock_hash() -> Column:
    return digests.record_digest({name: F.col(f"metadata_lock.{name}") for name in LOCK_FIELDS})


def _unsigned_hash() -> Column:
    """Digest of the certificate without its lock, hashes and signature fields."""
    return digests.record_digest(
        {
            "cert_id": F.col("cert_id"),
            "asset_id": F.col("asset_id"),
            "issued_at": text.iso_plain(F.col("issued_at")),
            "subject_name": F.col("subject_name"),
            "certificate_class": F.col("certificate_class"),
        }
    )


def lock_and_sign(certs: DataFrame, key: bytes, key_id: str) -> DataFrame:
    """Add the metadata lock, both hashes and the keyed signature.

    A lock field the table does not have is locked as null.
    """
    held = [
        (F.col(name) if name in certs.columns else F.lit(None).cast("string")).alias(name) for name in LOCK_FIELDS
    ]
    return (
        certs.withColumn("metadata_lock", F.struct(*held))
        .withColumn("metadata_hash", _lock_hash())
        .withColumn("certificate_hash", _unsigned_hash())
        .withColumn("signature", digests.keyed_mac(F.col("certificate_hash"), key))
        .withColumns({"signature_algorithm": F.lit(ALGORITHM), "public_key_id": F.lit(key_id)})
    )


def metadata_lock(certs: DataFrame, key: bytes) -> DataFrame:
    """Recompute lock, certificate hash and signature; first failing one is the reason."""
    reason = (
        F.when(F.col("metadata_lock").isNull(), F.lit("certificate has no metadata lock"))
        .when(~F.col("signature_algorithm").eqNullSafe(ALGORITHM), F.lit("unknown signature algorithm"))
        .when(~_lock_hash().eqNullSafe(F.col("metadata_hash")), F.lit("metadata hash mismatch"))
        .when(~_unsigned_hash().eqNullSafe(F.col("certificate_hash")), F.lit("certificate hash mismatch"))
        .when(
            ~digests.keyed_mac(F.col("certificate_hash"), key).eqNullSafe(F.col("signature")),
            F.lit("signature mismatch"),
        )
    )
    return certs.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def latest_certificate(certs: DataFrame) -> DataFrame:
    """Newest certificate row per asset, with the first and last issue time."""
    rest = [c for c in certs.columns if c != "asset_id"]
    return (
        certs.groupBy("asset_id")
        .agg(
            F.max_by(F.struct(*rest), F.struct("issued_at", "cert_id")).alias("newest"),
            F.min("issued_at").alias("first_issued_at"),
            F.max("issued_at").alias("latest_issued_at"),
            F.count(F.lit(1)).alias("certificate_count"),
        )
        .select("asset_id", "newest.*", "first_issued_at", "latest_issued_at", "certificate_count")
    )


def certificate_asset_join(certs: DataFrame, assets: DataFrame, tenant: str, limit: int) -> DataFrame:
    """One tenant's newest certificates with asset facts and the total count."""
    own = assets.where(F.col("tenant_id") == tenant).select(
        "asset_id", F.col("filename").alias("asset_filename"), "trust_score", "content_label"
    )
    joined = certs.drop("tenant_id").join(own, "asset_id")
    total = joined.agg(F.count(F.lit(1)).alias("total_count"))
    page = joined.select(
        "cert_id",
        "asset_id",
        "asset_filename",
        "subject_name",
        "certificate_class",
        "trust_score",
        "content_label",
        "issued_at",
        "certificate_hash",
        "signature_algorithm",
        "public_key_id",
    ).orderBy(F.col("issued_at").desc_nulls_last(), "cert_id").limit(limit)
    # total is a single aggregate row
    return page.join(F.broadcast(total), F.lit(True), "left")


def certificate_fallback_lookup(files: DataFrame, certs: DataFrame) -> DataFrame:
    """Readable certificate document first, else the latest certificate row."""
    readable = files.where(F.try_parse_json("document").isNotNull()).select(
        "asset_id", F.col("document").alias("file_document")
    )
    stored = ordering.first_per_key(
        certs, ["asset_id"], [F.col("issued_at").desc_nulls_last(), F.col("cert_id").desc()]
    ).select("asset_id", F.col("document").alias("row_document"))
    return readable.join(stored, "asset_id", "full_outer").select(
        "asset_id",
        F.coalesce("file_document", "row_document").alias("document"),
        F.when(F.col("file_document").isNotNull(), "file").otherwise("row").alias("origin"),
    )


def certificate_json() -> Column:
    """The stored JSON document of a signed certificate row."""
    return digests.canonical_json(
        {
            "cert_id": F.col("cert_id"),
            "asset_id": F.col("asset_id"),
            "issued_at": text.iso_plain(F.col("issued_at")),
            "subject_name": F.col("subject_name"),
            "certificate_class": F.col("certificate_class"),
            "certificate_hash": F.col("certificate_hash"),
            "metadata_hash": F.col("metadata_hash"),
            "signature": F.col("signature"),
            "signature_algorithm": F.col("signature_algorithm"),
            "public_key_id": F.col("public_key_id"),
        }
    )
