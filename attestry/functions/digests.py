"""Content identity, canonical row digests and keyed authentication codes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: prefix of a content identity.
ASSET_UID_PREFIX = "AU-"


def content_digests(content: Column) -> Column:
    """sha256, md5 and second fingerprint (SHA-256 stands in for BLAKE3)."""
    sha = F.sha2(content, 256)
    return F.struct(
        sha.alias("sha256"), F.md5(content).alias("md5"), sha.alias("second_fingerprint")
    )


def asset_uid(tenant: Column, sha256: Column) -> Column:
    """Deterministic identity of one tenant's copy of some bytes."""
    tenant_tag = F.upper(F.substring(F.md5(tenant), 1, 8))
    content_tag = F.upper(F.substring(F.sha2(F.concat(tenant, F.lit(":"), sha256), 256), 1, 16))
    return F.concat(F.lit(ASSET_UID_PREFIX), tenant_tag, content_tag)


def canonical_json(fields: Mapping[str, Column], exclude: Iterable[str] = ()) -> Column:
    """Compact JSON with keys in alphabetical order and nulls kept.

    Fields should be strings, integers or booleans, so that every engine
    prints them the same way.
    """
    left_out = set(exclude)
    ordered = [fields[name].alias(name) for name in sorted(fields) if name not in left_out]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def record_digest(fields: Mapping[str, Column], exclude: Iterable[str] = ()) -> Column:
    """SHA-256 of a row's canonical JSON, without its own hash column."""
    return F.sha2(canonical_json(fields, exclude), 256)


def keyed_mac(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 as two nested JVM digests; only the key pads are literals."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in block))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in block))
    inner = F.unhex(F.sha2(F.concat(inner_pad, message.cast("binary")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)
