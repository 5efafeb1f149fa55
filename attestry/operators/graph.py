"""Evidence graph of a whole registry: node and edge tables, documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text
from attestry.functions.media import literal_map
from attestry.operators import asset_scores, matching
from attestry.operators.facts import HUMAN_FORMS
from attestry.session import stored

SPLIT_SCHEMA = (
    "array<struct<name: string, contributor_name: string, role: string, contribution_type: string, "
    "creative_contribution_pct: string, ownership_split_pct: string, split_percentage: string, "
    "split: string, ai_assisted_pct: string>>"
)
LOCKED = ["locked", "finalized"]


@dataclass
class Registry:
    """The tables the graph is drawn from."""

    assets: DataFrame
    contributors: DataFrame
    split_sessions: DataFrame
    passports: DataFrame
    certificates: DataFrame
    events: DataFrame
    anomalies: DataFrame
    observations: DataFrame
    sessions: DataFrame


def split_record(sessions: DataFrame) -> DataFrame:
    """Public-safe split rows of each live session, with the ownership total.

    ``contributors_json`` is one stored document, so its rows stay an array;
    wallets are not in the schema and are dropped by parsing.
    """
    items = F.coalesce(F.from_json("contributors_json", SPLIT_SCHEMA), F.array().cast(SPLIT_SCHEMA))
    rows = F.transform(
        F.filter(items, lambda c: c.isNotNull()),
        lambda c: F.struct(
            F.coalesce(F.nullif(c["name"], F.lit("")), c["contributor_name"]).alias("name"),
            c["role"].alias("role"),
            c["contribution_type"].alias("contribution_type"),
            c["creative_contribution_pct"].alias("creative_contribution_pct"),
            F.coalesce(c["ownership_split_pct"], c["split_percentage"], c["split"]).alias("ownership_split_pct"),
            c["ai_assisted_pct"].alias("ai_assisted_pct"),
        ),
    )
    numbers = F.filter(
        F.transform("contributors", lambda c: text.as_number(c["ownership_split_pct"])), lambda n: n.isNotNull()
    )
    total = F.when(
        F.size(numbers) > 0, text.rounded(F.aggregate(numbers, F.lit(0.0), lambda acc, n: acc + n), 4)
    )
    return (
        sessions.withColumn("contributors", rows)
        .withColumn("ownership_total_pct", total)
        .withColumn("contributor_count", F.size("contributors"))
        .withColumn("locked_or_finalized", F.coalesce(F.col("status").isin(LOCKED), F.lit(False)))
        .withColumn("session_hash_present", F.coalesce(F.col("session_hash") != "", F.lit(False)))
        .drop("contributors_json")
    )


def _node(df: DataFrame, node_id: Column, kind: str, evidence: str, data: list) -> DataFrame:
    return df.select(
        "asset_id",
        node_id.alias("id"),
        F.lit(kind).alias("type"),
        F.lit(evidence).alias("evidence_class"),
        F.to_json(F.struct(*data)).alias("data"),
    )


def _id(prefix: str, name: str = "asset_id") -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(name).cast("string"))


def _has_rights() -> Column:
    return (F.coalesce("copyright_owner", F.lit("")) != "") | (F.coalesce("license_type", F.lit("")) != "")


def _node_parts(reg: Registry) -> tuple[list[DataFrame], list[DataFrame]]:
    """Node rows of the assets themselves, and of their children of any asset."""
    stamp = lambda name: text.iso_utc(F.col(name)).alias(name)
    observed = matching.legacy_observation_fallback(reg.assets, reg.observations)
    passports = asset_scores.passport_readiness(reg.passports)
    own = [
        _node(
            reg.assets,
            _id("asset"),
            "asset",
            "cryptographic_identity",
            [
                "asset_uid",
                "asset_id",
                "filename",
                "file_type",
                "asset_type",
                "file_size_bytes",
                "sha256",
                "second_fingerprint",
                "phash",
                stamp("created_at"),
            ],
        ),
        _node(
            reg.assets,
            _id("declaration"),
            "creator_declaration",
            "declaration",
            [
                "creator_name",
                "ai_disclosure",
                "ai_disclosure_complete",
                "ai_tools",
                "ai_modification_by_human",
                "human_authorship_summary",
                F.struct(*[F.col(c).alias(f) for f, c in HUMAN_FORMS.items()]).alias("human_contributions"),
            ],
        ),
        _node(
            reg.assets.where(_has_rights()),
            _id("rights"),
            "rights_claim",
            "rights_claim",
            ["copyright_owner", "license_type", "copyright_readiness_score", "copyright_readiness_label"],
        ),
    ]
    children = [
        _node(
            reg.contributors,
            _id("contributor", "contributor_id"),
            "contributor",
            "attribution",
            [
                "contributor_id",
                "name",
                "role",
                "contribution_type",
                "creative_contribution_pct",
                "ownership_split_pct",
                "ai_assisted_pct",
                stamp("added_at"),
            ],
        ),
        _node(
            split_record(reg.split_sessions),
            _id("rights-record:live-split", "session_id"),
            "live_split_record",
            "rights_record",
            [
                "session_id",
                "status",
                "session_hash",
                "contributor_count",
                "ownership_total_pct",
                "contributors",
                "locked_or_finalized",
                "session_hash_present",
            ],
        ),
        _node(
            passports,
            _id("dpp", "passport_id"),
            "digital_product_passport",
            "product_passport_record",
            [
                "passport_id",
                "passport_level",
                "product_name",
                "brand_name",
                "gtin14",
                "serial_number",
                "data_carrier_type",
                "compliance_status",
                "checks",
                "gaps",
            ],
        ),
        _node(
            reg.certificates,
            _id("certificate", "cert_id"),
            "certificate",
            "certificate_attestation",
            [
                "cert_id",
                "certificate_hash",
                stamp("issued_at"),
                "subject_name",
                "certificate_class",
                "signature_algorithm",
                "public_key_id",
            ],
        ),
        _node(
            reg.events,
            _id("provenance", "event_id"),
            "provenance_event",
            "provenance",
            [
                "event_id",
                "event_type",
                "description",
                "tool_used",
                "human_or_ai",
                "actor_name",
                stamp("timestamp"),
                "event_hash",
            ],
        ),
        _node(
            reg.anomalies.where("anomaly_score is not null"),
            _id("forensic:metadata"),
            "forensic_observation",
            "forensic_observation",
            [F.lit("metadata_anomaly").alias("signal"), F.col("anomaly_score").alias("score"), "flags"],
        ),
        _node(
            observed,
            F.when(
                F.col("status") == "legacy_persisted_score", _id("forensic:synthetic:legacy")
            ).otherwise(_id("forensic:synthetic", "observation_id")),
            "forensic_observation",
            "forensic_observation",
            ["signal", "probability", "provider", "model", "status"],
        ),
        _node(
            reg.sessions,
            _id("session"),
            "session_summary",
            "creation_process_evidence",
            ["status", "privacy_mode", "event_count", "chain_valid"],
        ),
    ]
    return own, children


# Relation of each node type to its asset.
RELATIONS = {
    "creator_declaration": "declares_about",
    "rights_claim": "claims_rights_in",
    "contributor": "attributed_to",
    "live_split_record": "records_rights_for",
    "digital_product_passport": "documents_product_identity_for",
    "certificate": "attests_to",
    "provenance_event": "records_event_for",
    "forensic_observation": "observes",
    "session_summary": "binds_creation_process_to",
}


def evidence_nodes(reg: Registry) -> DataFrame:
    """All nodes of all assets; evidence classes stay separate.

    Children of all sources are united first and meet the assets once.
    """
    own, children = _node_parts(reg)
    known = reduce(DataFrame.unionByName, children).join(reg.assets.select("asset_id"), "asset_id", "left_semi")
    return reduce(DataFrame.unionByName, own).unionByName(known)


def _asset_edge() -> Column:
    """struct(source, target, relation) of a node's edge to its asset; null for the asset."""
    relation = F.try_element_at(literal_map(RELATIONS), F.col("type"))
    return F.when(
        relation.isNotNull(),
        F.struct(F.col("id").alias("source"), _id("asset").alias("target"), relation.alias("relation")),
    )


def _record_edges(reg: Registry) -> DataFrame:
    """Rights record -> claim, and contributor or record -> a name that both bear.

    Members of a name point at the name, so a name that many share gives as many
    edges as it has members, not their pairs.
    """
    records = reg.split_sessions.join(reg.assets.where(_has_rights()).select("asset_id"), "asset_id", "left_semi")
    claims = records.select(
        "asset_id",
        _id("rights-record:live-split", "session_id").alias("source"),
        _id("rights").alias("target"),
        F.lit("documents_declared_rights").alias("relation"),
    )
    listed = (
        split_record(reg.split_sessions)
        .select("asset_id", F.col("session_id").alias("sheet_id"), F.explode("contributors").alias("c"))
        .select("asset_id", "sheet_id", F.col("c.name").alias("sheet_name"))
    )
    names = matching.name_match_join(reg.contributors, listed).join(
        reg.assets.select("asset_id"), "asset_id", "left_semi"
    )
    by_contributor = F.col("member") == "contributor"
    named = names.select(
        "asset_id",
        F.when(by_contributor, _id("contributor", "member_id")).otherwise(_id("rights-record:live-split", "member_id")).alias(
            "source"
        ),
        F.concat(_id("name"), F.lit(":"), F.col("name_key")).alias("target"),
        F.when(by_contributor, "named").otherwise("lists_name").alias("relation"),
    )
    return claims.unionByName(named)


def evidence_edges(reg: Registry, nodes: DataFrame) -> DataFrame:
    """Edges to the asset, to the rights claim and to shared names.

    ``nodes`` is the output of ``evidence_nodes``; only ids and types are read.
    """
    edges = nodes.select("asset_id", _asset_edge().alias("e")).where("e is not null").select("asset_id", "e.*")
    return edges.unionByName(_record_edges(reg))


ENTRY = "struct<id:string,type:string,evidence_class:string,data:string>"
EDGE = "struct<source:string,target:string,relation:string>"


def _node_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "asset_id", F.struct("id", "type", "evidence_class", "data").cast(ENTRY).alias("node"), F.lit(None).cast(EDGE).alias("edge")
    )


def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select(
        "asset_id",
        F.lit(None).cast(ENTRY).alias("node"),
        F.struct("source", "target", "relation").cast(EDGE).alias("edge"),
    )


def graph_document(nodes: DataFrame, edges: DataFrame, per_part: int = 1000) -> DataFrame:
    """Documents of separate node and edge tables."""
    entries = _node_rows(nodes).unionByName(_edge_rows(edges))
    # the edges of nodes to their assets are among the edges
    sums = _class_counts(nodes).withColumn("links", F.lit(0)).unionByName(_class_counts(edges))
    return _documents(entries, _part_counts(sums, per_part), F.collect_list("edge"))


def registry_documents(reg: Registry, per_part: int = 1000) -> DataFrame:
    """One or more nested documents per asset, about ``per_part`` nodes and edges each.

    A node's edge to its asset lies in the node's part.  Nodes are counted first,
    by asset and class alone, so that they meet the assets, their parts and each
    other in one shuffle and are not stored; an asset without counts is unknown.
    """
    own, children = _node_parts(reg)
    edges = stored(_record_edges(reg), "graph-edges")
    asked = reg.assets.select("asset_id")
    # source by source, so that nothing else of a child is read
    sums = reduce(DataFrame.unionByName, [_class_counts(part) for part in [*own, *children]])
    sums = sums.groupBy("asset_id", "evidence_class").agg(F.sum("n").alias("n"), F.sum("links").alias("links"))
    sums = sums.join(asked, "asset_id", "left_semi").unionByName(_class_counts(edges))
    counts = stored(_part_counts(sums, per_part), "graph-counts")
    # most children of unknown assets leave here, and the rest where they meet the counts
    near = matching.likely_members(reduce(DataFrame.unionByName, children), "asset_id", counts)
    entries = _node_rows(reduce(DataFrame.unionByName, own).unionByName(near)).unionByName(_edge_rows(edges))
    linked = F.filter(F.collect_list("node"), lambda n: n["type"].isin(*RELATIONS))
    return _documents(entries, counts, F.concat(F.collect_list("edge"), F.transform(linked, _asset_edge_of)))


def _asset_edge_of(node: Column) -> Column:
    """The edge of a node struct to its asset."""
    relation = F.try_element_at(literal_map(RELATIONS), node["type"])
    return F.struct(node["id"].alias("source"), _id("asset").alias("target"), relation.alias("relation")).cast(EDGE)


def _class_counts(rows: DataFrame) -> DataFrame:
    """(asset_id, evidence_class, n, links) of nodes or edges; ``links`` are the nodes with an edge to their asset."""
    if "evidence_class" not in rows.columns:
        rows = rows.withColumns({"evidence_class": F.lit(None).cast("string"), "type": F.lit(None).cast("string")})
    return rows.groupBy("asset_id", "evidence_class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("type").isin(*RELATIONS)).alias("links")
    )


def _part_counts(sums: DataFrame, per_part: int) -> DataFrame:
    """(asset_id, parts, evidence_counts); the classes are a fixed list of ten, edges have none."""
    named = F.when(F.col("evidence_class").isNotNull(), F.struct("evidence_class", "n"))
    return sums.groupBy("asset_id").agg(
        F.ceil(F.sum(F.col("n") + F.col("links")) / per_part).cast("int").alias("parts"),
        F.map_from_entries(F.array_sort(F.collect_list(named))).alias("evidence_counts"),
    )


def _documents(entries: DataFrame, counts: DataFrame, edges: Column) -> DataFrame:
    """A large graph is spread over parts by a digest of its ids, so no group grows
    with the size of one asset; class counts are repeated on every part.
    """
    key = F.coalesce(F.col("node.id"), F.concat_ws("|", "edge.source", "edge.target", "edge.relation"))
    # eight hex digits, which every engine can compute
    place = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return (
        entries.join(counts.select("asset_id", "parts"), "asset_id")
        .withColumn("part", F.pmod(place, F.col("parts")).cast("int"))
        .groupBy("asset_id", "part")
        .agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.array_sort(edges).alias("edges"))
        .join(counts, "asset_id")
        .select("asset_id", "part", "parts", _id("asset").alias("root_node_id"), "nodes", "edges", "evidence_counts")
    )
