"""Queries over the scalar and nested functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import (
    content,
    detectors,
    digests,
    disclosure,
    media,
    passports,
    profiles,
    responses,
    tags,
    text,
)
from attestry.operators import chain, tenants
from attestry.plans.catalog import query
from attestry.plans.views import MAC_KEY, Views, provenance_event_digest

def _i() -> Column:
    return F.col("doc_id")



def joined(col: Column | str) -> Column:
    return F.array_join(col, "|")


@query("content_digests")
def _content_digests(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", digests.content_digests(F.col("text")).alias("d")).select(
        "doc_id", "d.sha256", "d.md5", "d.second_fingerprint"
    )


@query("asset_uid")
def _asset_uid(v: Views) -> DataFrame:
    return v.assets.select("doc_id", "tenant_id", "asset_uid")


@query("tenant_uid")
def _tenant_uid(v: Views) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    clients = v.table("supplier").select(F.concat(F.lit("C"), key, F.lit("@Example.com")).alias("email"))
    ok, rejected = tenants.tenant_uid(v.applications, clients)
    return ok.select("application_id", "email", "tenant_id", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select("application_id", "email", F.lit(None).cast("string").alias("tenant_id"), "reason")
    )


@query("record_digest")
def _record_digest(v: Views) -> DataFrame:
    return v.provenance_events.select("event_id", provenance_event_digest().alias("digest"))


@query("keyed_mac")
def _keyed_mac(v: Views) -> DataFrame:
    return v.certificates.select("cert_id", digests.keyed_mac(F.col("certificate_hash"), MAC_KEY).alias("mac"))


@query("clean_text")
def _clean_text(v: Views) -> DataFrame:
    return v.assets.select(
        "asset_id",
        text.clean_text(F.col("creator_name")).alias("creator_name"),
        text.clean_text(F.col("human_authorship_summary")).alias("summary"),
    )


@query("zero_safe_percentage")
def _zero_safe_percentage(v: Views) -> DataFrame:
    primary = (
        F.when(F.col("position") % 5 == 0, F.lit(""))
        .when(F.col("position") % 7 == 0, F.lit("n/a"))
        .otherwise(F.format_string("%.4f", F.col("ownership_split_pct")))
    )
    primary = F.when(F.col("ownership_split_pct").isNull(), F.lit(None)).otherwise(primary)
    return v.split_rows.select(
        "contributor_id",
        text.zero_safe_percentage(primary, F.col("creative_contribution_pct")).alias("ownership"),
        text.zero_safe_percentage(F.col("ai_assisted_pct")).alias("assisted"),
    )


@query("normalize_ai_disclosure")
def _normalize_ai_disclosure(v: Views) -> DataFrame:
    raw = v.assets.select(
        "asset_id",
        F.when(_i() % 29 == 0, F.lit("robot")).when(_i() % 5 == 4, F.lit(" ")).otherwise(F.col("ai_disclosure_raw")).alias(
            "ai_disclosure_raw"
        ),
        F.when(_i() % 7 == 1, F.lit(True)).when(_i() % 7 == 2, F.lit(False)).alias("is_ai_generated"),
        F.when(_i() % 4 == 0, F.array(F.lit("  "))).otherwise(F.col("ai_tools")).alias("ai_tools"),
    )
    ok, rejected = disclosure.normalize_ai_disclosure(raw)
    return ok.select(
        "asset_id",
        "disclosure",
        "is_generated",
        "is_assisted",
        "is_disclosed",
        joined("tools").alias("tools"),
        F.lit(None).cast("string").alias("reason"),
    ).unionByName(rejected.select("asset_id", "reason"), allowMissingColumns=True)


@query("risk_band")
def _risk_band(v: Views) -> DataFrame:
    return v.observations.select(
        "observation_id", detectors.risk_band(text.as_number(F.col("probability"))).alias("band")
    ).select("observation_id", "band.probability", "band.pct", "band.risk")


@query("normalize_observations")
def _normalize_observations(v: Views) -> DataFrame:
    return detectors.normalize_observations(v.observations).select(
        "observation_id", "provider", "model", "signal", "probability", "probability_pct", "risk", "status", "details"
    )


@query("hex_valid")
def _hex_valid(v: Views) -> DataFrame:
    return v.metadata.select(
        "asset_id",
        text.hex_valid(F.col("hashes.sha256"), 64).alias("sha_ok"),
        text.hex_valid(F.upper("hashes.md5"), 32).alias("md5_ok"),
    )


@query("populated_predicates")
def _populated_predicates(v: Views) -> DataFrame:
    df = v.metadata
    names = ["gps", "camera", "exif", "timestamps", "copyright", "codec", "hashes"]
    return df.select(
        "asset_id",
        *[content.populated(df, n).alias(f"populated_{n}") for n in names],
        *[content.meaningful(df, n).alias(f"meaningful_{n}") for n in names],
    )


@query("first_tag")
def _first_tag(v: Views) -> DataFrame:
    looked = v.metadata.select("asset_id", tags.tag_lookup(F.col("raw_tags")).alias("t"))
    return looked.select(
        "asset_id",
        tags.first_tag("t", ["creator", "artist", "by-line"]).alias("creator"),
        tags.first_tag("t", ["software"]).alias("software"),
        tags.first_tag("t", ["gpslatitude"]).alias("latitude"),
        tags.first_tag("t", ["nothing", "make"]).alias("make"),
    )


@query("tag_group_partition")
def _tag_group_partition(v: Views) -> DataFrame:
    flat = lambda name: F.array_join(
        F.transform(F.array_sort(F.map_entries(f"g.{name}")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
    ).alias(name)
    return v.metadata.select("asset_id", tags.tag_group_partition(F.col("raw_tags")).alias("g")).select(
        "asset_id", flat("exif"), flat("iptc"), flat("xmp"), flat("audio_tags")
    )


@query("normalize_sections")
def _normalize_sections(v: Views) -> DataFrame:
    raw = v.metadata.select("asset_id", "raw_tags", "file.extension", "file.mime_type")
    out = tags.normalize_sections(raw, "raw_tags", "extension", "mime_type")
    return out.select(
        "asset_id",
        F.col("technical.format").alias("format"),
        F.col("technical.resolution").alias("resolution"),
        F.col("container.mime_type").alias("container_mime"),
        F.col("container.extension").alias("container_extension"),
        F.col("timestamps.created").alias("created"),
        F.col("camera.make").alias("make"),
        F.col("gps.latitude").alias("latitude"),
        F.col("gps.gps").alias("gps"),
        F.col("copyright.creator").alias("creator"),
        F.col("software.editing_software").alias("editing_software"),
        F.col("codec.audio").alias("codec_audio"),
    )


@query("normalize_audio_tags")
def _normalize_audio_tags(v: Views) -> DataFrame:
    block = F.map_filter(
        F.create_map(
            F.lit("TIT2"), F.when(_i() % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Song "), (_i() % 50).cast("string"))),
            F.lit("title"), F.lit("Fallback"),
            F.lit("COMM::eng"), F.when(_i() % 5 == 0, F.lit("note")),
            F.lit("album-artist"), F.when(_i() % 4 == 0, F.lit("Band")),
            F.lit("TYER"), (F.lit(1990) + _i() % 30).cast("string"),
            F.lit("XYZ"), F.lit("ignored"),
        ),
        lambda _, value: value.isNotNull(),
    )
    return v.assets.select("asset_id", tags.normalize_audio_tags(block).alias("t")).select(
        "asset_id", "t.title", "t.comment", "t.album_artist", "t.year", "t.artist", F.size("t.raw").alias("raw_tags")
    )


@query("flatten_nested")
def _flatten_nested(v: Views) -> DataFrame:
    return tags.flatten_nested(v.manifest_stores, "asset_id", "store")


@query("classify_media")
def _classify_media(v: Views) -> DataFrame:
    endings = ["a.JPG", "b.mp4", "c.tar.gz", "noext", "d.docx", "e.flac", ".png", "f."]
    name = F.concat((_i() % 100).cast("string"), F.element_at(F.array(*[F.lit(e) for e in endings]), (_i() % 8 + 1).cast("int")))
    mime = F.when(_i() % 9 == 0, F.lit("application/custom"))
    return v.assets.select("asset_id", media.classify_media(name, mime).alias("m")).select("asset_id", "m.*")


@query("layer_split")
def _layer_split(v: Views) -> DataFrame:
    out = tags.layer_split(v.metadata.withColumn("extractor", F.lit("table")), ["extractor"])
    return out.select(
        "asset_id",
        F.size("raw").alias("raw_tags"),
        F.col("normalized.file.mime_type").alias("mime_type"),
        F.col("derived.extractor").alias("extractor"),
        F.col("derived.metadata_sha256").alias("metadata_sha256"),
    )


@query("gtin14_check")
def _gtin14_check(v: Views) -> DataFrame:
    return v.passports.select("passport_id", passports.gtin14_check(F.col("gtin14")).alias("c")).select(
        "passport_id", "c.value", "c.valid", "c.reason"
    )


@query("serial_check")
def _serial_check(v: Views) -> DataFrame:
    return v.passports.select("passport_id", passports.serial_check(F.col("serial_number")).alias("c")).select(
        "passport_id", "c.value", "c.valid", "c.reason"
    )


@query("resolver_origin_check")
def _resolver_origin_check(v: Views) -> DataFrame:
    p, url = F.col("page_id"), F.col("url")
    origin = F.regexp_extract(url, "^([a-z]+://[^/]*)", 1)
    given = (
        F.when(p % 10 == 0, F.concat(F.lit(" "), F.regexp_replace(origin, "^http:", "https:"), F.lit("/ ")))
        .when(p % 10 == 1, F.regexp_replace(origin, "^https?://", "https://user:pw@"))
        .when(p % 10 == 2, F.concat(F.regexp_replace(origin, "^http:", "https:"), F.lit("?q=1")))
        .when(p % 10 == 3, F.lit(" "))
        .otherwise(url)
    )
    return v.table("pages").select("page_id", passports.resolver_origin_check(given).alias("c")).select(
        "page_id", "c.url", "c.reason"
    )


@query("item_uri")
def _item_uri(v: Views) -> DataFrame:
    gtin, serial = passports.gtin14_check(F.col("gtin14")), passports.serial_check(F.col("serial_number"))
    return (
        v.passports.select("passport_id", gtin.alias("g"), serial.alias("s"))
        .where("g.valid and s.valid")
        .select(
            "passport_id",
            passports.item_uri(F.lit(passports.CANONICAL_ORIGIN), F.col("g.value"), F.col("s.value")).alias("uri"),
        )
    )


@query("iso_utc")
def _iso_utc(v: Views) -> DataFrame:
    ts = F.col("ts")
    return v.table("events").select(
        "event_id",
        text.iso_utc(ts).alias("evidence_form"),
        text.iso_plain(F.when(F.col("event_id") % 2 == 0, F.date_trunc("second", ts)).otherwise(ts)).alias("fact_form"),
    )


@query("dictionary_match")
def _dictionary_match(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    running = (
        F.when(k % 6 == 0, F.lit("Logic  Pro X.app"))
        .when(k % 6 == 1, F.lit("MPC_Software"))
        .when(k % 6 == 2, F.lit("Ableton_Live 12.app"))
        .when(k % 6 == 3, F.lit("Serato DJ Pro"))
        .otherwise(F.col("p_name"))
    )
    device = F.when(k % 4 == 0, F.lit("MPC Live II")).when(k % 4 == 1, F.lit("Maschine+ Rev")).otherwise(F.col("p_name"))
    matched = v.table("part").select(
        "p_partkey",
        profiles.dictionary_match(running, profiles.APP_PROFILES).alias("app"),
        profiles.dictionary_match(running, profiles.PROCESS_ONLY).alias("process_only"),
        profiles.dictionary_match(device, profiles.HARDWARE_PROFILES).alias("hardware"),
    )
    return matched.select(
        "*",
        profiles.of_profile(F.col("app"), profiles.PROJECT_EXTENSIONS).alias("project_extensions"),
        profiles.of_profile(F.col("hardware"), profiles.HARDWARE_CATEGORIES).alias("hardware_category"),
    )


@query("manifest_actions")
def _manifest_actions(v: Views) -> DataFrame:
    return responses.parse_store(v.manifest_stores).select(
        "asset_id", joined(responses.manifest_actions()).alias("actions")
    )


@query("manifest_summary")
def _manifest_summary(v: Views) -> DataFrame:
    return responses.manifest_summary(v.manifest_stores).select(
        "asset_id",
        "manifest_present",
        "active_manifest",
        "claim_generator",
        "title",
        "ingredient_count",
        "assertion_count",
        joined("actions").alias("actions"),
        "validation_state",
        F.size("validation_status").alias("status_count"),
        "validation_error_count",
    )


@query("status_union_dedupe")
def _status_union_dedupe(v: Views) -> DataFrame:
    one = responses.status_union_dedupe()
    return (
        responses.parse_store(v.manifest_stores)
        .select("asset_id", F.posexplode(one).alias("position", "s"))
        .select("asset_id", "position", "s.code", "s.success")
    )


@query("location_check")
def _location_check(v: Views) -> DataFrame:
    k = F.col("k")
    location = F.map_filter(
        F.create_map(
            F.lit("level"),
            F.when(k % 5 == 0, "none").when(k % 5 == 1, "coarse").when(k % 5 == 2, "precise_private").when(k % 5 == 3, "exact"),
            F.lit("latitude"), F.when(k % 3 != 0, F.lit("1.5")),
            F.lit("longitude"), F.when(k % 7 != 0, F.lit("2.5")),
        ),
        lambda _, value: value.isNotNull(),
    )
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).select(
        "event_id", disclosure.location_check(location).alias("c")
    ).select("event_id", "c.ok", "c.reason")


@query("class_max_score")
def _class_max_score(v: Views) -> DataFrame:
    return responses.class_max_score(v.detector_responses, "ai_generated").select(
        "response_id", "probability", "segment_count"
    )


@query("top_attribution")
def _top_attribution(v: Views) -> DataFrame:
    return responses.top_attribution(v.detector_responses).select(
        "response_id", F.col("attribution.class").alias("top_class"), F.col("attribution.score").alias("score")
    )


@query("music_observations")
def _music_observations(v: Views) -> DataFrame:
    return responses.music_observations(v.detector_responses).select(
        "response_id", "model", "signal", "probability", "segment_count", F.col("attribution.class").alias("top_class")
    )


@query("opt_in_fields")
def _opt_in_fields(v: Views) -> DataFrame:
    k = F.col("event_id")
    fields = F.array(
        F.when(k % 2 == 0, F.lit(" transformation_statement")),
        F.when(k % 3 == 0, F.lit("production_environment")),
        F.lit("  "),
        F.when(k % 5 == 0, F.lit("production_environment ")),
        F.when(k % 11 == 0, F.lit("wallets")),
    )
    out = disclosure.opt_in_fields(v.table("events").select("event_id", "user_id", fields.alias("fields")))
    return out.select(
        "event_id",
        joined("fields").alias("fields"),
        "unsupported",
        disclosure.published("production_environment", F.concat(F.lit("Env "), F.col("user_id").cast("string"))).alias(
            "production_environment"
        ),
    )


@query("transformation_declare")
def _transformation_declare(v: Views) -> DataFrame:
    k = F.col("event_id")
    declared = F.array(
        F.when(k % 2 == 0, F.lit(" Edited")),
        F.when(k % 3 == 0, F.lit("REPLAYED ")),
        F.when(k % 5 == 0, F.lit("edited")),
        F.when(k % 13 == 0, F.lit("Painted")),
        F.lit(" "),
    )
    ok, rejected = disclosure.transformation_declare(
        v.table("events").select("event_id", (k % 4 == 0).alias("has_lineage"), declared.alias("transformations"))
    )
    return ok.select(
        "event_id",
        joined("transformations").alias("transformations"),
        F.col("has_lineage").alias("verified"),
        F.lit(None).cast("string").alias("reason"),
    ).unionByName(
        rejected.select("event_id", joined("transformations").alias("transformations"), F.lit(False).alias("verified"), "reason")
    )


@query("public_event_redaction")
def _public_event_redaction(v: Views) -> DataFrame:
    return chain.public_event_redaction(v.session_events).select(
        "event_id",
        "session_id",
        "sequence",
        "event_type",
        text.iso_utc(F.col("occurred_at")).alias("occurred_at"),
        "ai_used",
        F.col("location.level").alias("location_level"),
        F.col("location.public_summary").alias("location_summary"),
    )
