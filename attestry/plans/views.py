"""Registry tables derived from the driver's tables.

Every view is a formula over one driver table (FIXTURES.md, part C), with the
defects the integrity operators have to find.  Child tables refer to their
asset by ``asset_id``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import digests, text
from attestry.operators import chain, matching, ordering
from attestry.session import stored

MAC_KEY = b"registry-signing-key"
SEGMENTS_PER_RESPONSE = 1024


def _case(index: Column, values: list) -> Column:
    """values[index] as a chain of whens; None stays null."""
    out = None
    for position, value in enumerate(values):
        out = (out if out is not None else F).when(index == position, F.lit(value))
    return out


def _text_when(condition: Column, value) -> Column:
    return F.when(condition, value if isinstance(value, Column) else F.lit(value))


class Views:
    """Lazy DataFrames over one driver folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # V1 ---------------------------------------------------------------
    @cached_property
    def assets(self) -> DataFrame:
        i = F.col("doc_id")
        forms = [
            "human_creative_direction",
            "human_editing_present",
            "human_arrangement_present",
            "human_lyrics_present",
            "human_performance_present",
            "human_transformation_present",
        ]
        base = self.table("documents").select(
            i,
            F.col("source").alias("tenant_id"),
            F.sha2("text", 256).alias("sha256"),
            F.md5("text").alias("md5"),
            F.octet_length("text").cast("long").alias("file_size_bytes"),
        )
        kind = i % 4
        return base.select(
            i,
            "tenant_id",
            "sha256",
            "md5",
            digests.asset_uid(F.col("tenant_id"), F.col("sha256")).alias("asset_uid"),
            F.concat(F.lit("as-"), i.cast("string")).alias("asset_id"),
            F.concat(
                F.lit("file-"), i.cast("string"), F.lit("."), _case(kind, ["txt", "jpg", "pdf", "wav"])
            ).alias("filename"),
            _case(kind, ["text/plain", "image/jpeg", "application/pdf", "audio/x-wav"]).alias("file_type"),
            _case(kind, ["txt", "jpg", "pdf", "wav"]).alias("extension"),
            F.when(i % 6 != 5, _case(kind, ["text", "image", "application", "audio"])).alias("asset_type"),
            "file_size_bytes",
            F.when(i % 43 != 0, F.col("sha256")).alias("second_fingerprint"),
            _text_when(kind == 1, F.substring("md5", 1, 16)).alias("phash"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=i)).alias(
                "created_at"
            ),
            F.when(i % 7 == 0, F.lit(None))
            .when(i % 11 == 0, F.lit("   "))
            .otherwise(F.concat(F.lit("Creator "), (i % 23).cast("string")))
            .alias("creator_name"),
            F.when(i % 5 != 0, F.concat(F.lit("Owner "), (i % 31).cast("string"))).alias("copyright_owner"),
            F.when(i % 4 != 0, F.concat(F.lit("License "), (i % 3).cast("string"))).alias("license_type"),
            _case(i % 6, ["human", "ai", "mixed", "unknown", None, "AI_GENERATED"]).alias("ai_disclosure_raw"),
            _case(
                i % 6, ["human", "ai_generated", "ai_assisted", "unknown", None, "ai_generated"]
            ).alias("ai_disclosure"),
            F.when(i % 3 == 0, F.array(F.lit("tool-a"))).otherwise(F.array().cast("array<string>")).alias("ai_tools"),
            F.when(i % 9 != 0, (i * 37 % 101) / F.lit(100.0)).alias("ai_detection_score"),
            *[
                F.when((i + j) % 4 != 0, (i + j) % 3 == 0).alias(name)
                for j, name in enumerate(forms, start=1)
            ],
            F.when(i % 10 != 0, i % 3 == 0).alias("ai_disclosure_complete"),
            F.when(i % 5 != 0, i % 2 == 0).alias("ai_modification_by_human"),
            F.when(i % 8 == 0, F.lit("  "))
            .otherwise(F.concat(F.lit(" Summary "), (i % 13).cast("string")))
            .alias("human_authorship_summary"),
            (i % 2 == 0).alias("watermark_applied"),
            (i % 4 == 0).alias("watermark_visible"),
            F.when(i % 12 != 0, i % 6 == 2).alias("watermark_invisible"),
            F.when(i % 14 != 0, i % 5).cast("int").alias("total_verifications"),
            ((i * 53 % 101) / F.lit(100.0)).alias("trust_score"),
            _case(kind, ["unverified", "human_verified", "ai_assisted", "synthetic"]).alias("content_label"),
            _case(i % 5, ['["declared","hashed"]', "[]", "{broken", None, '{"not":"list"}']).alias("label_reasons"),
            ((i * 29 % 101) / F.lit(100.0)).alias("copyright_readiness_score"),
            _case(kind, ["strong", "moderate", "limited", "insufficient"]).alias("copyright_readiness_label"),
            _case(kind, ["standard", "hybrid_authorship", "live_split", "ai_assisted"]).alias("certificate_class"),
            F.when(i % 10 != 0, F.concat(F.lit("manifests/"), i.cast("string"))).alias("manifest_path"),
            F.concat(F.lit("registry/"), i.cast("string")).alias("registry_url"),
        )

    @cached_property
    def registered(self) -> DataFrame:
        """Lowest document per content identity."""
        return ordering.first_per_key(self.assets, ["asset_uid"], [F.col("doc_id")])

    @cached_property
    def manifests(self) -> DataFrame:
        """Manifest copy of the asset facts, with drifting owners."""
        i = F.col("doc_id")
        return self.assets.where("manifest_path is not null").select(
            "asset_id",
            "tenant_id",
            "asset_uid",
            F.when(i % 47 == 0, F.lit("renamed.bin")).otherwise(F.col("filename")).alias("filename"),
            F.when(i % 59 == 0, F.lit(None)).otherwise(F.col("sha256")).alias("sha256"),
            F.when(i % 61 == 0, F.lit("00")).otherwise(F.col("second_fingerprint")).alias("second_fingerprint"),
            "phash",
            "creator_name",
            F.when(i % 13 == 0, F.concat(F.coalesce("copyright_owner", F.lit("")), F.lit(" changed")))
            .otherwise(F.col("copyright_owner"))
            .alias("copyright_owner"),
            "license_type",
            "ai_disclosure",
            (F.col("trust_score") + F.when(i % 67 == 0, 0.01).otherwise(0.00001)).alias("trust_score"),
            "content_label",
        )

    # V2 ---------------------------------------------------------------
    @cached_property
    def metadata(self) -> DataFrame:
        i = F.col("doc_id")
        created = F.concat(F.when(i % 29 == 0, "2999").otherwise("2024"), F.lit(":06:01 12:00:00"))
        modified = F.when(i % 6 == 0, "2024:01:01 08:00:00").otherwise("2024:07:01 08:00:00")
        make = F.when(i % 2 != 0, F.lit("Canon"))
        latitude = F.when(i % 31 == 0, F.lit(95.0)).when(i % 3 == 0, F.lit(48.5))
        longitude = F.when(i % 4 != 0, F.lit(2.25))
        creator = text.clean_text(F.col("creator_name"))
        software = F.when(i % 14 == 0, F.lit("Adobe Photoshop")).when(i % 5 == 0, F.lit("Studio"))
        byline = F.when(i % 9 == 0, F.lit("Desk"))
        title = F.when(i % 4 == 3, F.concat(F.lit("Song "), i.cast("string")))
        dated = i % 8 != 0
        raw = F.map_filter(
            F.create_map(
                F.lit("EXIF:Make"), make,
                F.lit("IPTC:By-line"), byline,
                F.lit("XMP-dc:Creator"), creator,
                F.lit("ID3:Title"), title,
                F.lit("GPS:GPSLatitude"), F.when(i % 5 == 0, F.lit("48.5")),
                F.lit("EXIF:CreateDate"), F.when(dated, created),
                F.lit("File:ImageWidth"), F.when(i % 4 == 1, F.lit("640")),
                F.lit("File:ImageHeight"), F.when(i % 4 == 1, F.lit("480")),
                F.lit("Software"), software,
            ),
            lambda _, value: value.isNotNull(),
        )
        one_tag = lambda name, value: F.map_filter(
            F.create_map(F.lit(name), value), lambda _, v: v.isNotNull()
        )
        sha = F.when(i % 19 == 0, F.lit(None)).when(i % 23 == 0, F.lit("abc123")).otherwise(F.col("sha256"))
        return self.assets.select(
            "doc_id",
            "asset_id",
            "asset_uid",
            "tenant_id",
            F.struct(
                F.col("file_type").alias("mime_type"),
                "extension",
                F.col("file_size_bytes").alias("size"),
                "sha256",
            ).alias("file"),
            F.struct(
                F.upper("extension").alias("format"),
                F.when(i % 17 == 0, F.lit("image/png")).otherwise(F.col("file_type")).alias("mime_type"),
                F.when(i % 37 == 0, F.lit("png")).otherwise(F.col("extension")).alias("extension"),
            ).alias("container"),
            F.struct(sha.alias("sha256"), F.when(i % 41 != 0, F.col("md5")).alias("md5")).alias("hashes"),
            F.struct(
                F.when(dated, created).alias("created"),
                F.when(dated, modified).alias("modified"),
                F.lit(None).cast("string").alias("encoded"),
                F.when(dated & (i % 10 == 0), F.lit("2024:06:01 12:00:00")).alias("digitized"),
            ).alias("timestamps"),
            F.struct(make.alias("make"), F.when(i % 6 == 1, F.lit("EOS")).alias("model")).alias("camera"),
            F.struct(F.lit(False).alias("gps"), latitude.alias("latitude"), longitude.alias("longitude")).alias("gps"),
            F.struct(
                creator.alias("creator"),
                F.when(i % 3 == 0, F.lit("(c) 2024")).alias("copyright"),
            ).alias("copyright"),
            F.struct(
                software.alias("editing_software"), F.lit(None).cast("string").alias("export_application")
            ).alias("software"),
            F.struct(F.upper("extension").alias("format")).alias("technical"),
            F.struct(F.when(i % 4 == 3, F.lit("PCM")).alias("audio")).alias("codec"),
            one_tag("Make", make).alias("exif"),
            one_tag("By-line", byline).alias("iptc"),
            one_tag("creator", creator).alias("xmp"),
            F.struct(title.alias("title"), F.when(i % 8 == 3, F.lit("Singer")).alias("artist")).alias("audio_tags"),
            raw.alias("raw_tags"),
            F.struct(
                F.when(i % 27 != 0, F.sha2(F.concat_ws("|", "asset_uid", "filename"), 256)).alias("metadata_sha256")
            ).alias("derived"),
        )

    # V2e --------------------------------------------------------------
    @cached_property
    def provenance_events(self) -> DataFrame:
        e = F.col("event_id")
        event_type = F.coalesce(
            F.element_at(
                F.create_map(
                    *[
                        F.lit(x)
                        for pair in {
                            "signup": "upload",
                            "view": "verify",
                            "click": "watermark",
                            "purchase": "certificate_issued",
                            "error": "refresh",
                        }.items()
                        for x in pair
                    ]
                ),
                F.col("event_type"),
            ),
            F.lit("other"),
        )
        rows = self.table("events").select(
            "event_id",
            F.concat(F.lit("as-"), F.col("user_id").cast("string")).alias("asset_id"),
            event_type.alias("event_type"),
            F.col("ts").alias("timestamp"),
            F.when(e % 3 == 0, F.concat(F.lit("step "), F.col("props"))).alias("description"),
            F.when(e % 4 != 0, F.concat(F.lit("tool-"), (e % 4).cast("string"))).alias("tool_used"),
            _case(e % 3, ["human", "ai", "system"]).alias("human_or_ai"),
            F.concat(F.lit("actor-"), (e % 17).cast("string")).alias("actor_name"),
        )
        digest = provenance_event_digest()
        return rows.withColumn(
            "event_hash",
            F.when(e % 101 == 0, F.lit(None))
            .when(e % 997 == 0, F.lit("0" * 64))
            .otherwise(digest),
        )

    # V3 ---------------------------------------------------------------
    @cached_property
    def session_inputs(self) -> DataFrame:
        """Submitted session events, numbered, before hashes are assigned."""
        return self._session_inputs(self.table("events"))

    def _session_inputs(self, events: DataFrame) -> DataFrame:
        """Numbered events of whole sessions."""
        u, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("int")
        numbered = ordering.with_position(
            events,
            ["user_id"],
            ordering.hour_of("ts"),
            [F.col("ts"), F.col("event_id")],
            "sequence",
        )
        kind = (
            F.when(F.col("sequence") == 1, "session_started")
            .when(F.col("event_type") == "signup", "source_captured")
            .when(F.col("event_type") == "view", "work_saved")
            .when(F.col("event_type") == "click", "work_exported")
            .when(F.col("event_type") == "purchase", "ai_tool_disclosed")
            .otherwise("asset_registered")
        )
        return numbered.select(
            "event_id",
            u,
            F.concat(F.lit("S-"), u.cast("string")).alias("session_id"),
            F.concat(F.lit("src"), (u % 20).cast("string")).alias("tenant_id"),
            F.concat(F.lit("as-"), u.cast("string")).alias("asset_id"),
            "sequence",
            kind.alias("event_type"),
            F.col("ts").alias("occurred_at"),
            F.col("ts").alias("recorded_at"),
            F.lit("web").alias("source_type"),
            F.concat(F.lit("Studio "), (F.col("event_id") % 5).cast("string")).alias("source_name"),
            F.concat(F.lit("creator-"), u.cast("string")).alias("creator_id"),
            k.alias("k"),
            F.when(kind == "ai_tool_disclosed", k % 2 == 0).alias("ai_used"),
            F.when(kind == "session_started", _case(u % 4, ["private", "proof", "public", None])).alias("privacy_mode"),
            F.when(
                kind == "session_started", _case(u % 3, ["none", "coarse", "precise_private"])
            ).alias("location_level"),
            F.when(
                (kind == "session_started") & (u % 3 == 1) & (u % 2 == 0),
                F.concat(F.lit("Region "), (u % 7).cast("string")),
            ).alias("location_summary"),
            F.col("props").alias("payload"),
        )

    @cached_property
    def session_chain(self) -> DataFrame:
        """Session events with their hash links, before any tampering.

        Stored once, as a registry stores its events; sessions and checks read it.
        """
        return stored(chain.chain_build(self.stored_session_inputs), "session-chain")

    @cached_property
    def stored_session_inputs(self) -> DataFrame:
        """The numbered events as a stored table, for queries that read them several times."""
        return stored(self.session_inputs, "session-inputs")

    @cached_property
    def session_events(self) -> DataFrame:
        """Stored session events, with changed payloads and removed events."""
        return self._changed_events(self.session_chain)

    @cached_property
    def known_session_chain(self) -> DataFrame:
        """Linked events of the sessions of known assets, and of few others.

        A session belongs to one asset, so most events of unknown ones leave
        before they are numbered and linked.
        """
        events = self._likely(self.table("events"), F.col("user_id"))
        return stored(chain.chain_build(stored(self._session_inputs(events), "session-inputs")), "session-chain")

    @cached_property
    def known_session_events(self) -> DataFrame:
        return self._changed_events(self.known_session_chain)

    def _likely(self, rows: DataFrame, number: Column) -> DataFrame:
        """Most rows of unknown assets left out, by the number of the asset."""
        asset = F.concat(F.lit("as-"), number.cast("string"))
        known = self.assets.select(F.col("asset_id").alias("__asset"))
        return matching.likely_members(rows.withColumn("__asset", asset), "__asset", known).drop("__asset")

    def _changed_events(self, events: DataFrame) -> DataFrame:
        u, seq = F.col("user_id"), F.col("sequence")
        return self._left_events(events).withColumn(
            "payload",
            F.when((u % 10 == 0) & (seq == 3), F.lit('{"k": 999}')).otherwise(F.col("payload")),
        )

    def _left_events(self, events: DataFrame) -> DataFrame:
        return events.where(~((F.col("user_id") % 15 == 0) & (F.col("sequence") == 2)))

    @cached_property
    def unlinked_events(self) -> DataFrame:
        """Stored session events without their hash links, for work that checks no chain."""
        return self._left_events(self.stored_session_inputs)

    @cached_property
    def workflow_events(self) -> DataFrame:
        """Session events whose payload carries workflow checkpoints."""
        k, u = F.col("k"), F.col("user_id")
        point = _case(
            k % 6,
            [
                "automatic_project_revision",
                "automatic_audio_export",
                "source_asset_linked",
                "human_transformation_declared",
                "automatic_project_detected",
                None,
            ],
        )
        is_start = F.col("sequence") == 1
        device = F.struct(
            F.concat(F.lit(" Device "), (k % 4).cast("string")).alias("name"),
            F.when(k % 8 < 4, F.lit("keyboard")).alias("category"),
        )
        payload = F.struct(
            point.alias("checkpoint"),
            F.when(is_start, _case(u % 3, ["Studio", "Auto detect", "Other"])).alias("workflow"),
            F.when(is_start & (u % 2 == 0), F.lit("Workstation")).alias("daw_name"),
            F.when(k % 6 == 4, F.array(device, F.struct(F.lit(" ").alias("name"), F.lit("x").alias("category")))).alias(
                "connected_production_hardware"
            ),
            F.when(
                k % 6 == 4, F.array(F.concat(F.lit("App "), (k % 3).cast("string")), F.lit(" App 0 "))
            ).alias("process_only_environments"),
            F.when(k % 6 == 2, F.concat(F.lit("AU-"), k.cast("string"))).alias("source_asset_uid"),
            F.when(k % 6 == 2, k % 4 == 0).alias("history_mutated"),
            F.when(
                (k % 6 == 3) & (k % 5 != 0), F.array(F.lit("edited"), F.concat(F.lit("t"), (k % 4).cast("string")))
            ).alias("transformations"),
            F.when((k % 6 == 3) & (k % 2 == 1), F.concat(F.lit("statement "), k.cast("string"))).alias("statement"),
            F.when(k % 3 == 0, F.concat(F.lit("final "), k.cast("string"))).alias("final_provenance_disclosure"),
        )
        return self.session_inputs.withColumn("payload", F.to_json(payload))

    @cached_property
    def sessions(self) -> DataFrame:
        return self._sessions(self.session_chain, F.max_by("evidence_hash", "sequence"))

    @cached_property
    def known_sessions(self) -> DataFrame:
        return self._sessions(self.known_session_chain, F.max_by("evidence_hash", "sequence"))

    @cached_property
    def unlinked_sessions(self) -> DataFrame:
        """The sessions without the head of their chain."""
        return self._sessions(self.stored_session_inputs, F.lit(None).cast("string"))

    def _sessions(self, events: DataFrame, head: Column) -> DataFrame:
        u = F.col("user_id")
        return (
            events.groupBy("user_id", "session_id", "tenant_id", "asset_id")
            .agg(
                head.alias("head"),
                F.min("occurred_at").alias("started_at"),
                F.max("occurred_at").alias("last_at"),
            )
            .select(
                u,
                "session_id",
                "tenant_id",
                "asset_id",
                F.when(u % 8 == 0, "recording")
                .when(u % 5 == 1, "incomplete")
                .when(u % 10 == 0, "integrity_failed")
                .otherwise("complete")
                .alias("status"),
                F.when(u % 25 == 0, F.lit("f" * 64)).otherwise(F.col("head")).alias("current_hash"),
                "started_at",
                F.col("started_at").alias("created_at"),
                F.when(u % 8 != 0, F.col("last_at")).alias("closed_at"),
            )
        )

    # V4 ---------------------------------------------------------------
    @cached_property
    def observations(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            F.col("event_id").alias("observation_id"),
            F.concat(F.lit("as-"), F.col("user_id").cast("string")).alias("asset_id"),
            F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("tenant_id"),
            F.when(F.col("event_type").isin("view", "click"), F.lit("Sightengine "))
            .when(F.col("event_type").isin("signup", "purchase"), F.lit("hive"))
            .otherwise(F.lit("  "))
            .alias("provider"),
            F.when(e % 3 == 0, F.lit("genai"))
            .otherwise(F.concat(F.lit("m"), (e % 2).cast("string")))
            .alias("model"),
            F.lit("synthetic_media_probability").alias("signal"),
            F.when(e % 53 == 0, F.lit("bad"))
            .when(e % 61 == 0, F.lit("0.5f"))
            .when(e % 67 == 0, F.lit(" 5d"))
            .otherwise(F.format_string("%.4f", F.col("value") / 100))
            .alias("probability"),
            F.when(e % 59 == 0, F.lit("degraded")).alias("status"),
            F.col("props").alias("details"),
            F.col("ts").alias("observed_at"),
        )

    # V5 ---------------------------------------------------------------
    @cached_property
    def split_rows(self) -> DataFrame:
        """Split-sheet rows, one per order line, with the sheet's defects."""
        return self._split_rows(self.table("lineitem").where("l_orderkey is not null"))

    def _split_rows(self, lines: DataFrame) -> DataFrame:
        """Split rows of the lines of whole orders."""
        key = F.col("l_orderkey")
        order = [
            F.col(c)
            for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
        ]
        numbered = ordering.ordered(
            lines,
            ["l_orderkey"],
            F.struct("l_linenumber", F.floor(F.col("l_partkey") / 1024).alias("part_range")),
            order,
            position="position",
            total={"total": F.col("l_extendedprice")},
        )
        share = text.rounded(F.lit(100.0) * F.col("l_extendedprice") / F.col("total"), 4)
        first = F.col("position") == 1
        name = F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))
        return numbered.select(
            key.alias("sheet_id"),
            F.concat(F.lit("as-"), key.cast("string")).alias("asset_id"),
            F.concat_ws("-", key.cast("string"), F.col("position").cast("string")).alias("contributor_id"),
            "position",
            F.when(first & (key % 41 == 0), F.lit("  "))
            .when(F.col("position") % 2 == 0, F.concat(F.lit("  "), F.upper(name), F.lit(" ")))
            .otherwise(name)
            .alias("sheet_name"),
            name.alias("name"),
            _case(F.col("position") % 3, ["Producer", None, "Writer"]).alias("role"),
            F.when(F.col("l_returnflag") == "R", "ai").otherwise("human").alias("contribution_type"),
            F.when(first & (key % 33 == 0), F.lit(None))
            .when(first & (key % 20 == 0), share + 1)
            .otherwise(share)
            .alias("ownership_split_pct"),
            text.rounded(F.col("l_discount") * 100, 2).alias("creative_contribution_pct"),
            F.when(first, F.lit(0.0)).otherwise(text.rounded(F.col("l_tax") * 100, 2)).alias("ai_assisted_pct"),
            F.col("l_shipdate").alias("added_at"),
        )

    @cached_property
    def stored_split_rows(self) -> DataFrame:
        """The same rows as a stored table, for queries that read them several times."""
        return stored(self.split_rows, "split-rows")

    @cached_property
    def known_split_rows(self) -> DataFrame:
        """Stored split rows of known assets.

        A sheet belongs to one asset, so the lines of unknown ones leave before the
        ordered pass instead of after it.
        """
        asset = F.concat(F.lit("as-"), F.col("l_orderkey").cast("string"))
        known = self.assets.select(F.col("asset_id").alias("__asset"))
        lines = self._likely(self.table("lineitem").where("l_orderkey is not null"), F.col("l_orderkey")).withColumn("__asset", asset)
        return stored(self._split_rows(lines.join(known, "__asset", "left_semi").drop("__asset")), "known-split-rows")

    @cached_property
    def split_sessions(self) -> DataFrame:
        return self._split_sessions(self.stored_split_rows)

    @cached_property
    def known_split_sessions(self) -> DataFrame:
        """The split documents of known assets, stored as they are read several times."""
        return stored(self._split_sessions(self.known_split_rows), "known-split-sessions")

    def _split_sessions(self, rows: DataFrame) -> DataFrame:
        """Locked split documents; a sheet continues in a new one every 256 rows."""
        row = F.struct(
            "position",
            F.col("sheet_name").alias("name"),
            "role",
            "contribution_type",
            F.format_string("%.4f", "ownership_split_pct").alias("ownership_split_pct"),
            F.when(F.col("position") % 2 == 0, F.lit("wallet")).alias("wallet_address"),
        )
        return (
            rows.withColumn("volume", F.floor((F.col("position") - 1) / 256))
            .groupBy("sheet_id", "asset_id", "volume")
            .agg(F.to_json(F.array_sort(F.collect_list(row))).alias("body"))
            .select(
                F.concat_ws("-", F.lit("LS"), F.col("sheet_id").cast("string"), F.col("volume").cast("string")).alias(
                    "session_id"
                ),
                "sheet_id",
                "asset_id",
                F.when(F.col("sheet_id") % 3 == 0, "open").when(F.col("sheet_id") % 3 == 1, "locked").otherwise("finalized").alias("status"),
                F.when(F.col("sheet_id") % 19 == 0, F.lit("{broken")).otherwise(F.col("body")).alias("contributors_json"),
                F.when(F.col("sheet_id") % 7 != 0, F.sha2("body", 256)).alias("session_hash"),
            )
        )

    # V6 ---------------------------------------------------------------
    @cached_property
    def certificates(self) -> DataFrame:
        from attestry.operators import certificates as certs

        k = F.col("o_orderkey")
        rows = (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                k,
                F.concat(F.lit("ct-"), k.cast("string")).alias("cert_id"),
                F.concat(F.lit("as-"), F.col("o_custkey").cast("string")).alias("asset_id"),
                F.concat(F.lit("src"), F.col("c_nationkey").cast("string")).alias("tenant_id"),
                F.col("o_orderdate").alias("issued_at"),
                F.col("c_name").alias("subject_name"),
                F.col("c_name").alias("creator_name"),
                F.col("o_orderpriority").alias("certificate_class"),
                F.concat(F.lit("Owner "), (F.col("o_custkey") % 31).cast("string")).alias("copyright_owner"),
                F.concat(F.lit("file-"), F.col("o_custkey").cast("string")).alias("filename"),
            )
        )
        signed = certs.lock_and_sign(rows, MAC_KEY, "key-1")
        owner = F.when(k % 50 == 0, F.lit("Someone else")).otherwise(F.col("metadata_lock.copyright_owner"))
        return signed.withColumn(
            "metadata_lock", F.col("metadata_lock").withField("copyright_owner", owner)
        ).withColumn(
            "signature",
            F.when(k % 70 == 0, F.reverse("signature")).otherwise(F.col("signature")),
        )

    # V7 ---------------------------------------------------------------
    @cached_property
    def verification_logs(self) -> DataFrame:
        e = F.col("event_id")
        rows = self.table("events").select(
            F.concat(F.lit("lg-"), e.cast("string")).alias("log_id"),
            e,
            F.concat(F.lit("as-"), F.col("user_id").cast("string")).alias("asset_id"),
            F.when(F.col("event_type") == "view", "file_hash")
            .when(F.col("event_type") == "click", "asset_id")
            .otherwise("manifest")
            .alias("check_type"),
            _case(e % 3, ["pass", "warning", "fail"]).alias("result"),
            F.col("props").alias("details"),
            F.col("ts").alias("timestamp"),
        )
        return rows.withColumn(
            "log_hash",
            F.when(e % 499 == 0, F.lit("0" * 64)).otherwise(verification_log_digest()),
        )

    @cached_property
    def verification_counters(self) -> DataFrame:
        """Stored counters: the true count, one too many for every sixth asset."""
        return (
            self.table("events")
            .groupBy("user_id")
            .agg(F.count_if(F.col("event_type").isin("view", "click")).alias("n"))
            .select(
                F.concat(F.lit("as-"), F.col("user_id").cast("string")).alias("asset_id"),
                (F.col("n") + F.when(F.col("user_id") % 6 == 0, 1).otherwise(0)).alias("total_verifications"),
            )
        )

    # V8 ---------------------------------------------------------------
    @cached_property
    def detector_responses(self) -> DataFrame:
        """One nested response per user and run of event ids.

        A run spans SEGMENTS_PER_RESPONSE ids, so no response holds more
        segments than that, however many events one user has.
        """
        k = F.get_json_object("props", "$.k").cast("int")
        score = lambda name, value: F.struct(F.lit(name).alias("class"), value.alias("score"))
        segment = F.struct(
            F.col("event_id").alias("at"),
            F.array(
                score("ai_generated", F.format_string("%.4f", F.col("value") / 100)),
                score(" Suno ", F.format_string("%.2f", k / 100)),
                score("udio", F.format_string("%.2f", (k * 7 % 100) / 100)),
                score("other", F.lit("n/a")),
                score("ai_generated_music", F.when(k % 2 == 0, F.format_string("%.2f", k / 100)).otherwise("bad")),
                score(
                    "ai_generated_music_cover",
                    F.when(k % 5 == 0, F.format_string("%.2f", (k * 3 % 100) / 100)).otherwise("bad"),
                ),
            ).alias("classes"),
        )
        grouped = (
            self.table("events")
            .withColumn("run", F.floor(F.col("event_id") / SEGMENTS_PER_RESPONSE))
            .groupBy("user_id", "run")
            .agg(F.array_sort(F.collect_list(segment)).alias("output"))
        )
        plain = F.to_json(F.struct(F.array(F.struct(F.struct("output").alias("response"))).alias("status")))
        # every other run nests its rows elsewhere, and one class row lies apart
        apart = F.struct(F.lit("AI_generated ").alias("class"), F.lit("0.9995").alias("score"))
        deep = F.to_json(
            F.struct(
                F.struct(F.array(F.array(F.struct(F.struct("output").alias("page")))).alias("pages")).alias("result"),
                F.array(F.struct(F.struct(apart.alias("note")).alias("inner"))).alias("extra"),
            )
        )
        body = F.when(F.col("run") % 2 == 1, deep).otherwise(plain)
        return grouped.select(
            F.concat_ws(":", F.col("user_id").cast("string"), F.col("run").cast("string")).alias("response_id"),
            F.concat(F.lit("as-"), F.col("user_id").cast("string")).alias("asset_id"),
            body.alias("response"),
        )

    @cached_property
    def manifest_stores(self) -> DataFrame:
        """Content-credential stores as JSON text, one per asset."""
        i = F.col("doc_id")
        label = F.concat(F.lit("m"), i.cast("string"))
        snake = i % 2 == 0
        key = F.when(snake, "active_manifest").otherwise("activeManifest")
        success = F.when(i % 9 == 0, "false").otherwise("true")
        active = F.when(i % 12 == 0, "null").otherwise(F.concat(F.lit('"'), label, F.lit('"')))
        store = F.concat(
            F.lit('{"'), key, F.lit('":'), active,
            F.lit(',"validation_status":["claim.seen",{"code":"c'), (i % 3).cast("string"),
            F.lit('","success":'), success, F.lit('},"claim.seen"],"manifests":{"'), label,
            F.lit('":{"claim_generator":"gen-'), (i % 4).cast("string"),
            F.lit('","title":"t","ingredients":['), F.when(i % 5 == 0, "{}").otherwise(""),
            F.lit('],"assertions":[{"label":"c2pa.actions","data":{"actions":[{"action":"c2pa.created"},'),
            F.lit('{"action":"a'), (i % 6).cast("string"),
            F.lit('"},{"note":"none"}]}},{"label":"hash","data":{"actions":[{"action":"hidden"}]}}],'),
            F.lit('"validation_status":[{"code":"c'), (i % 3).cast("string"),
            F.lit('","success":'), success, F.lit("}]}}}"),
        )
        return self.assets.select("doc_id", "asset_id", store.alias("store"))

    # V9 ---------------------------------------------------------------
    @cached_property
    def applications(self) -> DataFrame:
        i = F.col("c_custkey")
        return self.table("customer").select(
            i.alias("application_id"),
            F.concat(F.lit("C"), (i % 1000).cast("string"), F.lit("@Example.com")).alias("email"),
            _case(i % 5, ["founder", "creator", "label", "enterprise", "gold"]).alias("plan"),
            F.col("c_name").alias("company_name"),
        )

    # V10 --------------------------------------------------------------
    @cached_property
    def passports(self) -> DataFrame:
        from attestry.functions import passports as pp

        i = F.col("p_partkey")
        body = F.lpad(i.cast("string"), 13, "0")
        check = (pp.gtin_check_digit(body) + F.when(i % 10 == 0, 1).otherwise(0)) % 10
        gtin = F.concat(body, check.cast("string"))
        return self.table("part").select(
            i,
            F.concat(F.lit("pp-"), i.cast("string")).alias("passport_id"),
            F.concat(F.lit("as-"), i.cast("string")).alias("asset_id"),
            F.when(i % 21 == 0, F.concat(F.substring(gtin, 1, 6), F.lit("X"), F.substring(gtin, 8, 7)))
            .when(i % 13 == 0, F.concat(F.lit(" "), gtin, F.lit(" ")))
            .otherwise(gtin)
            .alias("gtin14"),
            F.when(i % 44 == 0, F.lit("  "))
            .when(i % 30 == 0, F.rpad(F.concat(F.lit("SN-"), i.cast("string")), 21, "9"))
            .when(i % 7 == 0, F.concat(F.lit("SN "), i.cast("string"), F.lit("/~*é")))
            .when(i % 53 == 0, F.concat(F.lit("SN\t"), i.cast("string")))
            .otherwise(F.concat(F.lit("SN-"), i.cast("string")))
            .alias("serial_number"),
            _case(F.col("p_size") % 5, ["qr", "data_matrix", "nfc", "other", None]).alias("data_carrier_type"),
            F.when(i % 17 == 0, "batch").otherwise("item").alias("passport_level"),
            F.col("p_brand").alias("brand_name"),
            F.col("p_name").alias("product_name"),
        )


def provenance_event_digest() -> Column:
    return digests.record_digest(
        {
            "event_id": F.col("event_id"),
            "asset_id": F.col("asset_id"),
            "event_type": F.col("event_type"),
            "timestamp": text.iso_utc(F.col("timestamp")),
            "tool_used": F.col("tool_used"),
            "description": F.col("description"),
            "human_or_ai": F.col("human_or_ai"),
            "actor_name": F.col("actor_name"),
        }
    )


def verification_log_digest() -> Column:
    return digests.record_digest(
        {
            "log_id": F.col("log_id"),
            "asset_id": F.col("asset_id"),
            "check_type": F.col("check_type"),
            "result": F.col("result"),
            "details": F.col("details"),
            "timestamp": text.iso_utc(F.col("timestamp")),
        }
    )
