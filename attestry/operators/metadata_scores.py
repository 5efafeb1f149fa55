"""Metadata trust score and anomaly rules over normalised sections.

A section is a struct column; a field that a table does not have counts as
absent.  Every score is one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import content, text

# Factor weights and the sections that make metadata complete.
WEIGHTS = {
    "completeness": 25,
    "consistency": 20,
    "hash_integrity": 20,
    "container": 15,
    "creator": 10,
    "timestamps": 10,
}
COMPLETENESS_SECTIONS = [
    "file",
    "technical",
    "hashes",
    "container",
    "codec",
    "timestamps",
    "camera",
    "gps",
    "copyright",
    "software",
    "exif",
    "audio_tags",
    "xmp",
    "iptc",
]

# Accepted names of the same field, in order of preference.
EXTENSION = ["extension", "ext"]
MIME = ["mime_type", "mime"]
CREATED = ["created", "create_date", "date_created", "creation_date"]
MODIFIED = ["modified", "modify_date", "date_modified", "modification_date"]
RIGHTS_HOLDER = ["creator", "artist", "copyright_owner", "copyright", "rights", "author"]
DEVICE = ["make", "model"]
EDITOR = ["editing_software", "creator_tool", "export_application", "software"]
PERFORMER = ["artist", "album_artist", "composer"]


class Sections:
    """Field access by section and candidate names."""

    def __init__(self, df: DataFrame):
        self.df = df

    def has(self, section: str) -> bool:
        return section in self.df.columns

    def field(self, section: str, name: str) -> Column:
        kind = self.df.schema[section].dataType if self.has(section) else None
        if isinstance(kind, T.StructType) and name in kind.fieldNames():
            return F.col(section).getField(name)
        if isinstance(kind, T.MapType):
            return F.try_element_at(F.col(section), F.lit(name))
        return F.lit(None).cast("string")

    def first(self, section: str, names: list[str]) -> Column:
        return F.coalesce(*[text.clean_text(self.field(section, n)) for n in names])

    def populated(self, section: str) -> Column:
        return content.populated(self.df, section) if self.has(section) else F.lit(False)

    def meaningful(self, section: str) -> Column:
        return content.meaningful(self.df, section) if self.has(section) else F.lit(False)

    def values(self, section: str) -> list[Column]:
        kind = self.df.schema[section].dataType if self.has(section) else None
        names = kind.fieldNames() if isinstance(kind, T.StructType) else []
        return [text.clean_text(self.field(section, n)) for n in names]


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _one(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _same_text(left: Column, right: Column) -> Column:
    return _yes(F.lower(left) == F.lower(right))


def metadata_trust_score(meta: DataFrame) -> DataFrame:
    """Add overall (0..100), breakdown and the reasons per factor."""
    s = Sections(meta)
    filled = {name: s.populated(name) for name in COMPLETENESS_SECTIONS}
    missing = F.filter(
        F.array(*[F.when(~has, F.lit(name)) for name, has in filled.items()]), lambda n: n.isNotNull()
    )
    complete = (F.lit(len(filled)) - F.size(missing)) / F.lit(float(len(filled)))

    f_ext, c_ext = s.first("file", EXTENSION), s.first("container", EXTENSION)
    f_mime, c_mime = s.first("file", MIME), s.first("container", MIME)
    size = F.coalesce(s.field("file", "size").try_cast("double"), s.field("file", "size_bytes").try_cast("double"))
    both_ext, both_mime = f_ext.isNotNull() & c_ext.isNotNull(), f_mime.isNotNull() & c_mime.isNotNull()
    sha_ok = text.hex_valid(s.field("hashes", "sha256"), 64)
    failures = F.filter(
        F.array(
            F.when(both_ext & ~_same_text(f_ext, c_ext), F.lit("extension_differs")),
            F.when(both_mime & ~_same_text(f_mime, c_mime), F.lit("mime_differs")),
            F.when(~_yes(size > 0), F.lit("size_invalid")),
            F.when(~_yes(f_mime.contains("/")), F.lit("mime_invalid")),
            F.when(~sha_ok, F.lit("sha256_invalid")),
        ),
        lambda n: n.isNotNull(),
    )
    applicable = F.lit(3) + _one(both_ext) + _one(both_mime)
    consistent = (applicable - F.size(failures)) / applicable

    md5_ok = text.hex_valid(s.field("hashes", "md5"), 32)
    digest_ok = text.hex_valid(s.field("derived", "metadata_sha256"), 64)
    hashed = F.when(sha_ok, 0.5).otherwise(0.0) + F.when(md5_ok, 0.25).otherwise(0.0)
    hashed = hashed + F.when(digest_ok, 0.25).otherwise(0.0)

    coherent = _same_text(c_mime, f_mime) | _same_text(c_ext, f_ext)
    contained = F.when(c_mime.isNotNull(), 0.4).otherwise(0.0) + F.when(c_ext.isNotNull(), 0.3).otherwise(0.0)
    contained = contained + F.when(coherent, 0.3).otherwise(0.0)

    signals = {
        "copyright/creator": s.first("copyright", RIGHTS_HOLDER),
        "camera device": s.first("camera", DEVICE),
        "software/tool": s.first("software", EDITOR),
        "XMP rights": s.first("xmp", ["creator", "rights", "dc:creator", "dc:rights"]),
        "audio artist": s.first("audio_tags", PERFORMER),
    }
    attributed = F.filter(
        F.array(*[F.when(v.isNotNull(), F.lit(name)) for name, v in signals.items()]), lambda n: n.isNotNull()
    )
    creator = F.least(F.lit(1.0), F.size(attributed) / 2.0)

    created, modified = s.first("timestamps", CREATED), s.first("timestamps", MODIFIED)
    dated = F.coalesce(*s.values("timestamps"), F.lit(None).cast("string")).isNotNull()
    paired = created.isNotNull() & modified.isNotNull()
    timed = F.when(~dated, 0.0).otherwise(
        F.lit(0.5) + F.when(paired & (created <= modified), 0.5).when(paired, 0.25).otherwise(0.0)
    )
    timing = (
        F.when(~dated, "no timestamps")
        .when(~paired, "created/modified pair incomplete")
        .when(created <= modified, "created before modified")
        .otherwise("created later than modified")
    )

    fractions = {
        "completeness": complete,
        "consistency": consistent,
        "hash_integrity": F.least(F.lit(1.0), hashed),
        "container": F.least(F.lit(1.0), contained),
        "creator": creator,
        "timestamps": timed,
    }
    # whole points, halves to even
    points = {n: F.bround(fraction * WEIGHTS[n], 0).cast("int") for n, fraction in fractions.items()}
    scored = meta.withColumn("breakdown", F.struct(*[p.alias(n) for n, p in points.items()]))
    overall = sum((F.col(f"breakdown.{n}") for n in WEIGHTS), F.lit(0))
    return scored.withColumns(
        {
            "metadata_trust_score": F.greatest(F.lit(0), F.least(F.lit(100), overall)),
            "explanations": F.struct(
                missing.alias("missing_sections"),
                failures.alias("consistency_failures"),
                attributed.alias("attribution_signals"),
                timing.alias("timing"),
            ),
        }
    )


# Points per severity.
SEVERITY_POINTS = {"High": 30, "Medium": 15, "Low": 5}

# Rule -> category, severity, recommended action; the order is the output order.
ANOMALY_RULES = {
    "timestamp_order_reversed": ("Timestamp", "Medium", "check the edit history and the device clock"),
    "timestamp_future": ("Timestamp", "High", "reject or verify again"),
    "timestamp_missing": ("Timestamp", "Low", "ask for the original file if time matters"),
    "exif_stripped": ("Metadata Stripping", "High", "ask for the original capture"),
    "creator_missing": ("Creator", "Medium", "attach attribution before certification"),
    "gps_removed": ("GPS", "Low", "confirm that the location was removed on purpose"),
    "mime_mismatch": ("Container", "High", "reject or verify the file type again"),
    "extension_mismatch": ("Container", "Medium", "verify the true format"),
    "hash_missing": ("Hash", "Medium", "recompute and store the SHA-256"),
    "hash_malformed": ("Hash", "High", "recompute the affected hash"),
    "gps_impossible_coordinates": ("GPS", "High", "reject the location"),
    "gps_partial": ("GPS", "Low", "treat the location as unreliable"),
    "software_conflict": ("Software", "Medium", "investigate the origin"),
}


def metadata_anomaly_rules(meta: DataFrame, as_of_year: int, mime_type: Column | None = None) -> DataFrame:
    """Add anomaly_score (0..100), the flags in rule order and a summary."""
    s = Sections(meta)
    f_mime, c_mime = s.first("file", MIME), s.first("container", MIME)
    mime = F.lower(F.coalesce(*([text.clean_text(mime_type)] if mime_type is not None else []), f_mime, c_mime))
    image = _yes(mime.startswith("image/"))
    document = image | _yes((mime == "application/pdf") | mime.endswith("/pdf"))

    created = s.first("timestamps", ["created", "create_date", "creation_date"])
    modified = s.first("timestamps", ["modified", "modify_date", "modification_date"])

    def in_future(name: str) -> Column:
        year = F.regexp_extract(F.coalesce(s.field("timestamps", name), F.lit("")), "^([0-9]{4})", 1)
        return _yes(year.try_cast("int") > as_of_year)

    future = F.filter(
        F.array(
            *[
                F.when(in_future(n), F.lit(f"timestamps.{n}"))
                for n in ("created", "modified", "encoded", "digitized")
            ]
        ),
        lambda n: n.isNotNull(),
    )
    device = s.first("camera", DEVICE)
    signal = F.coalesce(
        device,
        s.first("copyright", RIGHTS_HOLDER),
        s.first("software", ["editing_software", "creator_tool", "software"]),
        s.first("audio_tags", PERFORMER),
    )
    lat_raw, lon_raw = s.field("gps", "latitude"), s.field("gps", "longitude")
    has_lat, has_lon = text.clean_text(lat_raw).isNotNull(), text.clean_text(lon_raw).isNotNull()
    lat, lon = text.as_number(lat_raw), text.as_number(lon_raw)
    beyond = lambda v, limit: _yes((F.abs(v) > limit) & ~F.isnan(v))
    raw_gps = (
        _yes(F.exists(F.map_keys("raw_tags"), lambda k: F.lower(k).contains("gps")))
        if s.has("raw_tags")
        else F.lit(False)
    )
    f_ext, c_ext = s.first("file", EXTENSION), s.first("container", EXTENSION)
    sha, md5 = text.clean_text(s.field("hashes", "sha256")), text.clean_text(s.field("hashes", "md5"))
    bad_hashes = F.filter(
        F.array(
            F.when(sha.isNotNull() & ~text.hex_valid(sha, 64), F.lit("hashes.sha256")),
            F.when(md5.isNotNull() & ~text.hex_valid(md5, 32), F.lit("hashes.md5")),
        ),
        lambda n: n.isNotNull(),
    )
    editor = F.lower(s.first("software", EDITOR))
    edited = _yes(editor.contains("photoshop") | editor.contains("lightroom"))
    fields = lambda *names: F.array(*[F.lit(n) for n in names])
    coordinates = fields("gps.latitude", "gps.longitude")

    fired = {
        "timestamp_order_reversed": (_yes(created > modified), fields("timestamps.created", "timestamps.modified")),
        "timestamp_future": (F.size(future) > 0, future),
        "timestamp_missing": (document & ~s.meaningful("timestamps"), fields("timestamps")),
        "exif_stripped": (
            image & ~s.meaningful("camera") & ~s.meaningful("exif") & ~s.meaningful("gps"),
            fields("camera", "exif", "gps"),
        ),
        "creator_missing": (
            signal.isNull(),
            fields("camera.make", "copyright.creator", "software.editing_software", "audio_tags.artist"),
        ),
        "gps_removed": (image & raw_gps & ~has_lat & ~has_lon, coordinates),
        "mime_mismatch": (_yes(F.lower(f_mime) != F.lower(c_mime)), fields("file.mime_type", "container.mime_type")),
        "extension_mismatch": (_yes(F.lower(f_ext) != F.lower(c_ext)), fields("file.extension", "container.extension")),
        "hash_missing": (~text.hex_valid(sha, 64), fields("hashes.sha256")),
        "hash_malformed": (F.size(bad_hashes) > 0, bad_hashes),
        "gps_impossible_coordinates": (lat.isNotNull() & (beyond(lat, 90) | beyond(lon, 180)), coordinates),
        "gps_partial": (has_lat != has_lon, coordinates),
        "software_conflict": (edited & device.isNull(), fields("software.editing_software", "camera.make")),
    }
    flags = F.filter(
        F.array(
            *[
                F.when(
                    fired[name][0],
                    F.struct(
                        F.lit(name).alias("flag"),
                        F.lit(category).alias("category"),
                        F.lit(severity).alias("severity"),
                        F.lit(SEVERITY_POINTS[severity]).alias("points"),
                        fired[name][1].alias("affected_fields"),
                        F.lit(action).alias("recommended_action"),
                    ),
                )
                for name, (category, severity, action) in ANOMALY_RULES.items()
            ]
        ),
        lambda f: f.isNotNull(),
    )
    listed = F.array_join(
        F.transform("flags", lambda f: F.concat(f["flag"], F.lit(" ("), f["severity"], F.lit(")"))), ", "
    )
    return (
        meta.withColumn("flags", flags)
        .withColumn(
            "anomaly_score",
            F.least(F.lit(100), F.aggregate("flags", F.lit(0), lambda total, f: total + f["points"])),
        )
        .withColumn(
            "anomaly_summary",
            F.when(F.size("flags") == 0, F.lit("none")).otherwise(
                F.concat(F.size("flags").cast("string"), F.lit(" flags: "), listed, F.lit("."))
            ),
        )
    )
