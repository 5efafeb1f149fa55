"""Raw tag maps: first tag, groups, sections, audio names, flattening, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import media

# Tag group prefixes.
EXIF_GROUPS = ["EXIF", "IFD0", "IFD1", "MAKERNOTES", "EXIFIFD", "SUBIFD"]
IPTC_GROUPS = ["IPTC"]
AUDIO_GROUPS = ["ID3", "ID3V1", "ID3V2", "VORBIS", "APE", "MPC"]

# Audio frame or tag name -> friendly name.
AUDIO_NAMES = {
    "title": ["tit2", "title"],
    "artist": ["tpe1", "artist"],
    "album": ["talb", "album"],
    "genre": ["tcon", "genre"],
    "year": ["tdrc", "tyer", "date", "year"],
    "track": ["trck", "tracknumber", "track"],
    "comment": ["comm", "comment"],
    "album_artist": ["tpe2", "albumartist"],
    "composer": ["tcom", "composer"],
}

# Candidate tag names per normalised field, in order of preference.
SECTION_TAGS = {
    "technical": {
        "format": ["format", "filetype", "fileformat"],
        "codec": ["compression", "audiocodec", "videocodec", "codec"],
        "container": ["container", "majorbrand", "filetypeextension"],
        "duration": ["duration", "length", "playduration"],
        "bitrate": ["bitrate", "audiobitrate", "avgbitrate"],
        "width": ["imagewidth", "exifimagewidth", "width"],
        "height": ["imageheight", "exifimageheight", "height"],
        "sample_rate": ["sample_rate", "samplerate", "audiosamplerate"],
        "channels": ["channels", "audiochannels", "channelmode"],
    },
    "container": {
        "format": ["filetype", "format", "fileformat"],
        "major_brand": ["majorbrand"],
        "mime_type": ["mimetype"],
        "extension": ["filetypeextension"],
    },
    "timestamps": {
        "created": ["createdate", "datetimeoriginal", "exif datetimeoriginal", "creationdate", "/creationdate"],
        "modified": ["modifydate", "image datetime", "filemodifydate", "/moddate"],
        "encoded": ["encodetime", "mediacreatedate"],
        "digitized": ["datetimedigitized", "exif datetimedigitized", "digitalcreationdatetime"],
        "timezone": ["timezone", "offsettime", "offsettimeoriginal"],
    },
    "camera": {
        "make": ["make", "image make", "cameramake"],
        "model": ["model", "image model", "cameramodel"],
        "lens": ["lensmodel", "lens", "lensinfo"],
        "iso": ["iso", "isospeed", "exif isospeedratings"],
        "aperture": ["aperture", "fnumber", "exif fnumber"],
        "shutter": ["shutterspeed", "exposuretime", "exif exposuretime"],
        "focal_length": ["focallength", "exif focallength"],
    },
    "gps": {
        "position": ["gpsposition"],
        "latitude": ["gpslatitude", "gps gpslatitude"],
        "longitude": ["gpslongitude", "gps gpslongitude"],
        "altitude": ["gpsaltitude", "gps gpsaltitude"],
        "country": ["country", "countrycode", "gpscountry"],
        "city": ["city", "sub-location"],
    },
    "copyright": {
        "creator": ["creator", "artist", "author", "/author", "by-line"],
        "copyright": ["copyright", "rights", "copyrightnotice"],
        "license": ["license", "usageterms", "webstatement"],
        "publisher": ["publisher", "credit", "source"],
    },
    "software": {
        "editing_software": ["software", "image software", "creatortool", "/creator", "processingsoftware"],
        "encoder": ["encoder", "encodedby", "encodingtool"],
        "export_application": ["applicationname", "producer", "/producer", "hostcomputer"],
    },
    "codec": {
        "any_audio": ["audiocodec", "codec", "audioformat", "compression"],
        "audio": ["audiocodec"],
        "any_video": ["videocodec", "compressorid", "compression"],
        "compression": ["compression"],
    },
}


def _last_wins(entries: Column) -> Column:
    """Map of entries whose keys may repeat; a later entry replaces an earlier one."""
    kept = F.filter(
        entries,
        lambda e, at: ~F.exists(
            F.slice(entries, at + 2, F.greatest(F.size(entries) - at, F.lit(0))), lambda o: o["key"] == e["key"]
        ),
    )
    return F.map_from_entries(kept)


def tag_lookup(tags: Column) -> Column:
    """struct(exact, tail): tags by lower-case key, and by the part after the last colon.

    Built once per row; every candidate name is then a map lookup.
    """
    lowered = F.transform(
        F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )
    exact = F.map_filter(_last_wins(lowered), lambda _, value: F.coalesce(value, F.lit("")) != "")
    tails = F.transform(
        F.map_entries(exact),
        lambda e: F.struct(F.substring_index(e["key"], ":", -1).alias("key"), e["value"].alias("value")),
    )
    first = F.filter(tails, lambda e, at: ~F.exists(F.slice(tails, 1, at), lambda o: o["key"] == e["key"]))
    return F.struct(exact.alias("exact"), F.map_from_entries(first).alias("tail"))


def first_tag(lookup: str, names: list[str]) -> Column:
    """First non-empty value among the names: the exact key, else a key ending in ``:name``."""
    candidates = []
    for name in names:
        for kind in ("exact", "tail"):
            candidates.append(F.try_element_at(F.col(f"{lookup}.{kind}"), F.lit(name.lower())))
    return F.coalesce(*candidates)


def tag_group_partition(tags: Column) -> Column:
    """struct(exif, iptc, xmp, audio_tags) of maps without their group prefix."""
    grouped = F.filter(F.map_entries(tags), lambda e: e["key"].contains(":"))
    group = lambda e: F.upper(F.substring_index(e["key"], ":", 1))

    def block(belongs) -> Column:
        own = F.transform(
            F.filter(grouped, belongs),
            lambda e: F.struct(
                F.regexp_replace(e["key"], "^[^:]*:", "").alias("key"),
                e["value"].alias("value"),
            ),
        )
        return _last_wins(own)

    return F.struct(
        block(lambda e: group(e).isin(EXIF_GROUPS)).alias("exif"),
        block(lambda e: group(e).isin(IPTC_GROUPS)).alias("iptc"),
        block(lambda e: group(e).startswith("XMP")).alias("xmp"),
        block(lambda e: group(e).isin(AUDIO_GROUPS)).alias("audio_tags"),
    )


def normalize_audio_tags(tags: Column) -> Column:
    """Nine friendly names, the first non-empty value of each, and the raw map."""
    base = lambda e: F.regexp_replace(F.lower(F.substring_index(e["key"], ":", 1)), "[^\\p{L}\\p{N}]", "")
    present = F.filter(F.map_entries(tags), lambda e: F.coalesce(e["value"], F.lit("")) != "")

    def first_of(keys: list[str]) -> Column:
        return F.try_element_at(F.filter(present, lambda e: base(e).isin(keys)), F.lit(1))["value"]

    named = [first_of(keys).alias(name) for name, keys in AUDIO_NAMES.items()]
    return F.struct(*named, tags.alias("raw"))


def normalize_sections(df: DataFrame, tags: str, extension: str, mime: str) -> DataFrame:
    """Add the eight sections that are read from raw tags."""
    df = df.withColumn("__tags", tag_lookup(F.col(tags)))
    ext, kind = F.nullif(F.col(extension), F.lit("")), F.col(mime)
    found = {
        section: {field: first_tag("__tags", names) for field, names in fields.items()}
        for section, fields in SECTION_TAGS.items()
    }
    technical, container, gps, codec = (found[s] for s in ("technical", "container", "gps", "codec"))
    width, height = technical.pop("width"), technical.pop("height")
    technical["resolution"] = F.concat(width, F.lit("x"), height)
    technical["format"] = F.coalesce(technical["format"], F.upper(ext))
    container["format"] = F.coalesce(container["format"], F.upper(ext))
    container["mime_type"] = F.coalesce(container["mime_type"], kind)
    container["extension"] = F.coalesce(container["extension"], ext)
    both = gps["latitude"].isNotNull() & gps["longitude"].isNotNull()
    gps["gps"] = F.coalesce(gps.pop("position"), both.cast("string"))
    gps["coordinates"] = F.when(
        both, F.struct(gps["latitude"].alias("latitude"), gps["longitude"].alias("longitude"))
    )
    is_audio = ext.isin(list(media.AUDIO_TYPES)) | kind.startswith("audio/")
    is_video = ext.isin(list(media.VIDEO_TYPES)) | kind.startswith("video/")
    codec["audio"] = F.when(is_audio, codec.pop("any_audio")).otherwise(codec["audio"])
    codec["video"] = F.when(is_video, codec.pop("any_video"))
    return df.withColumns(
        {
            section: F.struct(*[value.alias(field) for field, value in fields.items()])
            for section, fields in found.items()
        }
    ).drop("__tags")


def nesting(document: Column) -> Column:
    """Depth of the containers of a JSON text, by its brackets outside strings."""
    bare = F.regexp_replace(document, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    # of neighbours that hold nothing one is enough
    lone = F.regexp_replace(F.regexp_replace(bare, r"[^\[\]{}]++", ""), r"(?:\{\}|\[\])(?=\{\}|\[\])", "")
    brackets = F.split(lone, "")
    step = lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    walked = F.aggregate(
        brackets,
        start,
        lambda at, c: F.struct(
            (at["now"] + step(c)).alias("now"), F.greatest(at["most"], at["now"] + step(c)).alias("most")
        ),
    )
    return walked["most"]


def levels_of(document: Column) -> Column:
    """An array with an element for each level of a JSON text; empty for null."""
    return F.array_repeat(F.lit(0), F.coalesce(nesting(document), F.lit(0)))


PLACE = "array<struct<path: string, node: variant>>"


def _members(place: Column) -> Column:
    """Members of an object or list with their paths; of anything else none."""
    get = F.try_variant_get
    named = F.map_entries(get(place["node"], "$", "map<string, variant>"))
    before = F.when(place["path"] == "", "").otherwise(F.concat(place["path"], F.lit(".")))
    step = lambda i: F.concat(place["path"], F.lit("["), i.cast("string"), F.lit("]"))
    by_name = F.transform(named, lambda e: F.struct(F.concat(before, e["key"]).alias("path"), e["value"].alias("node")))
    items = get(place["node"], "$", "array<variant>")
    by_place = F.transform(items, lambda v, i: F.struct(step(i).alias("path"), v.alias("node")))
    return F.coalesce(by_name.cast(PLACE), by_place.cast(PLACE), F.array().cast(PLACE))


def flatten_nested(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path, value) of every leaf of a JSON document, like ``a.b[0].c``.

    One fold opens a document level by level, as often as this document is deep,
    and keeps the leaves of each level; a document is one row, so there is no
    shuffle and no look at the data before.  Containers without members, nulls
    and texts that are no JSON container have no leaves.
    """
    shape = lambda c: F.schema_of_variant(c)
    opens = lambda c: F.coalesce(shape(c).startswith("OBJECT") | shape(c).startswith("ARRAY"), F.lit(False))
    leaf = "array<struct<path: string, value: string>>"

    def opened(at: Column, _: Column) -> Column:
        below = F.flatten(F.transform(at["level"], _members))
        inner = F.filter(below, lambda p: opens(p["node"]))
        ends = F.transform(
            F.filter(below, lambda p: ~opens(p["node"])),
            lambda p: F.struct(p["path"].alias("path"), F.try_variant_get(p["node"], "$", "string").alias("value")),
        )
        return F.struct(inner.cast(PLACE).alias("level"), F.concat(at["leaves"], ends.cast(leaf)).alias("leaves"))

    root = F.array(F.struct(F.lit("").alias("path"), F.try_parse_json(document).alias("node"))).cast(PLACE)
    start = F.struct(root.alias("level"), F.array().cast(leaf).alias("leaves"))
    leaves = F.aggregate(levels_of(F.col(document)), start, opened)["leaves"]
    return df.select(key, F.explode(leaves).alias("leaf")).select(key, "leaf.path", "leaf.value")


def canonical_struct(col: Column, kind: T.DataType) -> Column:
    """Same value with alphabetical fields and leaves as text."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.struct(*[canonical_struct(col.getField(f.name), f.dataType).alias(f.name) for f in fields])
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(col))
        return F.map_from_entries(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: canonical_struct(x, kind.elementType))
    return col.cast("string")


# Sections of the normalised layer.
NORMALIZED_SECTIONS = [
    "file", "technical", "codec", "container", "timestamps", "camera", "gps", "location",
    "copyright", "software", "audio_tags", "exif", "iptc", "xmp", "hashes",
]


def layer_split(df: DataFrame, envelope: list[str]) -> DataFrame:
    """Raw, normalised and derived layers; the derived one carries the digest."""
    sections = [s for s in sorted(NORMALIZED_SECTIONS) if s in df.columns]
    normalized = F.struct(
        *[canonical_struct(F.col(s), df.schema[s].dataType).alias(s) for s in sections]
    )
    digest = F.sha2(F.to_json(normalized, {"ignoreNullFields": "false"}), 256)
    rest = [c for c in df.columns if c not in {*NORMALIZED_SECTIONS, *envelope, "raw_tags", "derived"}]
    return df.select(
        *rest,
        F.col("raw_tags").alias("raw"),
        F.struct(*sections).alias("normalized"),
        F.struct(*envelope, digest.alias("metadata_sha256")).alias("derived"),
    )
