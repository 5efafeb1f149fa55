"""File name to media type and family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Supported extensions per family, with their media types.
IMAGE_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "heic": "image/heic",
    "heif": "image/heif",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "webp": "image/webp",
}
VIDEO_TYPES = {
    "mp4": "video/mp4",
    "mov": "video/quicktime",
    "avi": "video/x-msvideo",
    "mkv": "video/x-matroska",
}
AUDIO_TYPES = {
    "mp3": "audio/mpeg",
    "wav": "audio/x-wav",
    "aif": "audio/aiff",
    "aiff": "audio/aiff",
    "flac": "audio/flac",
    "aac": "audio/aac",
    "m4a": "audio/mp4",
}
DOCUMENT_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
FAMILIES = {"image": IMAGE_TYPES, "video": VIDEO_TYPES, "audio": AUDIO_TYPES, "document": DOCUMENT_TYPES}
UNKNOWN_TYPE = "application/octet-stream"


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def extension(name: Column) -> Column:
    """Lower-case text after the last dot, or an empty string."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def guessed_type(name: Column) -> Column:
    known = {ext: mime for types in FAMILIES.values() for ext, mime in types.items()}
    return F.try_element_at(literal_map(known), extension(name))


def classify_media(name: Column, mime: Column) -> Column:
    """struct(extension, mime_type, supported, family)."""
    families = {ext: family for family, types in FAMILIES.items() for ext in types}
    family = F.try_element_at(literal_map(families), extension(name))
    given = F.nullif(mime, F.lit(""))
    return F.struct(
        extension(name).alias("extension"),
        F.coalesce(given, guessed_type(name), F.lit(UNKNOWN_TYPE)).alias("mime_type"),
        family.isNotNull().alias("supported"),
        family.alias("family"),
    )
