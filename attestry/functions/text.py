"""Text, number and time normalisation columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters a text strip removes.
WHITESPACE = " \t\n\r\x0b\x0c"


def stripped(col: Column) -> Column:
    return F.trim(col.cast("string"), F.lit(WHITESPACE))


def clean_text(col: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(stripped(col), F.lit(""))


# Decimal numbers as text; a cast alone would also take suffixes like 5f.
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def as_number(col: Column) -> Column:
    """Double if the text is a decimal number, else null; blank is null as well."""
    plain = stripped(col)
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def zero_safe_percentage(primary: Column, legacy: Column | None = None) -> Column:
    """Primary value, else the legacy one; a stored 0 stays 0."""
    value = primary.cast("string")
    if legacy is not None:
        value = F.coalesce(value, legacy.cast("string"))
    return as_number(value)


def rounded(col: Column, digits: int) -> Column:
    """Round half up by plain double arithmetic, the same in every engine."""
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def hex_valid(col: Column, length: int) -> Column:
    """True for exactly ``length`` hex digits after trim and lower case."""
    return F.coalesce(F.lower(stripped(col)).rlike(f"^[0-9a-f]{{{length}}}$"), F.lit(False))


def iso_utc(ts: Column) -> Column:
    """Evidence form: microseconds and a trailing Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_plain(ts: Column) -> Column:
    """Fact form: microseconds are printed only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
