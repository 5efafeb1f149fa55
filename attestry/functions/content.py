"""Two "has content" tests over nested values, generated from the type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _content(col: Column, kind: T.DataType, false_counts: bool) -> Column:
    if isinstance(kind, T.StructType):
        parts = [_content(col.getField(f.name), f.dataType, false_counts) for f in kind.fields]
        found = F.lit(False)
        for part in parts:
            found = found | part
        return F.coalesce(col.isNotNull() & found, F.lit(False))
    if isinstance(kind, T.ArrayType):
        found = F.exists(col, lambda x: _content(x, kind.elementType, false_counts))
    elif isinstance(kind, T.MapType):
        found = F.exists(F.map_values(col), lambda x: _content(x, kind.valueType, false_counts))
    elif isinstance(kind, T.StringType):
        found = F.trim(col) != ""
    elif isinstance(kind, T.BooleanType) and not false_counts:
        found = col
    else:
        found = col.isNotNull()
    return F.coalesce(found, F.lit(False))


def populated(df: DataFrame, name: str) -> Column:
    """True if the column holds any content; a stored False is content."""
    return _content(F.col(name), df.schema[name].dataType, True)


def meaningful(df: DataFrame, name: str) -> Column:
    """As ``populated``, but False alone is no content."""
    return _content(F.col(name), df.schema[name].dataType, False)
