"""Files as rows and submitted JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import digests


def bounded_binary_scan(
    spark: SparkSession, path: str, max_mb: int = 50, pattern: str = "*"
) -> tuple[DataFrame, DataFrame]:
    """(accepted files with digests, rejected files with reason).

    The size test is on the file listing; the reader does not open the content
    of a file it has already dropped.  A file of exactly the limit is accepted.
    """
    limit = int(max_mb) * 1024 * 1024
    if limit <= 0:
        raise ValueError("the size limit must be greater than zero")
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    name = F.substring_index("path", "/", -1).alias("name")
    place = F.col("path")
    accepted = files.where(F.col("length") <= limit).select(
        place, name, "length", "modificationTime", digests.content_digests(F.col("content")).alias("d")
    )
    rejected = files.where(F.col("length") > limit).select(
        place, name, "length", F.lit(f"file is larger than {max_mb} MB").alias("reason")
    )
    return accepted.select("path", "name", "length", "modificationTime", "d.*"), rejected


def _shape(col: Column) -> Column:
    return F.schema_of_variant(F.try_parse_json(col))


def json_object_gate(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is a JSON object, rejected with reason); blank counts as {}."""
    text = F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit("{}"))
    shape = _shape(text)
    reason = F.when(shape.isNull(), F.lit("not_json")).when(
        ~shape.startswith("OBJECT"), F.lit("not_an_object")
    )
    judged = df.withColumn(col, text).withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def json_column_decode(df: DataFrame, col: str, schema: str, default: Column) -> DataFrame:
    """Decode JSON text; null, bad JSON or another container type give the default."""
    wanted = "ARRAY" if schema.lower().startswith("array") else "OBJECT"
    usable = F.coalesce(_shape(F.col(col)).startswith(wanted), F.lit(False))
    return df.withColumn(
        col, F.coalesce(F.when(usable, F.from_json(col, schema, {"mode": "PERMISSIVE"})), default)
    )
