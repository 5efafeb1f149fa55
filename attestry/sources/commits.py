"""Datasets that readers see by a commit log.

Rows go to a folder of their own; then one line of the log names it.  A writer
that is lost half-way leaves a folder which no line names, so readers keep what
was there.  Nothing is deleted or replaced: the last line of a name holds.  One
writer at a time is assumed for each name; of two, the later line wins whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "name string, version long, load string"


def _log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the log; none where nothing has been committed."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LINE)
    return spark.read.schema(LINE).json(f"{path}/log")


def commit(rows: DataFrame, path: str, name: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Write rows as the new content of ``name`` (``column=value``), then say so."""
    spark = rows.sparkSession
    load = uuid.uuid4().hex
    rows.write.partitionBy(*by).format(kind).save(f"{path}/data/{name}/load={load}")
    version = _log(spark, path).where(F.col("name") == name).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
    spark.range(1).select(
        F.lit(name).alias("name"), F.lit(version).cast("long").alias("version"), F.lit(load).alias("load")
    ).coalesce(1).write.mode("append").json(f"{path}/log")


def committed(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """Rows of the last commit of every name; ``schema`` has the folder columns as well.

    The list of folders, one of each name, is read by the driver as any
    partition list is.
    """
    last = _log(spark, path).groupBy("name").agg(F.max_by("load", F.struct("version", "load")).alias("load"))
    folders = [f"{path}/data/{r['name']}/load={r['load']}" for r in last.collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{path}/data")
    return reader.format(kind).load(folders)
