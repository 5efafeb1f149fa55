"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", app: str = "attestry", **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own session."""
    parallelism = str(os.cpu_count() or 8) if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    # a local session without the setting works beside its tables
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/attestry-work"


_written: list[str] = []


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder.

    Only a local session may leave ``spark.checkpoint.dir`` unset; it works in
    its warehouse folder.  ``release`` deletes what a session has written here.
    """
    path = f"{_checkpoint_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete this process's intermediate tables; results read from them must be written first."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        place.getFileSystem(conf).delete(place, True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table that is read more than once to the shared folder and read it back.

    Unlike a cache, the table outlives lost executors.  It is read once or twice
    and then deleted, so it is written small.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
