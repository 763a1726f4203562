"""Session settings and the shared scratch / checkpoint location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "hexrisk", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is tuned for; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one is made only for a local master."""
    sc = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if not base:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        base = tempfile.mkdtemp(prefix="hexrisk-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder."""
    return os.path.join(shared_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex}")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path as it knows it; any scheme that Spark can read works."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``scratch_path`` named, once nothing reads it any more."""
    if not path.startswith(os.path.join(shared_dir(spark), "scratch") + "/"):
        raise ValueError(f"{path} is no scratch folder")
    fs, folder = file_system(spark, path)
    fs.delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so a lost executor costs no recomputation chain."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written to a scratch folder and read back: later plans know its size, and a lost executor costs nothing.

    ``by`` names its last columns, if filters on them shall read only what they ask for.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
