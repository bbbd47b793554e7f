"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM does not compile methods above 8000 bytes; without this, wide projections such as
    # the frame decoder run interpreted inside one huge generated method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# Settings a running session cannot change.
STATIC_SETTINGS = {
    # No stack capture per Column call: it multiplies the time to build plans of many expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(app: str = "tidewake", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings every operator here relies on (UTC above all)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**STATIC_SETTINGS, **SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created, for good.

    Only the registered queries call it; operators leave a session's settings alone.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named by ``spark.checkpoint.dir``, or set as checkpoint folder."""
    named = (spark.sparkContext.getConf().get("spark.checkpoint.dir")
             or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return named


_roots: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below the shared one; the driver drops it when it ends."""
    root = os.path.join(shared_dir(spark), f"tidewake-{spark.sparkContext.applicationId}")
    if root not in _roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots.add(root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path in this application's scratch folder."""
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back; for tables read several times."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """``rows`` and what tells, once they are written, how many they were (``n``)."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), seen
