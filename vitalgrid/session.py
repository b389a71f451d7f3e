"""Session settings and the shared folder used for cut lineage and staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "vitalgrid", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs assume.

    Nothing here fixes the physical plan: AQE picks join strategies, merges small
    shuffle partitions and splits skewed ones from run-time sizes.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        # Call-site capture costs several gateway calls per Column; plans here have thousands.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is made only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="vitalgrid-")
    return _LOCAL_DIRS[context.applicationId]


_STAGES: dict[str, str] = {}


def staging_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path in this application's part of the shared folder, which goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _STAGES:
        folder = os.path.join(shared_dir(spark), f"stages-{app}-{uuid.uuid4().hex[:8]}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _STAGES[app] = folder
    return os.path.join(_STAGES[app], f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the frame to the shared folder and read it back.

    A written table survives the loss of any executor, unlike a cached or locally
    checkpointed one.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
