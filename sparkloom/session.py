"""Session factory and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that every operator here assumes: UTC, ANSI mode, adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``, or one of our own where it is unset and all is one machine.

    RuntimeError where it is unset on a cluster: a machine-local folder there would give each executor another one.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    context = spark.sparkContext
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "sparkloom-shared")
        spark.conf.set(CHECKPOINT_KEY, named)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


_runs: dict[str, str] = {}  # application id and shared folder -> folder of this application in it


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of this application that is deleted when its JVM ends."""
    shared = shared_dir(spark)
    key = f"{spark.sparkContext.applicationId} {shared}"
    if key not in _runs:
        folder = f"{shared}/sparkloom-{uuid.uuid4().hex}"
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(target)
        system.deleteOnExit(target)
        _runs[key] = folder
    return f"{_runs[key]}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it back.

    Survives the loss of executors, unlike cached or locally checkpointed blocks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

