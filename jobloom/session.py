"""Session settings and the shared-storage helpers every operator uses."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "jobloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``, and without that name raises: its machines share no folder of their own
    choice. On one machine, as in tests, a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name the folder that the cluster's machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="jobloom-"))
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from the written rows, which cuts its lineage.

    Readers get the table's true size, so a small one is read in few tasks and the planner broadcasts it by its size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_in = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete ``settle``'s tables once nothing reads them any more."""
    for df in tables:
        remove(df.sparkSession, df.settled_in)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
