"""Published versions of a table in the shared folder: written aside, made public by one atomic step, and never changed.

A version is a pointer, a small file that names a folder of data. The data are written first, under a name of their own;
the pointer is written aside as well and then renamed, which fails if the version is there already. So a writer that dies
leaves folders that nothing names, and of two writers one publishes and the other sees what is published.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.session import remove


class PublishedConflict(ValueError):
    """A version that is published differs from what was to be loaded under its name."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _pointer(root: str, version: str) -> str:
    if not version or any(c in version for c in "/\\:") or version.startswith((".", "_")):
        raise ValueError(f"no version name: {version!r}")
    return f"{root.rstrip('/')}/versions/{version}"


def is_published(spark: SparkSession, root: str, version: str) -> bool:
    at = _path(spark, _pointer(root, version))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The rows of a published version."""
    at = _path(spark, _pointer(root, version))
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return spark.read.parquet(f"{root.rstrip('/')}/data/{name}")


def _publish(df: DataFrame, root: str, version: str) -> bool:
    """Whether this writer published ``df``; false if another did meanwhile."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{root.rstrip('/')}/data/{name}")
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    aside, at = _path(spark, f"{root.rstrip('/')}/aside/{name}"), _path(spark, _pointer(root, version))
    fs = at.getFileSystem(conf)
    fs.mkdirs(at.getParent())
    out = fs.create(aside, False)
    out.write(bytearray(name.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(aside, at, spark.sparkContext._gateway.new_array(rename, 0))
    except Py4JJavaError as failed:
        if not failed.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
            raise
        fs.delete(aside, False)
        remove(spark, f"{root.rstrip('/')}/data/{name}")
        return False
    return True


def differences(published: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, difference) of each key whose rows aren't the same on both sides: ``missing``, ``unexpected`` or ``changed``.

    Rows are compared as wholes and counted, so repeated ones must recur as often; nulls are equal to nulls. Both sides
    have the same columns in any order.
    """
    columns = sorted(expected.columns)
    if columns != sorted(published.columns):
        raise PublishedConflict(f"columns differ: {sorted(published.columns)} and {columns}")
    # The row as one struct, so that no column of the tables clashes with the counts.
    side = lambda df, sign: df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.lit(sign).alias("sign"))
    odd = side(published, 1).unionByName(side(expected, -1)).groupBy("row").agg(F.sum("sign").alias("net")).where("net <> 0")
    kind = F.when(F.min("net") > 0, "unexpected").when(F.max("net") < 0, "missing").otherwise("changed")
    told = odd.groupBy(F.struct(*[F.col("row").getField(k).alias(k) for k in keys]).alias("key")).agg(kind.alias("difference"))
    return told.select(*[F.col("key").getField(k).alias(k) for k in keys], "difference")


def load(expected: DataFrame, root: str, version: str, keys: list[str]) -> bool:
    """Publish ``expected`` as ``version`` once: true if this call did, false if the same rows were published already.

    Raises ``PublishedConflict`` with the first difference in the order of ``keys`` if other rows are published under that
    name; the published rows stay as they are.
    """
    spark = expected.sparkSession
    if not is_published(spark, root, version) and _publish(expected, root, version):
        return True
    first = differences(read(spark, root, version), expected, keys).orderBy(*keys).first()
    if first is not None:
        where = ", ".join(f"{k}={first[k]!r}" for k in keys)
        raise PublishedConflict(f"version {version} differs from what is to be loaded: row {first['difference']} ({where})")
    return False
