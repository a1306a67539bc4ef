"""Tables, shared scratch folders and tokens that the other modules use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset a temporary folder serves on a local master (tests); on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quaystone-"))
    return root.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM, for any Hadoop file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def type_of_path(spark: SparkSession):
    """The JVM's class of paths."""
    return spark._jvm.org.apache.hadoop.fs.Path


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    fs, where = hadoop_path(spark, path)
    fs.delete(where, True)


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that a reader sees whole or not at all: it is written under another name and renamed."""
    fs, where = hadoop_path(spark, path)
    _, temporary = hadoop_path(spark, f"{where.getParent()}/_{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    fs.rename(temporary, where)


def token(*keys: str | Column) -> Column:
    """60-bit token of a key, the same in other engines: the first 15 hex digits of its MD5."""
    text = F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
