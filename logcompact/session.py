"""Shared scratch folder and staged tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only in local mode without a setting, removed at exit."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or "local-cluster" in spark.conf.get(
        "spark.master", "local"
    ):
        raise RuntimeError(f"{SETTING} must name a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="logcompact-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set(SETTING, root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(scratch_root(spark), "logcompact", f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a result once and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch data through the file system that holds it."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Staged tables of one call in one folder; `drop` frees a table that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = scratch_path(spark, name)
        self._made: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{len(self._made)}"
        self._made.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(self.spark, table._scratch)  # type: ignore[attr-defined]

    def close(self) -> None:
        remove(self.spark, self.folder)
