"""What the operators share: words, documents and ranks that no single task has to count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logcompact.session import Scratch

#: The white space that divides words: space, and tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], scratch: Scratch, out: str = "rank") -> DataFrame:
    """Rank from 0 within `keys` by `order`, with no task holding a whole key.

    Rows are laid out by range over (keys, order), so a key of any size spreads over tasks. A row's rank is its place
    in its task plus the rows of the same key in the tasks before, which takes one small row per key and task. `df` is
    read twice (once to sample the ranges): give a staged table. Ties of the whole order get any of their ranks.
    """
    spark = df.sparkSession
    columns = df.columns
    laid = df.repartitionByRange(parallelism(spark), *keys, *order).sortWithinPartitions(*keys, *order)
    laid = scratch.write(laid.withColumn("_at", F.monotonically_increasing_id()), "ranks")
    laid = laid.withColumn("_task", F.shiftright("_at", 33))
    parts = laid.groupBy(*keys, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_task")) - F.col("_n")
    names = {k: f"_of_{i}" for i, k in enumerate([*keys, "_task"])}
    parts = parts.select(*[F.col(k).alias(v) for k, v in names.items()], (F.col("_first") - before).alias("_shift"))
    meet = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()])
    return laid.join(parts, meet).select(*columns, (F.col("_at") - F.col("_shift")).alias(out))
