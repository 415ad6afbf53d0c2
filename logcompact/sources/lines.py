"""Captured console output as ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logcompact.operators.ordered import BEFORE, CHUNK, beside
from logcompact.session import staged


def text_lines(text: Column) -> Column:
    """Lines of a text: cut at newlines, without a carriage return at their end or a phantom last one."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, lambda line: F.regexp_replace(line, r"\r\z", ""))


def split_lines(texts: DataFrame, run_id: str = "run_id", text: str = "text") -> DataFrame:
    """Lines (run_id, line_no from 1, text) of a table with one captured text per run."""
    return texts.select(
        F.col(run_id).cast("bigint").alias("run_id"),
        F.posexplode(text_lines(F.col(text))).alias("line_no", "text"),
    ).withColumn("line_no", F.col("line_no").cast("bigint") + 1)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of captured files: (run_id, line_no, text, file), a run per file.

    Files are split between tasks. A line's number is its place inside its split plus the lines of
    the splits before it, so a file of any size is numbered without passing through one task.
    """
    rows = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias(CHUNK),
            F.monotonically_increasing_id().alias("_seq"),
            F.regexp_replace("value", r"\r\z", "").alias("text"),
        )
    )
    # Another scan may cut the files elsewhere, so the cuts are fixed by writing the rows once.
    rows = staged(rows, "captured")
    parts = rows.groupBy("file", CHUNK).agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_low"))
    parts = parts.withColumn(
        "_base", F.expr(f"coalesce(sum(_n) OVER (PARTITION BY file ORDER BY {CHUNK} {BEFORE}), 0L)")
    )
    return rows.join(beside(staged(parts, "splits")), ["file", CHUNK]).select(
        F.xxhash64("file").alias("run_id"),
        (F.col("_base") + F.col("_seq") - F.col("_low") + 1).alias("line_no"),
        "text",
        "file",
    )
