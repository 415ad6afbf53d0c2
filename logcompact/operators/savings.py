"""Bytes and tokens saved: per run, per command and in total."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcompact.functions.text import saved_tokens, savings_pct, tokens_of_bytes
from logcompact.operators.ordered import beside

TOP_COMMANDS = 10
RECENT_RUNS = 10


def one_decimal(col: Column) -> Column:
    """Round half away from zero to one decimal."""
    return F.signum(col) * F.floor(F.abs(col) * 10 + 0.5) / 10.0


def with_savings(history: DataFrame) -> DataFrame:
    raw, filtered = F.col("raw_tokens"), F.col("filtered_tokens")
    return history.withColumns(
        {"saved_tokens": saved_tokens(raw, filtered), "savings_pct": savings_pct(raw, filtered)}
    )


def output_bytes(lines: DataFrame, name: str) -> DataFrame:
    """Bytes of each run's lines, each with its newline."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    return lines.groupBy("run_id").agg(F.sum(size).cast("bigint").alias(name))


def run_savings(runs: DataFrame, raw_lines: DataFrame, filtered_lines: DataFrame) -> DataFrame:
    """One history row per run, with run_id, from its lines before and after compaction.

    ``bypassed`` is taken from ``runs`` where present. Runs without lines count zero bytes.
    """
    if "bypassed" not in runs.columns:
        runs = runs.withColumn("bypassed", F.lit(False))
    sizes = (
        runs.join(beside(output_bytes(raw_lines, "raw_bytes")), "run_id", "left")
        .join(beside(output_bytes(filtered_lines, "filtered_bytes")), "run_id", "left")
        .fillna(0, ["raw_bytes", "filtered_bytes"])
        .withColumn("raw_tokens", tokens_of_bytes(F.col("raw_bytes")))
        .withColumn("filtered_tokens", tokens_of_bytes(F.col("filtered_bytes")))
    )
    return with_savings(sizes).select(
        "run_id",
        "ts",
        F.col("command").alias("cmd"),
        F.coalesce("args", F.lit("")).alias("args"),
        "raw_bytes",
        "filtered_bytes",
        "raw_tokens",
        "filtered_tokens",
        "saved_tokens",
        "savings_pct",
        "exec_ms",
        "bypassed",
        F.lit(False).alias("exact_tokens"),
    )


def savings_totals(history: DataFrame) -> DataFrame:
    """One row: runs, tokens saved, mean percentage of runs that were not bypassed, all exact."""
    bypassed = F.coalesce("bypassed", F.lit(False))
    exact = F.coalesce("exact_tokens", F.lit(False))
    zero = F.lit(0).cast("bigint")
    active = F.avg(F.when(~bypassed, F.col("savings_pct")))
    return history.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.coalesce(F.sum("saved_tokens"), zero).alias("total_saved"),
        F.coalesce(one_decimal(active), F.lit(0.0)).alias("avg_savings_pct"),
        F.coalesce(F.bool_and(exact), F.lit(False)).alias("exact_tokens"),
    )


def savings_by_command(history: DataFrame) -> DataFrame:
    return history.groupBy("cmd").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("saved_tokens").alias("total_saved"),
        one_decimal(F.avg("savings_pct")).alias("avg_pct"),
        F.expr("sum(exec_ms) div count(1)").alias("avg_exec_ms"),
    )


def top_commands(history: DataFrame, n: int = TOP_COMMANDS) -> DataFrame:
    """The n commands that saved most; ties in name order."""
    return savings_by_command(history).orderBy(F.desc("total_saved"), F.asc("cmd")).limit(n)


def recent_runs(history: DataFrame, n: int = RECENT_RUNS, tie: str | None = "run_id") -> DataFrame:
    """The last n runs, newest first; ``tie`` orders runs of the same time."""
    order = [F.desc("ts")]
    if tie and tie in history.columns:
        order.append(F.desc(tie))
    return history.orderBy(*order).limit(n)


class Summary(NamedTuple):
    totals: DataFrame
    top: DataFrame
    recent: DataFrame


def savings_summary(history: DataFrame, top: int = TOP_COMMANDS, recent: int = RECENT_RUNS) -> Summary:
    return Summary(savings_totals(history), top_commands(history, top), recent_runs(history, recent))
