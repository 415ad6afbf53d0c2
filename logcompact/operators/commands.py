"""Verdicts on command strings, and the saving a command family reaches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcompact.functions.commands import (
    DENIED_COMMANDS,
    IGNORED_COMMANDS,
    OWN_NAMES,
    basename,
    has_shell_meta,
    is_interactive,
    normalize_command,
)
from logcompact.functions.registry import registry_table
from logcompact.functions.text import trim_space

ALLOW, PASS_THROUGH, DENY = 0, 1, 2


def classify_commands(
    commands: DataFrame, column: str = "command_line", own_names: Sequence[str] = OWN_NAMES
) -> DataFrame:
    """Add the verdict on each command string: 0 allow, 1 pass through, 2 deny.

    Also adds ``normalized`` (without sudo and directory for allowed commands, otherwise the
    trimmed string) and the ``category`` and ``typical_pct`` of known commands.
    """
    table = registry_table(commands.sparkSession).selectExpr(
        "base AS _base", "category", "interactive AS _interactive", "savings_pct AS typical_pct"
    )
    text = trim_space(F.col(column))
    split = commands.withColumn("_text", text).withColumn("_call", normalize_command(F.col("_text")))
    split = split.withColumn("_base", F.col("_call.base"))
    known = split.join(F.broadcast(table), "_base", "left")
    passed = [*IGNORED_COMMANDS, *own_names]
    interactive = is_interactive(F.col("_call.args"), F.col("_interactive"))
    verdict = (
        F.when(F.col("_text") == "", PASS_THROUGH)
        .when(has_shell_meta(F.col("_text")), PASS_THROUGH)
        .when(F.col("_base").isin(passed), PASS_THROUGH)
        .when(F.col("_base").isin(list(DENIED_COMMANDS)), DENY)
        .when(F.col("category").isNull(), PASS_THROUGH)
        .when(interactive, PASS_THROUGH)
        .otherwise(ALLOW)
    )
    normal = F.concat(
        F.col("_call.env_prefix"),
        F.concat_ws(" ", F.col("_base"), F.nullif(F.col("_call.args"), F.lit(""))),
    )
    return (
        known.withColumn("verdict", verdict)
        .withColumn("normalized", F.when(F.col("verdict") == ALLOW, normal).otherwise(F.col("_text")))
        .drop("_text", "_call", "_base", "_interactive")
    )


def registry_coverage(history: DataFrame) -> DataFrame:
    """Actual against typical saving per category of the registry.

    History is first brought down to one row per command, so the join sees few rows.
    """
    per_command = history.groupBy("cmd").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("saved_tokens").alias("saved_tokens"),
        F.sum("savings_pct").alias("_pct"),
    )
    table = registry_table(history.sparkSession).select("base", "category", "savings_pct")
    joined = per_command.withColumn("base", basename(F.col("cmd"))).join(F.broadcast(table), "base")
    return joined.groupBy("category").agg(
        F.sum("runs").alias("runs"),
        F.sum("saved_tokens").alias("saved_tokens"),
        F.round(F.sum("_pct") / F.sum("runs"), 1).alias("actual_pct"),
        F.round(F.sum(F.col("savings_pct") * F.col("runs")) / F.sum("runs"), 1).alias("typical_pct"),
    )
