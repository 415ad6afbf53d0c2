"""Whole runs from raw output to compacted output and history."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcompact.functions.commands import is_excluded, is_security
from logcompact.functions.registry import attach_profile
from logcompact.functions.text import detect_kind
from logcompact.operators.blocks import compact_lines
from logcompact.operators.caps import MAX_GREP_HITS, MAX_STACK_FRAMES, cap_rows
from logcompact.operators.loops import loop_guard
from logcompact.operators.ordered import CHUNK, CHUNK_ROWS, attach, beside, chunked
from logcompact.operators.reports import (
    place,
    summarize_junit,
    summarize_tap,
    summarize_test_events,
)
from logcompact.operators.rules import (
    apply_project_rules,
    apply_rules,
    drop_blank,
    match_rule,
)
from logcompact.operators.savings import run_savings
from logcompact.session import scratch_path, staged
from logcompact.sources.control import ProjectRule, Rule


KINDS = ("plain", "junit", "tap", "ndjson")


def run_kinds(lines: DataFrame) -> DataFrame:
    """Report format of each run, told from its first line: (run_id, kind).

    The format rides in the low bits of the line number, so the least number brings it along in a
    hash aggregation; taking the first text itself would sort all lines.
    """
    kind = detect_kind(F.col("text"))
    code = F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1
    least = F.min(F.col("line_no") * len(KINDS) + code)
    first = lines.groupBy("run_id").agg(F.pmod(least, F.lit(len(KINDS))).cast("int").alias("_code"))
    return first.select("run_id", F.get(F.array(*map(F.lit, KINDS)), F.col("_code")).alias("kind"))


def compact_plain(
    runs: DataFrame,
    lines: DataFrame,
    project_rules: Sequence[ProjectRule] = (),
    blanks: bool = False,
    max_stack: int = MAX_STACK_FRAMES,
    max_grep: int = MAX_GREP_HITS,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Compact plain output: (run_id, pos, kind, n, sample, text), ordered by pos in each run.

    Blank lines are removed first, so that an error block usually lasts to the end of its run;
    ``blanks`` keeps them, so that two of them close it.
    """
    profiles = attach_profile(runs.select("run_id", "command")).select("run_id", "profile")
    lines = chunked(lines.select("run_id", "line_no", "text"), "line_no", size)
    if not blanks:
        lines = drop_blank(lines)
    lines = attach(apply_project_rules(lines, project_rules), profiles).drop(CHUNK)
    folded = staged(compact_lines(lines, size), "folded")
    return cap_rows(folded, max_stack, max_grep, 2 * size)


def route_runs(
    runs: DataFrame,
    lines: DataFrame,
    rules: Sequence[Rule] = (),
    excluded: Sequence[str] = (),
) -> DataFrame:
    """Choose each run's branch: (run_id, rule, kind, bypassed, branch).

    A run is bypassed for a security word, an excluded command, a retry loop or its own no_filter
    flag; otherwise a rule takes it, then the format of its first line decides.
    """
    loops = loop_guard(runs, excluded=tuple(excluded)).where("loop").select(
        "run_id", F.lit(True).alias("_loop")
    )
    routed = (
        match_rule(runs, rules)
        .join(beside(loops), "run_id", "left")
        .join(beside(run_kinds(lines)), "run_id", "left")
        .withColumn("no_filter", F.coalesce("_loop", F.lit(False)) | F.coalesce("no_filter", F.lit(False)))
    )
    return with_branch(routed, excluded).select("run_id", "rule", "kind", "bypassed", "branch")


def with_branch(runs: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Add ``bypassed`` and ``branch`` to runs with command, args, no_filter, rule and kind (null without lines)."""
    bypassed = (
        is_security(F.col("command"), F.col("args"))
        | is_excluded(F.col("command"), excluded)
        | F.coalesce("no_filter", F.lit(False))
    )
    runs = runs.withColumn("kind", F.coalesce("kind", F.lit("plain"))).withColumn("bypassed", bypassed)
    branch = (
        F.when(F.col("bypassed"), "bypass")
        .when(F.col("rule").isNotNull(), "rule")
        .otherwise(F.col("kind"))
    )
    return runs.withColumn("branch", branch)


class Compacted(NamedTuple):
    """``lines``: (run_id, place, text), ordered by place in each run; ``history`` has run_id."""

    lines: DataFrame
    history: DataFrame


def compact(
    runs: DataFrame,
    lines: DataFrame,
    rules: Sequence[Rule] = (),
    project_rules: Sequence[ProjectRule] = (),
    excluded: Sequence[str] = (),
    max_stack: int = MAX_STACK_FRAMES,
    max_grep: int = MAX_GREP_HITS,
    size: int = CHUNK_ROWS,
) -> Compacted:
    """Compact every run by the branch it takes, and record what that saved."""
    # Runs may be a grouping of all lines, and four steps read them.
    runs = staged(runs, "runs")
    routes = staged(route_runs(runs, lines, rules, excluded), "routes")
    # At most six names; a branch that no run takes is left out of the plan.
    branches = {row["branch"] for row in routes.select("branch").distinct().collect()}
    facts = runs.select("run_id", "command").join(beside(routes), "run_id")
    # One copy of the lines with their branch, laid out by branch: each branch reads only its own.
    lined = attach(chunked(lines.select("run_id", "line_no", "text"), "line_no", size), routes.select("run_id", "branch"))
    raw = lined.where("branch IS NOT NULL").withColumn("text", F.coalesce("text", F.lit(""))).drop(CHUNK)
    routed = by_branch(raw)

    def taken(branch: str) -> tuple[DataFrame, DataFrame]:
        chosen = facts.where(F.col("branch") == branch)
        return chosen, routed.where(F.col("branch") == branch).drop("branch")

    through = []
    if "plain" in branches:
        plain_runs, plain = taken("plain")
        profiles = attach_profile(plain_runs.select("run_id", "command")).select("run_id", "profile")
        plain = apply_project_rules(drop_blank(plain), project_rules)
        profiled = attach(chunked(plain, "line_no", size), profiles).drop(CHUNK)
        through.append(compact_lines(profiled, size).select("run_id", "pos", "text"))
    if "bypass" in branches:
        # Bypassed runs skip the filters, yet their listings, hits and frames are capped all the same.
        bypass = taken("bypass")[1]
        through.append(bypass.select("run_id", (F.col("line_no") * 2).alias("pos"), "text"))
    parts = []
    if through:
        capped = cap_rows(staged(_union(through), "folded"), max_stack, max_grep, 2 * size)
        parts.append(capped.select("run_id", place("pos"), "text"))
    if "rule" in branches:
        ruled_runs, ruled = taken("rule")
        by_rules = apply_rules(ruled_runs.select("run_id", "rule"), ruled, rules, size)
        parts.append(by_rules.select("run_id", place("pos"), "text"))
    if "ndjson" in branches:
        parts.append(summarize_test_events(taken("ndjson")[1], size))
    if "tap" in branches:
        parts.append(summarize_tap(taken("tap")[1], size))
    if "junit" in branches:
        parts.append(summarize_junit(taken("junit")[1], size))
    if not parts:
        parts.append(routed.where("false").select("run_id", place("line_no"), "text"))
    out = staged(_union(parts), "compacted")
    history = run_savings(runs.join(beside(routes.select("run_id", "bypassed")), "run_id"), lines, out)
    return Compacted(out, history)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def by_branch(lines: DataFrame) -> DataFrame:
    """Stage the lines in one folder per branch, so that a filter on it prunes files."""
    spark = lines.sparkSession
    path = scratch_path(spark, "routed")
    lines.write.partitionBy("branch").parquet(path)
    return spark.read.schema(lines.schema).parquet(path)
