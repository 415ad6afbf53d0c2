"""Repeated invocations of one command: the loop guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcompact.functions.commands import command_key, is_excluded, is_security
from logcompact.operators.ordered import ranged, running, streaks
from logcompact.session import staged

# Runs at most this far apart belong together; the third one is flagged.
GAP_SECONDS = 300
THRESHOLD = 3


def _series(
    runs: DataFrame,
    gap_seconds: int,
    excluded: tuple[str, ...],
    pieces: int | None,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Runs that count, numbered within their series.

    A popular command can hold a third of all runs, and most of them in one hour, so its runs are cut into ranges of about
    equal numbers of runs.
    """
    # Staged before the filter: runs may come out of a grouping by run, and the filter would look for its words in every
    # row of that grouping instead of once per run.
    counted = runs.select(
        command_key(F.col("command"), F.col("args")).alias("key"),
        "run_id",
        "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"),
        (~is_security(F.col("command"), F.col("args")) & ~is_excluded(F.col("command"), excluded)).alias("_counts"),
    )
    counted = staged(counted, "counted-runs").where("_counts").drop("_counts")
    counted = ranged(counted, ["key"], ["_at", "run_id"], "run-ranges", pieces)
    gap = int(gap_seconds * 1_000_000)
    if seed is not None:
        seed = seed.select("key", "n", F.unix_micros(F.col("ts").cast("timestamp")).alias("value"))
    return streaks(
        counted,
        ["key"],
        ["_at", "run_id"],
        "_at",
        lambda before, now: f"({now} - {before} > {gap})",
        seed,
    )


def loop_guard(
    runs: DataFrame,
    gap_seconds: int = GAP_SECONDS,
    threshold: int = THRESHOLD,
    excluded: tuple[str, ...] = (),
    pieces: int | None = None,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Count each run within its series of equal commands.

    Returns ``key, run_id, ts, count, loop``. A series ends when more than ``gap_seconds`` pass
    without the command. Runs that are bypassed for their command (security, excluded) do not
    count and are left out. ``seed`` (key, n, ts) continues series that began earlier. ``pieces`` is the number of ranges
    that all runs are cut into.
    """
    seen = _series(runs, gap_seconds, excluded, pieces, seed)
    return seen.select(
        "key", "run_id", "ts", F.col("_s_n").alias("count"), (F.col("_s_n") >= threshold).alias("loop")
    )


def loop_sessions(
    runs: DataFrame,
    gap_seconds: int = GAP_SECONDS,
    excluded: tuple[str, ...] = (),
    pieces: int | None = None,
) -> DataFrame:
    """Totals per series of equal commands: (key, start, last_ts, runs).

    Built on the numbered runs rather than on session windows, which would bring all runs of one
    command into one task.
    """
    seen = _series(runs, gap_seconds, excluded, pieces)
    seen = running(
        seen, ["key"], ["_at", "run_id"], "max", "IF(_s_n = 1, _at, NULL)", "_began"
    )
    gap = int(gap_seconds * 1_000_000)
    ends = seen.where(f"NOT _s_has_next OR _s_next - _at > {gap}")
    return ends.selectExpr(
        "key",
        "timestamp_micros(IF(_s_n = 1, _at, _began)) AS start",
        "timestamp_micros(_at) AS last_ts",
        "_s_n AS runs",
    )
