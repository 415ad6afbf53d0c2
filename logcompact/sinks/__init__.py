"""Where results go: the run history, kept raw output and the readable report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logcompact import schemas
from logcompact.operators.ordered import attach, chunked
from logcompact.operators.savings import Summary

RETAIN_MODES = ("always", "failures", "never")


def write_history(history: DataFrame, path: str, fmt: str = "json") -> None:
    """Append one record per run; false flags and empty arguments are left out of JSON."""
    names = [field.split()[0] for field in schemas.HISTORY.split(", ")]
    rows = history.select(*names)
    if fmt == "json":
        optional = {"args": F.nullif("args", F.lit(""))}
        for flag in ("bypassed", "exact_tokens"):
            optional[flag] = F.when(F.col(flag), True)
        rows = rows.withColumns(optional)
        rows.write.mode("append").option("ignoreNullFields", "true").json(path)
    else:
        rows.write.mode("append").format(fmt).save(path)


def failed_run_lines(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of runs that ended with an exit code other than zero."""
    failed = runs.where("exit_code <> 0").select("run_id", F.lit(True).alias("_failed"))
    return attach(chunked(lines), failed).where("_failed").drop("_failed", "_chunk")


def retain_raw(runs: DataFrame, lines: DataFrame, mode: str = "failures") -> DataFrame:
    """Raw lines to keep, with the run's start, exit code and date in columns."""
    if mode not in RETAIN_MODES:
        raise ValueError(f"mode must be one of {RETAIN_MODES}")
    if mode == "never":
        runs = runs.where("false")
    elif mode == "failures":
        runs = runs.where("exit_code <> 0")
    facts = runs.select(
        "run_id", F.col("ts").alias("started"), "exit_code", F.to_date("ts").alias("date")
    )
    return attach(chunked(lines), facts).where("date IS NOT NULL").drop("_chunk")


def write_raw(runs: DataFrame, lines: DataFrame, path: str, mode: str = "failures") -> None:
    retain_raw(runs, lines, mode).write.mode("append").partitionBy("date").parquet(path)


def shorten(col: Column, n: int) -> Column:
    """Cut to n bytes of text, the last replaced by an ellipsis."""
    cut = F.make_valid_utf8(F.substring(col.cast("binary"), F.lit(1), F.lit(n - 1)))
    return F.when(F.octet_length(col) > n, F.concat(cut, F.lit("…"))).otherwise(col)


def savings_report(summary: Summary) -> DataFrame:
    """The report as text rows (section, ord, text): totals, top commands, recent runs.

    Inputs are one total row and two lists cut to a few rows, so their numbering is cheap.
    """
    total = summary.totals
    facts = [
        ("Runs", F.format_number("total_runs", 0)),
        ("Tokenizer", F.when(F.col("exact_tokens"), "byte pairs").otherwise("estimate, bytes/4")),
        ("Tokens saved", F.format_number("total_saved", 0)),
        ("Mean saving", F.format_string("%.1f%%", "avg_savings_pct")),
    ]
    lines = F.array(*(F.concat(F.lit(f"{name}: "), value) for name, value in facts))
    totals = total.where("total_runs > 0").select(F.posexplode(lines).alias("ord", "text")).select(
        F.lit(1).alias("section"), (F.col("ord") + 1).cast("bigint").alias("ord"), "text"
    )
    rank = F.row_number().over
    top = summary.top.select(
        F.lit(2).alias("section"),
        rank(Window.orderBy(F.desc("total_saved"), "cmd")).cast("bigint").alias("ord"),
        F.format_string(
            "%-30s %5d runs %7.1f%% %20s tokens %8s",
            shorten(F.col("cmd"), 30),
            "runs",
            "avg_pct",
            F.format_number("total_saved", 0),
            F.format_string("%.1fs", F.col("avg_exec_ms") / 1000.0),
        ).alias("text"),
    )
    recent = summary.recent
    order = [F.desc("ts")] + ([F.desc("run_id")] if "run_id" in recent.columns else [])
    state = F.when(F.coalesce("bypassed", F.lit(False)), "not compacted").otherwise(
        F.format_string("%.1f%% saved", "savings_pct")
    )
    # The line keeps the space after a command without arguments, as it decides the cut.
    call = F.concat(F.col("cmd"), F.lit(" "), F.coalesce("args", F.lit("")))
    last = recent.select(
        F.lit(3).alias("section"),
        rank(Window.orderBy(*order)).cast("bigint").alias("ord"),
        F.format_string(
            "%s  %-28s  %-25s  %s tokens  (%dms)",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            shorten(call, 28),
            state,
            F.format_number("saved_tokens", 0),
            "exec_ms",
        ).alias("text"),
    )
    # Nothing recorded yet: one line instead of a report of zeros.
    none = total.where("total_runs = 0").select(
        F.lit(0).alias("section"), F.lit(1).cast("bigint").alias("ord"), F.lit("no runs recorded").alias("text")
    )
    return none.unionByName(totals).unionByName(top).unionByName(last)


__all__ = [
    "failed_run_lines", "retain_raw", "savings_report", "shorten", "write_history", "write_raw",
]
