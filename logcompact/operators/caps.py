"""Caps on search hits and stack frames, and names instead of long directory listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcompact.functions.profiles import is_grep_hit, is_ls_long, is_stack_frame
from logcompact.functions.text import ls_name, strip_ansi
from logcompact.operators.blocks import row, unfold
from logcompact.operators.ordered import CHUNK, CHUNK_ROWS, beside, chunked, streaks, with_exprs
from logcompact.session import staged

MAX_GREP_HITS = 30
MAX_STACK_FRAMES = 5
# Rows at the end of a run sort behind every line.
END = 1 << 60
UNLIMITED = 1 << 60


def classify_for_caps(rows: DataFrame) -> DataFrame:
    """Add the kind of each row: l listing, g search hit, f stack frame, o other."""
    plain = F.col("_plain")
    kind = (
        F.when(is_ls_long(plain), "l")
        .when(is_grep_hit(plain), "g")
        .when(is_stack_frame(plain), "f")
        .otherwise("o")
    )
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("_plain", strip_ansi(F.col("text"))).withColumn("_cap", kind)


def _changed(previous: str, current: str) -> str:
    return f"{previous}.on <> {current}.on"


def _cap_streaks(
    rows: DataFrame, kind: str, limit: int, marker: str, end: int | None, seed: DataFrame | None = None
) -> DataFrame:
    """Keep the first rows of each streak of one kind and count the others.

    Adds ``_rows``, what the row turns into: itself, itself after the count of the streak before
    it, or nothing; ``_released``, true for a row right after a capped streak; and ``_on``. A
    streak at the end of a run is counted at ``end``, unless that is None. ``limit`` 0 keeps all.
    """
    limit = limit if limit > 0 else UNLIMITED
    on = f"(_cap = '{kind}')"
    seen = streaks(rows, ["run_id"], ["pos"], f"named_struct('on', {on})", _changed, seed)
    seen = with_exprs(
        seen, _on=on, _released=f"NOT {on} AND coalesce(_s_prev.on AND _s_prev_n > {limit}, false)"
    )
    itself = row("pos * 2 + 1", "line", "1", "text")
    before = row("pos * 2", marker, f"_s_prev_n - {limit}", "''")
    last = row(str(end), marker, f"_s_n - {limit}", "''")
    closing = "" if end is None else f"WHEN _on AND _s_n > {limit} AND NOT _s_has_next THEN array({last})"
    return with_exprs(
        seen,
        _rows=f"""CASE WHEN _released THEN array({before}, {itself})
                       WHEN NOT _on OR _s_n <= {limit} THEN array({itself}) {closing} END""",
    )


def _last_streak(seen: DataFrame) -> DataFrame:
    """Per run the open streak: (run_id, n, on)."""
    last = seen.groupBy("run_id").agg(F.expr("max_by(named_struct('n', _s_n, 'on', _on), pos) AS s"))
    return last.select("run_id", "s.n", "s.on")


def _seed(state: DataFrame | None, name: str) -> DataFrame | None:
    if state is None:
        return None
    known = state.where(f"{name}_n IS NOT NULL")
    return known.selectExpr("run_id", f"{name}_n AS n", f"named_struct('on', {name}_on) AS value")


def _cap(
    rows: DataFrame, max_stack: int, max_grep: int, size: int, ends: bool, state: DataFrame | None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = classify_for_caps(chunked(rows.select("run_id", "pos", "text"), "pos", size))
    # Classifying is the costly part and is asked for by every pass over the rows, so its result is written once.
    shown = F.when(F.col("_cap") == "l", ls_name(F.col("_plain"))).otherwise(F.col("text"))
    rows = staged(rows.select("run_id", "pos", shown.alias("text"), "_cap", CHUNK), "caps-classified")
    listings = rows.where("_cap = 'l'")
    hits = _cap_streaks(
        rows.where("_cap <> 'l'"), "g", max_grep, "grep_omitted",
        END if ends else None, _seed(state, "grep"),
    )
    rest = hits.where("NOT _on AND NOT _released").select("run_id", "pos", "text", "_cap", CHUNK)
    frames = _cap_streaks(
        rest, "f", max_stack, "frames_omitted", END + 1 if ends else None, _seed(state, "stack")
    )
    out = (
        unfold(listings, f"array({row('pos * 2 + 1', 'name', '1', 'text')})")
        .unionByName(unfold(hits.where("_on OR _released"), "_rows"))
        .unionByName(unfold(frames, "_rows"))
    )
    return out, hits, frames, rest


def cap_rows(
    rows: DataFrame,
    max_stack: int = MAX_STACK_FRAMES,
    max_grep: int = MAX_GREP_HITS,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Cap hits and frames and shorten listings in rows (run_id, pos, text).

    Listings are left out of every count; hits are left out of frame counts; the row that ends a
    capped streak of hits passes unexamined. Returns (run_id, pos, kind, n, sample, text).
    """
    return _cap(rows, max_stack, max_grep, size, True, None)[0]


CAP_STATE = "run_id BIGINT, grep_n BIGINT, grep_on BOOLEAN, stack_n BIGINT, stack_on BOOLEAN"


def continue_caps(
    rows: DataFrame, state: DataFrame, max_stack: int, max_grep: int, size: int = CHUNK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Cap more rows of runs that go on: the rows, and the state after them."""
    out, hits, frames, _ = _cap(rows, max_stack, max_grep, size, False, state)
    grep = _last_streak(hits).selectExpr("run_id", "n AS grep_n2", "on AS grep_on2")
    stack = _last_streak(frames).selectExpr("run_id", "n AS stack_n2", "on AS stack_on2")
    after = state.join(beside(grep), "run_id", "full").join(beside(stack), "run_id", "full")
    return out, after.selectExpr(
        "run_id",
        "coalesce(grep_n2, grep_n) AS grep_n",
        "coalesce(grep_on2, grep_on) AS grep_on",
        "coalesce(stack_n2, stack_n) AS stack_n",
        "coalesce(stack_on2, stack_on) AS stack_on",
    )


def close_caps(state: DataFrame, max_stack: int, max_grep: int) -> DataFrame:
    """The counts that ended runs still owe, from their state."""
    grep, stack = (limit if limit > 0 else UNLIMITED for limit in (max_grep, max_stack))
    return unfold(
        state,
        f"""array_compact(array(
            IF(grep_on AND grep_n > {grep}, {row(str(END), 'grep_omitted', f'grep_n - {grep}', "''")}, NULL),
            IF(stack_on AND stack_n > {stack}, {row(str(END + 1), 'frames_omitted', f'stack_n - {stack}', "''")}, NULL)))""",
    )


def cap_stack_frames(lines: DataFrame, n: int = MAX_STACK_FRAMES, size: int = CHUNK_ROWS) -> DataFrame:
    """Keep the first n frames of each stack trace and count the others."""
    rows = _positions(lines, size)
    return unfold(_cap_streaks(rows, "f", n, "frames_omitted", END + 1), "_rows")


def cap_grep_hits(lines: DataFrame, n: int = MAX_GREP_HITS, size: int = CHUNK_ROWS) -> DataFrame:
    """Keep the first n hits of each series of search hits and count the others."""
    rows = _positions(lines, size)
    return unfold(_cap_streaks(rows, "g", n, "grep_omitted", END), "_rows")


def _positions(lines: DataFrame, size: int) -> DataFrame:
    rows = lines.select("run_id", (F.col("line_no") * 2).alias("pos"), "text")
    return classify_for_caps(chunked(rows, "pos", 2 * size))
