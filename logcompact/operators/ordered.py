"""Ordered computations that stay parallel when one group holds most of the rows.

A window over ``partitionBy(run)`` puts a whole run in one task. Here the rows of a group are cut
into chunks of its order, the windows run inside (group, chunk), and one summary row per chunk
carries what the chunks before it contribute. Only the summaries, a few hundred bytes per chunk,
are ever ordered by group alone.

The summaries are written to the shared scratch folder before they are joined back. That keeps the
plan of the rows a single scan however many ordered steps follow each other. They grow with the runs
and are joined where their rows are (`beside`): a broadcast would pass them through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcompact.session import staged

# About 25 MB of console text: a comfortable sort for one task. A run of 10^11 lines has 400,000
# chunks, whose summaries still sort in one small task.
CHUNK_ROWS = 1 << 18
CHUNK = "_chunk"

SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def chunked(rows: DataFrame, position: str = "line_no", size: int = CHUNK_ROWS) -> DataFrame:
    """Add the chunk number of each row's position."""
    return rows.withColumn(CHUNK, F.expr(f"{position} div {int(size)}"))


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, pieces: int | None = None) -> DataFrame:
    """Rows with chunks cut by count: ranges of (keys, order) that Spark samples to about equal numbers of rows.

    For positions that say nothing of how many rows lie between them, such as time stamps. A key that holds many rows
    spreads over as many chunks as its share of ``pieces`` (by default the shuffle partitions), equal places stay together.
    The rows are staged, so that a chunk is the same for all who read them; they are read twice, once for the sample.
    """
    pieces = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(pieces, *keys, *order)
    return staged(laid.withColumn(CHUNK, F.spark_partition_id().cast("bigint")), name)


def merged_chunks(rows: DataFrame, keys: Sequence[str], size: int = CHUNK_ROWS) -> DataFrame:
    """(keys, chunk, _merged, _chunks) of chunked rows: chunks put together in order until they hold ``size`` rows.

    Sparse positions leave few rows in a chunk of positions. A merged chunk has fewer than twice ``size`` rows, and
    ``_chunks`` is how many of them the group has. There may be as many chunks of positions as rows, so they are counted
    up in ranges.
    """
    counts = rows.groupBy(*keys, CHUNK).agg(F.expr("count(1) AS _n")).withColumnRenamed(CHUNK, "_position")
    counts = running(ranged(staged(counts, "chunk-counts"), keys, ["_position"], "chunk-ranges"), keys, ["_position"], "sum", "_n", "_before")
    counts = staged(counts.selectExpr(*keys, "_position", f"_before div {int(size)} AS {CHUNK}"), "merged")
    groups = counts.select(*keys, CHUNK).distinct().groupBy(*keys).agg(F.expr("count(1) AS _chunks"))
    return attach(counts, groups, keys).selectExpr(*keys, f"_position AS {CHUNK}", f"{CHUNK} AS _merged", "_chunks")


def beside(facts: DataFrame) -> DataFrame:
    """Facts for a join, brought to the rows by key and merged with them.

    There is at least one fact per run or chunk, so they grow with the input. Below its limit a file of them would be
    broadcast, which sends it to the driver, several times as large as on disk and once for each of dozens of joins.
    """
    return facts.hint("merge")


def laid_out(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt out by (keys, chunk).

    A window takes rows that are dealt by a part of its keys for good enough. Rows that come out of a join, a grouping or a
    bucketed table by run would so keep a long run in one task, chunks or not.
    """
    return rows.repartition(*keys, CHUNK)


def with_exprs(rows: DataFrame, **exprs: str) -> DataFrame:
    """Add columns given as SQL expressions; they cannot refer to each other."""
    return rows.withColumns({name: F.expr(sql) for name, sql in exprs.items()})


def within_chunk(keys: Sequence[str], order: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(keys)}, {CHUNK} ORDER BY {', '.join(order)}"


def across_chunks(keys: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(keys)} ORDER BY {CHUNK}"


def streaks(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    breaks: Callable[[str, str], str],
    seed: DataFrame | None = None,
) -> DataFrame:
    """Number the rows inside maximal streaks of neighbours.

    ``value`` is an SQL expression carried from row to row; ``breaks(previous, current)`` is the
    SQL test, over the values of two neighbours, that a new streak starts. Adds ``_s_n``, the row's
    place in its streak from 1; ``_s_prev``, ``_s_next`` and ``_s_has_next``, the values of its
    neighbours; and ``_s_prev_n``, the previous row's place in its own streak. ``seed`` continues
    streaks that began earlier: keys, ``n`` (rows so far in the open streak) and ``value`` (of its
    last row).
    """
    inner, outer = within_chunk(keys, order), across_chunks(keys)
    rows = with_exprs(laid_out(rows, keys), _v=f"named_struct('v', {value})")
    rows = with_exprs(
        rows,
        _r=f"CAST(row_number() OVER ({inner}) AS BIGINT)",
        _b=f"lag(_v) OVER ({inner})",
        _a=f"lead(_v) OVER ({inner})",
    )
    rows = with_exprs(rows, _new=f"_b IS NOT NULL AND {breaks('_b.v', '_v.v')}")
    parts = rows.groupBy(*keys, CHUNK).agg(
        F.expr("count(1) AS _n"),
        F.expr("min_by(_v, _r) AS _first"),
        F.expr("max_by(_v, _r) AS _last"),
        F.expr("max(IF(_new, _r, NULL)) AS _turn"),
    )
    if seed is not None:
        parts = parts.unionByName(
            seed.selectExpr(
                *keys,
                f"CAST(NULL AS BIGINT) AS {CHUNK}",
                "CAST(n AS BIGINT) AS _n",
                "named_struct('v', value) AS _first",
                "named_struct('v', value) AS _last",
                "CAST(NULL AS BIGINT) AS _turn",
            )
        )
    carry = with_exprs(
        parts,
        _base=f"coalesce(sum(_n) OVER ({outer} {BEFORE}), 0L)",
        _before=f"lag(_last) OVER ({outer})",
        _after=f"lead(_first) OVER ({outer})",
    )
    carry = with_exprs(carry, _open=f"_before IS NULL OR {breaks('_before.v', '_first.v')}")
    carry = with_exprs(
        carry,
        _start=f"last(_base + coalesce(_turn, IF(_open, 1L, NULL)), true) OVER ({outer} {BEFORE})",
    )
    carry = carry.where(f"{CHUNK} IS NOT NULL").select(
        *keys, CHUNK, "_base", "_before", "_after", "_open", "_start"
    )
    joined = rows.join(beside(staged(carry, "streaks")), [*keys, CHUNK])
    joined = with_exprs(joined, _turn="IF(IF(_b IS NULL, _open, _new), _base + _r, NULL)")
    joined = with_exprs(
        joined,
        _s_n=f"_base + _r - coalesce(max(_turn) OVER ({inner} {SO_FAR}), _start) + 1",
        _s_prev_n=f"_base + _r - coalesce(max(_turn) OVER ({inner} {BEFORE}), _start)",
        _s_prev="coalesce(_b, _before).v",
        _s_next="coalesce(_a, _after).v",
        _s_has_next="coalesce(_a, _after) IS NOT NULL",
    )
    return joined.drop(
        "_base", "_before", "_after", "_open", "_start", "_turn", "_v", "_r", "_b", "_a", "_new"
    )


def running(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], aggregate: str, value: str, name: str
) -> DataFrame:
    """Add ``aggregate`` (sum or max) of a BIGINT expression over the rows before each row.

    A sum over no rows is 0, a maximum over no rows is null.
    """
    inner, outer = within_chunk(keys, order), across_chunks(keys)
    rows = with_exprs(laid_out(rows, keys), _value=f"CAST({value} AS BIGINT)")
    parts = with_exprs(
        rows.groupBy(*keys, CHUNK).agg(F.expr(f"{aggregate}(_value) AS _part")),
        _base=f"{aggregate}(_part) OVER ({outer} {BEFORE})",
    ).drop("_part")
    within = with_exprs(rows, _within=f"{aggregate}(_value) OVER ({inner} {BEFORE})")
    total = {
        "sum": "coalesce(_base, 0L) + coalesce(_within, 0L)",
        "max": "coalesce(greatest(_base, _within), _base, _within)",
    }
    return (
        within.join(beside(staged(parts, "running")), [*keys, CHUNK])
        .withColumn(name, F.expr(total[aggregate]))
        .drop("_base", "_within", "_value")
    )


def number_rows(
    rows: DataFrame, keys: Sequence[str], position: str, name: str, size: int = CHUNK_ROWS
) -> DataFrame:
    """Number the rows of each group from 1 in the order of an integer position."""
    counted = running(chunked(rows, position, size), keys, [position], "sum", "1", name)
    return counted.withColumn(name, F.expr(f"{name} + 1")).drop(CHUNK)


def attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Add the columns of ``facts`` (one row per key) to chunked rows, left join.

    Joining on the key alone would send a long run to one task. The facts are first joined to the
    list of (key, chunk), which is small, and then to the rows on both.
    """
    chunks = rows.select(*keys, CHUNK).distinct().join(beside(facts), list(keys), "left")
    return laid_out(rows, keys).join(beside(staged(chunks, "facts")), [*keys, CHUNK])
