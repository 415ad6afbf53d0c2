"""Error blocks, success runs and repeated lines of plain console output (batch form).

The behaviour is that of a reader that goes through a run line by line:

* an error line opens a block that lasts until two blank lines in a row, or the end of the run;
  all its lines are kept and grouped by the file they refer to;
* neighbouring success lines fold into one row;
* neighbouring lines that differ only in numbers fold into the first one and a "repeated" row.

Where the reader stands follows from running maxima of line numbers, so no line is handled in
sequence: a block is open when an error started after the last closing pair of blanks, and a
success line is collected when a countable one came after the last line that was no success.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcompact.functions.profiles import is_error, is_noise, is_success
from logcompact.functions.text import (
    file_of,
    normalize_numbers,
    rest_after,
    strip_ansi,
    summary_text,
)
from logcompact.operators.ordered import (
    BEFORE,
    CHUNK,
    CHUNK_ROWS,
    SO_FAR,
    across_chunks,
    attach,
    beside,
    chunked,
    running,
    streaks,
    with_exprs,
    within_chunk,
)
from logcompact.session import staged

# A line number before every line.
NOWHERE = f"{-(1 << 62)}L"


FLAGS = ("_noise", "_error", "_success", "_blank")
PLACED = (
    "run_id", "line_no", CHUNK, "text", "_plain", "_noise", "_blank",
    "_collected", "_gap", "_block", "_in_block", "_block_head", "_closes",
)


def classify_lines(lines: DataFrame) -> DataFrame:
    """Add the stripped text and the noise, error, success and blank flags of each line.

    Needs ``text`` and ``profile`` (null for tools without one).
    """
    profile, plain = F.col("profile"), F.col("_plain")
    lines = lines.withColumn("text", F.coalesce("text", F.lit("")))
    return lines.withColumn("_plain", strip_ansi(F.col("text"))).withColumns(
        {
            "_noise": is_noise(profile, plain),
            "_error": is_error(profile, plain),
            "_success": is_success(profile, plain),
            "_blank": plain == "",
        }
    )


def _locally(lines: DataFrame) -> DataFrame:
    """What a chunk alone tells about its classified lines."""
    inner = within_chunk(["run_id"], ["line_no"])
    lines = with_exprs(
        lines,
        _c_seen=f"max(IF(NOT _success, line_no, NULL)) OVER ({inner} {SO_FAR})",
        _hit=f"max(IF(_success AND NOT _noise AND NOT _error, line_no, NULL)) OVER ({inner} {SO_FAR})",
        _after=f"lag(_blank) OVER ({inner})",
    )
    return with_exprs(
        lines,
        # A leading success line without a countable one depends on the chunks before.
        _hangs="_success AND _c_seen IS NULL AND _hit IS NULL",
        _known=f"_success AND coalesce(_hit > coalesce(_c_seen, {NOWHERE}), false)",
    )


def _carried(lines: DataFrame) -> DataFrame:
    """What the chunks before each chunk tell: one row per chunk."""
    outer = across_chunks(["run_id"])
    opens = "_error AND NOT _noise AND NOT _known"
    parts = lines.groupBy("run_id", CHUNK).agg(
        F.expr("max(_c_seen) AS _seen"),
        F.expr("max(_hit) AS _hit"),
        F.expr("min(line_no) AS _first"),
        F.expr("min_by(_blank, line_no) AS _first_blank"),
        F.expr("max_by(_blank, line_no) AS _last_blank"),
        F.expr(f"max(IF({opens}, line_no, NULL)) AS _opened_free"),
        F.expr(f"max(IF({opens} AND NOT _hangs, line_no, NULL)) AS _opened_held"),
        F.expr("max(IF(_blank AND _after, line_no, NULL)) AS _closed"),
    )
    carry = with_exprs(
        parts,
        _p_seen=f"coalesce(max(_seen) OVER ({outer} {BEFORE}), {NOWHERE})",
        _p_hit=f"max(_hit) OVER ({outer} {BEFORE})",
        _p_blank=f"coalesce(lag(_last_blank) OVER ({outer}), false)",
    )
    carry = with_exprs(carry, _p_held="coalesce(_p_hit > _p_seen, false)")
    return with_exprs(
        carry,
        _p_opened=f"max(IF(_p_held, _opened_held, _opened_free)) OVER ({outer} {BEFORE})",
        _p_closed="max(coalesce(_closed, IF(_first_blank AND _p_blank, _first, NULL))) "
        f"OVER ({outer} {BEFORE})",
    ).select("run_id", CHUNK, "_p_seen", "_p_blank", "_p_held", "_p_opened", "_p_closed")


def place_lines(flags: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Tell for every classified, chunked line whether it is collected or inside an error block.

    Adds ``_collected``, ``_in_block``, ``_block_head`` (first line of a block), ``_block`` (number
    of the closing line before the block; one value per block), ``_closes`` (second of two blank
    lines) and ``_gap`` (number of the last line that was no success). ``lines`` may hold the same
    lines in another layout: the first pass then moves only the flags of ``flags``.
    """
    carry = staged(_carried(_locally(flags)), "places")
    lines = _locally(flags if lines is None else lines).join(beside(carry), ["run_id", CHUNK])
    inner = within_chunk(["run_id"], ["line_no"])
    lines = with_exprs(
        lines,
        _collected="_known OR (_hangs AND _p_held)",
        _closes="_blank AND coalesce(_after, _p_blank)",
        _gap="coalesce(_c_seen, _p_seen)",
    )
    lines = with_exprs(lines, _opens="_error AND NOT _noise AND NOT _collected")
    opened = "coalesce(max(IF(_opens, line_no, NULL)) OVER ({} {}), _p_opened, {})".format
    lines = with_exprs(
        lines,
        _start=opened(inner, SO_FAR, NOWHERE),
        _start_before=opened(inner, BEFORE, NOWHERE),
        _block=f"coalesce(max(IF(_closes, line_no, NULL)) OVER ({inner} {BEFORE}), _p_closed, {NOWHERE})",
    )
    return with_exprs(
        lines,
        _in_block="_start > _block",
        _block_head="_start > _block AND _start_before <= _block",
    ).drop(
        "_c_seen", "_hit", "_after", "_hangs", "_known", "_opens", "_start",
        "_start_before", "_p_seen", "_p_blank", "_p_held", "_p_opened", "_p_closed",
    )


def classify_and_place(lines: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """``place_lines`` over raw lines (run_id, line_no, text, profile).

    The first pass classifies where the lines are read and moves flags only; the second moves each
    line's text once and classifies it where its chunk is.
    """
    lines = chunked(lines, "line_no", size)
    flags = classify_lines(lines).select("run_id", "line_no", CHUNK, *FLAGS)
    # Said outright, because lines that come laid out by run alone would otherwise stay so.
    layout = ["run_id", CHUNK]
    return place_lines(flags.repartition(*layout), classify_lines(lines.repartition(*layout)))


def parted(previous: str, current: str) -> str:
    return f"NOT coalesce({previous} = {current}, false)"


def row(pos: str, kind: str, n: str, sample: str) -> str:
    """SQL for one output row: its place, what it is, how many lines it stands for, its text."""
    return (
        f"named_struct('pos', CAST({pos} AS BIGINT), 'kind', '{kind}', "
        f"'n', CAST({n} AS BIGINT), 'sample', {sample})"
    )


def unfold(rows: DataFrame, exprs: str) -> DataFrame:
    """One row for each struct of an array expression, with its text."""
    rows = rows.select("run_id", F.explode(F.expr(exprs)).alias("row")).select("run_id", "row.*")
    return rows.withColumn("text", summary_text(F.col("kind"), F.col("n"), F.col("sample")))


def fold_streaks(placed: DataFrame) -> DataFrame:
    """Streaks of success lines and of lines equal without numbers, among the lines that count."""
    # The first line of a block stays as a row without a key, because a block parts its neighbours.
    live = placed.where("(NOT _in_block AND (_collected OR NOT _noise)) OR _block_head")
    live = live.withColumn("_number_free", normalize_numbers(F.col("_plain")))
    live = with_exprs(
        live,
        _key="CASE WHEN _in_block THEN NULL WHEN _collected THEN concat('s', _gap) "
        "WHEN NOT _blank THEN concat('o', _number_free) END",
    ).select("run_id", "line_no", CHUNK, "text", "_plain", "_collected", "_in_block", "_key")
    seen = streaks(live, ["run_id"], ["line_no"], "_key", parted)
    return with_exprs(seen, _ends=f"NOT _s_has_next OR {parted('_key', '_s_next')}")


def fold_lines(placed: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Fold success runs and repeated lines outside error blocks.

    Returns (run_id, pos, kind, n, sample, text); ``pos`` orders the rows of a run: twice the line
    number, plus one for a row that follows its line.
    """
    seen = fold_streaks(placed) if seen is None else seen
    line = row("line_no * 2", "line", "1", "text")
    ok = row("line_no * 2 + 1", "ok", "_s_n", "_plain")
    repeated = row("line_no * 2 + 1", "repeated", "_s_n", "substring(_key, 2)")
    return unfold(
        seen.where("NOT _in_block"),
        # A repetition cut short by a success line is not reported.
        f"""CASE WHEN _collected THEN IF(_ends, array({ok}), NULL)
            ELSE array_compact(array(
                IF(_s_n = 1, {line}, NULL),
                IF(_ends AND _s_n > 1 AND NOT coalesce(startswith(_s_next, 's'), false),
                   {repeated}, NULL))) END""",
    )


def settled_before(placed: DataFrame, seen: DataFrame) -> DataFrame:
    """Per run the first line whose result later lines may still change: (run_id, cut).

    That is the start of an open error block, or the first line after the last finished streak.
    """
    closed = placed.groupBy("run_id").agg(
        F.expr("max_by(IF(_in_block AND NOT _closes, _block, NULL), line_no) AS _open"),
    )
    blocks = placed.where("_in_block").groupBy("run_id", "_block").agg(
        F.min("line_no").alias("_low"), F.max("line_no").alias("_high")
    )
    blocks = blocks.join(beside(closed), "run_id").groupBy("run_id").agg(
        F.expr("max(IF(_block = _open, _low, NULL)) AS _open_at"),
        F.expr("max(IF(_open IS NULL OR _block <> _open, _high, NULL)) AS _closed_at"),
    )
    done = seen.groupBy("run_id").agg(
        F.expr(
            "max(IF(NOT _in_block AND ((_ends AND _s_has_next) OR _key IS NULL), line_no, NULL)) AS _done_at"
        )
    )
    ends = closed.join(beside(blocks), "run_id", "left").join(beside(done), "run_id", "left")
    return ends.select(
        "run_id", F.expr("coalesce(_open_at, greatest(_closed_at, _done_at) + 1) AS cut")
    )


def group_block_lines(lines: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Group the lines of each error block by the file they refer to.

    Needs chunked ``run_id, line_no, text, _block``. In a block with more than one file, lines
    without a file come first, then the files in the order they were first seen; a file with
    several lines gets a header and its lines lose the file name. Returns (run_id, pos, kind, n,
    sample) with ``pos`` as in ``fold_lines``: a block of m lines needs at most 1.5 m of its 2 m places.
    """
    by_file = ["run_id", "_block", "_file"]
    same = ", ".join(by_file)
    lines = lines.select("run_id", "line_no", CHUNK, "_block", "text").withColumn(
        "_file", file_of(F.col("text"))
    )
    parts = with_exprs(
        lines.groupBy(*by_file, CHUNK).agg(
            F.expr("min(line_no) AS _first"), F.expr("count(1) AS _n")
        ),
        _file_first=f"min(_first) OVER (PARTITION BY {same})",
        _file_n=f"sum(_n) OVER (PARTITION BY {same})",
        _prior=f"coalesce(sum(_n) OVER (PARTITION BY {same} ORDER BY {CHUNK} {BEFORE}), 0L)",
    )
    parts = staged(parts, "block-files")
    files = parts.where("_first = _file_first").select(*by_file, "_file_first", "_file_n")
    blocks = files.groupBy("run_id", "_block").agg(
        F.expr("count_if(_file <> '') AS _files"),
        F.expr("min(_file_first) AS _block_first"),
        F.expr("coalesce(max(IF(_file = '', _file_n, NULL)), 0L) AS _loose"),
    )
    files = running(
        chunked(files, "_file_first", size),
        ["run_id", "_block"],
        ["_file_first"],
        "sum",
        "IF(_file = '', 0, _file_n + IF(_file_n > 1, 1, 0))",
        "_offset",
    )
    files = attach(files, blocks, ["run_id", "_block"]).selectExpr(
        *by_file, "_files", "_block_first", "IF(_file = '', 0L, _loose + _offset) AS _offset"
    )
    facts = staged(parts.join(beside(files), by_file).drop("_first", "_n", "_file_first"), "block-places")

    lines = lines.join(beside(facts), [*by_file, CHUNK]).withColumn(
        "_rest", rest_after(F.col("text"), F.col("_file"))
    )
    lines = with_exprs(
        lines,
        _start="_block_first * 2 + _offset",
        _rank=f"_prior + row_number() OVER (PARTITION BY {same}, {CHUNK} ORDER BY line_no)",
    )
    same_place = row("line_no * 2", "line", "1", "text")
    moved = row("_start + _rank - 1", "line", "1", "text")
    header = row("_start", "file", "_file_n", "_file")
    short = row("_start + _rank", "grouped", "1", "concat('  ', _rest)")
    return unfold(
        lines,
        f"""CASE WHEN _files <= 1 THEN array({same_place})
                 WHEN _file = '' OR _file_n = 1 THEN array({moved})
                 WHEN _rank = 1 THEN array({header}, {short})
                 ELSE array({short}) END""",
    )


def compact_lines(lines: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Error blocks, success runs and repeated lines of whole runs.

    ``lines`` has run_id, line_no, text and profile. Returns (run_id, pos, kind, n, sample, text).
    """
    placed = classify_and_place(lines, size)
    # Classifying is the costly part and three steps follow, so its result is written once.
    placed = staged(placed.select(*PLACED), "placed")
    folded = fold_lines(placed)
    blocks = group_block_lines(placed.where("_in_block"), size)
    return folded.unionByName(blocks)


def error_blocks(lines: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """The lines inside error blocks, with the block they belong to."""
    placed = classify_and_place(lines, size)
    return placed.where("_in_block").select(
        "run_id", "line_no", "text", F.col("_block").alias("block_id"), CHUNK
    )


def group_errors_by_file(lines: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Error-block lines (run_id, line_no, text, block_id) grouped by file, in their new order."""
    lines = lines.withColumnRenamed("block_id", "_block").fillna("", ["text"])
    return group_block_lines(chunked(lines, "line_no", size), size)


def collapse_success(lines: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """One row for each run of success lines that lies outside error blocks."""
    placed = classify_and_place(lines, size)
    return fold_lines(placed).where("kind = 'ok'")


def dedup_adjacent(lines: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Fold neighbouring lines that are equal without colours and numbers; no other folding.

    Blank lines are kept and part their neighbours.
    """
    plain = lines.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(
        "_plain", strip_ansi(F.col("text"))
    )
    no = "false"
    return fold_lines(
        with_exprs(
            chunked(plain, "line_no", size),
            _blank="_plain = ''",
            _noise=no,
            _collected=no,
            _in_block=no,
            _block_head=no,
            _gap=NOWHERE,
        )
    )
