"""Streams of console lines: rule stages without state, whole-run compaction, report summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logcompact.functions.profiles import PROFILE_OF
from logcompact.functions.text import trim_space
from logcompact.operators.blocks import (
    PLACED,
    classify_and_place,
    fold_lines,
    fold_streaks,
    group_block_lines,
    settled_before,
)
from logcompact.operators.caps import (
    CAP_STATE,
    MAX_GREP_HITS,
    MAX_STACK_FRAMES,
    close_caps,
    continue_caps,
)
from logcompact.operators.ordered import CHUNK_ROWS, attach, beside, chunked
from logcompact.operators.reports import (
    PACKAGE_OK,
    kept_test_output,
    no_events,
    parse_tap,
    parse_test_events,
    render_packages,
    summarize_junit,
    tap_counts,
    tap_failures,
    tap_heads,
)
from logcompact.operators.rules import (
    apply_project_rules,
    clean_lines,
    keep_lines,
    match_rule,
    strip_lines,
    truncate_lines,
)
from logcompact.session import staged
from logcompact.sources.control import ProjectRule, Rule, read_rules
from logcompact.streaming.state import Slots, start, write_batch


def stream_strip(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rule stages that look at one line: control codes, replace, strip, keep, truncate.

    ``lines`` carries ``rule``, or command and args, so that no join is needed. Lines without a
    rule pass unchanged. Works on streams and tables alike.
    """
    if "rule" not in lines.columns:
        lines = match_rule(lines, rules)
    kept = keep_lines(strip_lines(clean_lines(lines, rules), rules), rules)
    return truncate_lines(kept, rules)


def stream_rule_refresh(
    lines: DataFrame, rules_path: str, out: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """``stream_strip`` with the rule files read again for every micro-batch.

    A change of the files applies to all lines that arrive after it.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rules = read_rules(batch.sparkSession, rules_path).rules
        write_batch(stream_strip(batch, rules), out, batch_id)

    return start(lines, step, checkpoint, **trigger)


PENDING = "run_id BIGINT, line_no BIGINT, text STRING, profile STRING"


def profile_of(command: str = "command"):
    """Profile of a command as an expression, as a stream cannot wait for a join."""
    pairs = [F.lit(x) for item in PROFILE_OF.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col(command))


def stream_compact(
    lines: DataFrame,
    state: str,
    out: str,
    checkpoint: str,
    project_rules: Sequence[ProjectRule] = (),
    blanks: bool = False,
    max_stack: int = MAX_STACK_FRAMES,
    max_grep: int = MAX_GREP_HITS,
    size: int = CHUNK_ROWS,
    **trigger: object,
) -> StreamingQuery:
    """Compact plain output as it arrives; equals the batch result over the same lines.

    ``lines``: run_id, line_no, text, command, is_end. Lines of a run arrive in order; a row with
    ``is_end`` closes its run. Each micro-batch emits what later lines cannot change and keeps the
    rest: an open error block, a success run or repetition that may go on, and the counts of open
    frame and hit series. Rows: (run_id, pos, kind, n, sample, text) under ``out``.
    """
    advance = compact_step(state, project_rules, blanks, max_stack, max_grep, size)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = staged(batch, "micro-batch")
        ended = staged(batch.where("is_end").select("run_id").distinct(), "ended")
        fresh = batch.where("NOT is_end").select("run_id", "line_no", "text", profile_of().alias("profile"))
        write_batch(advance(fresh, ended, batch_id), out, batch_id)

    return start(lines, step, checkpoint, **trigger)


def compact_step(
    state: str, project_rules: Sequence[ProjectRule], blanks: bool, max_stack: int, max_grep: int, size: int
) -> Callable[..., DataFrame]:
    """What one micro-batch adds to the compacted output: a function of its lines (with profile), the runs it ends and its number.

    Rows ``through`` (run_id, pos, text), of runs that are not compacted, are capped along.
    """
    pending = Slots(f"{state}/pending", PENDING)
    counters = Slots(f"{state}/counters", CAP_STATE)

    def step(fresh: DataFrame, ended: DataFrame, batch_id: int, through: DataFrame | None = None) -> DataFrame:
        spark = fresh.sparkSession
        ended = ended.select("run_id")
        fresh = fresh.withColumn("text", F.coalesce("text", F.lit("")))
        if not blanks:
            fresh = fresh.where("text <> ''")
        fresh = apply_project_rules(fresh, project_rules)
        work = pending.before(spark, batch_id).unionByName(fresh)

        placed = classify_and_place(work, size)
        placed = staged(placed.select(*PLACED, "profile"), "placed")
        seen = staged(fold_streaks(placed), "seen")
        cuts = settled_before(placed, seen).join(
            beside(ended.withColumn("_ended", F.lit(True))), "run_id", "left"
        )
        cuts = cuts.select(
            "run_id", F.expr(f"IF(_ended, {1 << 61}L, coalesce(cut, {-(1 << 61)}L)) AS cut")
        )
        placed = staged(attach(placed, cuts), "cut")
        # A settled line never shares a streak or block with an unsettled one.
        blocks = group_block_lines(placed.where("_in_block AND line_no < cut"), size)
        folded = fold_lines(placed, attach(seen, cuts).where("line_no < cut"))
        settled = folded.unionByName(blocks).select("run_id", "pos", "text")
        settled = staged(settled if through is None else settled.unionByName(through), "settled")

        before = counters.before(spark, batch_id)
        capped, after = continue_caps(settled, before, max_stack, max_grep, 2 * size)
        after = staged(after, "caps")
        owed = close_caps(after.join(beside(ended), "run_id", "left_semi"), max_stack, max_grep)
        pending.write(placed.where("line_no >= cut"), batch_id)
        counters.write(after.join(beside(ended), "run_id", "left_anti"), batch_id)
        return capped.unionByName(owed)

    return step


Step = Callable[[DataFrame, DataFrame, int], DataFrame]


def _stream_report(lines: DataFrame, advance: Step, out: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Write what a step makes of the lines of each micro-batch and the runs that it closes."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = staged(batch.select("run_id", "line_no", "text", "is_end"), "micro-batch")
        ended = staged(batch.where("is_end").select("run_id").distinct(), "ended")
        write_batch(advance(batch.where("NOT is_end").drop("is_end"), ended, batch_id), out, batch_id)

    return start(lines, step, checkpoint, **trigger)


PACKAGES = (
    "run_id BIGINT, package STRING, passed BIGINT, failed BIGINT, skipped BIGINT, elapsed DOUBLE, ended_line BIGINT, "
    "pkg_failed BOOLEAN, first_line BIGINT"
)
OUTPUT = "run_id BIGINT, line_no BIGINT, package STRING, test STRING, output STRING"


def _add_packages(before: DataFrame, events: DataFrame) -> DataFrame:
    """Counts per run and package: those of the batches before and those of new events."""
    ended = "event.test = '' AND event.action IN ('pass', 'fail')"
    new = events.where("event IS NOT NULL").selectExpr(
        "run_id",
        "event.package",
        *(
            f"CAST(event.test <> '' AND event.action = '{action}' AS BIGINT) AS {name}"
            for action, name in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))
        ),
        f"IF({ended}, event.elapsed, 0D) AS elapsed",
        f"IF({ended}, line_no, NULL) AS ended_line",
        "event.test = '' AND event.action = 'fail' AS pkg_failed",
        "line_no AS first_line",
    )
    return before.unionByName(new).groupBy("run_id", "package").agg(
        *(F.sum(name).alias(name) for name in ("passed", "failed", "skipped")),
        F.expr("coalesce(max_by(elapsed, ended_line), 0D) AS elapsed"),
        F.max("ended_line").alias("ended_line"),
        F.bool_or("pkg_failed").alias("pkg_failed"),
        F.min("first_line").alias("first_line"),
    )


def stream_test_summary(
    lines: DataFrame, state: str, out: str, checkpoint: str, size: int = CHUNK_ROWS, **trigger: object
) -> StreamingQuery:
    """Summaries of go-test runs: (run_id, place, text).

    Each line is parsed once. State of an open run is one row of counts per package and the output of what has not passed
    yet, so it does not grow with passed tests. Lines that are no events appear at once, the rest when the run ends.
    """
    return _stream_report(lines, test_summary_step(state, size), out, checkpoint, **trigger)


def test_summary_step(state: str, size: int) -> Step:
    counts = Slots(f"{state}/packages", PACKAGES)
    output = Slots(f"{state}/output", OUTPUT)
    test = ["run_id", "package", "test"]

    def step(fresh: DataFrame, ended: DataFrame, batch_id: int) -> DataFrame:
        spark = fresh.sparkSession
        events = staged(parse_test_events(fresh), "events")
        merged = _add_packages(counts.before(spark, batch_id), events)
        merged = merged.join(beside(ended.withColumn("_ended", F.lit(True))), "run_id", "left")
        merged = staged(merged, "packages")

        new = events.where("event.action = 'output'").select(
            "run_id", "line_no", "event.package", "event.test", "event.output"
        )
        passes = events.where("event.action = 'pass' AND event.test <> ''").selectExpr(
            "run_id", "event.package", "event.test", "line_no"
        )
        passes = passes.groupBy(*test).agg(F.max("line_no").alias("last_pass"))
        held = chunked(output.before(spark, batch_id).unionByName(new), "line_no", size)
        held = attach(held, passes, test).where("last_pass IS NULL OR line_no > last_pass").drop("last_pass")
        held = staged(attach(held, ended.withColumn("_ended", F.lit(True))), "output")

        closed = merged.where("_ended").withColumn("ok", F.expr(PACKAGE_OK))
        of_closed = held.where("_ended").select(
            "run_id", "line_no", F.expr("named_struct('action', 'output', 'package', package, 'test', test, "
            "'output', output, 'elapsed', 0D) AS event")
        )
        shown = render_packages(closed, kept_test_output(of_closed, closed, size))
        counts.write(merged.where("_ended IS NULL"), batch_id)
        output.write(held.where("_ended IS NULL"), batch_id)
        return no_events(events).unionByName(shown)

    return step


TAP_COUNTS = "run_id BIGINT, total BIGINT, passed BIGINT, failed BIGINT, skipped BIGINT, plan_line BIGINT"
TAP_OPEN = "run_id BIGINT, line_no BIGINT, text STRING"


def stream_tap_summary(
    lines: DataFrame, state: str, out: str, checkpoint: str, size: int = CHUNK_ROWS, **trigger: object
) -> StreamingQuery:
    """Summaries of TAP runs: (run_id, place, text).

    Each line is read once. State of an open run is one row of counts and at most two lines: its last result, and the mark
    of a diagnostic block that is open. Failures and their diagnostics appear at once, the counts when the run ends.
    """
    return _stream_report(lines, tap_step(state, size), out, checkpoint, **trigger)


def tap_step(state: str, size: int) -> Step:
    counts = Slots(f"{state}/counts", TAP_COUNTS)
    still_open = Slots(f"{state}/open", TAP_OPEN)

    def step(fresh: DataFrame, ended: DataFrame, batch_id: int) -> DataFrame:
        spark = fresh.sparkSession
        # The lines held put the parser in the state it had; they were counted when they came.
        held = staged(still_open.before(spark, batch_id), "open")
        both = held.unionByName(fresh)
        parsed = staged(parse_tap(both, size), "tap-lines")
        new = parsed.join(beside(held.select("run_id", "line_no")), ["run_id", "line_no"], "left_anti")

        zero = {name: F.lit(0).cast("bigint") for name in ("total", "passed", "failed", "skipped")}
        seen = fresh.select("run_id").distinct().select("run_id", *(v.alias(n) for n, v in zero.items()))
        parts = counts.before(spark, batch_id).unionByName(seen.withColumn("plan_line", F.lit(None).cast("bigint")))
        plan = F.expr("max(IF(what = 'plan', line_no, NULL)) AS plan_line")
        numbers = tap_counts(new).join(beside(new.groupBy("run_id").agg(plan)), "run_id")
        merged = parts.unionByName(numbers).groupBy("run_id").agg(
            F.expr("coalesce(max_by(total, plan_line), 0L) AS total"),
            *(F.sum(name).alias(name) for name in ("passed", "failed", "skipped")),
            F.max("plan_line").alias("plan_line"),
        )
        merged = staged(merged.join(beside(ended.withColumn("_ended", F.lit(True))), "run_id", "left"), "counts")
        counts.write(merged.where("_ended IS NULL"), batch_id)

        marks = both.where(trim_space(F.col("text")) == "---").groupBy("run_id").agg(
            F.max("line_no").alias("line_no"), (F.count(F.lit(1)) % 2 == 1).alias("_odd")
        )
        marks = marks.where("_odd").select("run_id", "line_no", F.lit("---").alias("text"))
        result = parsed.where("what IN ('ok', 'skip', 'fail')").groupBy("run_id").agg(
            F.max("line_no").alias("line_no"), F.max_by("what", "line_no").alias("what")
        )
        # Only whether it failed matters later.
        result = result.selectExpr("run_id", "line_no", "IF(what = 'fail', 'not ok 0', 'ok 0') AS text")
        left = marks.unionByName(result).join(beside(ended), "run_id", "left_anti")
        still_open.write(left, batch_id)
        return tap_heads(merged.where("_ended")).unionByName(tap_failures(new))

    return step


def junit_step(state: str, size: int) -> Step:
    """Summaries of JUnit reports as their runs end. Whether a report is well-formed shows at its end, and if not its lines
    are the output, so the lines of an open run are its state; they are moved, and read as XML once."""
    held = Slots(f"{state}/lines", TAP_OPEN)

    def step(fresh: DataFrame, ended: DataFrame, batch_id: int) -> DataFrame:
        rows = held.before(fresh.sparkSession, batch_id).unionByName(fresh)
        rows = attach(chunked(rows, "line_no", size), ended.select("run_id", F.lit(True).alias("_ended")))
        rows = staged(rows, "reports")
        held.write(rows.where("_ended IS NULL"), batch_id)
        return summarize_junit(rows.where("_ended").select("run_id", "line_no", "text"), size)

    return step
