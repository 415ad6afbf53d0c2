"""Whole runs of every format over one stream of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logcompact.operators.caps import MAX_GREP_HITS, MAX_STACK_FRAMES
from logcompact.operators.ordered import CHUNK, CHUNK_ROWS, attach, beside, chunked
from logcompact.operators.reports import place
from logcompact.operators.rules import match_rule
from logcompact.plans.compact import by_branch, run_kinds, with_branch
from logcompact.session import staged
from logcompact.sources.control import ProjectRule, Rule
from logcompact.streaming.lines import compact_step, junit_step, profile_of, tap_step, test_summary_step
from logcompact.streaming.rules import rule_step
from logcompact.streaming.state import Slots, start, write_batch

ROUTES = "run_id BIGINT, rule INT, branch STRING, profile STRING"


def stream_route(
    lines: DataFrame,
    state: str,
    out: str,
    checkpoint: str,
    rules: Sequence[Rule] = (),
    project_rules: Sequence[ProjectRule] = (),
    excluded: Sequence[str] = (),
    max_stack: int = MAX_STACK_FRAMES,
    max_grep: int = MAX_GREP_HITS,
    size: int = CHUNK_ROWS,
    **trigger: object,
) -> StreamingQuery:
    """Compact runs by the branch each takes, as ``compact`` does for tables: (run_id, place, text).

    ``lines``: run_id, line_no, text, command, args, no_filter, is_end. Lines of a run arrive in order; a row with
    ``is_end`` closes its run. The first micro-batch with a run decides its branch, which is kept as state until the run
    ends: the command, ``no_filter`` (of a run's loops, too, which ``stream_loop_guard`` tells) and the first line's format.
    Every micro-batch feeds all branches and is one folder of output.
    """
    routes = Slots(f"{state}/routes", ROUTES)
    plain = compact_step(f"{state}/plain", project_rules, False, max_stack, max_grep, size)
    by_rules = rule_step(rules, f"{state}/rule", size)
    reports = {
        "ndjson": test_summary_step(f"{state}/ndjson", size),
        "tap": tap_step(f"{state}/tap", size),
        "junit": junit_step(f"{state}/junit", size),
    }

    def step(batch: DataFrame, batch_id: int) -> None:
        names = ("run_id", "line_no", "text", "command", "args", "no_filter", "is_end")
        batch = staged(batch.select(*names), "micro-batch")
        fresh = batch.where("NOT is_end").select("run_id", "line_no", F.coalesce("text", F.lit("")).alias("text"))
        known = routes.before(batch.sparkSession, batch_id)
        calls = batch.groupBy("run_id").agg(
            F.first("command", True).alias("command"), F.first("args", True).alias("args"), F.bool_or("no_filter").alias("no_filter")
        )
        new = match_rule(calls.join(beside(known), "run_id", "left_anti"), rules).join(beside(run_kinds(fresh)), "run_id", "left")
        new = with_branch(new, excluded).select("run_id", "rule", "branch", profile_of().alias("profile"))
        now = staged(known.unionByName(new), "routes")
        ended = staged(batch.where("is_end").select("run_id").distinct().join(beside(now), "run_id"), "ended")
        routed = by_branch(attach(chunked(fresh, "line_no", size), now).drop(CHUNK))

        def of(branch: str) -> tuple[DataFrame, DataFrame]:
            mine = F.col("branch") == branch
            return routed.where(mine).select("run_id", "line_no", "text", "rule", "profile"), ended.where(mine).select("run_id", "rule")

        through = of("bypass")[0].select("run_id", (F.col("line_no") * 2).alias("pos"), "text")
        lined = of("plain")[0].drop("rule")
        rows = plain(lined, ended.where("branch IN ('plain', 'bypass')"), batch_id, through)
        shown = rows.select("run_id", place("pos"), "text")
        ruled, ruled_ended = of("rule")
        shown = shown.unionByName(by_rules(ruled.drop("profile"), ruled_ended, batch_id).select("run_id", place("pos"), "text"))
        for branch, report in reports.items():
            lined, closed = of(branch)
            shown = shown.unionByName(report(lined.select("run_id", "line_no", "text"), closed.select("run_id"), batch_id))
        write_batch(shown, out, batch_id)
        routes.write(now.join(beside(ended.select("run_id")), "run_id", "left_anti"), batch_id)

    return start(lines, step, checkpoint, **trigger)
