"""All nine rule stages over a stream of lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logcompact.operators.ordered import CHUNK_ROWS, attach, beside, chunked
from logcompact.operators.rules import (
    automaton_answers,
    automaton_states,
    by_rule,
    clean_lines,
    decided,
    entry_machines,
    entry_slots,
    keep_lines,
    lines_within,
    match_rule,
    message_rows,
    on_empty,
    strip_lines,
    truncate_lines,
)
from logcompact.session import staged
from logcompact.sources.control import Rule
from logcompact.streaming.state import Slots, start, write_batch

KEPT = "run_id BIGINT, kept BIGINT"
STATES = "run_id BIGINT, slot INT, state INT"
HELD = "run_id BIGINT, rule INT, line_no BIGINT, text STRING"


def rule_step(rules: Sequence[Rule], state: str, size: int) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """What one micro-batch adds to the output: a function of its lines, the runs it ends and its number.

    Lines: run_id, line_no, text, rule; ended runs: run_id, rule. State of an open run: how many lines were kept (a
    countdown of ``max_lines``), one automaton state per pattern of ``match_output``, and the lines that may still be shown
    or replaced: the last ``tail_lines``, or the lines kept so far where a message may stand for them.
    """
    machines = entry_machines(rules, [place for place, rule in enumerate(rules) if rule.match_output])
    slots = entry_slots(rules)
    counts, states, held = Slots(f"{state}/kept", KEPT), Slots(f"{state}/states", STATES), Slots(f"{state}/held", HELD)
    waits = [place for place, rule in enumerate(rules) if rule.match_output or rule.tail_lines > 0]
    most = F.nullif(by_rule(rules, lambda r: max(r.max_lines, 0), 0), F.lit(0))
    last = F.nullif(by_rule(rules, lambda r: max(r.tail_lines, 0), 0), F.lit(0))

    def step(lines: DataFrame, ended: DataFrame, batch_id: int) -> DataFrame:
        spark = lines.sparkSession
        closed = ended.select("run_id", F.lit(True).alias("_ended"))
        lines = chunked(lines.where("rule IS NOT NULL").select("run_id", "line_no", "text", "rule"), "line_no", size)
        cleaned = clean_lines(lines, rules)

        told = states.before(spark, batch_id)
        if machines:
            asked = sorted({machine.place for machine in machines})
            told = automaton_states(cleaned.where(F.col("rule").isin(asked)), machines, told)
            told = staged(told.join(beside(closed), "run_id", "left"), "states")
            answered = automaton_answers(told.where("_ended"), machines, slots)
            replaced = staged(decided(ended, answered, rules), "replaced")
            states.write(told.where("_ended IS NULL"), batch_id)
        else:
            replaced = ended.where("false").select("run_id", "rule", F.lit("").alias("message"))

        kept = truncate_lines(keep_lines(strip_lines(cleaned, rules), rules), rules)
        before = counts.before(spark, batch_id)
        left = F.greatest(most - F.coalesce("kept", F.lit(0)), F.lit(0))
        kept = attach(kept, before).withColumn("_left", F.when(most.isNotNull(), left))
        kept = lines_within(kept, F.col("_left"), None, size).select("run_id", "rule", "line_no", "text")
        kept = staged(kept, "kept")
        after = before.unionByName(kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("kept")))
        after = staged(after.groupBy("run_id").agg(F.sum("kept").alias("kept")), "counts")
        counts.write(after.join(beside(closed), "run_id", "left_anti"), batch_id)

        waiting = held.before(spark, batch_id).unionByName(kept.where(F.col("rule").isin(waits)))
        waiting = lines_within(waiting, None, last, size).withColumn("line_no", F.col("line_no").cast("bigint"))
        waiting = attach(chunked(waiting, "line_no", size), closed)
        waiting = staged(waiting, "held")
        held.write(waiting.where("_ended IS NULL"), batch_id)
        shown = attach(waiting.where("_ended"), replaced.select("run_id", F.lit(True).alias("_replaced")))
        shown = shown.where("_replaced IS NULL").select("run_id", "line_no", "text")
        shown = shown.unionByName(kept.where(~F.col("rule").isin(waits)).select("run_id", "line_no", "text"))
        quiet = ended.where("rule IS NOT NULL").join(beside(replaced.select("run_id")), "run_id", "left_anti")
        return (
            shown.select("run_id", F.col("line_no").alias("pos"), F.lit("line").alias("kind"), "text")
            .unionByName(message_rows(replaced.where("message <> ''")))
            .unionByName(message_rows(on_empty(quiet, after, rules)))
        )

    return step


def stream_apply_rules(
    lines: DataFrame,
    rules: Sequence[Rule],
    state: str,
    out: str,
    checkpoint: str,
    size: int = CHUNK_ROWS,
    **trigger: object,
) -> StreamingQuery:
    """All nine stages over a stream; equals ``apply_rules`` over the same lines: (run_id, pos, kind, text).

    ``lines``: run_id, line_no, text, is_end, and rule, or command and args. Lines of a run arrive in order; a row with
    ``is_end`` closes its run. Each line is read once. Lines appear at once unless their rule has ``tail_lines`` or
    ``match_output``, which only the end of the run decides. Patterns of ``match_output`` are automata here; one that
    would be too large is refused when the stream starts.
    """
    if "rule" not in lines.columns:
        lines = match_rule(lines, rules)
    advance = rule_step(rules, state, size)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = staged(batch.select("run_id", "line_no", "text", "rule", "is_end"), "micro-batch")
        ended = staged(batch.where("is_end").select("run_id", "rule").distinct(), "ended")
        write_batch(advance(batch.where("NOT is_end"), ended, batch_id), out, batch_id)

    return start(lines, step, checkpoint, **trigger)
