"""Rules on the output of a command: which rule takes a run, and its nine stages.

Rules are control data: a few dozen, known when the plan is built. Their patterns go into the plan
as literals, which a task compiles once; a pattern column would be compiled again for every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcompact.functions.automata import BEFORE, Automaton, TooLarge, automaton, composed
from logcompact.functions.commands import full_command
from logcompact.functions.dialect import Pattern, UnsupportedPattern, any_of, to_java, translate
from logcompact.functions.text import replace_chain, strip_ansi, truncate_bytes
from logcompact.operators.ordered import CHUNK, CHUNK_ROWS, attach, beside, chunked, running
from logcompact.session import staged
from logcompact.sources.control import ProjectRule, Rule

# Lines that are put together for a pattern that may match some newlines, at least.
BLOCK_LINES = 64
# Characters that an automaton reads at once, those of a run that are walked one by one beside other runs, and ranges whose
# maps are composed in one row.
AT_ONCE, WALK_AT_MOST, RANGES_TOGETHER = 1 << 20, 1 << 14, 256
# The place of a run's states, before all its lines.
STATE_LINE = -(1 << 63)


def match_rule(runs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``rule``, the place of the first rule whose match_command fits the full command.

    Null where none fits. A rule without match_command never fits.
    """
    command = full_command(F.col("command"), F.col("args"))
    choice: Column | None = None
    for place, rule in enumerate(rules):
        if rule.match_command:
            hit = command.rlike(to_java(rule.match_command))
            choice = F.when(hit, place) if choice is None else choice.when(hit, place)
    return runs.withColumn("rule", F.lit(None).cast("int") if choice is None else choice)


def by_rule(rules: Sequence[Rule], value: Callable[[Rule], object], default: object) -> Column:
    """A value per rule; equal values share a branch."""
    places: dict[object, list[int]] = {}
    for place, rule in enumerate(rules):
        found = value(rule)
        if found != default:
            places.setdefault(found, []).append(place)
    out: Column | None = None
    for found, where in places.items():
        test = F.col("rule").isin(where)
        result = found if isinstance(found, Column) else F.lit(found)
        out = F.when(test, result) if out is None else out.when(test, result)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def _tested(rules: Sequence[Rule], patterns: Callable[[Rule], tuple[str, ...]], none: bool) -> Column:
    """Whether the text matches any of its rule's patterns; ``none`` for rules without patterns."""
    out: Column | None = None
    for place, rule in enumerate(rules):
        if patterns(rule):
            test = F.col("text").rlike(any_of(patterns(rule)))
            mine = F.col("rule") == place
            out = F.when(mine, test) if out is None else out.when(mine, test)
    return F.lit(none) if out is None else out.otherwise(none)


def strip_lines(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Drop lines that match one of their rule's strip patterns."""
    return lines.where(~_tested(rules, lambda r: r.strip_lines, False))


def keep_lines(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Where the rule has keep patterns, keep only lines that match one."""
    return lines.where(_tested(rules, lambda r: r.keep_lines, True))


def clean_lines(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Stages one and two: control sequences and replacements."""
    text = F.coalesce(F.col("text"), F.lit(""))
    coloured = [place for place, rule in enumerate(rules) if rule.strip_ansi]
    if coloured:
        text = F.when(F.col("rule").isin(coloured), strip_ansi(text, osc=False)).otherwise(text)
    lines = lines.withColumn("text", text)
    for place, rule in enumerate(rules):
        if rule.replace:
            changed = replace_chain(F.col("text"), rule.replace)
            lines = lines.withColumn(
                "text", F.when(F.col("rule") == place, changed).otherwise(F.col("text"))
            )
    return lines


def truncate_lines(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    limit = by_rule(rules, lambda r: max(r.truncate_at, 0), 0)
    return lines.withColumn("text", truncate_bytes(F.col("text"), limit))


def apply_project_rules(lines: DataFrame, rules: Sequence[ProjectRule]) -> DataFrame:
    """Drop lines that match a suppress rule; the other actions do nothing."""
    patterns = [rule.match for rule in rules if rule.action == "suppress"]
    if not patterns:
        return lines
    return lines.where(~F.coalesce("text", F.lit("")).rlike(any_of(patterns)))


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.coalesce("text", F.lit("")) != "")


def _entry_column(
    rules: Sequence[Rule], places: Sequence[int], number: int, part: str, test: Callable[[Pattern], Column]
) -> Column:
    """Test of one part of the number-th match_output entry of each rule; null where it is not set."""
    out: Column | None = None
    for place in places:
        entries = rules[place].match_output
        source = getattr(entries[number], part) if number < len(entries) else ""
        if source:
            mine = F.col("rule") == place
            found = test(translate(source))
            out = F.when(mine, found) if out is None else out.when(mine, found)
    return F.lit(None).cast("boolean") if out is None else out


def match_output(runs: DataFrame, lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Runs whose whole output is replaced by one message: (run_id, rule, message).

    ``runs`` has run_id and rule, ``lines`` is cleaned, chunked and carries its rule. The first entry whose
    pattern matches (or is empty) and whose unless-pattern does not, decides. A pattern that cannot
    match a newline is tested line by line and the answers are combined per run, so the output is
    never put together. Rules whose patterns match some newlines at most are tested on overlapping
    blocks of lines; those with a pattern that can match any number by automata, range by range. Patterns whose
    automaton would be too large are refused when the plan is built.
    """
    with_entries = [place for place, rule in enumerate(rules) if rule.match_output]
    if not with_entries:
        empty = F.lit("").alias("message")
        return runs.where("false").select("run_id", "rule", empty)

    def crosses(place: int) -> bool:
        parts = [p for m in rules[place].match_output for p in (m.pattern, m.unless) if p]
        return any(translate(p).crosses_lines for p in parts)

    def newlines(place: int) -> int | None:
        parts = [p for m in rules[place].match_output for p in (m.pattern, m.unless) if p]
        each = [translate(p).newlines for p in parts]
        return None if None in each else max(each, default=0)

    crossing = [place for place in with_entries if crosses(place)]
    local = [place for place in with_entries if place not in crossing]
    whole = [place for place in crossing if newlines(place) is None]
    blocks = [place for place in crossing if place not in whole]
    slots = entry_slots(rules)

    answers = []
    if local:
        answers.append(_line_answers(lines.where(F.col("rule").isin(local)), rules, local, slots))
    if blocks:
        reach = max(newlines(place) for place in blocks)
        answers.append(_block_answers(lines.where(F.col("rule").isin(blocks)), rules, blocks, slots, reach))
    if whole:
        machines = entry_machines(rules, whole)
        states = automaton_states(lines.where(F.col("rule").isin(whole)), machines)
        answers.append(automaton_answers(states, machines, slots))
    answered = answers[0]
    for more in answers[1:]:
        answered = answered.unionByName(more)

    return decided(runs, answered, rules)


def entry_slots(rules: Sequence[Rule]) -> list[tuple[int, str]]:
    """(number, part) of all match_output entries."""
    most = max((len(rule.match_output) for rule in rules), default=0)
    return [(number, part) for number in range(most) for part in ("pattern", "unless")]


def decided(runs: DataFrame, answered: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The message of the first entry that applies, from the answers per run (run_id, _pattern0, _unless0, ...)."""
    with_entries = [place for place, rule in enumerate(rules) if rule.match_output]
    most = max((len(rules[place].match_output) for place in with_entries), default=0)
    # A run without lines has the empty output.
    takers = runs.where(F.col("rule").isin(with_entries)).select("run_id", "rule")
    joined = takers.join(beside(answered), "run_id", "left")
    chosen: Column | None = None
    for number in range(most):
        verdicts = {}
        for part in ("pattern", "unless"):
            empty = _entry_column(rules, with_entries, number, part, lambda p: F.lit("").rlike(p.java))
            verdicts[part] = F.coalesce(F.col(f"_{part}{number}"), empty)
        owners = [p for p in with_entries if number < len(rules[p].match_output)]
        message = by_rule(
            [r if p in owners else Rule("") for p, r in enumerate(rules)],
            lambda r, n=number: r.match_output[n].message if n < len(r.match_output) else "",
            "",
        )
        applies = (
            F.col("rule").isin(owners)
            & F.coalesce(verdicts["pattern"], F.lit(True))
            & ~F.coalesce(verdicts["unless"], F.lit(False))
        )
        chosen = F.when(applies, message) if chosen is None else chosen.when(applies, message)
    return joined.select("run_id", "rule", chosen.alias("message")).where("message IS NOT NULL")


def _line_answers(
    lines: DataFrame, rules: Sequence[Rule], places: Sequence[int], slots: Sequence[tuple[int, str]]
) -> DataFrame:
    sources = [p for pl in places for m in rules[pl].match_output for p in (m.pattern, m.unless) if p]
    if any(translate(p).anchored for p in sources):
        # Only then does it matter which line is the first or the last of its run.
        ends = lines.groupBy("run_id").agg(
            F.min("line_no").alias("_low"), F.max("line_no").alias("_high")
        )
        lines = attach(lines, ends)
        first, last = F.col("line_no") == F.col("_low"), F.col("line_no") == F.col("_high")
    else:
        first = last = F.lit(True)

    def test(pattern: Pattern) -> Column:
        text = F.col("text")
        if not pattern.anchored:
            return text.rlike(pattern.java)
        return (
            F.when(first & last, text.rlike(pattern.at(True, True)))
            .when(first, text.rlike(pattern.at(True, False)))
            .when(last, text.rlike(pattern.at(False, True)))
            .otherwise(text.rlike(pattern.at(False, False)))
        )

    return lines.groupBy("run_id").agg(
        *(
            F.max(_entry_column(rules, places, number, part, test)).alias(f"_{part}{number}")
            for number, part in slots
        )
    )


def _block_answers(
    lines: DataFrame, rules: Sequence[Rule], places: Sequence[int], slots: Sequence[tuple[int, str]], reach: int
) -> DataFrame:
    """Answers for patterns whose matches hold at most ``reach`` newlines.

    A run is cut into blocks of lines; each has as many of the following lines besides as a match
    that begins in it can reach, and one more, so that no match ends at an end that is the block's only.
    """
    more = reach + 1
    size = max(BLOCK_LINES, more)
    last = lines.groupBy("run_id").agg(F.max("line_no").alias("_high"))
    rows = running(attach(lines, last), ["run_id"], ["line_no"], "sum", "1", "_n")
    own = F.expr(f"_n div {size}")
    before = F.when((own > 0) & (F.col("_n") % size < more), F.array(own - 1, own)).otherwise(F.array(own))
    texts = (
        rows.withColumn("_block", F.explode(before))
        .groupBy("run_id", "rule", "_block")
        .agg(
            F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("_lines"),
            F.bool_or(F.col("line_no") == F.col("_high")).alias("_last"),
        )
        .withColumn("full", F.array_join(F.transform("_lines", lambda line: line["text"]), "\n"))
    )
    text, first, end = F.col("full"), F.col("_block") == 0, F.col("_last")

    def test(pattern: Pattern) -> Column:
        return (
            F.when(first & end, text.rlike(pattern.within(True, True)))
            .when(first, text.rlike(pattern.within(True, False)))
            .when(end, text.rlike(pattern.within(False, True)))
            .otherwise(text.rlike(pattern.within(False, False)))
        )

    return texts.groupBy("run_id").agg(
        *(
            F.max(_entry_column(rules, places, number, part, test)).alias(f"_{part}{number}")
            for number, part in slots
        )
    )


class Machine(NamedTuple):
    """The automaton of one part of a rule's match_output entry."""

    place: int
    number: int
    part: str
    automaton: Automaton


def entry_machines(rules: Sequence[Rule], places: Sequence[int]) -> list[Machine]:
    """Automata of all patterns of some rules; those that would be too large are refused."""
    machines = []
    for place in places:
        for number, entry in enumerate(rules[place].match_output):
            for part in ("pattern", "unless"):
                source = getattr(entry, part)
                if source:
                    try:
                        machines.append(Machine(place, number, part, automaton(source)))
                    except TooLarge as error:
                        raise UnsupportedPattern(str(error)) from error
    return machines


def automaton_states(lines: DataFrame, machines: Sequence[Machine], before: DataFrame | None = None) -> DataFrame:
    """Where the lines of a run take its rule's automata: (run_id, slot, state), slots being places in ``machines``.

    ``before`` (the same columns) holds the states that runs come with; other runs start in BEFORE. The lines are dealt in
    ranges of (run, line number) of about equal size. In a range every run but the first begins there, so its automata go
    from state to state. Only of the first it is not known where it stands: its lines make a map that takes each state to
    some state, one for each range at most, and the maps of a run are applied in order.
    """
    run_type = dict(lines.dtypes)["run_id"]
    # The states of a run go before its lines.
    number = F.coalesce(F.col("line_no").cast("bigint"), F.lit(STATE_LINE + 1))
    rows = lines.select(
        "run_id", number.alias("line_no"), "rule", "text", F.lit(None).cast("int").alias("slot"), F.lit(None).cast("int").alias("state")
    )
    if before is not None:
        begun = before.select(
            "run_id", F.lit(STATE_LINE).cast("bigint").alias("line_no"), F.lit(None).cast("int").alias("rule"),
            F.lit(None).cast("string").alias("text"), "slot", "state",
        )
        rows = begun.unionByName(rows)
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(pieces, "run_id", "line_no").sortWithinPartitions("run_id", "line_no")
    schema = f"run_id {run_type}, line_no bigint, slot int, state int, map array<int>"
    found = laid.mapInArrow(lambda batches: _walked(batches, machines), schema)
    found = found.withColumn("_range", F.floor(F.spark_partition_id() / RANGES_TOGETHER))
    for keys in (["run_id", "slot", "_range"], ["run_id", "slot"]):
        found = _composed(found, keys)
    return found.select("run_id", "slot", F.coalesce("state", F.element_at("map", BEFORE + 1)).alias("state"))


def _walked(batches: Iterator[pa.RecordBatch], machines: Sequence[Machine]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (run_id, line_no, rule, text, slot, state), each run's states, or the maps of what began before."""
    run, first, begins, open_slots = None, None, False, {}

    def told(ready: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*ready, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], ids_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
             pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.list_(pa.int32()))],
            names=["run_id", "line_no", "slot", "state", "map"],
        )

    def closed() -> list[tuple]:
        return [
            (run, first, slot, None, at.tolist()) if isinstance(at, np.ndarray) else (run, first, slot, int(at), None)
            for slot, at in open_slots.items()
        ]

    ids_type, seen = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        ids_type = batch.column(0).type
        ids, numbers, places, texts, slots, states = (column.to_pylist() for column in batch.columns)
        starts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
        # (open slots of a run, slot, its lines) of those that go from state to state
        ready, walks = [], []
        for a, b in zip(starts, starts[1:], strict=False):
            if not seen or ids[a] != run:
                ready += [(open_slots, run, first)] if seen else []
                begins = seen or slots[a] is not None
                run, first, open_slots, seen = ids[a], numbers[a], {}, True
            while a < b and slots[a] is not None:
                open_slots[slots[a]] = states[a]
                a += 1
            for slot, machine in enumerate(machines if a < b else ()):
                if machine.place == places[a]:
                    if slot not in open_slots and begins:
                        open_slots[slot] = BEFORE
                    if slot not in open_slots:
                        open_slots[slot] = _map_of(machine.automaton, texts[a:b])
                    elif isinstance(open_slots[slot], np.ndarray):
                        open_slots[slot] = _map_of(machine.automaton, texts[a:b])[open_slots[slot]]
                    else:
                        walks.append((open_slots, slot, a, b))
        _walk(walks, texts, machines)
        out = []
        last = (open_slots, run, first)
        for open_slots, run, first in ready:
            out += closed()
        open_slots, run, first = last
        if out:
            yield told(out)
    if seen and (out := closed()):
        yield told(out)


def _walk(walks: list[tuple[dict, int, int, int]], texts: list[str | None], machines: Sequence[Machine]) -> None:
    """Take the open states (of ``walks``: where they are kept, slot, first line, end) over their lines, all of a slot side by side."""
    for slot, machine in enumerate(machines):
        mine, held, size = [], [], 0
        for kept, _, a, b in (walk for walk in walks if walk[1] == slot):
            codes = sum(len(text or "") + 1 for text in texts[a:b])
            if codes > WALK_AT_MOST:
                kept[slot] = _map_of(machine.automaton, texts[a:b])[kept[slot]]
                continue
            mine.append(kept)
            held.append(texts[a:b])
            size += codes
            if size >= AT_ONCE:
                _side_by_side(machine.automaton, slot, mine, held)
                mine, held, size = [], [], 0
        _side_by_side(machine.automaton, slot, mine, held)


def _side_by_side(machine: Automaton, slot: int, kept: list[dict], texts: list[list[str | None]]) -> None:
    if kept:
        for one, state in zip(kept, machine.states_of([one[slot] for one in kept], texts).tolist(), strict=True):
            one[slot] = state


def automaton_answers(states: DataFrame, machines: Sequence[Machine], slots: Sequence[tuple[int, str]]) -> DataFrame:
    """Answers per run from the states (run_id, slot, state) that its text has led to."""
    ended: Column | None = None
    for slot, machine in enumerate(machines):
        test = F.col("state").isin(np.flatnonzero(machine.automaton.ends).tolist())
        ended = F.when(F.col("slot") == slot, test) if ended is None else ended.when(F.col("slot") == slot, test)
    told = states.withColumn("_found", F.lit(None).cast("boolean") if ended is None else ended)

    def answer(number: int, part: str) -> Column:
        own = [k for k, m in enumerate(machines) if (m.number, m.part) == (number, part)]
        return F.max(F.when(F.col("slot").isin(own), F.col("_found"))).alias(f"_{part}{number}")

    return told.groupBy("run_id").agg(*(answer(number, part) for number, part in slots))


def _map_of(machine: Automaton, texts: list[str | None]) -> np.ndarray:
    """Where some lines take each state, a stretch at a time."""
    maps, held, size = [], [], 0
    for text in texts:
        held.append(text)
        size += len(text or "") + 1
        if size >= AT_ONCE:
            maps.append(machine.map_of(held))
            held, size = [], 0
    maps.append(machine.map_of(held))
    return composed(np.stack(maps))


def _composed(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States and maps of each group in the order of their first lines, as one: a state, if there is one, comes first."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "state", "map")))
    grouped = found.groupBy(*keys).agg(parts.alias("_parts"))
    first, rest = F.element_at("_parts", 1), F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0)))
    # a state goes on as an array of one
    begun = F.coalesce(F.array_compact(F.array(first["state"])), F.array())
    whole = F.aggregate(
        rest, F.when(first["state"].isNotNull(), begun).otherwise(first["map"]),
        lambda done, more: F.transform(done, lambda s: F.get(more["map"], s)),
    )
    return grouped.select(
        *keys, first["line_no"].alias("line_no"), first["state"].isNotNull().alias("_begun"), whole.alias("_whole")
    ).select(
        *keys, "line_no", F.when(F.col("_begun"), F.get("_whole", F.lit(0))).alias("state"),
        F.when(~F.col("_begun"), F.col("_whole")).alias("map"),
    )


def head_lines(lines: DataFrame, n: int | Column, size: int = CHUNK_ROWS) -> DataFrame:
    """The first n lines of each run; n may be a column that is the same for all lines of a run."""
    return lines_within(lines, n, None, size)


def tail_lines(lines: DataFrame, n: int | Column, size: int = CHUNK_ROWS) -> DataFrame:
    """The last n lines of each run."""
    return lines_within(lines, None, n, size)


def lines_within(lines: DataFrame, head: int | Column | None, tail: int | Column | None, size: int = CHUNK_ROWS) -> DataFrame:
    """Of the first ``head`` lines of each run the last ``tail``; null and None mean no limit.

    Lines are counted per chunk, which tells the chunks that the cuts fall in; only their line numbers are ranked. The text
    is read once and neither sorted nor sent to one task by run. Lines that share a number stay or go together: all stay if one does.
    """
    columns = lines.columns
    rows = lines if CHUNK in columns else chunked(lines, "line_no", size)
    rows = rows.withColumns({"_head": _limit(head), "_tail": _limit(tail)})
    limited = rows.where("_head IS NOT NULL OR _tail IS NOT NULL")
    counts = limited.groupBy("run_id", CHUNK).agg(
        F.expr("count(1) AS _n"), F.first("_head").alias("_head"), F.first("_tail").alias("_tail")
    )
    up_to, run = f"PARTITION BY run_id ORDER BY {CHUNK}", "PARTITION BY run_id"
    counts = counts.withColumns({
        "_base": F.expr(f"sum(_n) OVER ({up_to}) - _n"),
        "_end": F.expr(f"least(sum(_n) OVER ({run}), coalesce(_head, sum(_n) OVER ({run})))"),
    })
    counts = counts.withColumn("_begin", F.expr("greatest(_end - coalesce(_tail, _end), 0L)"))
    # Lines _begin to _end of the run are kept: a chunk is kept, left out, or cut at a line.
    chunks = staged(counts.select("run_id", CHUNK, "_n", "_base", "_begin", "_end"), "limits")
    cut = chunks.where("(_base < _begin AND _begin < _base + _n) OR (_base < _end AND _end < _base + _n)")
    numbers = limited.select("run_id", CHUNK, "line_no").join(beside(cut), ["run_id", CHUNK])
    place = f"_base + row_number() OVER (PARTITION BY run_id, {CHUNK} ORDER BY line_no)"
    numbers = numbers.withColumn("_place", F.expr(place)).groupBy("run_id", CHUNK).agg(
        F.expr("max(IF(_place = _begin + 1, line_no, NULL)) AS _low"),
        F.expr("max(IF(_place = _end, line_no, NULL)) AS _high"),
    )
    kept = chunks.where("_begin < _base + _n AND _base < _end").select("run_id", CHUNK)
    kept = staged(kept.join(beside(numbers), ["run_id", CHUNK], "left").withColumn("_kept", F.lit(True)), "cuts")
    found = rows.join(beside(kept), ["run_id", CHUNK], "left")
    inside = "_kept AND (_low IS NULL OR line_no >= _low) AND (_high IS NULL OR line_no <= _high)"
    return found.where(f"(_head IS NULL AND _tail IS NULL) OR ({inside})").select(*columns)


def _limit(n: int | Column | None) -> Column:
    return (n if isinstance(n, Column) else F.lit(n)).cast("bigint")


def limit_lines(lines: DataFrame, rules: Sequence[Rule], size: int = CHUNK_ROWS) -> DataFrame:
    """Stages seven and eight: the first max_lines lines, and of those the last tail_lines."""
    head, tail = (
        F.nullif(by_rule(rules, lambda r, f=field: max(getattr(r, f), 0), 0), F.lit(0)) for field in ("max_lines", "tail_lines")
    )
    if all(rule.max_lines <= 0 and rule.tail_lines <= 0 for rule in rules):
        return lines
    return lines_within(lines, head, tail, size)


def on_empty(runs: DataFrame, output: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One message row for each run with a rule whose output holds no line: (run_id, message)."""
    message = by_rule(rules, lambda r: r.on_empty, "")
    told = runs.withColumn("message", message).where("message <> ''").select("run_id", "message")
    return told.join(beside(output.select("run_id").distinct()), "run_id", "left_anti")


def apply_rules(
    runs: DataFrame,
    lines: DataFrame,
    rules: Sequence[Rule],
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """All nine stages for the runs that a rule takes: (run_id, pos, kind, text).

    ``runs`` may already carry ``rule``; otherwise it is matched here. ``kind`` tells lines from
    messages that stand for a whole output.
    """
    if "rule" not in runs.columns:
        runs = match_rule(runs, rules)
    runs = runs.where("rule IS NOT NULL").select("run_id", "rule")
    lines = chunked(lines.select("run_id", "line_no", "text"), "line_no", size)
    lines = clean_lines(attach(lines, runs).where("rule IS NOT NULL"), rules)

    replaced = match_output(runs, lines, rules)
    if any(rule.match_output for rule in rules):
        replaced = staged(replaced, "replaced")
        settled = replaced.select("run_id", F.lit(True).alias("_settled"))
        lines = attach(lines, settled).where("_settled IS NULL").drop("_settled")
    kept = keep_lines(strip_lines(lines, rules), rules)
    kept = truncate_lines(kept, rules).select("run_id", "rule", "line_no", "text", CHUNK)
    # Most of the output is gone here; the limits count its lines before they read them.
    kept = limit_lines(staged(kept, "kept"), rules, size)
    left = runs.join(beside(replaced.select("run_id")), "run_id", "left_anti")
    return (
        kept.select("run_id", F.col("line_no").alias("pos"), F.lit("line").alias("kind"), "text")
        .unionByName(message_rows(replaced.where("message <> ''")))
        .unionByName(message_rows(on_empty(left, kept, rules)))
    )


def message_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "run_id",
        F.lit(1).cast("bigint").alias("pos"),
        F.lit("message").alias("kind"),
        F.col("message").alias("text"),
    )


def check_rules(rules: Sequence[Rule], tests: DataFrame) -> DataFrame:
    """Run each inline test (rule, name, input, expected) through its rule, addressed by name.

    Adds the actual output and ``passed``. Line ends are normalised and trailing newlines dropped.
    """
    places = {rule.name: place for place, rule in reversed(list(enumerate(rules)))}
    place = F.lit(None).cast("int")
    for name, number in places.items():
        place = F.when(F.col("rule_name") == name, number).otherwise(place)

    def tidy(col: Column) -> Column:
        return F.rtrim(F.regexp_replace(col, "\r+(?=\n|\\z)", ""), F.lit("\r\n"))

    cases = tests.withColumnRenamed("rule", "rule_name").withColumn(
        "run_id", F.sha2(F.to_json(F.struct("rule_name", "name", "input", "expected")), 256)
    )
    # equal cases are one run, whose answer all of them get
    once = cases.dropDuplicates(["run_id"])
    # The input of a test is a small text, so it splits inside one row.
    text = tidy(F.col("input"))
    lines = once.where(text != "").select(
        "run_id", F.posexplode(F.split(text, "\n")).alias("line_no", "text")
    ).withColumn("line_no", F.col("line_no").cast("bigint") + 1)
    runs = once.select("run_id", place.alias("rule"))
    output = apply_rules(runs, lines, rules)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    actual = output.groupBy("run_id").agg(
        F.array_join(F.transform(ordered, lambda line: line["text"]), "\n").alias("actual")
    )
    return (
        cases.join(beside(actual), "run_id", "left")
        .withColumn("actual", F.coalesce("actual", F.lit("")))
        .withColumn("passed", tidy(F.col("actual")) == tidy(F.col("expected")))
        .select(F.col("rule_name").alias("rule"), "name", "expected", "actual", "passed")
    )


__all__ = [
    "apply_project_rules", "apply_rules", "check_rules", "drop_blank", "head_lines",
    "keep_lines", "limit_lines", "match_output", "match_rule", "on_empty", "strip_lines", "tail_lines", "truncate_lines",
]
