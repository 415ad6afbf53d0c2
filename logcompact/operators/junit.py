"""JUnit XML of any size: where to cut a report, and what its pieces hold.

A report is cut at line starts, one cut per chunk of lines at most, and never inside a tag. What the parser would know at
a cut is carried there: the lexer's state by a map of states per chunk, the open elements by a balance of tags per piece.
Each piece then is a document of its own: the open elements are opened before it and closed behind it.
All three passes read lines one by one, so neither a report nor a suite nor a case has to fit in memory; of a failure's
text only what can be shown is kept. Reports of one chunk need the last pass only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from logcompact.functions.text import WHITE_SPACE
from logcompact.operators.ordered import CHUNK, CHUNK_ROWS, beside, chunked, merged_chunks
from logcompact.session import staged

# The lexer's states at a line start; in the first four a report can be cut.
TEXT, COMMENT, CDATA, INSTRUCTION, TAG, DOUBLE, SINGLE, DOCTYPE, SUBSET = range(9)
CUT = INSTRUCTION
ENDS = {COMMENT: "-->", CDATA: "]]>", INSTRUCTION: "?>", DOUBLE: '"', SINGLE: "'", SUBSET: "]"}
AFTER = {COMMENT: TEXT, CDATA: TEXT, INSTRUCTION: TEXT, DOUBLE: TAG, SINGLE: TAG, SUBSET: DOCTYPE}
OPENINGS = {COMMENT: "<!--", CDATA: "<![CDATA[", INSTRUCTION: "<?x "}
STARTS = (("<!--", COMMENT), ("<![CDATA[", CDATA), ("<?", INSTRUCTION), ("<!", DOCTYPE))
MARK, SUBSET_MARK, NAME = re.compile("[>\"']"), re.compile(r"[>\[]"), re.compile(r"/?[^\s<>/\"']*")
BEGIN, END = "logcompact-begin", "logcompact-end"

LONG = re.compile(r"[+-]?\d+", re.ASCII)
DOUBLE_VALUE = re.compile(r"([+-]?(?:NaN|Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))[fFdD]?", re.ASCII)
# What a number format reads of a text that is no plain number: a number at its start, digits grouped by commas.
NUMBER_PREFIX = re.compile(r"-?(?:\d[\d,]*(?:\.\d*)?|\.\d+)", re.ASCII)
# Of a failure's text three lines are shown.
SHOWN = 3
# The place of a piece's head, before all its lines.
FIRST_ROW = -(1 << 63)


def scan(line: str, state: int, name: str = "", told: Callable[[str, bool], None] | None = None) -> tuple[int, str]:
    """The state behind a line, and the name of the tag it is in; ``told`` gets each tag's name and whether it is empty."""
    at = 0
    while True:
        if state == TEXT:
            at = line.find("<", at)
            if at < 0:
                return TEXT, ""
            for start, inside in STARTS:
                if line.startswith(start, at):
                    state, at = inside, at + len(start)
                    break
            else:
                found = NAME.match(line, at + 1)
                state, name, at = TAG, found[0], found.end()
        elif state in (TAG, DOCTYPE):
            found = (MARK if state == TAG else SUBSET_MARK).search(line, at)
            if not found:
                return state, name
            at = found.end()
            if found[0] != ">":
                state = {'"': DOUBLE, "'": SINGLE, "[": SUBSET}[found[0]]
                continue
            if state == TAG and told:
                told(name, line[at - 2 : at - 1] == "/")
            state = TEXT
        else:
            end = line.find(ENDS[state], at)
            if end < 0:
                return state, name
            at, state = end + len(ENDS[state]), AFTER[state]


def _grouped(batches: Iterator[pa.RecordBatch], start: Callable, types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Feeds rows (run, part, line_no, ...), sorted so, to one reader per (run, part); yields the rows they make."""
    key, reader, out = None, None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for run, part, *row in zip(*columns, strict=True):
            if key != (run, part):
                if reader:
                    out += [(*key, *made) for made in reader.finish()]
                key, reader = (run, part), start()
            reader.line(*row)
            if len(out) >= 4096:
                yield _batch(out, types)
                out = []
    if reader:
        out += [(*key, *made) for made in reader.finish()]
    yield _batch(out, types)


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, types, strict=True)], schema=types)


def _read(rows: DataFrame, start: Callable, schema: str) -> DataFrame:
    """One reader per (run, part) over its rows in order, dealt by both."""
    run, part, order = rows.columns[:3]
    schema = f"run_id {dict(rows.dtypes)[run]}, {part} bigint, {schema}"
    types = to_arrow_schema(StructType.fromDDL(schema))
    laid = rows.repartition(run, part).sortWithinPartitions(run, part, order)
    return laid.mapInArrow(lambda batches: _grouped(batches, start, types), schema)


def _per_run(rows: DataFrame, fold: Callable[[list[dict]], list[dict]], order: str, schema: str) -> DataFrame:
    """A fold over the few rows of a run in order; a task reads its runs one after another."""
    schema = f"run_id {dict(rows.dtypes)['run_id']}, {schema}"
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def folded() -> list[dict]:
            return [{"run_id": held[0]["run_id"], **row} for row in fold(held)] if held else []

        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["run_id"] != held[0]["run_id"]:
                    out += folded()
                    held = []
                held.append(row)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=types)
                out = []
        yield pa.RecordBatch.from_pylist(out + folded(), schema=types)

    return rows.repartition("run_id").sortWithinPartitions("run_id", order).mapInArrow(run, schema)


class _States:
    """Of a chunk, for each state it may start in: the state it ends in, and its first line that can start a piece."""

    def __init__(self) -> None:
        self.now = list(range(9))
        self.cut: list[int | None] = [None] * 9
        self.cut_state: list[int | None] = [None] * 9

    def line(self, line_no: int, text: str) -> None:
        for start, state in enumerate(self.now):
            if self.cut[start] is None and state <= CUT:
                self.cut[start], self.cut_state[start] = line_no, state
        after = {state: scan(text, state)[0] for state in set(self.now)}
        self.now = [after[state] for state in self.now]

    def finish(self) -> list[tuple]:
        return [(self.now, self.cut, self.cut_state)]


def _cuts(chunks: list[dict]) -> list[dict]:
    state, piece, out = TEXT, None, []
    for row in chunks:
        cut = row["cut"][state]
        out.append({CHUNK: row[CHUNK], "cut": cut, "cut_state": row["cut_state"][state], "before": piece})
        piece = row[CHUNK] if cut is not None else piece
        state = row["ends"][state]
    return out


class _Balance:
    """Tags of a piece: how many it closes that it didn't open, which it leaves open, how far up an element ends."""

    def __init__(self) -> None:
        self.state, self.name = None, ""
        self.closed, self.opened, self.least = 0, [], None

    def line(self, line_no: int, text: str, state: int) -> None:
        self.state, self.name = scan(text, state if self.state is None else self.state, self.name, self.tag)

    def tag(self, name: str, empty: bool) -> None:
        if name.startswith("/"):
            if self.opened:
                self.opened.pop()
            else:
                self.closed += 1
        elif not empty:
            self.opened.append(name)
            return
        depth = len(self.opened) - self.closed
        self.least = depth if self.least is None else min(self.least, depth)

    def finish(self) -> list[tuple]:
        return [(self.closed, self.opened, self.least, self.state)]


def _stacks(pieces: list[dict]) -> list[dict]:
    stack: list[str] = []
    out: list[dict] = []
    for at, row in enumerate(pieces):
        out.append({"piece": row["piece"], "stack": list(stack), "first": at == 0, "last": at == len(pieces) - 1})
        if row["least"] is not None and len(stack) + row["least"] <= 0:
            # The root ends here; what follows is not part of the report.
            out[-1]["last"] = True
            break
        del stack[len(stack) - row["closed"] :]
        stack += row["opened"]
    return out


class _Shown:
    """What can be shown of a text that comes in parts. Blank lines before it and the text behind the third line are shortened."""

    def __init__(self) -> None:
        self.kept: list[str] = []
        self.lines, self.begun, self.more = 0, False, False

    def add(self, text: str) -> None:
        if not self.begun:
            rest = text.lstrip(WHITE_SPACE)
            blank = text[: len(text) - len(rest)].count("\n")
            new = min(blank, SHOWN + 1 - self.lines)
            self.lines += new
            if new:
                self.kept.append("\n" * new)
            if not rest:
                return
            self.begun, self.lines, text = True, 0, rest
        while text and self.lines < SHOWN:
            head, line_end, text = text.partition("\n")
            self.kept.append(head + line_end)
            self.lines += len(line_end)
        if text.strip(WHITE_SPACE):
            self.more = True

    def __str__(self) -> str:
        return "".join(self.kept) + ("." if self.more else "")


class _Bad(Exception):
    pass


def _long(attributes: dict[str, str], name: str) -> int | None:
    value = attributes.get(name)
    if value is None:
        return None
    if not LONG.fullmatch(value) or not -(1 << 63) <= int(value) < 1 << 63:
        raise _Bad
    return int(value)


def _double(attributes: dict[str, str], name: str) -> float | None:
    value = attributes.get(name)
    if value is None:
        return None
    if found := DOUBLE_VALUE.fullmatch(value):
        return float(found[1])
    if found := NUMBER_PREFIX.match(value):
        return float(found[0].replace(",", ""))
    raise _Bad


def _local(name: str) -> str:
    return name.rpartition(":")[2].lower()


PARSED = (
    "what string, root boolean, suite bigint, case_no bigint, name string, classname string, tests bigint, failures bigint, "
    "errors bigint, time double, failure string, failure_more string, failure_text string, error string, error_more string, error_text string"
)


class _Parser:
    """Suites, failed cases and the parts of cases that go over cuts, from one piece.

    Suites and cases are counted inside the piece from 1; 0 is the one that is open at its start. A failure or an error
    comes as its message and text, and the text that goes on one from the piece before as ``more``.
    """

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.expat = None
        self.stack: list[str] = []
        self.suites = self.root_cases = self.cases = 0
        self.live = self.done = self.over = self.bad = False
        self.case: dict | None = None
        self.message: str | None = None

    def line(self, line_no: int, text: str, stack: list[str] | None, first: bool | None, last: bool | None, state: int | None, end: int | None) -> None:
        if stack is not None:
            self.begin(stack, first, last, state, end)
        elif not (self.done or self.bad):
            self.feed(text + "\n")

    def begin(self, stack: list[str], first: bool, last: bool, state: int, end: int) -> None:
        self.last, self.end_state = last, end
        self.expat = expat.ParserCreate()
        self.expat.buffer_text = False
        self.expat.StartElementHandler, self.expat.EndElementHandler = self.start, self.end
        self.expat.CharacterDataHandler, self.expat.ProcessingInstructionHandler = self.chars, self.instruction
        self.expat.DefaultHandler = self.other
        self.live = first
        if not first:
            opened = "".join(f"<{name}>" for name in stack)
            self.feed(f"<!---->{opened}<?{BEGIN}?>" + OPENINGS.get(state, ""))

    def feed(self, text: str, final: bool = False) -> None:
        try:
            self.expat.Parse(text, final)
        except (expat.ExpatError, _Bad):
            # What stands behind the root is not read.
            self.bad = not (self.done or self.over)

    def other(self, data: str) -> None:
        if data.startswith("&") and self.live and not self.over:
            raise _Bad

    def instruction(self, target: str, data: str) -> None:
        if target == BEGIN and not self.live:
            self.live = True
            # Elements open from the piece before: case 0 of suite 0, and its failure.
            depth = self.case_depth()
            if depth and len(self.stack) > depth:
                self.open_case({}, depth == 1, fresh=False)
                kind = _local(self.stack[depth + 1]) if len(self.stack) > depth + 1 else ""
                self.message = kind if kind in ("failure", "error") else None
                if self.message:
                    self.case[f"{kind}_more"] = _Shown()
        elif target == END:
            self.over = True

    def case_depth(self) -> int:
        """The depth at which the open elements hold a case: below the root, or below a suite that is below the root."""
        names = [_local(name) for name in self.stack[1:3]]
        if names[:1] == ["testcase"]:
            return 1
        return 2 if names == ["testsuite", "testcase"] else 0

    def open_case(self, attributes: dict[str, str], root: bool, fresh: bool = True) -> None:
        _double(attributes, "time")
        if fresh:
            if root:
                self.root_cases += 1
            else:
                self.cases += 1
        number = (self.root_cases if root else self.cases) if fresh else 0
        self.case = {"root": root, "suite": self.suites, "case_no": number, "whole": fresh,
                     "name": attributes.get("name"), "classname": attributes.get("classname")}

    def start(self, name: str, found: dict[str, str]) -> None:
        depth = len(self.stack)
        self.stack.append(name)
        if not self.live or self.over or self.done:
            return
        kind = _local(name)
        attributes = {_local(k): v.strip() for k, v in found.items() if not k.startswith("xmlns:")}
        if depth == 0 or depth == 1 and kind == "testsuite":
            if depth:
                self.suites, self.cases = self.suites + 1, 0
            numbers = [_long(attributes, k) for k in ("tests", "failures", "errors")]
            self.rows.append(("root" if not depth else "suite", not depth, self.suites, None, attributes.get("name"), None,
                              *numbers, _double(attributes, "time"), *[None] * 6))
        elif depth == self.case_depth() and kind == "testcase":
            self.open_case(attributes, depth == 1)
        elif self.case is not None and depth == self.case_depth() + 1 and kind in ("failure", "error"):
            self.message = kind
            self.case[kind] = attributes.get("message") or ""
            self.case[f"{kind}_text"] = _Shown()

    def chars(self, data: str) -> None:
        if self.message and self.live and not self.over and len(self.stack) == self.case_depth() + 2:
            text = f"{self.message}_text"
            self.case[text if text in self.case else f"{self.message}_more"].add(data)

    def end(self, name: str) -> None:
        self.stack.pop()
        if not self.live or self.over or self.done:
            return
        depth = len(self.stack)
        if depth == 0:
            self.done = True
        if self.message and self.case_depth() and depth == self.case_depth() + 1:
            self.message = None
        elif self.case is not None and not self.case_depth():
            self.close_case()

    def close_case(self, whole: bool = True) -> None:
        case, self.case = self.case, None
        told = any(k in case for k in ("failure", "error", "failure_more", "error_more"))
        whole = whole and case["whole"]
        if told or case["whole"] and not whole:
            texts = {k: str(case[k]) if k in case else None
                     for k in ("failure", "failure_more", "failure_text", "error", "error_more", "error_text")}
            self.rows.append(("case" if whole else "part", case["root"], case["suite"], case["case_no"], case["name"],
                              case["classname"], None, None, None, None, *texts.values()))

    def finish(self) -> list[tuple]:
        if not (self.bad or self.done):
            if self.last:
                self.feed("", True)
            else:
                self.expat.SetReparseDeferralEnabled(False)
                self.feed(OPENINGS_END.get(self.end_state, "") + f"<?{END}?>")
                rest = "".join(f"</{name}>" for name in reversed(self.stack)) or "<r/>"
                if not self.bad:
                    self.feed(rest, True)
                if self.case is not None:
                    self.close_case(whole=False)
        if self.bad:
            return [("bad", *[None] * 15)]
        counted = ("count", None, self.suites, self.cases, None, None, self.root_cases, *[None] * 9)
        return [counted, *self.rows]


OPENINGS_END = {state: ENDS[state] for state in OPENINGS}


def _numbers(counts: list[dict]) -> list[dict]:
    suites = cases = root_cases = 0
    out = []
    for row in counts:
        out.append({"piece": row["piece"], "suites_before": suites, "cases_before": cases, "root_cases_before": root_cases})
        cases = row["case_no"] + (0 if row["suite"] else cases)
        suites, root_cases = suites + row["suite"], root_cases + row["tests"]
    return out


def _merged(parts: list[dict]) -> dict:
    """One case from its parts in order; of several failures the last counts."""
    out = {k: parts[0][k] for k in ("name", "classname")}
    for kind in ("failure", "error"):
        message = text = None
        for row in parts:
            if message is not None and row[f"{kind}_more"] is not None:
                text += row[f"{kind}_more"]
            if row[kind] is not None:
                message, text = row[kind], row[f"{kind}_text"]
        out[kind], out[f"{kind}_text"] = message, text
    return out


def _cut_pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces of reports that go over several chunks: a head with what is open at its start, and its lines."""
    states = _read(rows, _States, "ends array<int>, cut array<bigint>, cut_state array<int>")
    cuts = staged(_per_run(states, _cuts, CHUNK, f"{CHUNK} bigint, cut bigint, cut_state int, before bigint"), "cuts")
    # cut_state is read of a piece's first line only
    pieces = rows.repartition("run_id", CHUNK).join(beside(cuts), ["run_id", CHUNK])
    begun = F.col("cut").isNotNull() & (F.col("line_no") >= F.col("cut"))
    pieces = pieces.select(
        "run_id", F.when(begun, F.col(CHUNK)).otherwise(F.col("before")).alias("piece"), "line_no", "text",
        F.col("cut_state").alias("state"),
    )
    pieces = staged(pieces, "pieces")
    tags = _read(pieces, _Balance, "closed bigint, opened array<string>, least bigint, end int")
    tags = staged(tags, "tags")
    stacks = _per_run(tags, _stacks, "piece", "piece bigint, stack array<string>, first boolean, last boolean")
    starts = cuts.where("cut IS NOT NULL").select("run_id", F.col(CHUNK).alias("piece"), F.col("cut_state").alias("state"))
    stacks = stacks.join(beside(starts), ["run_id", "piece"]).join(beside(tags.select("run_id", "piece", "end")), ["run_id", "piece"])
    stacks = staged(stacks, "stacks")
    heads = stacks.select(
        "run_id", "piece", F.lit(FIRST_ROW).cast("bigint").alias("line_no"), F.lit("").alias("text"),
        "stack", "first", "last", "state", "end",
    )
    # a piece behind the root has no head
    live = stacks.select("run_id", "piece", F.lit(True).alias("_live"))
    body = pieces.drop("state").repartition("run_id", "piece").join(beside(live), ["run_id", "piece"], "left_semi")
    return heads, body.select("run_id", "piece", "line_no", "text")


def read_junit(lines: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """What reports hold, piece by piece: rows (run_id, piece, what, suite_no, case_no, ...).

    ``what`` is suite, root (a root that is itself the suite), case (one with a failure or an error) or bad (the run is no
    well-formed report). Suites and cases are counted from 0.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    lines = lines.select("run_id", "line_no", F.coalesce("text", F.lit("")).alias("text"))
    rows = chunked(lines, "line_no", size).select("run_id", CHUNK, "line_no", "text")
    # A run of one chunk is one piece: nothing is carried to it, and it is read once.
    chunks = staged(merged_chunks(rows, ["run_id"], size).withColumn("alone", F.col("_chunks") == 1), "chunks")
    rows = rows.repartition("run_id", CHUNK).join(beside(chunks), ["run_id", CHUNK])
    rows = rows.select("run_id", F.col("_merged").alias(CHUNK), "line_no", "text", "alone")
    heads = chunks.where("alone").select("run_id", "_merged").distinct().select(
        "run_id", F.col("_merged").alias("piece"), F.lit(FIRST_ROW).cast("bigint").alias("line_no"), F.lit("").alias("text"),
        F.array().cast("array<string>").alias("stack"), F.lit(True).alias("first"), F.lit(True).alias("last"),
        F.lit(TEXT).alias("state"), F.lit(TEXT).alias("end"),
    )
    body = rows.where("alone").select("run_id", F.col(CHUNK).alias("piece"), "line_no", "text")
    if chunks.where("NOT alone").limit(1).count():
        more_heads, more = _cut_pieces(rows.where("NOT alone").drop("alone"))
        heads, body = heads.unionByName(more_heads), body.unionByName(more)
    body = body.withColumns({k: F.lit(None).cast(t) for k, t in heads.dtypes if k not in body.columns})
    found = staged(_read(heads.unionByName(body), _Parser, PARSED), "parsed")

    runs = found.groupBy("run_id").agg(F.expr("bool_or(what = 'bad') AS bad"), F.expr("bool_or(what = 'suite') AS wrapped"))
    numbers = _per_run(
        found.where("what = 'count'"), _numbers, "piece",
        "piece bigint, suites_before bigint, cases_before bigint, root_cases_before bigint",
    )
    numbers = staged(numbers.join(beside(runs.where("NOT bad")), "run_id"), "numbers")
    # a root with suites is no suite itself
    rows = found.where("what NOT IN ('bad', 'count')").repartition("run_id", "piece").join(beside(numbers), ["run_id", "piece"])
    rows = rows.where("NOT (root AND wrapped)").select(
        "run_id", "piece", "what",
        F.expr("IF(root, 0L, suites_before + suite - 1) AS suite_no"),
        F.expr("""CASE WHEN root THEN root_cases_before + case_no WHEN suite = 0 THEN cases_before + case_no
            ELSE case_no END - 1 AS case_no"""),
        *found.columns[6:],
    )
    # cases that go over a cut: a few rows each
    keys = ["run_id", "suite_no", "case_no"]
    parts = rows.where("what = 'part'")
    made = f"run_id {dict(rows.dtypes)['run_id']}, suite_no bigint, case_no bigint, piece bigint, what string, "
    made += ", ".join(f"{n} string" for n in ("name", "classname", "failure", "failure_text", "error", "error_text"))
    types = to_arrow_schema(StructType.fromDDL(made))

    def merge(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["piece"])
        same = {k: found[0][k] for k in (*keys, "piece")}
        return pa.Table.from_pylist([{**same, "what": "case", **_merged(found)}], schema=types)

    whole = parts.groupBy(*keys).applyInArrow(merge, made)
    out = rows.where("what <> 'part'").unionByName(whole, allowMissingColumns=True).drop("failure_more", "error_more")
    bad = runs.where("bad").select("run_id", F.lit("bad").alias("what"))
    return out.where("what <> 'case' OR failure IS NOT NULL OR error IS NOT NULL").unionByName(bad, allowMissingColumns=True)
