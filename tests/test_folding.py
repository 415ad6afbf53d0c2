"""Folding and caps against a grammar of whole runs, with chunks far smaller than a run."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logcompact.operators import blocks, caps
from logcompact.operators.ordered import chunked

# A line is one letter: A-H for the eight mixes of (noise, error, success), Y a blank line and
# Z a blank line that is noise.
LETTERS = {
    chr(ord("A") + i): dict(noise=bool(i & 1), error=bool(i & 2), success=bool(i & 4)) for i in range(8)
} | {"Y": dict(noise=False, error=False, success=False), "Z": dict(noise=True, error=False, success=False)}


def letters(test):
    return "[" + "".join(k for k, f in LETTERS.items() if test(k, f)) + "]"


BLANK, FULL = "[YZ]", "[A-H]"
RUN = re.compile(
    "(?P<block>" + letters(lambda k, f: k < "Y" and f["error"] and not f["noise"]) + rf".*?(?:{BLANK}{{2}}|\Z))"
    "|(?P<ok>" + letters(lambda k, f: k < "Y" and f["success"] and not f["noise"] and not f["error"])
    + letters(lambda k, f: f["success"]) + "*)"
    "|(?P<noise>" + letters(lambda k, f: f["noise"]) + ")|(?P<blank>Y)|(?P<line>.)"
)
FILE = re.compile(r"(\w+\.go):\d+:")


def group(numbered):
    """(number, text) of a block -> its texts, grouped by file."""
    files = {n: (FILE.match(t) or [None, ""])[1] for n, t in numbered}
    named = [f for f in files.values() if f]
    if len(set(named)) < 2:
        return [t for _, t in numbered]
    order = {f: i for i, f in reversed(list(enumerate(files.values())))}
    ranked = sorted(numbered, key=lambda nt: (files[nt[0]] != "", order[files[nt[0]]], nt[0]))
    out, headed = [], set()
    for n, text in ranked:
        file = files[n]
        if file and named.count(file) > 1:
            if file not in headed:
                out.append(f"{file}: {named.count(file)} errors")
                headed.add(file)
            text = "  " + text[len(file):].lstrip(":")
        out.append(text)
    return out


def expected(run):
    """run: list of (letter, text)."""
    word = "".join(letter for letter, _ in run)
    tokens = [(m.lastgroup, m.start(), m.end()) for m in RUN.finditer(word)]
    tokens = [t for t in tokens if t[0] != "noise"]
    out, i = [], 0
    while i < len(tokens):
        kind, start, end = tokens[i]
        if kind == "block":
            out += group([(n, run[n][1]) for n in range(start, end)])
        elif kind == "ok":
            out.append(run[start][1] if end - start == 1 else f"[{end - start} ok lines]")
        elif kind == "blank":
            out.append(run[start][1])
        else:
            key = re.sub(r"\b\d+\b", "N", run[start][1])
            j = i
            while j < len(tokens) and tokens[j][0] == "line" and re.sub(r"\b\d+\b", "N", run[tokens[j][1]][1]) == key:
                j += 1
            out.append(run[start][1])
            if j - i > 1 and not (j < len(tokens) and tokens[j][0] == "ok"):
                out.append(f"[{j - i} times]: {key}")
            i = j - 1
        i += 1
    return out


@pytest.fixture(scope="module")
def random_runs():
    rng = random.Random(7)
    runs = {}
    for run in range(400):
        weights = [rng.choice([0, 1, 4]) for _ in LETTERS]
        weights[0] += 1
        picked = rng.choices(list(LETTERS), weights, k=rng.randint(1, 22))
        runs[run] = [
            (k, "" if k in "YZ" else rng.choice(["x 1", "x 2", "y", f"a.go:{n}:", "b.go:3:1", "c.go:4: z"]))
            for n, k in enumerate(picked)
        ]
    return runs


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_folding_matches_the_grammar(spark, rendered, random_runs, size):
    rows = [
        # Line numbers have gaps, as after a filter.
        (run, 2 * n + run % 3, text, text, f["noise"], f["error"], f["success"], text == "")
        for run, lines in random_runs.items()
        for n, (letter, text) in enumerate(lines)
        for f in [LETTERS[letter]]
    ]
    names = "run_id BIGINT, line_no BIGINT, text STRING, _plain STRING, " + ", ".join(
        f"_{c} BOOLEAN" for c in ("noise", "error", "success", "blank")
    )
    placed = blocks.place_lines(chunked(spark.createDataFrame(rows, names), "line_no", size))
    placed = placed.cache()
    out = blocks.fold_lines(placed).unionByName(blocks.group_block_lines(placed.where("_in_block"), size))
    got = rendered(out)
    want = {run: lines for run, lines in ((r, expected(ls)) for r, ls in random_runs.items()) if lines}
    assert got == want


def capped(run, stack, grep):
    """run: list of (kind, text) with kinds l, g, f, o."""
    kept = [(k, t) for k, t in run if k != "l"]
    released, hits = set(), {}
    for m in re.finditer("g+", "".join(k for k, _ in kept)):
        if grep and m.end() - m.start() > grep:
            released.add(m.end())
            hits[m.end()] = m.end() - m.start() - grep
            for n in range(m.start() + grep, m.end()):
                kept[n] = ("g", None)
    rest = [n for n, (k, _) in enumerate(kept) if k != "g" and n not in released]
    frames = {}
    for m in re.finditer("f+", "".join(kept[n][0] for n in rest)):
        if stack and m.end() - m.start() > stack:
            after = rest[m.end()] if m.end() < len(rest) else len(kept)
            frames[after] = m.end() - m.start() - stack
            for n in rest[m.start() + stack : m.end()]:
                kept[n] = ("f", None)
    out, n = [], 0

    def marks(at):
        return ([f"[{hits[at]} more search hits]"] if at in hits else []) + (
            [f"[{frames[at]} more frames]"] if at in frames else []
        )

    for kind, text in run:
        if kind == "l":
            out.append("name of it")
            continue
        out += marks(n)
        if kept[n][1] is not None:
            out.append(text)
        n += 1
    return out + marks(n)


SAMPLES = {
    "l": "-rw-r--r-- 1 u g 5 Jan 1 10:00 name of it",
    "g": "lib/a.py:3: hit",
    "f": "    at app.call(1)",
    "o": "plain",
}


@pytest.mark.parametrize("size,stack,grep", [(1, 2, 3), (3, 1, 1), (8, 0, 2), (8, 2, 0), (1000, 2, 3)])
def test_caps_match_the_grammar(spark, rendered, size, stack, grep):
    rng = random.Random(3)
    runs = {
        run: [(k, SAMPLES[k]) for k in rng.choices("lgfo", [1, rng.choice([2, 6]), rng.choice([2, 6]), 2], k=rng.randint(1, 25))]
        for run in range(300)
    }
    rows = [(run, 3 * n, text) for run, lines in runs.items() for n, (_, text) in enumerate(lines)]
    frame = spark.createDataFrame(rows, "run_id BIGINT, pos BIGINT, text STRING")
    got = rendered(caps.cap_rows(frame, stack, grep, size))
    assert got == {run: capped(lines, stack, grep) for run, lines in runs.items()}


def test_success_rows_lose_colours_and_other_lines_keep_them(spark, rendered):
    lines = spark.createDataFrame(
        [(1, 1, "\x1b[32m✓ a\x1b[0m", None), (1, 2, "\x1b[31mplain\x1b[0m", None)],
        "run_id BIGINT, line_no BIGINT, text STRING, profile STRING",
    )
    assert rendered(blocks.compact_lines(lines)) == {1: ["✓ a", "\x1b[31mplain\x1b[0m"]}


def test_one_run_with_most_of_the_rows_spreads_over_tasks(spark):
    """The rows of a run are partitioned by chunk, so the largest task is bounded."""
    lines = spark.range(40_000).select(
        F.lit(1).cast("bigint").alias("run_id"),
        F.col("id").alias("line_no"),
        F.concat(F.lit("step "), F.col("id")).alias("text"),
    )
    out = blocks.dedup_adjacent(lines, 1000)
    assert [(r["pos"], r["n"]) for r in out.orderBy("pos").collect()] == [(0, 1), (2 * 39_999 + 1, 40_000)]
    spread = chunked(lines, "line_no", 1000).repartition(8, "run_id", "_chunk")
    largest = spread.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest <= 40_000 / 2


def test_facts_are_joined_where_their_rows_are(spark, lines_of):
    """Facts per run and chunk grow with the input: no join sends them to the driver, small as they are."""
    from pyspark.sql import functions as F

    from logcompact.operators.blocks import collapse_success
    from logcompact.operators.caps import cap_rows
    from logcompact.operators.ordered import attach, chunked, number_rows
    from logcompact.operators.rules import head_lines

    lines = lines_of({1: "a\nb\nc", 2: "ok\nok"})
    facts = spark.createDataFrame([(1, "x")], "run_id BIGINT, fact STRING")
    made = [
        attach(chunked(lines, size=2), facts),
        number_rows(lines, ["run_id"], "line_no", "n", 2),
        collapse_success(lines.withColumn("profile", F.lit(None).cast("string")), 2),
        cap_rows(lines.withColumnRenamed("line_no", "pos"), 1, 1, 2),
        head_lines(lines, 2, 2),
    ]
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_caps_classify_rows_once(spark, lines_of, rendered):
    rows = lines_of({1: "-rw-r--r-- 1 u g 5 Jan 1 10:00 a b.txt\nx.py:1: a\nx.py:2: b\n\tat f\n\tat g\nend", 2: "x.py:3: c"})
    capped = caps.cap_rows(rows.withColumnRenamed("line_no", "pos"), 1, 1, 4)
    # what reads the classified rows again and again holds no pattern
    assert "RLIKE" not in capped._jdf.queryExecution().optimizedPlan().toString().upper()
    assert rendered(capped) == {
        1: ["a b.txt", "x.py:1: a", "[1 more search hits]", "\tat f", "\tat g", "end"],
        2: ["x.py:3: c"],
    }
