"""Streams give the batch answer, whatever the micro-batches and however small the chunks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from logcompact.operators import blocks, caps, loops, reports
from logcompact.operators import rules as U
from logcompact.plans.compact import compact, compact_plain
from logcompact.streaming import history as H
from logcompact.sources.control import parse_rules
from logcompact.streaming import lines as L
from logcompact.streaming import routes as W
from logcompact.streaming import rules as R

TEXTS = [
    "step 1", "step 2", "error: x", "a.go:1:2: m", "b.go:2: n", "b.go:3: o", "", "", "✓ a", "✓ b",
    "\tframe()", "\tframe()", "-rw-r--r-- 1 u g 5 Jan 1 10:00 name", "plain",
]


def feed(spark, tmp_path, batches, begin):
    """Append each batch to the source and run the stream to its end."""
    places = [str(tmp_path / name) for name in ("state", "out", "checkpoint")]
    for batch in batches:
        batch.write.mode("append").parquet(str(tmp_path / "source"))
        stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "source"))
        query = begin(stream, *places)
        query.awaitTermination()
        assert query.exception() is None
    return spark.read.parquet(places[1])


@pytest.mark.parametrize("blanks", [True, False])
def test_compaction(spark, tmp_path, rendered, blanks):
    rng = random.Random(11)
    lines = {
        run: [(n, text) for n, text in enumerate(rng.choices(TEXTS, [rng.choice([0, 1, 3]) + 0.1 for _ in TEXTS], k=rng.randint(1, 40)))]
        for run in range(60)
    }
    schema = "run_id BIGINT, line_no BIGINT, text STRING, command STRING, is_end BOOLEAN"
    parts = [[], [], [], []]
    for run, rows in lines.items():
        edges = sorted(rng.randint(0, len(rows)) for _ in range(3))
        for part, (low, high) in enumerate(zip([0, *edges], [*edges, len(rows)], strict=True)):
            parts[part] += [(run, n, text, "tool", False) for n, text in rows[low:high]]
        parts[rng.choice([2, 3]) if edges[2] == len(rows) else 3].append((run, 10**6, None, "tool", True))
    # A run closed in the third part has no rows in the fourth.
    batches = [spark.createDataFrame(rows, schema) for rows in parts]
    out = feed(
        spark, tmp_path, batches,
        lambda stream, *places: L.stream_compact(stream, *places, blanks=blanks, max_stack=1, max_grep=2, size=3),
    )
    whole = spark.createDataFrame([(r, n, t) for r, rows in lines.items() for n, t in rows], "run_id BIGINT, line_no BIGINT, text STRING")
    runs = spark.createDataFrame([(r, "tool") for r in lines], "run_id BIGINT, command STRING")
    batch = compact_plain(runs, whole, blanks=blanks, max_stack=1, max_grep=2, size=1000)
    assert rendered(out) == rendered(batch)


def test_micro_batches_broadcast_nothing(spark, tmp_path, monkeypatch):
    """Facts per run and chunk, state and ended runs grow with the input: no step sends them to the driver, small as they are."""
    plans, parquet = [], DataFrameWriter.parquet

    def write(writer, *args, **options):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        return parquet(writer, *args, **options)

    schema = "run_id BIGINT, line_no BIGINT, text STRING, command STRING, is_end BOOLEAN"
    lines = [(run, n, text, "tool", False) for run in (1, 2) for n, text in enumerate(TEXTS)]
    ends = [(run, 10**6, None, "tool", True) for run in (1, 2)]
    batches = [spark.createDataFrame(rows, schema) for rows in (lines, ends)]
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    feed(spark, tmp_path, batches, lambda stream, *places: L.stream_compact(stream, *places, blanks=True, size=8))
    assert sum("SortMergeJoin" in plan for plan in plans) >= 3
    assert not [plan for plan in plans if "Broadcast" in plan]


def test_loop_guard(spark, tmp_path):
    rng, at, rows = random.Random(2), 0, []
    for i in range(120):
        at += rng.choice([10, 200, 300, 301])
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), rng.choice("ab"), ""))
    schema = "run_id BIGINT, ts TIMESTAMP, command STRING, args STRING"
    batches = [spark.createDataFrame(rows[n : n + 30], schema) for n in range(0, 120, 30)]
    out = feed(spark, tmp_path, batches, H.stream_loop_guard)
    batch = loops.loop_guard(spark.createDataFrame(rows, schema))
    key = lambda frame: sorted((r.run_id, r["count"], r.loop) for r in frame.collect())
    assert key(out) == key(batch)


def test_changed_rules_apply_to_later_lines(spark, tmp_path):
    rules = tmp_path / "rules.toml"
    schema = "run_id BIGINT, line_no BIGINT, text STRING, command STRING, args STRING"
    batches = [spark.createDataFrame([(1, n, "x", "a", ""), (1, n + 1, "y", "a", "")], schema) for n in (1, 3)]
    patterns = iter(["x", "y"])

    def begin(stream, state, out, checkpoint):
        rules.write_text(f'[filters.a]\nmatch_command = "^a"\nstrip_lines_matching = ["{next(patterns)}"]')
        return L.stream_rule_refresh(stream, str(rules), out, checkpoint)

    out = feed(spark, tmp_path, batches, begin)
    assert sorted((r.line_no, r.text) for r in out.collect()) == [(2, "y"), (3, "x")]


def test_first_cut_of_open_runs(spark):
    """What later lines can still change starts at the open block or the last streak."""
    lines = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, "b 1"), (1, 3, "b 2"), (2, 1, "error: x"), (2, 2, "y"), (3, 1, "error: x"), (3, 2, ""), (3, 3, "")],
        "run_id BIGINT, line_no BIGINT, text STRING",
    ).withColumn("profile", F.lit(None).cast("string"))
    placed = blocks.classify_and_place(lines, 2)
    cuts = blocks.settled_before(placed, blocks.fold_streaks(placed)).collect()
    assert {r.run_id: r.cut for r in cuts} == {1: 2, 2: 1, 3: 4}


def test_caps_owed_at_the_end(spark):
    state = spark.createDataFrame([(1, 5, True, None, None), (2, 5, False, 9, True), (3, 2, True, 1, True)], caps.CAP_STATE)
    owed = caps.close_caps(state, 3, 2)
    assert sorted((r.run_id, r.text) for r in owed.collect()) == [(1, "[3 more search hits]"), (2, "[6 more frames]")]


def cut(spark, lines, rng, parts=4):
    """Batches of the lines of runs, cut at random places, each run closed by a row of its own."""
    schema = "run_id BIGINT, line_no BIGINT, text STRING, is_end BOOLEAN"
    batches = [[] for _ in range(parts)]
    for run, rows in lines.items():
        edges = sorted(rng.randint(0, len(rows)) for _ in range(parts - 1))
        for part, (low, high) in enumerate(zip([0, *edges], [*edges, len(rows)], strict=True)):
            batches[part] += [(run, n, text, False) for n, text in rows[low:high]]
        batches[parts - 1].append((run, 10**6, None, True))
    return [spark.createDataFrame(rows, schema) for rows in batches]


def compare(spark, tmp_path, rendered, lines, begin, summarize):
    rng = random.Random(5)
    out = feed(spark, tmp_path, cut(spark, lines, rng), lambda stream, *places: begin(stream, *places, size=3))
    rows = [(r, n, t) for r, texts in lines.items() for n, t in texts]
    whole = spark.createDataFrame(rows, "run_id BIGINT, line_no BIGINT, text STRING")
    assert rendered(out, "place") == rendered(summarize(whole), "place")


def test_tap(spark, tmp_path, rendered):
    rng = random.Random(7)
    texts = ["ok 1 - a", "ok 2 # SKIP b", "not ok 3 - c", "not ok 4", "---", " --- ", "1..7", "1..9", "x: y", "", None,
             "1..99999999999999999999"]
    lines = {run: list(enumerate(rng.choices(texts, k=rng.randint(1, 30)))) for run in range(60)}
    compare(spark, tmp_path, rendered, lines, L.stream_tap_summary, reports.summarize_tap)


def test_go_tests(spark, tmp_path, rendered):
    rng = random.Random(8)

    def line():
        if rng.random() < 0.1:
            return rng.choice(["panic", "", None, "null"])
        event = {"Action": rng.choice(["output", "output", "output", "pass", "fail", "skip", "run"]), "Package": rng.choice("pq")}
        test = rng.choice(["", "", "A", "B", "C"])
        event |= {"Test": test} if test else {}
        event |= {"Output": rng.choice(["o1\n", "o2\n", " \n"])} if event["Action"] == "output" else {}
        event |= {"Elapsed": rng.choice([0, 1.5, 2.5])} if event["Action"] in ("pass", "fail") else {}
        return json.dumps(event)

    lines = {run: [(n, line()) for n in range(rng.randint(1, 40))] for run in range(60)}
    compare(spark, tmp_path, rendered, lines, L.stream_test_summary, reports.summarize_test_events)


@pytest.mark.parametrize("tests", [3, 300])
def test_state_does_not_grow_with_passed_tests(spark, tmp_path, tests):
    schema = "run_id BIGINT, line_no BIGINT, text STRING, is_end BOOLEAN"
    go, tap = [], []
    for n in range(tests):
        for action in ("output", "pass"):
            event = {"Action": action, "Package": "p", "Test": f"T{n}", "Output": "text\n"}
            go.append((1, len(go), json.dumps(event), False))
        tap.append((1, n, f"ok {n}", False))
    go.append((1, len(go), json.dumps({"Action": "output", "Package": "p", "Test": "open", "Output": "o"}), False))
    for name, rows, begin in (("go", go, L.stream_test_summary), ("tap", tap, L.stream_tap_summary)):
        (tmp_path / name).mkdir()
        feed(spark, tmp_path / name, [spark.createDataFrame(rows, schema)], begin)
    held = {part: spark.read.parquet(str(tmp_path / part / "slot=0")).count()
            for part in ("go/state/packages", "go/state/output", "tap/state/counts", "tap/state/open")}
    assert set(held.values()) == {1}


def test_savings(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice("abc"), rng.randint(0, 50), rng.choice([0.0, 12.5, 50.0]), rng.randint(0, 9),
             rng.choice([True, False, None]), rng.choice([True, False, None])) for _ in range(90)]
    schema = "cmd STRING, saved_tokens BIGINT, savings_pct DOUBLE, exec_ms BIGINT, bypassed BOOLEAN, exact_tokens BOOLEAN"
    batches = [spark.createDataFrame(rows[n : n + 30], schema) for n in range(0, 90, 30)]
    feed(spark, tmp_path, batches, lambda stream, _, out, checkpoint: H.stream_savings(stream, out, checkpoint))
    found = {r.cmd: r for r in H.latest_totals(spark, str(tmp_path / "out")).collect()}
    for cmd in "abc":
        own = [r for r in rows if r[0] == cmd]
        assert (found[cmd].runs, found[cmd].total_saved) == (len(own), sum(r[1] for r in own))
        assert found[cmd].avg_exec_ms == sum(r[3] for r in own) // len(own)
    appended = feed(
        spark, tmp_path / "history", batches, lambda stream, _, out, checkpoint: H.stream_history(stream, out, checkpoint)
    )
    assert sorted(map(repr, appended.collect())) == sorted(map(repr, spark.createDataFrame(rows, schema).collect()))


STAGES = parse_rules(r"""
[filters.r0]
match_command = "^r0"
strip_lines_matching = ["^b"]
max_lines = 4
on_empty = "r0: empty"
[filters.r1]
match_command = "^r1"
keep_lines_matching = ["a", "b"]
tail_lines = 3
on_empty = "r1: empty"
[filters.r2]
match_command = "^r2"
match_output = [
  { pattern = "a1\\n+b2", message = "across", unless = "c$" },
  { pattern = "(?s)^c.*a1$", message = "" },
  { pattern = "b2", message = "b" , unless = "a1|^c" },
]
strip_lines_matching = ["."]
on_empty = "r2: empty"
[filters.r3]
match_command = "^r3"
replace = [{ pattern = "(\\w)(\\d)", replacement = "$2$1" }]
match_output = [{ pattern = "\\A1a\\n2b", message = "begins" }]
truncate_lines_at = 3
max_lines = 6
tail_lines = 2
[filters.r4]
match_command = "^r4"
strip_ansi = true
""").rules


def test_all_nine_rule_stages(spark, tmp_path, rendered):
    """Limits, messages and empty outputs that only the end of a run decides, wherever the micro-batches end."""
    rng = random.Random(4)
    assert len(STAGES) == 5
    texts = ["a1", "b2", "c", "", "\x1b[31ma1\x1b[0m", "longer line", None]
    lines = {run: list(enumerate(rng.choices(texts, k=rng.choice([0, 1, 2, 3, 12])), 1)) for run in range(72)}
    lines |= {2: [(1, "b2")], 3: [(1, "a1"), (2, "b2"), (3, "c")]}
    command = {run: f"r{run % 6}" for run in lines}
    schema = "run_id BIGINT, line_no BIGINT, text STRING, command STRING, args STRING, is_end BOOLEAN"
    parts = [[], [], []]
    for run, rows in lines.items():
        edges = sorted(rng.randint(0, len(rows)) for _ in range(2))
        for part, (low, high) in enumerate(zip([0, *edges], [*edges, len(rows)], strict=True)):
            parts[part] += [(run, n, text, command[run], "", False) for n, text in rows[low:high]]
        parts[rng.choice([1, 2]) if edges[1] == len(rows) else 2].append((run, 10**6, None, command[run], "", True))
    out = feed(
        spark, tmp_path, [spark.createDataFrame(rows, schema) for rows in parts],
        lambda stream, *places: R.stream_apply_rules(stream, STAGES, *places, size=3),
    )
    runs = spark.createDataFrame([(run, c, "") for run, c in command.items()], "run_id BIGINT, command STRING, args STRING")
    whole = spark.createDataFrame([(r, n, t) for r, rows in lines.items() for n, t in rows], "run_id BIGINT, line_no BIGINT, text STRING")
    batch = U.apply_rules(runs, whole, STAGES, size=1000)
    found = {(r.run_id, r.pos, r.kind, r.text) for r in out.collect()}
    assert found == {(r.run_id, r.pos, r.kind, r.text) for r in batch.collect()}
    told = {text for _, _, kind, text in found if kind == "message"}
    assert told >= {"r0: empty", "r1: empty", "r2: empty", "across", "b", "begins"}
    state = {name: spark.read.parquet(str(tmp_path / "state" / name / "slot=0")).count() for name in ("kept", "states", "held")}
    assert state == {"kept": 0, "states": 0, "held": 0}
    # after the second micro-batch an open run holds at most its tail, unless a message may replace all
    left = spark.read.parquet(str(tmp_path / "state" / "held" / "slot=1")).where("rule IN (0, 1, 3, 4)")
    assert left.groupBy("run_id", "rule").count().where("count > IF(rule = 1, 3, 2)").count() == 0


def test_runs_of_all_branches_in_one_stream(spark, tmp_path, rendered):
    """Each run is routed by what its first micro-batch tells, and gives what compact makes of the whole run."""
    texts = {
        0: ["ok  \ta", "ok  \tb", "x", "a.go:1: e"], 1: ['{"Action":"output","Package":"p","Output":"o"}', '{"Action":"pass","Package":"p"}'],
        2: ["TAP version 13", "1..2", "ok 1", "not ok 2 - z"], 3: ["<testsuite name='n' tests='2' failures='1'>",
        "<testcase name='t'><failure message='m'/></testcase>", "</testsuite>"], 4: ["a1", "b2", "longer line"],
        5: ["a:1:x", "a:2:x", "a:3:x", "b"], 6: ["<testsuite>", "</broken>"], 7: [], 8: ["bad", "b"], 9: ["<?xml"],
    }
    calls = {4: "r1", 5: "snyk", 8: "r0"}
    runs = [(run, dt.datetime(2024, 1, 1 + run), calls.get(run, "tool"), "", 0, 1, run == 9) for run in texts]
    schema = "run_id BIGINT, line_no BIGINT, text STRING, command STRING, args STRING, no_filter BOOLEAN, is_end BOOLEAN"
    parts = [[], [], []]
    for run, _, command, args, _, _, plain in runs:
        for n, text in enumerate(texts[run]):
            parts[min(n, 2)].append((run, n, text, command, args, plain, False))
        parts[2].append((run, 10**6, None, command, args, plain, True))
    out = feed(
        spark, tmp_path, [spark.createDataFrame(rows, schema) for rows in parts],
        lambda stream, *places: W.stream_route(stream, *places, STAGES, max_grep=1, size=2),
    )
    table = spark.createDataFrame(
        runs, "run_id BIGINT, ts TIMESTAMP, command STRING, args STRING, exit_code INT, exec_ms BIGINT, no_filter BOOLEAN"
    )
    whole = spark.createDataFrame([(r, n, t) for r, rows in texts.items() for n, t in enumerate(rows)], "run_id BIGINT, line_no BIGINT, text STRING")
    want = rendered(compact(table, whole, STAGES, max_grep=1, size=1000).lines, "place")
    assert rendered(out, "place") == want
    assert want[5] == ["a:1:x", "[2 more search hits]", "b"] and want[8] == ["r0: empty"] and want[9] == ["<?xml"]
    assert spark.read.parquet(str(tmp_path / "state" / "routes" / "slot=0")).count() == 0
