import pytest

from logcompact.functions.dialect import UnsupportedPattern
from logcompact.operators import rules as U
from logcompact.sources import control as K

TEXT = r"""
[filters.cut]
match_command = "^cut\\b"
strip_ansi = true
truncate_lines_at = 5

[filters.short]
match_command = "^short\\b"
strip_lines_matching = ["^drop"]
max_lines = 3
tail_lines = 2
on_empty = "short: empty"

[filters.said]
match_command = "^said now$"
match_output = [
  { pattern = "all good", message = "good", unless = "bad" },
  { pattern = "^one$", message = "" },
  { pattern = "end$", message = "ended" },
  { pattern = "x\\n+y", message = "across" },
]
on_empty = "said: empty"

[filters.swap]
match_command = "^swap"
replace = [{ pattern = "(\\w)(\\d)", replacement = "$2$1" }, { pattern = "^1", replacement = "one-" }]
keep_lines_matching = ["one"]

[filters.broken]
match_command = "^broken"
strip_lines_matching = ["(?!x)"]

[filters.silent]
description = "takes no command"
"""


@pytest.fixture(scope="module")
def parsed():
    return K.parse_rules(TEXT).rules


def test_parsing_drops_a_rule_with_a_bad_pattern(parsed):
    assert [r.name for r in parsed] == ["cut", "short", "said", "swap", "silent"]
    assert K.parse_rules("not toml [").rules == ()
    assert K.parse_rules("filters = 3").rules == ()


def test_stages(spark, lines_of, rendered, parsed):
    commands = {1: "cut", 2: "short", 3: "said", 4: "said", 5: "said", 6: "said", 7: "swap", 8: "short", 9: "other",
                10: "said", 11: "said", 12: "short"}
    runs = spark.createDataFrame(
        [(i, c, "now" if c == "said" else "") for i, c in commands.items()], "run_id BIGINT, command STRING, args STRING"
    )
    lines = lines_of({
        1: "\x1b[31mabcdefg\x1b[0m\nab", 2: "a\ndrop\nb\nc\nd", 3: "x\nall good", 4: "all good\nbad\nsome", 5: "one",
        6: "one\ntwo\nend\nmore", 7: "a1\nb2", 8: "drop me", 9: "a", 10: "two\nend", 11: "x\n\ny",
    })
    got = rendered(U.apply_rules(runs, lines, parsed, size=2))
    assert got == {
        1: ["abcde", "ab"],
        2: ["b", "c"],
        3: ["good"],
        4: ["all good", "bad", "some"],
        # an empty message gives nothing, and on_empty is not asked
        6: ["one", "two", "end", "more"],
        7: ["one-a"],
        8: ["short: empty"],
        10: ["ended"],
        11: ["across"],
        12: ["short: empty"],
    }


def test_first_rule_wins_and_sources_merge_in_order(spark, parsed):
    mine = K.parse_rules('[filters.mine]\nmatch_command = "^cut"').rules
    runs = spark.createDataFrame([(1, "cut", None), (2, "x", "y")], "run_id BIGINT, command STRING, args STRING")
    merged = K.merge_rules(mine, parsed)
    chosen = {r.run_id: r.rule for r in U.match_rule(runs, merged).collect()}
    assert chosen == {1: 0, 2: None}
    assert merged[chosen[1]].name == "mine"
    assert U.match_rule(runs, parsed).where("rule = 0").count() == 1


def test_builtin_rules_pass_their_tests(spark):
    file = K.builtin_rules()
    assert len(file.rules) == 59
    failed = U.check_rules(file.rules, K.rule_tests_table(spark, file.tests)).where("NOT passed").collect()
    assert failed == []


def test_rules_are_read_from_files(spark, tmp_path):
    (tmp_path / "b.toml").write_text('[filters.two]\nmatch_command = "^b"')
    (tmp_path / "a.toml").write_text('[filters.one]\nmatch_command = "^a"\n[[tests.one]]\nname = "t"\ninput = "x"\nexpected = "x"')
    (tmp_path / "c.toml").write_text("broken [")
    found = K.read_rules(spark, str(tmp_path))
    assert [r.name for r in found.rules] == ["one", "two"]
    assert found.tests[0].rule == "one"
    assert K.read_rules(spark, str(tmp_path / "none.toml")).rules == ()
    assert K.rules_table(spark, found.rules).count() == 2


def test_project_rules(spark, tmp_path, lines_of):
    path = tmp_path / "p.json"
    path.write_text('{"rules": [{"match": "^a", "action": "suppress"}, {"match": "b", "action": "keep"}, {"match": "(", "action": "suppress"}]}')
    rules = K.read_project_rules(spark, str(path))
    assert [r.match for r in rules] == ["^a", "b"]
    kept = U.apply_project_rules(lines_of({1: "a1\nb\nba"}), rules)
    assert sorted(r.text for r in kept.collect()) == ["b", "ba"]


def test_patterns_over_some_newlines_need_no_whole_text(spark, lines_of):
    """Blocks of lines decide, wherever a match lies and whatever the chunks."""
    rules = K.parse_rules(r"""
[filters.a]
match_command = "^a"
match_output = [
  { pattern = "x\\n\\n?y$", message = "end" },
  { pattern = "(?m)^x\\ny$", message = "inside" },
  { pattern = "^x\\ny", message = "start" },
  { pattern = "(?m)p\\n^(?:q|\\n)", message = "lines", unless = "(?s)no.no" },
]""").rules
    pad = "\n".join(["pad"] * 63)
    texts = {1: f"{pad}\nx\n\ny", 2: f"{pad}\nx\ny\n{pad}", 3: f"x\nyy\n{pad}", 4: f"{pad}\np\nq", 5: f"{pad}\np\n\n{pad}\nno",
             6: f"{pad}\np\n\n\nno\nno", 7: f"{pad}\nx\n\ny\nz\n{pad}", 8: f"{pad}\nx\nyy"}
    runs = spark.createDataFrame([(i, 0) for i in texts], "run_id BIGINT, rule INT")
    for size in (2, 64, 1000):
        lines = U.chunked(lines_of(texts), "line_no", size).withColumn("rule", U.F.lit(0))
        got = {r.run_id: r.message for r in U.match_output(runs, lines, rules).collect()}
        assert got == {1: "end", 2: "inside", 3: "start", 4: "lines", 5: "lines"}, size


UNBOUNDED = r"""
[filters.a]
match_command = "^a"
match_output = [
  { pattern = "(?s)begin.*end$", message = "closed", unless = "(?s)fail.*\\nfail" },
  { pattern = "one\\s+two", message = "apart" },
  { pattern = "(?m)^x(\\n.*)*\\n^y$", message = "lines" },
  { pattern = "(?s)^only.{0,9}$", message = "short" },
]
[filters.b]
match_command = "^b"
match_output = [{ pattern = "(?s)a.*z", message = "b" }]
"""


def test_patterns_over_any_newlines_need_no_whole_text(spark, lines_of):
    """Automata decide, wherever a match lies, whatever the chunks, and beside a run that would not fit one value."""
    rules = K.parse_rules(UNBOUNDED).rules
    pad = "\n".join(["pad line"] * 70)
    texts = {
        1: f"begin\n{pad}\nend", 2: f"begin\n{pad}\nend\n{pad}", 3: f"begin\n{pad}\nfail\n{pad}\nfail\nend", 4: f"{pad}\none \n\n\t two",
        5: f"x\n{pad}\ny\n{pad}", 6: f"xx\n{pad}\ny", 7: "only\nfew", 8: f"only\n{pad}", 9: "begin end", 10: "", 11: "end\nbegin",
        12: f"a\n{pad}\nz", 13: f"z\n{pad}\na",
    }
    runs = spark.createDataFrame([(i, int(i > 11)) for i in texts], "run_id BIGINT, rule INT")
    joined = runs.withColumnRenamed("run_id", "_id")
    for size in (1, 7, 64, 1000):
        lines = U.chunked(lines_of(texts), "line_no", size)
        lines = lines.join(joined, lines.run_id == joined._id).drop("_id")
        got = {r.run_id: r.message for r in U.match_output(runs, lines, rules).collect()}
        assert got == {1: "closed", 4: "apart", 5: "lines", 7: "short", 9: "closed", 12: "b"}, size


def test_one_long_run_beside_short_ones(spark):
    """Three hundred megabytes of one run, in many chunks; the others keep their answers."""
    rules = K.parse_rules(UNBOUNDED).rules[1:]
    long = spark.range(3000, numPartitions=8).selectExpr("1L AS run_id", "id AS line_no", "IF(id = 5, 'a', IF(id = 2990, 'z', repeat('q', 100000))) AS text")
    short = spark.range(2, 6).selectExpr("id AS run_id", "0L AS line_no", "IF(id % 2 = 0, 'a z', 'z a') AS text")
    lines = U.chunked(long.unionByName(short), "line_no", 200).withColumn("rule", U.F.lit(0))
    runs = spark.range(1, 6).selectExpr("id AS run_id", "0 AS rule")
    assert sorted(r.run_id for r in U.match_output(runs, lines, rules).collect()) == [1, 2, 4]


def test_patterns_without_a_reasonable_automaton_are_refused(spark, lines_of):
    rules = K.parse_rules(r"""
[filters.a]
match_command = "^a"
match_output = [{ pattern = "(?s)a.{20}b.*c", message = "m" }]""").rules
    runs = spark.createDataFrame([(1, 0)], "run_id BIGINT, rule INT")
    lines = U.chunked(lines_of({1: "a"})).withColumn("rule", U.F.lit(0))
    with pytest.raises(UnsupportedPattern, match="states"):
        U.match_output(runs, lines, rules)


def test_limits_are_counted_by_chunk(spark):
    """First and last lines against slices, over dense, sparse and one-line chunks, with limits by run."""
    rng = __import__("random").Random(3)
    numbers = {run: sorted(rng.sample(range(1, 400), rng.choice([1, 2, 9, 60]))) for run in range(12)}
    rows = [(run, n, f"t{n}", run % 4 or None, run % 3 or None) for run, found in numbers.items() for n in found]
    lines = spark.createDataFrame(rows, "run_id BIGINT, line_no BIGINT, text STRING, h INT, t INT")
    for size in (1, 7, 100, 1000):
        for n in (0, 1, 5, 100):
            got = {(r.run_id, r.line_no) for r in U.head_lines(lines, n, size).collect()}
            assert got == {(run, x) for run, found in numbers.items() for x in found[:n]}
            got = {(r.run_id, r.line_no) for r in U.tail_lines(lines, n, size).collect()}
            assert got == {(run, x) for run, found in numbers.items() for x in found[len(found) - min(n, len(found)):]}
        both = U.lines_within(lines, U.F.col("h"), U.F.col("t"), size)
        assert both.columns == lines.columns
        want = set()
        for run, found in numbers.items():
            head = found[: run % 4 or None]
            want |= {(run, x) for x in head[-(run % 3 or len(head)):]}
        assert {(r.run_id, r.line_no) for r in both.collect()} == want
    assert U.head_lines(lines.where("false"), 3).count() == 0
    doubled = lines.where("run_id = 0").limit(1).unionByName(lines.where("run_id = 0").limit(1))
    assert U.head_lines(doubled, 1).count() == 2


def test_only_the_first_run_of_a_range_needs_maps(spark):
    """Runs that begin in a range go from state to state, however sparse their lines; states may come from earlier lines."""
    import pyarrow as pa

    rules = [U.Rule("r", match_output=(K.MatchOutput(r"(?s)a.*b.*c", "all"),))]
    machines = U.entry_machines(rules, [0])
    rows = [(run, n * 10_000_000, 0, text, None, None) for run in range(4) for n, text in enumerate("xaybzc" * (run + 1))]
    names = ["run_id", "line_no", "rule", "text", "slot", "state"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def walked(rows, size):
        batches = [rows[k : k + size] for k in range(0, len(rows), size)]
        arrays = [[pa.array(c, t) for c, t in zip(zip(*b, strict=True), types, strict=True)] for b in batches]
        return [row for b in U._walked((pa.RecordBatch.from_arrays(a, names=names) for a in arrays), machines) for row in b.to_pylist()]

    for size in (1, 4, 7, 100):
        found = walked(rows, size)
        assert [(row["run_id"], row["line_no"]) for row in found] == [(run, 0) for run in range(4)]
        assert [row["map"] is not None for row in found] == [True, False, False, False]
        ends = [machines[0].automaton.ends[row["map"][0] if row["map"] else row["state"]] for row in found]
        assert all(ends)

    schema = "run_id BIGINT, line_no BIGINT, rule INT, text STRING"
    cut = [[row[:4] for row in rows if (row[1] < 30_000_000) == early and row[0] < 2] for early in (True, False)]
    before = spark.createDataFrame([], "run_id BIGINT, slot INT, state INT")
    for part in cut:
        before = U.automaton_states(spark.createDataFrame(part, schema), machines, before)
    once = U.automaton_states(spark.createDataFrame([row[:4] for row in rows if row[0] < 2], schema), machines)
    assert sorted(before.collect()) == sorted(once.collect())


def test_run_over_many_ranges(spark, monkeypatch):
    """One run over all ranges, some of them composed first."""
    monkeypatch.setattr(U, "RANGES_TOGETHER", 2)
    rules = [U.Rule("r", match_output=(K.MatchOutput(r"(?s)^a.*b.*c$", "all"),))]
    machines = U.entry_machines(rules, [0])
    texts = {1: ["a", *["x"] * 500, "b", *["y"] * 500, "c"], 2: ["b"], 3: ["a", "c", "b"]}
    rows = [(run, n, 0, text) for run, lines in texts.items() for n, text in enumerate(lines)]
    lines = spark.createDataFrame(rows, "run_id BIGINT, line_no BIGINT, rule INT, text STRING")
    found = {row["run_id"]: row["state"] for row in U.automaton_states(lines, machines).collect()}
    ends = machines[0].automaton.ends
    assert {run: bool(ends[state]) for run, state in found.items()} == {1: True, 2: False, 3: False}
