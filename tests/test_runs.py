"""Commands, loops, savings, sources, sinks and the composite plan."""

import base64
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import logcompact
from logcompact import sinks
from logcompact.functions import registry, text
from logcompact.operators import commands, loops, savings
from logcompact.plans.compact import compact, compact_plain
from logcompact.sources import control, history, lines

T0 = dt.datetime(2024, 1, 1)


def test_command_verdicts(spark):
    cases = {
        "sudo -u bob -E A=1 git status": (0, "A=1 git status"),
        "sudo git x": (0, "git x"),
        "A=1 sudo git x": (1, "A=1 sudo git x"),
        "/usr/bin/git diff": (0, "git diff"),
        "ls | wc": (1, "ls | wc"),
        "docker run -it x": (1, "docker run -it x"),
        "docker ps": (0, "docker ps"),
        "go run .": (1, "go run ."),
        "go runner": (0, "go runner"),
        "rm -rf x": (1, "rm -rf x"),
        "dd if=x": (2, "dd if=x"),
        "nope": (1, "nope"),
        "  npm run dev  ": (1, "npm run dev"),
        "npm RUN -it": (1, "npm RUN -it"),
        "sudo": (1, "sudo"),
        "": (1, ""),
        "logcompact git": (1, "logcompact git"),
    }
    frame = spark.createDataFrame([(c,) for c in cases], "command_line STRING")
    got = {r.command_line: (r.verdict, r.normalized) for r in commands.classify_commands(frame).collect()}
    assert got == cases


def test_dimensions(spark):
    rows = registry.registry_rows()
    assert len(rows) == 133 and len({r[1] for r in rows}) == 74
    assert registry.profile_map(spark).select("profile").distinct().count() == 19


@pytest.mark.parametrize("pieces", [1, 9])
def test_loop_guard_counts_runs_close_in_time(spark, pieces):
    rng = random.Random(5)
    runs, at = [], 0
    for i in range(300):
        at += rng.choice([1, 100, 299, 300, 301, 900])
        runs.append((i, T0 + dt.timedelta(seconds=at), rng.choice(["a", "b", "b", "b"]), rng.choice(["", "audit x"])))
    frame = spark.createDataFrame(runs, "run_id BIGINT, ts TIMESTAMP, command STRING, args STRING")
    want = {}
    for i, ts, command, args in runs:
        if args:
            continue
        times = [t for j, t, c, a in runs if c == command and not a and j <= i]
        count = 1
        while count < len(times) and times[-count] - times[-count - 1] <= dt.timedelta(minutes=5):
            count += 1
        want[i] = (count, count >= 3)
    got = {r.run_id: (r["count"], r.loop) for r in loops.loop_guard(frame, pieces=pieces).collect()}
    assert got == want
    sessions = loops.loop_sessions(frame)
    assert sessions.agg(F.sum("runs")).first()[0] == len(want)
    assert sessions.count() == sum(count == 1 for count, _ in want.values())


def test_a_hot_hour_of_one_command_spreads_over_chunks(spark):
    hot = spark.range(20_000).selectExpr("id AS run_id", "timestamp_millis(id * 100) AS ts", "'make' AS command", "'' AS args")
    runs = hot.unionByName(spark.range(10).selectExpr("-1 - id", "timestamp_seconds(id * 400)", "'go'", "'vet'").toDF(*hot.columns))
    series = loops._series(runs, 300, (), 16)
    sizes = series.where("run_id >= 0").groupBy("_chunk").count().toPandas()["count"]
    assert len(sizes) >= 12 and sizes.max() < 4_000
    got = loops.loop_guard(runs, pieces=16)
    assert got.where("run_id >= 0 AND count <> run_id + 1").count() == 0
    assert got.where("run_id < 0 AND count = 1").count() == 10
    ends = loops.loop_sessions(runs, pieces=16).where("runs > 1").collect()
    assert [(r.runs, r.start, r.last_ts) for r in ends] == [
        (20_000, dt.datetime(1970, 1, 1), dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=1_999_900))
    ]


def record(spark, rows):
    names = ["run_id", "ts", "cmd", "args", "raw_tokens", "filtered_tokens", "exec_ms", "bypassed", "exact_tokens"]
    frame = spark.createDataFrame(rows, "run_id BIGINT, ts TIMESTAMP, cmd STRING, args STRING, raw_tokens BIGINT, "
                                  "filtered_tokens BIGINT, exec_ms BIGINT, bypassed BOOLEAN, exact_tokens BOOLEAN")  # fmt: skip
    assert frame.columns == names
    return savings.with_savings(frame).withColumns(
        {"raw_bytes": F.col("raw_tokens") * 4, "filtered_bytes": F.col("filtered_tokens") * 4}
    )


def test_summary_and_history_files(spark, tmp_path):
    rows = record(spark, [
        (1, T0, "go", "test", 100, 10, 5, False, True),
        (2, T0 + dt.timedelta(1), "go", "", 10, 10, 8, True, None),
        (3, T0 + dt.timedelta(2), "npm", "i", 10, 40, 1, None, True),
    ])
    found = logcompact.savings_summary(rows)
    assert tuple(found.totals.first()) == (3, 90, 45.0, False)
    assert [tuple(r) for r in found.top.collect()] == [("go", 2, 90, 45.0, 6), ("npm", 1, 0, 0.0, 1)]
    assert [r.run_id for r in found.recent.collect()] == [3, 2, 1]
    empty = savings.savings_totals(rows.where("false")).first()
    assert tuple(empty) == (0, 0, 0.0, False)
    sinks.write_history(rows, str(tmp_path / "h"))
    with open(tmp_path / "h" / "part-extra.json", "w") as extra:
        extra.write('\n{broken\n{"cmd":"x","raw_tokens":"text"}\n')
    back = history.read_history(spark, str(tmp_path / "h"))
    assert {(r.cmd, r.saved_tokens, r.bypassed) for r in back.collect()} == {
        ("go", 90, False), ("go", 0, True), ("npm", 0, False),
    }
    report = [r.text for r in sinks.savings_report(found).orderBy("section", "ord").collect()]
    assert report[2] == "Tokens saved: 90" and "not compacted" in report[7]
    none = sinks.savings_report(logcompact.savings_summary(rows.where("false"))).collect()
    assert [r.text for r in none] == ["no runs recorded"]


def test_raw_lines_are_kept_by_mode(spark, lines_of):
    runs = spark.createDataFrame([(1, T0, 0), (2, T0, 3)], "run_id BIGINT, ts TIMESTAMP, exit_code INT")
    raw = lines_of({1: "a\nb", 2: "c"})
    kept = {m: sorted(r.text for r in sinks.retain_raw(runs, raw, m).collect()) for m in sinks.RETAIN_MODES}
    assert kept == {"always": ["a", "b", "c"], "failures": ["c"], "never": []}


def test_lines_of_texts_and_files(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, "x\n\ny"), (4, None)], "run_id BIGINT, text STRING")
    got = sorted((r.run_id, r.line_no, r.text) for r in lines.split_lines(texts).collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (3, 1, "x"), (3, 2, ""), (3, 3, "y")]
    (tmp_path / "one.log").write_text("".join(f"line {n}\r\n" for n in range(1, 2001)))
    (tmp_path / "two.log").write_text("p\rq\nlast")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        read = lines.read_log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for r in read:
        by_file.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line_no, r.text))
    assert sorted(by_file["one.log"]) == [(n, f"line {n}") for n in range(1, 2001)]
    assert sorted(by_file["two.log"]) == [(1, "p\rq"), (2, "last")]


def test_every_run_takes_one_branch(spark, lines_of, rendered):
    calls = [("go", "test"), ("go", "test"), ("go", "test"), ("go", "test"), ("make", "all"), ("x", "a"), ("snyk", "x"),
             ("y", "tap"), ("z", "j"), ("q", "none"), ("SKIP", ""), ("w", "quiet")]
    minutes = [0, 1, 2, 20] + [0] * 8
    runs = spark.createDataFrame(
        [(i + 1, T0 + dt.timedelta(minutes=m), c, a, 0, 10, i == 11) for i, ((c, a), m) in enumerate(zip(calls, minutes, strict=True))],
        "run_id BIGINT, ts TIMESTAMP, command STRING, args STRING, exit_code INT, exec_ms BIGINT, no_filter BOOLEAN",
    )
    raw = lines_of({
        1: "=== RUN\nok  \ta\nok  \tb\nx", 2: "FAIL\nz", 3: "a\na\na", 5: "make[1]: Entering directory 'x'\ngcc",
        6: '{"Action":"pass","Package":"p"}', 7: "a:1:x\na:2:x\nb", 8: "TAP version 13\n1..1\nok 1",
        9: "<testsuite name='n' tests='1'/>", 11: "a\na", 12: "b\nb",
    })
    found = compact(runs, raw, control.builtin_rules().rules, excluded=["skip"], max_grep=1, size=2)
    assert rendered(found.lines, "place") == {
        1: ["[2 ok lines]", "x"], 2: ["FAIL", "z"], 3: ["a", "a", "a"], 5: ["gcc"], 6: ["ok   p"],
        7: ["a:1:x", "[1 more search hits]", "b"], 8: ["[TAP] 1/1 passed"], 9: ["[JUnit] n: 1/1 passed"],
        11: ["a", "a"], 12: ["b", "b"],
    }
    rows = {r.run_id: r for r in found.history.collect()}
    assert [i for i, r in rows.items() if r.bypassed] and {i for i, r in rows.items() if r.bypassed} == {3, 7, 11, 12}
    assert (rows[1].raw_bytes, rows[1].filtered_bytes, rows[10].raw_bytes) == (24, 15, 0)


def test_blank_lines_decide_how_long_a_block_lasts(spark, lines_of, rendered):
    runs = spark.createDataFrame([(1, "tool")], "run_id BIGINT, command STRING")
    raw = lines_of({1: "error: x\na\n\n\nb\nb"})
    assert rendered(compact_plain(runs, raw)) == {1: ["error: x", "a", "b", "b"]}
    assert rendered(compact_plain(runs, raw, blanks=True)) == {1: ["error: x", "a", "", "", "b", "[2 times]: b"]}


def test_token_estimate(spark):
    frame = spark.createDataFrame([("abcdefgh",), ("",)], "t string")
    assert [r.n for r in frame.select(text.token_estimate(F.col("t")).alias("n")).collect()] == [2, 0]


def test_loop_guard_looks_for_words_once_per_run(spark, monkeypatch):
    plans = []

    def seen(rows, name):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return staged(rows, name)

    staged = loops.staged
    monkeypatch.setattr(loops, "staged", seen)
    lines = spark.createDataFrame(
        [(run, f"2024-01-01 00:0{n}:00", "make" if run < 3 else "trivy") for run in (1, 2, 3) for n in range(2)], "run_id BIGINT, ts STRING, command STRING"
    )
    runs = lines.groupBy("run_id", "command").agg(F.min(F.col("ts").cast("timestamp")).alias("ts")).withColumn("args", F.lit("x"))
    found = {r["run_id"]: r["count"] for r in loops.loop_guard(runs, pieces=2).collect()}
    assert found == {1: 1, 2: 2}
    # a filter below the grouping would read every line of a run
    assert "Aggregate" in plans[0]
    assert "Filter" not in plans[0].partition("Aggregate")[2]
