from logcompact.operators import reports as R
from logcompact.operators.ordered import chunked, merged_chunks


def test_go_test_events(lines_of, rendered):
    lines = lines_of({1: "\n".join([
        '{"Action":"output","Package":"p","Test":"A","Output":"early\\n"}',
        '{"action":"pass","Package":"p","Test":"A"}',
        "no event",
        '{"Action":"output","Package":"p","Test":"B","Output":"bad\\n"}',
        '{"Action":"output","Package":"p","Test":"B","Output":"\\n"}',
        '{"Action":"fail","Package":"p","Test":"B"}',
        '{"Action":"output","Package":"p","Output":"FAIL p\\n"}',
        '{"Action":"output","Package":"p","Test":"A","Output":"again\\n"}',
        '{"Action":"fail","Package":"p","Elapsed":1.5}',
        '{"Action":"pass","Package":"q","Elapsed":"x"}',
        '{"Action":"pass","Package":"q","Elapsed":2} trailing',
        '{"Action":"pass","Package":"q","Time":"2024-01-01T00:00:00Z","Elapsed":0.25}',
    ])})
    for size in (2, 1000):
        assert rendered(R.summarize_test_events(lines, size), "place") == {1: [
            "no event",
            '{"Action":"pass","Package":"q","Elapsed":"x"}',
            '{"Action":"pass","Package":"q","Elapsed":2} trailing',
            "FAIL p (1.500s): 1/2 failed",
            "  --- FAIL: B", "    bad",
            "  --- FAIL: A", "    again",
            "FAIL p",
            "ok   q (0.250s)",
        ]}


def test_tap(lines_of, rendered):
    lines = lines_of({
        1: "TAP version 13\n1..4\nok 1 - a\nnot ok 2 - b\n  ---\n  message: x\n  ok 9\n1..7\n  ---\nok 3 # skip\nnot ok 4\n---\ntail\n...",
        2: "TAP version 13\n1..2\nok 1\nok 2 # TODO x",
        3: "TAP version 13",
        4: "TAP version 13\nok 1\n---\nlost\n---\nnot ok 2 b",
    })
    for size in (2, 1000):
        assert rendered(R.summarize_tap(lines, size), "place") == {
            1: ["[TAP] 1/7 passed, 2 FAILED:", "  not ok: b", "  message: x", "  ok 9", "  not ok: ", "  tail", "  ..."],
            2: ["[TAP] 1/2 passed, 1 skipped"],
            3: ["[TAP] 0/0 passed"],
            4: ["[TAP] 1/0 passed, 1 FAILED:", "  not ok: b"],
        }


def test_junit(lines_of, rendered):
    case = '<testcase name="t1" classname="c"><failure message="m">body\n l2\n l3\n l4</failure></testcase>'
    lines = lines_of({
        1: '<?xml version="1.0"?>\n<testsuites><testsuite name="a" tests="3" failures="1" errors="1" time="1.5">\n'
        + case + '\n<testcase name="t2"/><testcase name="t3" classname="t3"><error/></testcase></testsuite>'
        '<testsuite name="b" tests="1"/></testsuites>',
        2: "<testsuite broken",
        3: "<testsuites/>",
        4: '<testsuite name="s" tests="2"><testcase name="x"><skipped/></testcase></testsuite>',
    })
    assert rendered(R.summarize_junit(lines), "place") == {
        1: ["[JUnit] a: 1/3 passed (1.500s), 2 FAILED:", "  FAIL: c.t1", "    m", "    body", "    l2", "    l3",
            "    [more lines]", "  FAIL: t3", "[JUnit] b: 1/1 passed"],
        2: ["<testsuite broken", ""],
        3: ["[JUnit] : 0/0 passed"],
        4: ["[JUnit] s: 2/2 passed"],
    }


def test_junit_in_pieces(lines_of, rendered):
    """A report, its suites and its cases may go over any number of cuts, with cuts inside comments, texts and CDATA."""
    body = "\n".join(f"line {i}" for i in range(9))
    lines = lines_of({
        1: '<?xml version="1.0"?>\n<!-- a > b\n<testcase>\n-->\n<testsuites\n name="all"\n>\n<testsuite name="a"\n tests="9" failures="2">\n'
        '<properties>\n<property\nname="x"/>\n</properties>\n'
        + "".join(f'<testcase name="ok{i}">\n<system-out>\n<![CDATA[\n<testcase>\n</testsuite>\n]]>\n</system-out>\n</testcase>\n' for i in range(3))
        + f'<testcase\nname="t1"\nclassname="c">\n<failure message="m &gt; 1">\n\n\n\n\n\n{body}\n</failure>\n</testcase>\n'
        '<testcase name="t2"><failure>\n<![CDATA[\na <\n]]>\nb</failure><error message="no"/>\n</testcase>\n</testsuite>\n'
        '<testsuite name="b" tests="2" errors="1"><testcase name="x"/>\n<testcase name="y">\n<error>\n\n</error>\n</testcase>\n</testsuite>\n'
        '</testsuites>\n<behind\nit',
        2: '<testsuite name="s" tests="1" failures="1">\n\n\n<testcase name="p">\n<failure>x\n</failure>\n</testcase>\n\n\n</wrong>',
        3: '<testsuite name="s" tests="1" failures="1">\n\n\n<testcase name="p">\n<failure>x\n\n\n\n\ny\n</failure>\n</testcase>\n\n\n</testsuite>',
        4: '<testsuite name="s">\n\n\n\n',
        5: '<testsuite tests="x">\n\n\n</testsuite>',
    })
    for size in (1, 2, 7, 1000):
        got = rendered(R.summarize_junit(lines, size), "place")
        assert got[1] == [
            "[JUnit] a: 7/9 passed, 2 FAILED:", "  FAIL: c.t1", "    m > 1", "    line 0", "    line 1", "    line 2",
            "    [more lines]", "  FAIL: t2", "    a <", "    ", "    b",
            "[JUnit] b: 1/2 passed, 1 FAILED:", "  FAIL: y",
        ], size
        assert got[3] == ["[JUnit] s: 0/1 passed, 1 FAILED:", "  FAIL: p", "    x", "    ", "    ", "    [more lines]"], size
        for run, n in ((2, 10), (4, 5), (5, 4)):
            assert len(got[run]) == n + 1 and got[run][0].startswith("<testsuite"), (size, run)


def test_sparse_line_numbers_leave_few_pieces(spark, lines_of, rendered):
    """Line numbers a million apart give the same report, and chunks with as many rows as dense ones."""
    cases = "\n".join(f'<testcase name="t{k}">' + ("<failure message='m'>x\ny</failure>" if k % 3 == 0 else "") + "</testcase>" for k in range(40))
    lines = lines_of({1: f'<testsuite name="s" tests="40" failures="14">\n{cases}\n</testsuite>', 2: "<testsuite tests='1'/>"})
    sparse = lines.withColumn("line_no", R.F.col("line_no") * 1_000_000)
    want = rendered(R.summarize_junit(lines), "place")
    assert len(want[1]) > 40
    for size in (1, 4, 1000):
        assert rendered(R.summarize_junit(sparse, size), "place") == want
    rows = chunked(sparse, "line_no", 10)
    merged = rows.join(merged_chunks(rows, ["run_id"], 10), ["run_id", "_chunk"]).groupBy("run_id", "_merged", "_chunks").count().collect()
    assert all(r["count"] <= 10 for r in merged) and {(r["run_id"], r["_chunks"]) for r in merged} == {(1, 6), (2, 1)}
    assert len(merged) == 7
