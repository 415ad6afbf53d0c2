"""Summaries of structured test reports: go-test JSON events, TAP and JUnit XML.

Rendered rows are (run_id, place, text); ``place`` is a struct of four numbers that sorts the rows
of a run. Details stay rows throughout, so a package or test of any size is never put in one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logcompact.functions.dialect import to_java
from logcompact.functions.text import trim_space
from logcompact.operators.junit import read_junit
from logcompact.operators.ordered import CHUNK, CHUNK_ROWS, attach, beside, chunked, running
from logcompact.session import staged

LAST = (1 << 62) - 1


def place(a: str = "0", b: str = "0", c: str = "0", d: str = "0") -> Column:
    values = ", ".join(f"'{n}', CAST({v} AS BIGINT)" for n, v in zip("abcd", (a, b, c, d), strict=True))
    return F.expr(f"named_struct({values})").alias("place")


# The shape of a time stamp.
TIME_STAMP = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z"


def parse_test_events(lines: DataFrame) -> DataFrame:
    """Add ``event`` (action, package, test, elapsed, output); null where the line is no event.

    Names match in any case. A field of the wrong type makes the line no event, as does anything
    after the object. A bare ``null`` is an event without fields.
    """
    text = trim_space(F.coalesce("text", F.lit("")))
    # Parsed inside an array, because the parser stops at the end of the first value.
    parsed = lines.withColumn(
        "_json", F.when(text.startswith("{") | (text == "null"), F.concat(F.lit("["), text, F.lit("]")))
    ).withColumn("_json", F.expr("try_parse_json(_json)"))
    parsed = parsed.withColumn(
        "_fields",
        F.expr(
            "CASE WHEN try_variant_get(_json, '$[1]', 'variant') IS NULL "
            "THEN try_variant_get(_json, '$[0]', 'map<string,variant>') END"
        ),
    )
    names = ("Action", "Package", "Test", "Output", "Elapsed", "Time")

    def find(name: str) -> str:
        return (
            f"coalesce(_fields['{name}'], get(filter(map_entries(_fields), "
            f"e -> lower(e.key) = '{name.lower()}'), 0).value)"
        )

    parsed = parsed.withColumns({f"_{n}": F.expr(find(n)) for n in names})
    types = {n: f"coalesce(schema_of_variant(_{n}), 'VOID')" for n in names}
    texts = [f"{types[n]} IN ('VOID', 'STRING')" for n in names[:4]]
    number = f"NOT {types['Elapsed']} RLIKE '^(STRING|BOOLEAN|OBJECT|ARRAY)'"
    stamp = f"({types['Time']} = 'VOID' OR ({types['Time']} = 'STRING' AND _when RLIKE r'{TIME_STAMP}'))"
    value = "coalesce(try_variant_get(_{0}, '$', 'string'), '')".format
    parsed = parsed.withColumn("_when", F.expr(value("Time")))
    null_event = "schema_of_variant(try_variant_get(_json, '$[0]', 'variant')) = 'VOID'"
    return parsed.withColumn(
        "event",
        F.expr(
            f"""CASE WHEN _json IS NOT NULL AND {' AND '.join([*texts, number, stamp])}
                      AND (_fields IS NOT NULL OR {null_event})
                THEN named_struct('action', {value('Action')}, 'package', {value('Package')},
                    'test', {value('Test')}, 'output', {value('Output')},
                    'elapsed', coalesce(try_variant_get(_Elapsed, '$', 'double'), 0D)) END"""
        ),
    ).drop("_json", "_fields", "_when", *(f"_{n}" for n in names))


PACKAGE_OK = "NOT pkg_failed AND failed = 0"


def test_packages(events: DataFrame) -> DataFrame:
    """Per run and package: tests passed, failed and skipped, elapsed seconds, and the verdict."""
    flat = events.where("event IS NOT NULL").select("run_id", "line_no", "event.*")
    ended = "test = '' AND action IN ('pass', 'fail')"
    counts = [
        F.expr(f"count_if(test <> '' AND action = '{action}')").alias(name)
        for action, name in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))
    ]
    return (
        flat.groupBy("run_id", "package")
        .agg(
            *counts,
            F.expr(f"coalesce(max_by(elapsed, line_no) FILTER (WHERE {ended}), 0D) AS elapsed"),
            F.expr("bool_or(test = '' AND action = 'fail') AS pkg_failed"),
            F.min("line_no").alias("first_line"),
        )
        .withColumn("ok", F.expr(PACKAGE_OK))
    )


def kept_test_output(events: DataFrame, packages: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Output lines that a report of failing packages shows.

    A test's output up to its last pass is dropped; output of a package itself counts only when the
    package failed. Rows: (run_id, package, first_line, test, test_line, line_no, text), where
    ``test_line`` is the first kept line of the test and the test of package output is empty.
    """
    failing = packages.where("NOT ok").select("run_id", "package", "first_line", "pkg_failed")
    flat = chunked(events.where("event IS NOT NULL").select("run_id", "line_no", "event.*"), "line_no", size)
    used = attach(
        flat.where("action = 'output' OR (action = 'pass' AND test <> '')"), failing, ["run_id", "package"]
    ).where("first_line IS NOT NULL AND (test <> '' OR pkg_failed)")
    used = staged(used.drop("pkg_failed", "elapsed"), "test-output")
    passes = (
        used.where("action = 'pass'")
        .groupBy("run_id", "package", "test")
        .agg(F.max("line_no").alias("last_pass"))
    )
    keys = ["run_id", "package", "test"]
    kept = attach(used.where("action = 'output'"), passes, keys).where(
        "last_pass IS NULL OR line_no > last_pass"
    )
    starts = kept.groupBy(*keys).agg(F.min("line_no").alias("test_line"))
    return attach(kept, starts, keys).select(
        "run_id", "package", "first_line", "test", "test_line", "line_no",
        F.expr("rtrim('\n', output) AS text"),
    )


def _seconds(col: str) -> str:
    return f"IF({col} > 0, format_string(' (%.3fs)', {col}), '')"


def summarize_test_events(lines: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Rendered summary of go-test events; lines that are no events come first, unchanged."""
    # Parsing JSON is the costly part, and four steps follow.
    events = staged(parse_test_events(lines.select("run_id", "line_no", "text")), "events")
    packages = staged(test_packages(events), "packages")
    return no_events(events).unionByName(render_packages(packages, kept_test_output(events, packages, size)))


def no_events(events: DataFrame) -> DataFrame:
    return events.where("event IS NULL").select("run_id", place("0", "line_no"), "text")


def render_packages(packages: DataFrame, kept: DataFrame) -> DataFrame:
    """A line per package, and under a failing one its tests with their kept output."""
    header = (
        f"IF(ok, concat('ok   ', package, {_seconds('elapsed')}), "
        f"concat('FAIL ', package, {_seconds('elapsed')}, ': ', failed, '/', "
        "passed + failed + skipped, ' failed'))"
    )
    heads = packages.select("run_id", place("1", "first_line"), F.expr(header).alias("text"))
    kept = staged(kept, "kept-output")
    # A test goes before its lines, whatever number they begin with.
    tests = kept.where("test <> '' AND line_no = test_line").select(
        "run_id",
        place("1", "first_line", "test_line", "least(0L, test_line - 1)"),
        F.expr("concat('  --- FAIL: ', test) AS text"),
    )
    shown = kept.where(trim_space(F.col("text")) != "")
    details = shown.select(
        "run_id",
        place("1", "first_line", f"IF(test = '', {LAST}, test_line)", "line_no"),
        F.expr("IF(test = '', text, concat('    ', text)) AS text"),
    )
    return heads.unionByName(tests).unionByName(details)


# The lines of the Test Anything Protocol.
TAP_OK = r"^ok\s+(\d+)\s*-?\s*(.*)"
TAP_NOT_OK = r"^not ok\s+(\d+)\s*-?\s*(.*)"
TAP_PLAN = r"^1\.\.(\d+)"
TAP_DIRECTIVE = r"(?i)#\s*(skip|todo)"


def tap_kind(line: Column) -> Column:
    """What a trimmed line is by itself: plan, mark (of a diagnostic block), ok, fail or other."""
    return (
        F.when(line.rlike(to_java(TAP_PLAN)), "plan")
        .when(line == "---", "mark")
        .when(line.rlike(to_java(TAP_OK)), "ok")
        .when(line.rlike(to_java(TAP_NOT_OK)), "fail")
        .otherwise("other")
    )


def parse_tap(lines: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """The meaningful lines of TAP output.

    Rows: (run_id, line_no, what, n, text, owner). ``what`` is plan, ok, skip, fail or diag; ``n``
    is the number of a plan; ``owner`` is the line of the failure a diagnostic belongs to.
    A line of three dashes opens and closes a diagnostic block; plans count inside blocks too.
    """
    text = trim_space(F.coalesce("text", F.lit("")))
    rows = chunked(lines.select("run_id", "line_no", text.alias("line")), "line_no", size)
    line = F.col("line")
    ok, not_ok = to_java(TAP_OK), to_java(TAP_NOT_OK)
    rows = running(
        rows.withColumn("_kind", tap_kind(line)), ["run_id"], ["line_no"], "sum", "IF(_kind = 'mark', 1, 0)", "_marks"
    )
    described = trim_space(
        F.when(F.col("_kind") == "ok", F.regexp_extract(line, ok, 2)).otherwise(
            F.regexp_extract(line, not_ok, 2)
        )
    )
    rows = rows.withColumn(
        "what",
        F.expr("""CASE WHEN _kind IN ('plan', 'mark') THEN _kind WHEN _marks % 2 = 1 THEN 'diag'
                       ELSE _kind END"""),
    ).where("what NOT IN ('mark', 'other')")
    rows = rows.withColumn("text", F.when(F.col("what").isin("ok", "fail"), described).otherwise(line))
    skipped = F.col("text").rlike(to_java(TAP_DIRECTIVE))
    rows = rows.withColumn(
        "what", F.when((F.col("what") == "ok") & skipped, "skip").otherwise(F.col("what"))
    )
    # The last result before a diagnostic, with a failure told by an odd number.
    rows = running(
        staged(rows.select("run_id", "line_no", CHUNK, "what", "text", "line"), "tap"),
        ["run_id"],
        ["line_no"],
        "max",
        "CASE WHEN what IN ('ok', 'skip') THEN line_no * 2 WHEN what = 'fail' THEN line_no * 2 + 1 END",
        "_result",
    ).where("what <> 'diag' OR _result % 2 = 1")
    return rows.select(
        "run_id",
        "line_no",
        "what",
        F.when(F.col("what") == "plan", F.regexp_extract(line, to_java(TAP_PLAN), 1).try_cast("bigint"))
        .alias("n"),
        "text",
        F.expr("CASE WHEN what = 'diag' THEN _result div 2 WHEN what = 'fail' THEN line_no END AS owner"),
    )


def tap_counts(parsed: DataFrame) -> DataFrame:
    """Per run: planned, passed, failed and skipped tests."""
    counts = [F.expr(f"count_if(what = '{w}')").alias(n)
              for w, n in (("ok", "passed"), ("fail", "failed"), ("skip", "skipped"))]
    total = F.expr("coalesce(max_by(n, line_no) FILTER (WHERE what = 'plan'), 0L) AS total")
    return parsed.groupBy("run_id").agg(total, *counts)


def summarize_tap(lines: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Rendered summary of TAP output: counts, then each failure with its diagnostics."""
    parsed = staged(parse_tap(lines, size), "tap-lines")
    # A run whose lines say nothing still gets its zero counts.
    runs = lines.select("run_id").distinct()
    counts = runs.join(beside(tap_counts(parsed)), "run_id", "left").fillna(0)
    return tap_heads(counts).unionByName(tap_failures(parsed))


def tap_heads(counts: DataFrame) -> DataFrame:
    header = """IF(failed = 0,
        concat('[TAP] ', passed, '/', total, ' passed', IF(skipped > 0, concat(', ', skipped, ' skipped'), '')),
        concat('[TAP] ', passed, '/', total, ' passed, ', failed, ' FAILED:'))"""
    return counts.select("run_id", place("1"), F.expr(header).alias("text"))


def tap_failures(parsed: DataFrame) -> DataFrame:
    return parsed.where("owner IS NOT NULL").select(
        "run_id",
        place("1", "owner", "IF(what = 'fail', 0, 1)", "line_no"),
        F.expr("concat(IF(what = 'fail', '  not ok: ', '  '), text) AS text"),
    )


def parse_junit(lines: DataFrame, size: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Suites (run_id, suite_no, name, tests, failures, errors, time) and their failed cases, one row each.

    A run that is no valid report gets one suite row with suite_no null. Reports are read in pieces, so neither a report
    nor a suite is ever put in one value.
    """
    rows = staged(read_junit(lines, size), "junit")
    suites = rows.where("what <> 'case'").selectExpr(
        "run_id",
        "suite_no",
        "coalesce(name, '') AS name",
        "coalesce(tests, 0L) AS tests",
        "coalesce(failures, 0L) AS failures",
        "coalesce(errors, 0L) AS errors",
        "coalesce(time, 0D) AS time",
    )
    return suites, rows.where("what = 'case'").withColumnRenamed("piece", CHUNK)


def junit_failures(suites: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per failed case of a suite that counts failures: (run_id, suite_no, case_no, label, message, body).

    ``body`` holds the first three trimmed lines, ``more`` tells that there was a fourth. A failure
    goes before an error.
    """
    failing = suites.where("failures + errors <> 0").select("run_id", "suite_no", F.lit(True).alias("_failing"))
    cases = attach(cases, failing, ["run_id", "suite_no"]).where("_failing")
    text = F.expr("IF(failure IS NOT NULL, failure_text, error_text)")
    cases = cases.withColumn("_body", F.split(trim_space(F.coalesce(text, F.lit(""))), "\n", 4))
    return cases.select(
        "run_id",
        "suite_no",
        "case_no",
        F.expr(
            """CASE WHEN coalesce(classname, '') IN ('', coalesce(name, '')) THEN coalesce(name, '')
                    ELSE concat(classname, '.', coalesce(name, '')) END AS label"""
        ),
        F.expr("coalesce(failure, error) AS message"),
        F.when(F.get("_body", F.lit(0)) != "", F.transform(F.slice("_body", 1, 3), trim_space))
        .otherwise(F.array().cast("array<string>"))
        .alias("body"),
        (F.size("_body") > 3).alias("more"),
    )


def summarize_junit(lines: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Rendered summary of JUnit reports; a run that does not parse keeps its raw lines."""
    suites, cases = parse_junit(lines, size)
    good = suites.where("suite_no IS NOT NULL")
    bad = "failures + errors"
    header = (
        f"concat('[JUnit] ', name, ': ', tests - ({bad}), '/', tests, ' passed', {_seconds('time')}, "
        f"IF({bad} = 0, '', concat(', ', {bad}, ' FAILED:')))"
    )
    heads = good.select("run_id", place("1", "suite_no"), F.expr(header).alias("text"))
    failures = junit_failures(good, cases).withColumn(
        "rows",
        F.expr(
            """concat(array(concat('  FAIL: ', label)),
                      IF(message = '', array(), array(concat('    ', message))),
                      transform(body, l -> concat('    ', l)),
                      IF(more, array('    [more lines]'), array()))"""
        ),
    )
    details = failures.select(
        "run_id", "suite_no", "case_no", F.posexplode("rows").alias("row_no", "text")
    ).select("run_id", place("1", "suite_no", "case_no + 1", "row_no"), "text")
    raw = suites.where("suite_no IS NULL").select("run_id")
    raw_lines = attach(chunked(lines, "line_no", size), raw.withColumn("_raw", F.lit(True))).where("_raw").select(
        "run_id", place("0", "line_no"), "text"
    )
    # The raw text ends in a newline, which leaves one empty line behind it.
    last = raw.select("run_id", place("2"), F.lit("").alias("text"))
    return heads.unionByName(details).unionByName(raw_lines).unionByName(last)
