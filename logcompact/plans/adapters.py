"""Runs and console lines derived from the given tables.

The tables hold no console output, so lines are built from their columns. Each adapter is one SQL
text that Spark and the reference database read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logcompact.sources.control import ProjectRule, parse_rules
from logcompact.sources.lines import split_lines

EVENT_RUNS = """
SELECT event_id AS run_id, ts,
       CASE event_type WHEN 'view' THEN 'go' WHEN 'signup' THEN 'git' WHEN 'error' THEN 'cargo'
                       WHEN 'click' THEN 'npm' ELSE 'make' END AS command,
       CASE WHEN event_id % 53 = 0 THEN 'audit' ELSE 'task ' || CAST(user_id % 7 AS STRING) END AS args,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code,
       CAST(floor(value * 10) AS BIGINT) AS exec_ms,
       event_id % 97 = 0 AS no_filter
FROM events"""

EVENT_HISTORY = f"""
SELECT run_id, ts, command AS cmd, args, raw_bytes, filtered_bytes, raw_tokens, filtered_tokens,
       greatest(raw_tokens - filtered_tokens, 0) AS saved_tokens,
       CASE WHEN raw_tokens > 0 THEN floor(CAST(greatest(raw_tokens - filtered_tokens, 0) AS DOUBLE)
            / CAST(raw_tokens AS DOUBLE) * 1000 + 0.5) / 10.0 ELSE CAST(0 AS DOUBLE) END AS savings_pct,
       exec_ms, bypassed, exact_tokens
FROM (SELECT r.*, raw_tokens * 4 AS raw_bytes,
             CAST(floor(raw_tokens / (1 + run_id % 9)) AS BIGINT) * 4 AS filtered_bytes,
             CAST(floor(raw_tokens / (1 + run_id % 9)) AS BIGINT) AS filtered_tokens,
             run_id % 11 = 0 AS bypassed, run_id % 2 = 0 AS exact_tokens
      FROM (SELECT q.*, exec_ms AS raw_tokens FROM ({EVENT_RUNS}) q) r) h"""

# A user is a run; its kind of line changes every 1,500 events.
USER_RUNS = """
SELECT user_id AS run_id, min(ts) AS ts,
       CASE user_id % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'git' WHEN 2 THEN 'cargo' WHEN 3 THEN 'npm'
                        WHEN 4 THEN 'make' ELSE 'tool' END AS command,
       'target ' || CAST(user_id % 3 AS STRING) AS args,
       CAST(max(CASE WHEN event_type = 'error' AND value > 90 THEN 1 ELSE 0 END) AS INT) AS exit_code,
       count(*) AS exec_ms, user_id % 29 = 0 AS no_filter
FROM events GROUP BY user_id"""

_N = "CAST(event_id % 90 + 1 AS STRING)"
USER_LINES = f"""
SELECT user_id AS run_id, event_id AS line_no, event_type = 'error' AS is_err,
 CASE (user_id * 7 + CAST(floor(event_id / 1500) AS BIGINT)) % 11
  WHEN 0 THEN 'step ' || {_N} || ' done'
  WHEN 1 THEN CASE WHEN event_id % 7 = 0 THEN 'error: build stopped' WHEN event_id % 7 = 1 THEN 'detail ' || {_N}
              ELSE 'src/f' || CAST(event_id % 3 AS STRING) || '.go:' || {_N} || ':5: error: bad value' END
  WHEN 2 THEN '✓ case ' || {_N}
  WHEN 3 THEN CASE WHEN event_id % 3 = 0 THEN '=== RUN Test' || {_N} ELSE '--- PASS: Test' || {_N} END
  WHEN 4 THEN CASE WHEN event_id % 5 = 0 THEN 'part ' || {_N} ELSE '' END
  WHEN 5 THEN '    at app.call(' || {_N} || ')'
  WHEN 6 THEN '-rw-r--r-- 1 u g ' || {_N} || ' Jan 1 10:00 file ' || {_N} || '.txt'
  WHEN 7 THEN chr(27) || '[31mred ' || {_N} || chr(27) || '[0m'
  WHEN 8 THEN 'lib/x' || CAST(event_id % 4 AS STRING) || '.py:' || {_N} || ': hit'
  WHEN 9 THEN CASE WHEN event_id % 3 = 0 THEN 'ok' ELSE '' END
  ELSE CASE WHEN event_id % 6 = 0 THEN 'hint: try ' || event_type || ' ' || {_N} || 'ms'
            WHEN event_id % 6 = 1 THEN 'error: ' || event_type
            ELSE 'note ' || event_type || ' ' || CAST(value AS STRING) END END AS text
FROM events"""

EVENT_COMMANDS = """
SELECT event_id,
 CASE event_id % 14
  WHEN 0 THEN 'git status --short'
  WHEN 1 THEN 'sudo -u root -E git log -n ' || CAST(user_id AS STRING)
  WHEN 2 THEN 'A=1 B=' || event_type || ' npm test'
  WHEN 3 THEN '/usr/local/bin/cargo build'
  WHEN 4 THEN 'ls -l | wc'
  WHEN 5 THEN 'docker exec -it box' || CAST(user_id AS STRING) || ' sh'
  WHEN 6 THEN 'mytool ' || event_type
  WHEN 7 THEN 'rm -rf build'
  WHEN 8 THEN 'dd if=/dev/zero of=x'
  WHEN 9 THEN '  npm run dev  '
  WHEN 10 THEN 'A=1 sudo make ' || event_type
  WHEN 11 THEN 'trivy scan ' || event_type
  WHEN 12 THEN 'kubectl run --interactive ' || CAST(user_id AS STRING)
  ELSE event_type END AS command_line
FROM events"""

# Go-test events, one run per user, some lines no event at all.
USER_TESTS = """
SELECT user_id AS run_id, event_id AS line_no,
 CASE WHEN event_id % 31 = 0 THEN 'panic ' || event_type
      WHEN event_id % 37 = 0 THEN '{"Action":"pass","Package":"pkg","Elapsed":"slow"}'
 ELSE '{"Action":"' || action || '","Package":"pkg' || CAST(event_id % 3 AS STRING) || '"'
   || CASE WHEN test = '' THEN '' ELSE ',"Test":"' || test || '"' END
   || CASE WHEN action = 'output' THEN ',"Output":"line ' || CAST(event_id AS STRING) || chr(92) || 'n"' ELSE '' END
   || ',"Elapsed":' || CAST(event_id % 40 AS STRING) || '.5}' END AS text
FROM (SELECT e.*,
        CASE event_type WHEN 'view' THEN 'output' WHEN 'click' THEN 'output' WHEN 'error' THEN
             CASE WHEN user_id % 2 = 0 THEN 'fail' ELSE 'skip' END WHEN 'signup' THEN 'pass' ELSE 'skip' END AS action,
        CASE WHEN event_id % 11 = 0 THEN '' ELSE 'T' || CAST(event_id % 5 AS STRING) END AS test
      FROM events e) x"""

USER_TAP = """
SELECT user_id AS run_id, event_id AS line_no,
 CASE event_id % 9 WHEN 0 THEN 'not ok ' || CAST(event_id AS STRING) || ' - ' || event_type
   WHEN 1 THEN 'not ok ' || CAST(event_id AS STRING) || ' ' || event_type
   WHEN 2 THEN '  ---' WHEN 3 THEN '  value: ' || CAST(user_id AS STRING)
   WHEN 4 THEN 'ok ' || CAST(event_id AS STRING) || ' # SKIP later'
   WHEN 5 THEN '1..' || CAST(event_id % 70 AS STRING)
   WHEN 6 THEN 'TAP version 13'
   ELSE 'ok ' || CAST(event_id AS STRING) || ' - fine' END AS text
FROM events"""

# One XML line per event between the lines that open and close the suite of a user.
USER_JUNIT = """
SELECT user_id AS run_id, -1 AS line_no,
  '<testsuite name="u' || CAST(user_id AS STRING) || '" tests="' || CAST(count(*) AS STRING)
  || '" failures="' || CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS STRING)
  || '" errors="0" time="1.25">' AS text
FROM events GROUP BY user_id
UNION ALL
SELECT user_id, event_id, CASE WHEN event_type = 'error'
  THEN '<testcase name="t' || CAST(event_id AS STRING) || '" classname="c"><failure message="bad">a</failure></testcase>'
  ELSE '<testcase name="t' || CAST(event_id AS STRING) || '" classname="c"/>' END
FROM events
UNION ALL
SELECT user_id, 1000000000000, CASE WHEN user_id % 13 = 0 THEN '</broken>' ELSE '</testsuite>' END
FROM events GROUP BY user_id"""

# Four runs a user, days apart: plain lines, go-test events, TAP (mostly with its header) and JUnit.
MIXED_RUNS = " UNION ALL ".join(
    f"""SELECT run_id * 4 + {k} AS run_id, ts + INTERVAL {40 * k} DAY AS ts, command, args, exit_code, exec_ms, no_filter
FROM ({USER_RUNS}) u{k}"""
    for k in range(4)
)
MIXED_LINES = f"""
SELECT run_id * 4 AS run_id, line_no, text FROM ({USER_LINES}) p
UNION ALL SELECT run_id * 4 + 1, line_no, text FROM ({USER_TESTS}) e
UNION ALL SELECT run_id * 4 + 2, line_no, text FROM ({USER_TAP}) t
UNION ALL SELECT user_id * 4 + 2, -1, 'TAP version 14' FROM events WHERE user_id % 5 <> 0 GROUP BY user_id
UNION ALL SELECT run_id * 4 + 3, line_no, text FROM ({USER_JUNIT}) j"""

RULES_TOML = r'''
[filters.git-target]
match_command = "^git\\b"
strip_ansi = true
strip_lines_matching = ["^hint:", "^\\s*$"]
truncate_lines_at = 12
max_lines = 5
on_empty = "git: nothing"

[filters.npm-target]
match_command = "^npm\\s+target\\s+[01]$"
replace = [{ pattern = "(\\d+)", replacement = "<$1>" }, { pattern = "<", replacement = "#" }]
match_output = [
  { pattern = "red #[78]\\d", message = "red seen", unless = "hit$" },
  { pattern = "zzz", message = "never" },
]
keep_lines_matching = ["step", "red", "hit"]
tail_lines = 4

[filters.make-target]
match_command = "^make\\b"
strip_lines_matching = ["."]
on_empty = "make: quiet"

[filters.cargo-one]
match_command = "^cargo target 1$"
max_lines = 8
tail_lines = 3
'''

RULES = parse_rules(RULES_TOML).rules

# Patterns that may match any number of newlines; users take the rules in turn.
UNBOUNDED_RULES = parse_rules(r'''
[filters.even]
match_command = "."
match_output = [
  { pattern = "(?s)error: signup.*error: view.*step", message = "three apart", unless = "(?s)ok\\n.*error: click.*ok\\n" },
  { pattern = "error: \\w+\\n(?:.*\\n)*?step \\d+ done\\s+part", message = "a part in the end" },
  { pattern = "(?s)^(?:note|error|hint|step|ok|=).*[0-9a-z]$", message = "from end to end" },
]
[filters.odd]
match_command = "."
match_output = [
  { pattern = "(?sm)^error: signup$.*^error: purchase$", message = "lines", unless = "(?s)error: click[^x]*error: view" },
  { pattern = "error\\b[^:]*:\\s+(?:view|click)\\n\\s*\\n+ok", message = "blank between" },
]
''').rules

PROJECT_RULES = (
    ProjectRule(r"^note view", "suppress"),
    ProjectRule(r"^step", "collapse"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Use every core for an input of a few small files; larger inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def adapted(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run an adapter's SQL over the events of a folder."""
    text = sql.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}")
    return spark.sql(text, events=spread(table(spark, folder, "events"), "event_id"))


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    return split_lines(spread(table(spark, folder, "documents"), "doc_id"), "doc_id", "text")
