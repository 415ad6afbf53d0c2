"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logcompact import sinks
from logcompact.functions import commands as C
from logcompact.functions import profiles as P
from logcompact.functions import registry as G
from logcompact.functions import text as T
from logcompact.operators import blocks, caps, loops, reports, rules, savings
from logcompact.operators.commands import classify_commands, registry_coverage
from logcompact.operators.ordered import attach, beside, chunked
from logcompact.plans import adapters as A
from logcompact.plans import oracles as O
from logcompact.plans.compact import compact, compact_plain, route_runs, run_kinds
from logcompact.session import scratch_path
from logcompact.sources.control import Rule, merge_rules, rules_table
from logcompact.sources.history import defaults, read_history
from logcompact.sources.lines import read_log_lines
from logcompact.streaming import history as history_streams
from logcompact.streaming import lines as streams
from logcompact.streaming import routes as route_streams
from logcompact.streaming import rules as rule_streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if oracle is not None:
            ORACLES[key] = oracle
        return function

    return add


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return A.adapted(spark, folder, A.EVENT_HISTORY)


def _user_runs(spark: SparkSession, folder: str) -> DataFrame:
    return A.adapted(spark, folder, A.USER_RUNS)


def _user_lines(spark: SparkSession, folder: str) -> DataFrame:
    return A.adapted(spark, folder, A.USER_LINES)


def _profiled(spark: SparkSession, folder: str) -> DataFrame:
    profiles = G.attach_profile(_user_runs(spark, folder)).select("run_id", "profile")
    return attach(chunked(_user_lines(spark, folder)), profiles).select(
        "run_id", "line_no", "text", "profile"
    )


def _rows(df: DataFrame) -> DataFrame:
    return df.select("run_id", "pos", "kind", "n", "sample", "text")


def _placed(df: DataFrame) -> DataFrame:
    return df.select("run_id", "place.*", "text")


# --- savings ---------------------------------------------------------------------------------


@query(O.TOTALS)
def savings_totals(spark: SparkSession, folder: str) -> DataFrame:
    return savings.savings_totals(_history(spark, folder))


@query(O.BY_COMMAND)
def savings_by_command(spark: SparkSession, folder: str) -> DataFrame:
    return savings.savings_by_command(_history(spark, folder))


@query(O.TOP)
def top_commands(spark: SparkSession, folder: str) -> DataFrame:
    return savings.top_commands(_history(spark, folder), 3)


RECENT_COLUMNS = ["run_id", "cmd", "args", "saved_tokens", "savings_pct", "exec_ms", "bypassed"]


@query(O.RECENT)
def recent_runs(spark: SparkSession, folder: str) -> DataFrame:
    return savings.recent_runs(_history(spark, folder)).select(*RECENT_COLUMNS)


@query(
    f"""SELECT 'total' AS part, '' AS cmd, total_runs AS runs, total_saved AS saved, avg_savings_pct AS pct FROM ({O.TOTALS}) t
    UNION ALL SELECT 'top', cmd, runs, total_saved, avg_pct FROM ({O.TOP.replace('LIMIT 3', 'LIMIT 10')}) c
    UNION ALL SELECT 'recent', cmd, run_id, saved_tokens, savings_pct FROM ({O.RECENT}) r"""
)
def savings_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = savings.savings_summary(_history(spark, folder))
    total = found.totals.selectExpr(
        "'total' AS part", "'' AS cmd", "total_runs AS runs", "total_saved AS saved", "avg_savings_pct AS pct"
    )
    top = found.top.selectExpr("'top' AS part", "cmd", "runs", "total_saved AS saved", "avg_pct AS pct")
    recent = found.recent.selectExpr(
        "'recent' AS part", "cmd", "run_id AS runs", "saved_tokens AS saved", "savings_pct AS pct"
    )
    return total.unionByName(top).unionByName(recent)


@query(
    f"""SELECT category, count(*) AS runs, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens,
    round(sum(h.savings_pct) / count(*), 1) AS actual_pct, round(sum(r.pct) / count(*), 1) AS typical_pct
    FROM ({A.EVENT_HISTORY}) h JOIN (SELECT col0 AS base, col1 AS category, CAST(col2 AS DOUBLE) AS pct
    FROM (VALUES {O.REGISTRY}) v) r ON h.cmd = r.base GROUP BY category""",
    "registry_coverage",
)
def _coverage(spark: SparkSession, folder: str) -> DataFrame:
    return registry_coverage(_history(spark, folder))


@query(O.REPORT)
def savings_report(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.savings_report(savings.savings_summary(_history(spark, folder)))


@query(
    f"""WITH raw AS (SELECT run_id, sum(strlen(text) + 1) AS n FROM ({O.DOC_LINES}) d GROUP BY run_id),
    kept AS (SELECT run_id, sum(strlen(text) + 1) AS n FROM ({O.DEDUP_DOC}) d GROUP BY run_id)
    SELECT doc_id AS run_id, CAST(raw.n AS BIGINT) AS raw_bytes, CAST(kept.n AS BIGINT) AS filtered_bytes,
      CAST(raw.n // 4 AS BIGINT) AS raw_tokens, CAST(kept.n // 4 AS BIGINT) AS filtered_tokens,
      CAST(greatest(raw.n // 4 - kept.n // 4, 0) AS BIGINT) AS saved_tokens,
      CASE WHEN raw.n // 4 > 0 THEN floor(CAST(greatest(raw.n // 4 - kept.n // 4, 0) AS DOUBLE) / CAST(raw.n // 4 AS DOUBLE) * 1000 + 0.5) / 10.0
      ELSE 0.0 END AS savings_pct
    FROM documents JOIN raw ON raw.run_id = doc_id JOIN kept ON kept.run_id = doc_id"""
)
def run_savings(spark: SparkSession, folder: str) -> DataFrame:
    lines = A.doc_lines(spark, folder)
    runs = A.table(spark, folder, "documents").selectExpr(
        "doc_id AS run_id", "current_timestamp() AS ts", "source AS command", "lang AS args", "n_chars AS exec_ms"
    )
    found = savings.run_savings(runs, lines, blocks.dedup_adjacent(lines))
    return found.select(
        "run_id", "raw_bytes", "filtered_bytes", "raw_tokens", "filtered_tokens", "saved_tokens", "savings_pct"
    )


@query("SELECT doc_id, CAST(strlen(text) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return A.table(spark, folder, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(
    """SELECT doc_id, CAST(greatest(strlen(text) - n_chars // 2, 0) AS BIGINT) AS saved_tokens,
    CASE WHEN strlen(text) > 0 THEN floor(CAST(greatest(strlen(text) - n_chars // 2, 0) AS DOUBLE) / strlen(text) * 1000 + 0.5) / 10.0
    ELSE 0.0 END AS savings_pct FROM documents""",
    "savings",
)
def _savings(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.octet_length("text").cast("bigint")
    half = F.floor(F.col("n_chars") / 2)
    return A.table(spark, folder, "documents").select("doc_id", T.savings(raw, half).alias("s")).select("doc_id", "s.*")


# --- lines and text --------------------------------------------------------------------------


@query(O.DOC_LINES)
def split_lines(spark: SparkSession, folder: str) -> DataFrame:
    return A.doc_lines(spark, folder)


def _text_query(name: str, expr: Callable, sql: str, docs: bool = False) -> None:
    """One expression over the text of every line of the users or of the documents."""
    source = O.DOC_LINES if docs else A.USER_LINES

    @query(f"SELECT run_id, line_no, {sql} AS value FROM ({source}) x", name)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        lines = A.doc_lines(spark, folder) if docs else _user_lines(spark, folder)
        return lines.select("run_id", "line_no", expr(F.col("text")).alias("value"))


_CHAIN = ((r"(\w+) done", "done $1"), (r"\d+", "<$0>"), (r"([aeiou])r", "${1}R"))
_text_query("strip_ansi", T.strip_ansi, O.plain_of("text"))
_text_query("normalize_numbers", T.normalize_numbers, O.number_free("text"))
_text_query("normalize_numbers_documents", T.normalize_numbers, O.number_free("text"), docs=True)
_text_query(
    "replace_chain",
    lambda text: T.replace_chain(text, _CHAIN),
    "regexp_replace(regexp_replace(regexp_replace(text, '(\\w+) done', 'done \\1', 'g'), "
    "'\\d+', '<\\0>', 'g'), '([aeiou])r', '\\1R', 'g')",
)
_text_query(
    "truncate_bytes",
    lambda text: T.truncate_bytes(text, 40),
    """CASE WHEN strlen(text) <= 40 THEN text ELSE (
    SELECT left(text, k) || CASE WHEN strlen(left(text, k)) < 40 THEN '�' ELSE '' END
    FROM (SELECT list_max(list_filter(range(0, 41), lambda i: strlen(left(text, i)) <= 40)) AS k)) END""",
    docs=True,
)
_text_query(
    "ls_name",
    T.ls_name,
    "CASE WHEN len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) >= 9 THEN "
    "array_to_string(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')[9:], ' ') ELSE text END",
)
_text_query("is_stack_frame", P.is_stack_frame, O.any_regex("text", P.STACK_FRAME))
_text_query("is_grep_hit", P.is_grep_hit, O.any_regex("text", [P.GREP_HIT]))
_text_query("is_ls_long", P.is_ls_long, O.any_regex("text", [P.LS_LONG]))
_text_query("detect_kind", T.detect_kind, "'plain'", docs=True)


@query(
    f"""SELECT run_id, line_no, regexp_extract(text, {O.q(T.FILE_REF)}, 1) AS file,
    ltrim(substr(text, length(regexp_extract(text, {O.q(T.FILE_REF)}, 1)) + 1), ':') AS rest
    FROM ({A.USER_LINES}) x WHERE regexp_extract(text, {O.q(T.FILE_REF)}, 1) <> ''"""
)
def file_ref(spark: SparkSession, folder: str) -> DataFrame:
    lines = _user_lines(spark, folder).withColumn("ref", T.file_ref(F.col("text")))
    return lines.where("ref IS NOT NULL").select("run_id", "line_no", "ref.file", "ref.rest")


@query(
    f"""SELECT run_id, line_no, CASE line_no % 5 WHEN 0 THEN '[' || n || ' times]: ' || text
    WHEN 1 THEN CASE WHEN n = 1 THEN text ELSE '[' || n || ' ok lines]' END WHEN 2 THEN '[' || n || ' more search hits]'
    WHEN 3 THEN '[' || n || ' more frames]' ELSE text || ': ' || n || ' errors' END AS text
    FROM (SELECT *, line_no % 3 AS n FROM ({A.USER_LINES}) x) y"""
)
def summary_text(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("repeated", "ok", "grep_omitted", "frames_omitted", "file")))
    kind = F.get(kinds, (F.col("line_no") % 5).cast("int"))
    return _user_lines(spark, folder).select(
        "run_id", "line_no", T.summary_text(kind, F.col("line_no") % 3, F.col("text")).alias("text")
    )


@query(
    f"""SELECT run_id, CASE WHEN starts_with(text, '<testsuite') THEN 'junit' WHEN starts_with(text, 'TAP version') THEN 'tap'
    WHEN json_valid(text) THEN 'ndjson' ELSE 'plain' END AS kind FROM (
    SELECT run_id, arg_min(text, line_no) AS text FROM (SELECT run_id, line_no, text FROM ({A.USER_JUNIT}) j
      UNION ALL SELECT run_id + 1000000, line_no, text FROM ({A.USER_TAP}) t
      UNION ALL SELECT run_id + 2000000, line_no, text FROM ({A.USER_TESTS}) e) x GROUP BY run_id) y"""
)
def detect_run_kind(spark: SparkSession, folder: str) -> DataFrame:
    lines = None
    for number, sql in enumerate((A.USER_JUNIT, A.USER_TAP, A.USER_TESTS)):
        more = A.adapted(spark, folder, sql).withColumn("run_id", F.col("run_id") + number * 1_000_000)
        lines = more if lines is None else lines.unionByName(more)
    return run_kinds(lines)


# --- predicates ------------------------------------------------------------------------------


@query(
    f"""SELECT run_id, line_no, {O.NOISE} AS noise, {O.ERROR} AS error, {O.SUCCESS} AS success
    FROM (SELECT *, {O.plain_of('text')} AS st FROM ({O.USER_PROFILED}) x) y"""
)
def line_flags(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.classify_lines(_profiled(spark, folder)).select(
        "run_id", "line_no", F.col("_noise").alias("noise"), F.col("_error").alias("error"),
        F.col("_success").alias("success"),
    )


@query(
    "SELECT doc_id, profile, "
    + ", ".join(
        f"{sql} AS {name}"
        for sql, name in ((O.NOISE, "noise"), (O.ERROR, "error"), (O.SUCCESS, "success"))
    )
    + " FROM (SELECT doc_id, text AS st, unnest(["
    + ", ".join(O.q(p) for p in P.PROFILES)
    + "]) AS profile FROM documents) x"
)
def document_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Every profile over every whole text."""
    names = F.array(*(F.lit(p) for p in P.PROFILES))
    rows = A.table(spark, folder, "documents").select("doc_id", "text", F.explode(names).alias("profile"))
    text, profile = F.col("text"), F.col("profile")
    return rows.select(
        "doc_id", "profile", P.is_noise(profile, text).alias("noise"), P.is_error(profile, text).alias("error"),
        P.is_success(profile, text).alias("success"),
    )


@query(f"SELECT run_id, line_no, text FROM ({A.USER_LINES}) x WHERE NOT {O.suppressed('text')}")
def project_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.apply_project_rules(_user_lines(spark, folder), A.PROJECT_RULES).select("run_id", "line_no", "text")


@query(f"SELECT run_id, line_no, text FROM ({A.USER_LINES}) x WHERE text <> ''")
def drop_blank(spark: SparkSession, folder: str) -> DataFrame:
    return rules.drop_blank(_user_lines(spark, folder)).select("run_id", "line_no", "text")


def _ruled_lines(spark: SparkSession, folder: str) -> DataFrame:
    runs = rules.match_rule(_user_runs(spark, folder), A.RULES).select("run_id", "rule")
    lines = attach(chunked(_user_lines(spark, folder)), runs)
    return lines.select("run_id", "rule", "line_no", "text")


def _stage_oracle(part: str, keep: bool) -> str:
    tests = []
    for place, rule in enumerate(A.RULES):
        patterns = getattr(rule, part)
        if patterns:
            hit = O.any_regex("text", patterns)
            tests.append(f"WHEN rule = {place} THEN {hit if keep else 'NOT ' + hit}")
    return f"""SELECT run_id, line_no, text FROM ({A.USER_LINES}) l LEFT JOIN ({O.RULED}) r USING (run_id)
    WHERE CASE {' '.join(tests)} ELSE true END"""


@query(_stage_oracle("strip_lines", False))
def strip_lines(spark: SparkSession, folder: str) -> DataFrame:
    return rules.strip_lines(_ruled_lines(spark, folder), A.RULES).select("run_id", "line_no", "text")


@query(_stage_oracle("keep_lines", True))
def keep_lines(spark: SparkSession, folder: str) -> DataFrame:
    return rules.keep_lines(_ruled_lines(spark, folder), A.RULES).select("run_id", "line_no", "text")


# --- commands --------------------------------------------------------------------------------


def _commands(spark: SparkSession, folder: str) -> DataFrame:
    return A.adapted(spark, folder, A.EVENT_COMMANDS)


@query(f"SELECT event_id, env_prefix, base, args FROM ({O.NORMALIZED}) x")
def normalize_command(spark: SparkSession, folder: str) -> DataFrame:
    split = C.normalize_command(F.col("command_line")).alias("c")
    return _commands(spark, folder).select("event_id", split).select("event_id", "c.*")


@query(O.CLASSIFIED, "classify_commands")
def _classified(spark: SparkSession, folder: str) -> DataFrame:
    return classify_commands(_commands(spark, folder)).select(
        "event_id", "category", "typical_pct", "verdict", "normalized"
    )


@query(
    f"""SELECT run_id, command || ' ' || args AS full_command, md5(command || ' ' || args) AS key, {O.SECURITY} AS security,
    lower(command) IN ('npm', 'make') AS excluded FROM ({A.EVENT_RUNS}) r"""
)
def command_key(spark: SparkSession, folder: str) -> DataFrame:
    command, args = F.col("command"), F.col("args")
    return A.adapted(spark, folder, A.EVENT_RUNS).select(
        "run_id",
        C.full_command(command, args).alias("full_command"),
        C.command_key(command, args).alias("key"),
        C.is_security(command, args).alias("security"),
        C.is_excluded(command, ("NPM", "Make")).alias("excluded"),
    )


@query(f"SELECT event_id, regexp_matches(command_line, {O.q(C.SHELL_META)}) AS meta FROM ({A.EVENT_COMMANDS}) c")
def shell_meta(spark: SparkSession, folder: str) -> DataFrame:
    return _commands(spark, folder).select("event_id", C.has_shell_meta(F.col("command_line")).alias("meta"))


@query(f"SELECT event_id, {O.INTERACTIVE} AS interactive FROM ({O.NORMALIZED}) x")
def interactive(spark: SparkSession, folder: str) -> DataFrame:
    table = G.registry_table(spark).select("base", "interactive")
    split = C.normalize_command(F.col("command_line")).alias("c")
    calls = _commands(spark, folder).select("event_id", split).select("event_id", "c.base", "c.args")
    return calls.join(F.broadcast(table), "base", "left").select(
        "event_id", C.is_interactive(F.col("args"), F.col("interactive")).alias("interactive")
    )


@query(f"SELECT run_id, command, {O.PROFILE} AS profile FROM ({A.EVENT_RUNS}) r")
def attach_profile(spark: SparkSession, folder: str) -> DataFrame:
    return G.attach_profile(A.adapted(spark, folder, A.EVENT_RUNS)).select("run_id", "command", "profile")


@query(f"SELECT category, count(*) AS events FROM ({O.CLASSIFIED}) c WHERE category IS NOT NULL GROUP BY category")
def registry_table(spark: SparkSession, folder: str) -> DataFrame:
    found = classify_commands(_commands(spark, folder)).where("category IS NOT NULL")
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("events"))


@query(O.loop_sql(A.EVENT_RUNS))
def loop_guard(spark: SparkSession, folder: str) -> DataFrame:
    return loops.loop_guard(A.adapted(spark, folder, A.EVENT_RUNS)).select("key", "run_id", "count", "loop")


@query(
    f"""SELECT key, runs FROM (SELECT key, first, count(*) AS runs FROM (SELECT *, max(CASE WHEN count = 1 THEN run_id END)
    OVER (PARTITION BY key ORDER BY rn) AS first FROM (SELECT l.*, row_number() OVER (PARTITION BY key ORDER BY ts, run_id) AS rn
    FROM ({O.loop_sql(A.EVENT_RUNS)}) l JOIN ({A.EVENT_RUNS}) r USING (run_id)) a) b GROUP BY key, first) c"""
)
def loop_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return loops.loop_sessions(A.adapted(spark, folder, A.EVENT_RUNS)).select("key", "runs")


# --- rules -----------------------------------------------------------------------------------


@query(f"SELECT run_id, {O.rule_choice(A.RULES)} AS rule FROM ({A.EVENT_RUNS}) r")
def match_rule(spark: SparkSession, folder: str) -> DataFrame:
    return rules.match_rule(A.adapted(spark, folder, A.EVENT_RUNS), A.RULES).select("run_id", "rule")


@query(
    f"""SELECT name, count(*) AS runs FROM (SELECT CASE {O.rule_choice(A.RULES[2:] + A.RULES[:2])}
    {' '.join(f"WHEN {i} THEN {O.q(r.name)}" for i, r in enumerate(A.RULES[2:] + A.RULES[:2]))} END AS name
    FROM ({A.EVENT_RUNS}) r) x WHERE name IS NOT NULL GROUP BY name""",
    "merge_rules",
)
def _merged(spark: SparkSession, folder: str) -> DataFrame:
    merged = merge_rules(A.RULES[2:], A.RULES[:2])
    named = rules_table(spark, merged).selectExpr("priority AS rule", "name")
    runs = rules.match_rule(A.adapted(spark, folder, A.EVENT_RUNS), merged)
    return runs.groupBy("rule").agg(F.count(F.lit(1)).alias("runs")).join(named, "rule").select("name", "runs")


@query(
    f"WITH {O.rules_ctes(O.RULED, A.USER_LINES)} SELECT run_id, message FROM r1_said WHERE message IS NOT NULL"
)
def match_output(spark: SparkSession, folder: str) -> DataFrame:
    runs = rules.match_rule(_user_runs(spark, folder), A.RULES)
    lines = rules.clean_lines(_ruled_lines(spark, folder), A.RULES)
    return rules.match_output(runs, chunked(lines), A.RULES).select("run_id", "message")


_IN_TURN = f"SELECT DISTINCT run_id, CAST(run_id % 2 AS INTEGER) AS rule FROM ({A.USER_LINES}) t"


@query(
    f"WITH {O.rules_ctes(_IN_TURN, A.USER_LINES, A.UNBOUNDED_RULES)}, said AS (SELECT * FROM r0_said UNION ALL SELECT * FROM r1_said) "
    "SELECT run_id, message FROM said WHERE message IS NOT NULL"
)
def match_output_unbounded(spark: SparkSession, folder: str) -> DataFrame:
    lines = _user_lines(spark, folder).select("run_id", "line_no", "text", F.expr("CAST(run_id % 2 AS INT)").alias("rule"))
    runs = lines.select("run_id", "rule").distinct()
    lines = rules.clean_lines(chunked(lines, "line_no", 1 << 12), A.UNBOUNDED_RULES)
    return rules.match_output(runs, lines, A.UNBOUNDED_RULES).select("run_id", "message")


@query(f"SELECT run_id, line_no FROM (SELECT *, row_number() OVER {O.W} AS r FROM ({O.DOC_LINES}) d) x WHERE r <= 3")
def head_lines(spark: SparkSession, folder: str) -> DataFrame:
    return rules.head_lines(A.doc_lines(spark, folder), 3).select("run_id", "line_no")


@query(
    f"""SELECT run_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) AS r
    FROM ({O.DOC_LINES}) d) x WHERE r <= 2"""
)
def tail_lines(spark: SparkSession, folder: str) -> DataFrame:
    return rules.tail_lines(A.doc_lines(spark, folder), 2).select("run_id", "line_no")


@query(
    f"""SELECT run_id, CASE rule {' '.join(f"WHEN {i} THEN {O.q(r.on_empty)}" for i, r in enumerate(A.RULES))} END AS message
    FROM ({O.RULED}) r WHERE rule IN (0, 2) AND run_id NOT IN (SELECT run_id FROM ({A.USER_LINES}) l WHERE text LIKE '%red%')"""
)
def on_empty(spark: SparkSession, folder: str) -> DataFrame:
    runs = rules.match_rule(_user_runs(spark, folder), A.RULES)
    return rules.on_empty(runs, _user_lines(spark, folder).where("text LIKE '%red%'"), A.RULES)


@query(O.APPLY_RULES)
def apply_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.apply_rules(_user_runs(spark, folder), _user_lines(spark, folder), A.RULES)


# --- folding ---------------------------------------------------------------------------------


@query(O.DEDUP_DOC)
def dedup_adjacent(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(blocks.dedup_adjacent(A.doc_lines(spark, folder)))


@query(f"SELECT * FROM ({O.compact_lines_sql(O.USER_PROFILED)}) x WHERE kind = 'ok'")
def collapse_success(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(blocks.collapse_success(_profiled(spark, folder)))


@query(f"WITH {O.place_ctes(O.USER_PROFILED)} SELECT run_id, line_no, text FROM placed WHERE inb")
def error_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.error_blocks(_profiled(spark, folder)).select("run_id", "line_no", "text")


@query(
    f"""WITH {O.place_ctes(O.USER_PROFILED)}, {O.BLOCK_CTES}
    SELECT run_id, pos, kind, CAST(n AS BIGINT) AS n, sample, text FROM blocks"""
)
def group_errors_by_file(spark: SparkSession, folder: str) -> DataFrame:
    found = blocks.error_blocks(_profiled(spark, folder)).drop("_chunk")
    return _rows(blocks.group_errors_by_file(found))


_CAP_SOURCE = f"SELECT run_id, line_no * 2 AS pos, text FROM ({A.USER_LINES}) x"
_CAP_KINDS = f"""kinds AS (SELECT *, {O.CAP_KIND} AS cap FROM (SELECT *, {O.plain_of('text')} AS st FROM ({_CAP_SOURCE}) s) x)"""


@query(
    f"""WITH {_CAP_KINDS}, {O.cap_ctes('kinds', 'f', 'f', 2, 'frames_omitted', 'frames', caps.END + 1)}
    SELECT {O.COLUMNS} FROM f_rows"""
)
def cap_stack_frames(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(caps.cap_stack_frames(_user_lines(spark, folder), 2))


@query(
    f"""WITH {_CAP_KINDS}, {O.cap_ctes('kinds', 'g', 'g', 3, 'grep_omitted', 'search hits', caps.END)}
    SELECT {O.COLUMNS} FROM g_rows"""
)
def cap_grep_hits(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(caps.cap_grep_hits(_user_lines(spark, folder), 3))


@query(O.compact_plain_sql(O.PLAIN_LINES), "compact_plain")
def _plain(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(compact_plain(_user_runs(spark, folder), _user_lines(spark, folder), A.PROJECT_RULES))


@query(O.compact_plain_sql(f"SELECT * FROM ({O.USER_PROFILED}) x"), "compact_plain_with_blanks")
def _plain_blanks(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(compact_plain(_user_runs(spark, folder), _user_lines(spark, folder), blanks=True))


# --- reports ---------------------------------------------------------------------------------


@query(
    f"""WITH parsed AS ({O.EVENTS_PARSED}) SELECT run_id, line_no, action, package, test, output, elapsed
    FROM parsed WHERE good"""
)
def parse_test_events(spark: SparkSession, folder: str) -> DataFrame:
    events = reports.parse_test_events(A.adapted(spark, folder, A.USER_TESTS))
    return events.where("event IS NOT NULL").select("run_id", "line_no", "event.*")


@query(f"WITH parsed AS ({O.EVENTS_PARSED}) {O.PACKAGES}")
def test_packages(spark: SparkSession, folder: str) -> DataFrame:
    events = reports.parse_test_events(A.adapted(spark, folder, A.USER_TESTS))
    return reports.test_packages(events).drop("ok")


@query(O.TEST_SUMMARY)
def test_event_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(reports.summarize_test_events(A.adapted(spark, folder, A.USER_TESTS)))


@query(O.TAP_SUMMARY)
def tap_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(reports.summarize_tap(A.adapted(spark, folder, A.USER_TAP)))


@query(O.JUNIT_SUMMARY)
def junit_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(reports.summarize_junit(A.adapted(spark, folder, A.USER_JUNIT)))


# --- sources, sinks and the composite --------------------------------------------------------


@query(
    f"""SELECT cmd, args, raw_tokens, filtered_tokens, saved_tokens, savings_pct, exec_ms, bypassed, exact_tokens
    FROM ({A.EVENT_HISTORY}) h"""
)
def history_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "history")
    sinks.write_history(defaults(_history(spark, folder)), path)
    return read_history(spark, path).select(
        "cmd", "args", "raw_tokens", "filtered_tokens", "saved_tokens", "savings_pct", "exec_ms", "bypassed",
        "exact_tokens",
    )


@query(
    f"""SELECT l.run_id, line_no, text, exit_code FROM ({A.USER_LINES}) l JOIN ({A.USER_RUNS}) r USING (run_id)
    WHERE exit_code <> 0"""
)
def retain_raw(spark: SparkSession, folder: str) -> DataFrame:
    kept = sinks.retain_raw(_user_runs(spark, folder), _user_lines(spark, folder), "failures")
    return kept.select("run_id", "line_no", "text", "exit_code")


@query(
    f"""SELECT l.run_id, line_no, text FROM ({A.USER_LINES}) l JOIN ({A.USER_RUNS}) r USING (run_id) WHERE exit_code <> 0"""
)
def failed_run_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = sinks.failed_run_lines(_user_runs(spark, folder), _user_lines(spark, folder))
    return found.select("run_id", "line_no", "text")


@query("SELECT text, count(*) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM "
       "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents) x GROUP BY text")  # fmt: skip
def read_captured_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The documents written as text files and read back as lines."""
    # Every line keeps its document in front, as the files do not follow the documents.
    ids = A.table(spark, folder, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")
    )
    marked = scratch_path(spark, "marked")
    ids.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "text").alias("value")).write.text(marked)
    lines = read_log_lines(spark, marked)
    split = lines.select(
        F.substring_index("text", "\t", 1).alias("doc"), F.expr("substring(text, instr(text, '\t') + 1)").alias("text")
    )
    return split.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("docs"))


@query(O.ROUTES, "route_runs")
def _routes(spark: SparkSession, folder: str) -> DataFrame:
    return route_runs(_user_runs(spark, folder), _user_lines(spark, folder), A.RULES)


@query(f"{O.COMPACT_CTES} SELECT run_id, CAST(place AS BIGINT) AS place, text FROM output_lines", "compact")
def _compact(spark: SparkSession, folder: str) -> DataFrame:
    found = compact(_user_runs(spark, folder), _user_lines(spark, folder), A.RULES, A.PROJECT_RULES)
    return found.lines.select("run_id", F.col("place.a").alias("place"), "text")


@query(O.history_sql(O.COMPACT_CTES, A.USER_RUNS, A.USER_LINES), "compact_history")
def _compact_history(spark: SparkSession, folder: str) -> DataFrame:
    found = compact(_user_runs(spark, folder), _user_lines(spark, folder), A.RULES, A.PROJECT_RULES)
    return found.history.select("run_id", "cmd", "args", "raw_bytes", "filtered_bytes", "saved_tokens", "bypassed")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Runs and lines of every format."""
    return A.adapted(spark, folder, A.MIXED_RUNS), A.adapted(spark, folder, A.MIXED_LINES)


@query(f"SELECT run_id, line_no, {O.KIND} AS kind FROM ({A.MIXED_LINES}) l")
def detect_kind_of_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1].select("run_id", "line_no", T.detect_kind(F.col("text")).alias("kind"))


@query(O.MIXED_ROUTES)
def route_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return route_runs(*_mixed(spark, folder), A.RULES)


@query(f"{O.MIXED_CTES} SELECT run_id, a, b, c, d, text FROM output_lines")
def compact_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(compact(*_mixed(spark, folder), A.RULES, A.PROJECT_RULES).lines)


@query(O.history_sql(O.MIXED_CTES, A.MIXED_RUNS, A.MIXED_LINES))
def compact_mixed_history(spark: SparkSession, folder: str) -> DataFrame:
    found = compact(*_mixed(spark, folder), A.RULES, A.PROJECT_RULES)
    return found.history.select("run_id", "cmd", "args", "raw_bytes", "filtered_bytes", "saved_tokens", "bypassed")


# --- streams: a file source read to its end, compared with the batch answer -------------------


def _stream(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """An adapter over the events as a stream. Its SQL must not aggregate."""
    schema = A.table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")
    text = sql.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}")
    return spark.sql(text, events=events)


def _in_parts(rows: DataFrame, at: Column, parts: int = 3) -> list[DataFrame]:
    """Cut a table in a few parts by the range of a number."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    part = F.floor((at - low) * parts / (high - low + 1))
    return [rows.where(part == n) for n in range(parts)]


def _feed(
    spark: SparkSession, name: str, parts: list[DataFrame], begin: Callable[[DataFrame, str, str, str], object]
) -> tuple[str, str]:
    """Let parts of a table arrive one after the other; each start goes on from the checkpoint."""
    root = scratch_path(spark, name)
    source, state, out = f"{root}/source", f"{root}/state", f"{root}/out"
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        _finish(begin(stream, state, out, f"{root}/checkpoint"))
    return state, out


def _finish(stream_query) -> None:
    stream_query.awaitTermination()
    if stream_query.exception():
        raise stream_query.exception()


def _line_parts(rows: DataFrame) -> list[DataFrame]:
    """Lines in three parts by line number, with a row that ends each run in the last part."""
    runs = [F.first(c).alias(c) for c in rows.columns if c not in ("run_id", "line_no")]
    ends = rows.groupBy("run_id").agg(*runs).withColumn("line_no", F.lit(1 << 40).cast("bigint"))
    parts = [part.withColumn("is_end", F.lit(False)) for part in _in_parts(rows, F.col("line_no"))]
    return [*parts[:-1], parts[-1].unionByName(ends.withColumn("is_end", F.lit(True)))]


def _time_parts(rows: DataFrame) -> list[DataFrame]:
    return _in_parts(rows, F.unix_micros(F.col("ts").cast("timestamp")))


_STRIP_SOURCE = f"""SELECT l.*, CASE run_id % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'git' WHEN 2 THEN 'cargo' WHEN 3 THEN 'npm'
  WHEN 4 THEN 'make' ELSE 'tool' END AS command, 'target ' || CAST(run_id % 3 AS STRING) AS args FROM ({A.USER_LINES}) l"""
_STRIP_TEXT = f"""CASE WHEN rule = 0 THEN regexp_replace(text, {O.q(T.CSI)}, '', 'g')
  WHEN rule = 1 THEN regexp_replace(regexp_replace(text, '(\\d+)', '<\\1>', 'g'), '<', '#', 'g') ELSE text END"""
_STRIPPED = f"""SELECT run_id, line_no, CASE WHEN rule = 0 THEN left(text, 12) ELSE text END AS text FROM (
  SELECT run_id, line_no, rule, {_STRIP_TEXT} AS text FROM (SELECT *, {O.rule_choice(A.RULES)} AS rule FROM ({_STRIP_SOURCE}) s) r) x
  WHERE CASE WHEN rule = 0 THEN NOT {O.any_regex('text', A.RULES[0].strip_lines)} WHEN rule = 2 THEN NOT {O.any_regex('text', A.RULES[2].strip_lines)} ELSE true END
    AND CASE WHEN rule = 1 THEN {O.any_regex('text', A.RULES[1].keep_lines)} ELSE true END"""


@query(_STRIPPED, "stream_strip")
def _stream_strip(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "strip")
    stripped = streams.stream_strip(_stream(spark, folder, _STRIP_SOURCE), A.RULES).select("run_id", "line_no", "text")
    writer = stripped.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
    _finish(writer.trigger(availableNow=True).start(f"{root}/out"))
    return spark.read.schema("run_id BIGINT, line_no BIGINT, text STRING").parquet(f"{root}/out")


@query(_STRIPPED, "stream_rule_refresh")
def _stream_refresh(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "refresh")
    spark.createDataFrame([(A.RULES_TOML,)], "value STRING").coalesce(1).write.text(f"{root}/rules")
    source = _stream(spark, folder, _STRIP_SOURCE).select("run_id", "line_no", "text", "command", "args")
    _finish(streams.stream_rule_refresh(source, f"{root}/rules/part-*", f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out").select("run_id", "line_no", "text")


def _stream_plain(spark: SparkSession, folder: str, blanks: bool) -> DataFrame:
    commands = _user_runs(spark, folder).select("run_id", "command")
    lines = attach(chunked(_user_lines(spark, folder)), commands).select("run_id", "line_no", "text", "command")
    rules_used = () if blanks else A.PROJECT_RULES
    _, out = _feed(
        spark, "compact", _line_parts(lines),
        lambda stream, *places: streams.stream_compact(stream, *places, rules_used, blanks),
    )
    return _rows(spark.read.parquet(out))


@query(O.compact_plain_sql(O.PLAIN_LINES), "stream_compact")
def _stream_compact(spark: SparkSession, folder: str) -> DataFrame:
    return _stream_plain(spark, folder, False)


@query(O.compact_plain_sql(f"SELECT * FROM ({O.USER_PROFILED}) x"), "stream_compact_with_blanks")
def _stream_compact_blanks(spark: SparkSession, folder: str) -> DataFrame:
    return _stream_plain(spark, folder, True)


@query(O.APPLY_RULES, "stream_apply_rules")
def _stream_rules(spark: SparkSession, folder: str) -> DataFrame:
    runs = _user_runs(spark, folder).select("run_id", "command", "args")
    lines = attach(chunked(_user_lines(spark, folder)), runs).select("run_id", "line_no", "text", "command", "args")
    _, out = _feed(
        spark, "rules", _line_parts(lines), lambda stream, *places: rule_streams.stream_apply_rules(stream, A.RULES, *places)
    )
    return spark.read.parquet(out).select("run_id", "pos", "kind", "text")


@query(f"{O.MIXED_CTES} SELECT run_id, a, b, c, d, text FROM output_lines", "stream_route")
def _stream_route(spark: SparkSession, folder: str) -> DataFrame:
    runs, lines = _mixed(spark, folder)
    repeated = loops.loop_guard(runs).where("loop").select("run_id", "loop")
    runs = runs.join(beside(repeated), "run_id", "left").selectExpr("run_id", "command", "args", "no_filter OR coalesce(loop, false) AS no_filter")
    lines = attach(chunked(lines), runs).drop("_chunk")
    _, out = _feed(
        spark, "routes", _line_parts(lines),
        lambda stream, *places: route_streams.stream_route(stream, *places, A.RULES, A.PROJECT_RULES),
    )
    return _placed(spark.read.parquet(out))


@query(O.TEST_SUMMARY, "stream_test_summary")
def _stream_tests(spark: SparkSession, folder: str) -> DataFrame:
    parts = _line_parts(A.adapted(spark, folder, A.USER_TESTS))
    return _placed(spark.read.parquet(_feed(spark, "tests", parts, streams.stream_test_summary)[1]))


@query(O.TAP_SUMMARY, "stream_tap_summary")
def _stream_tap(spark: SparkSession, folder: str) -> DataFrame:
    parts = _line_parts(A.adapted(spark, folder, A.USER_TAP))
    return _placed(spark.read.parquet(_feed(spark, "tap", parts, streams.stream_tap_summary)[1]))


@query(O.loop_sql(A.EVENT_RUNS), "stream_loop_guard")
def _stream_loops(spark: SparkSession, folder: str) -> DataFrame:
    parts = _time_parts(A.adapted(spark, folder, A.EVENT_RUNS))
    _, out = _feed(spark, "loops", parts, history_streams.stream_loop_guard)
    return spark.read.parquet(out).select("key", "run_id", "count", "loop")


@query(O.BY_COMMAND, "stream_savings")
def _stream_savings(spark: SparkSession, folder: str) -> DataFrame:
    parts = _time_parts(A.adapted(spark, folder, A.EVENT_HISTORY))
    _, out = _feed(
        spark, "savings", parts, lambda stream, _, out, checkpoint: history_streams.stream_savings(stream, out, checkpoint)
    )
    return history_streams.latest_totals(spark, out)


@query(
    "SELECT run_id, cmd, saved_tokens, savings_pct, exec_ms, bypassed, exact_tokens "
    f"FROM ({A.EVENT_HISTORY}) h"
)
def stream_history(spark: SparkSession, folder: str) -> DataFrame:
    parts = _time_parts(A.adapted(spark, folder, A.EVENT_HISTORY))
    _, out = _feed(
        spark, "appended", parts, lambda stream, _, out, checkpoint: history_streams.stream_history(stream, out, checkpoint)
    )
    return spark.read.parquet(out).select(
        "run_id", "cmd", "saved_tokens", "savings_pct", "exec_ms", "bypassed", "exact_tokens"
    )


# --- extension points ------------------------------------------------------------------------


@query("SELECT doc_id, CAST(strlen(text) // 4 AS BIGINT) AS tokens, false AS exact_tokens FROM documents")
def count_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return A.table(spark, folder, "documents").select(
        "doc_id", T.token_estimate(F.col("text")).alias("tokens"), F.lit(False).alias("exact_tokens")
    )


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS name, doc_id % 3 <> 1 AS passed, string_split(text, chr(10))[1] AS actual
    FROM documents"""
)
def check_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as rule tests of a rule that keeps one line; a third of them expect another line."""
    tests = A.table(spark, folder, "documents").select(
        F.lit("first-line").alias("rule"),
        F.col("doc_id").cast("string").alias("name"),
        F.col("text").alias("input"),
        F.when(F.col("doc_id") % 3 == 1, "another").otherwise(F.split("text", "\n")[0]).alias("expected"),
    )
    found = rules.check_rules([Rule("first-line", max_lines=1)], tests)
    return found.select("name", "passed", "actual")
