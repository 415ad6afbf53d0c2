"""The registered queries restated in plain SQL, for comparison on the same tables."""

from __future__ import annotations

from logcompact.functions.commands import (
    DENIED_COMMANDS,
    ENV_PREFIX,
    IGNORED_COMMANDS,
    OWN_NAMES,
    SECURITY_KEYWORDS,
    SHELL_META,
    SUDO_FLAGS,
)
from logcompact.functions.profiles import (
    GENERAL_ERROR,
    GENERAL_SUCCESS,
    GREP_HIT,
    LS_LONG,
    PROFILE_OF,
    PROFILES,
    STACK_FRAME,
    Test,
)
from logcompact.functions.registry import registry_rows
from logcompact.functions.text import CSI, FILE_REF, NUMBER, OSC
from logcompact.operators.caps import END
from logcompact.plans import adapters as A
from logcompact.sources.control import Rule


def q(text: str) -> str:
    """An SQL string literal; control characters are spelled out."""
    parts, plain = [], ""
    for ch in text:
        if ch < " ":
            parts += [f"'{plain}'", f"chr({ord(ch)})"]
            plain = ""
        else:
            plain += "''" if ch == "'" else ch
    parts.append(f"'{plain}'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def plain_of(text: str) -> str:
    return f"regexp_replace({text}, {q(f'{CSI}|{OSC}')}, '', 'g')"


def number_free(text: str) -> str:
    return f"regexp_replace({text}, {q(NUMBER)}, 'N', 'g')"


DOC_LINES = """
SELECT run_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text
FROM (SELECT doc_id AS run_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) a) b"""


def _test(test: Test, text: str) -> str:
    value = q(test.value)
    sql = {
        "prefix": f"starts_with({text}, {value})",
        "suffix": f"suffix({text}, {value})",
        "contains": f"contains({text}, {value})",
        "equals": f"{text} = {value}",
        "regex": f"regexp_matches({text}, {value})",
        "blank": f"trim({text}) = ''",
    }[test.op]
    return f"NOT {sql}" if test.negate else sql


def _role(role, text: str) -> str:
    groups = [(alt,) if isinstance(alt, Test) else alt for alt in role]
    return " OR ".join("(" + " AND ".join(_test(t, text) for t in group) + ")" for group in groups)


def role_sql(name: str, general, profile: str = "profile", text: str = "st") -> str:
    cases = []
    for profile_name, spec in PROFILES.items():
        tests = getattr(spec, name)
        if tests is not None:
            subject = f"trim({text})" if name in spec.trimmed else text
            cases.append(f"WHEN {q(profile_name)} THEN {_role(tests, subject)}")
    default = _role(general, text) if general else "false"
    return f"CASE {profile} {' '.join(cases)} ELSE {default} END"


#: A short kubectl line that starts with I is no noise.
SHORT_INFO = "profile = 'kubectl' AND starts_with(st, 'I') AND strlen(st) <= 20"
NOISE = f"(({role_sql('noise', None)}) AND NOT ({SHORT_INFO}))"
ERROR = role_sql("error", GENERAL_ERROR)
SUCCESS = role_sql("success", GENERAL_SUCCESS)

PROFILE = (
    "CASE command "
    + " ".join(f"WHEN {q(c)} THEN {q(p)}" for c, p in PROFILE_OF.items())
    + " END"
)


def profiled_sql(runs: str, lines: str) -> str:
    return f"""
SELECT l.run_id, l.line_no, l.text, r.profile FROM ({lines}) l
JOIN (SELECT run_id, {PROFILE} AS profile FROM ({runs}) u) r USING (run_id)"""


USER_PROFILED = profiled_sql(A.USER_RUNS, A.USER_LINES)

W = "(PARTITION BY run_id ORDER BY line_no)"
FLAGGED = f"""
SELECT run_id, line_no, text, st, profile, st = '' AS b, {NOISE} AS p, {ERROR} AS e, {SUCCESS} AS s
FROM (SELECT *, {plain_of('text')} AS st FROM lines_in) x"""


def place_ctes(lines: str) -> str:
    """CTEs up to ``placed``: per line whether it is collected (col) or in block ``seg`` (inb)."""
    return f"""
lines_in AS ({lines}),
flagged AS ({FLAGGED}),
closing AS (SELECT *, b AND coalesce(lag(b) OVER {W}, false) AS closer,
   row_number() OVER {W} - row_number() OVER (PARTITION BY run_id, s ORDER BY line_no) AS isl FROM flagged),
collected AS (SELECT *,
   coalesce(sum(closer::INT) OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg,
   s AND max((NOT p AND NOT e)::INT) OVER (PARTITION BY run_id, s, isl ORDER BY line_no) = 1 AS col FROM closing),
placed AS (SELECT *, max((e AND NOT p AND NOT col)::INT) OVER (PARTITION BY run_id, seg ORDER BY line_no) = 1 AS inb
   FROM collected)"""


FOLD_CTES = f"""
live AS (SELECT *, CASE WHEN inb THEN NULL WHEN col THEN 's' || isl WHEN NOT b THEN 'o' || {number_free('st')} END AS k
   FROM placed WHERE inb OR col OR NOT p),
turned AS (SELECT *, CASE WHEN k IS NULL OR k IS DISTINCT FROM lag(k) OVER {W} THEN 1 ELSE 0 END AS turn,
   lead(k) OVER {W} AS nk FROM live),
numbered AS (SELECT *, sum(turn) OVER {W} AS island FROM turned),
counted AS (SELECT *, row_number() OVER (PARTITION BY run_id, island ORDER BY line_no) AS place,
   count(*) OVER (PARTITION BY run_id, island) AS n FROM numbered),
folded AS (
   SELECT run_id, line_no * 2 AS pos, 'line' AS kind, 1 AS n, text AS sample, text FROM counted
   WHERE NOT inb AND NOT col AND place = 1
   UNION ALL
   SELECT run_id, line_no * 2 + 1, 'repeated', n, substr(k, 2), '[' || n || ' times]: ' || substr(k, 2) FROM counted
   WHERE NOT inb AND NOT col AND k IS NOT NULL AND place = n AND n > 1 AND NOT coalesce(nk LIKE 's%', false)
   UNION ALL
   SELECT run_id, line_no * 2 + 1, 'ok', n, st, CASE WHEN n = 1 THEN st ELSE '[' || n || ' ok lines]' END FROM counted
   WHERE NOT inb AND col AND place = n)"""

BLOCK_CTES = f"""
refs AS (SELECT *, regexp_extract(text, {q(FILE_REF)}, 1) AS file FROM placed WHERE inb),
sized AS (SELECT *, min(line_no) OVER (PARTITION BY run_id, seg) AS bf,
   min(line_no) OVER (PARTITION BY run_id, seg, file) AS ff, count(*) OVER (PARTITION BY run_id, seg, file) AS fn FROM refs),
filed AS (SELECT sized.*, nf FROM sized JOIN (SELECT run_id, seg, count(DISTINCT CASE WHEN file <> '' THEN file END) AS nf
   FROM sized GROUP BY run_id, seg) x USING (run_id, seg)),
shown AS (
   SELECT run_id, seg, bf, file, ff, line_no, 1 AS lo, CASE WHEN file <> '' AND fn > 1 THEN 'grouped' ELSE 'line' END AS kind,
     1 AS n, CASE WHEN file <> '' AND fn > 1 THEN '  ' || ltrim(substr(text, length(file) + 1), ':') ELSE text END AS sample
   FROM filed WHERE nf > 1
   UNION ALL
   SELECT DISTINCT run_id, seg, bf, file, ff, ff, 0, 'file', fn, file FROM filed WHERE nf > 1 AND file <> '' AND fn > 1),
blocks AS (
   SELECT run_id, 2 * bf + row_number() OVER (PARTITION BY run_id, seg ORDER BY file <> '', ff, lo, line_no) - 1 AS pos,
     kind, n, sample, CASE WHEN kind = 'file' THEN sample || ': ' || n || ' errors' ELSE sample END AS text FROM shown
   UNION ALL
   SELECT run_id, 2 * line_no, 'line', 1, text, text FROM filed WHERE nf <= 1)"""


def any_regex(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {q(p)})" for p in patterns) + ")"


CAP_KIND = (
    f"CASE WHEN {any_regex('st', [LS_LONG])} THEN 'l' WHEN {any_regex('st', [GREP_HIT])} THEN 'g' "
    f"WHEN {any_regex('st', STACK_FRAME)} THEN 'f' ELSE 'o' END"
)


def cap_ctes(source: str, name: str, kind: str, limit: int, marker: str, words: str, end: int) -> str:
    """CTEs that cap streaks of one kind in ``source``: <name>_rows and <name>_seen."""
    w = "(PARTITION BY run_id ORDER BY pos)"
    return f"""
{name}_a AS (SELECT *, cap = '{kind}' AS hit, row_number() OVER {w}
   - row_number() OVER (PARTITION BY run_id, cap = '{kind}' ORDER BY pos) AS isl FROM {source}),
{name}_b AS (SELECT *, row_number() OVER (PARTITION BY run_id, hit, isl ORDER BY pos) AS place FROM {name}_a),
{name}_seen AS (SELECT *, lead(pos) OVER {w} AS npos, coalesce(lead(hit) OVER {w}, false) AS nhit,
   NOT hit AND coalesce(lag(hit) OVER {w}, false) AND coalesce(lag(place) OVER {w}, 0) > {limit} AS released FROM {name}_b),
{name}_rows AS (
   SELECT run_id, pos * 2 + 1 AS pos, 'line' AS kind, 1 AS n, text AS sample, text, hit, released FROM {name}_seen
   WHERE NOT hit OR place <= {limit}
   UNION ALL
   SELECT run_id, coalesce(npos * 2, {end}), '{marker}', place - {limit}, '', '[' || (place - {limit}) || ' more {words}]',
     hit, released FROM {name}_seen WHERE hit AND place > {limit} AND NOT nhit)"""


def caps_ctes(source: str, stack: int = 5, grep: int = 30) -> str:
    """CTEs ending in ``capped``: listings, hits and frames of (run_id, pos, text)."""
    name = f"""array_to_string(list_filter(regexp_split_to_array(trim(st), '\\s+'), lambda x: x <> '')[9:], ' ')"""
    fields = "len(list_filter(regexp_split_to_array(trim(st), '\\s+'), lambda x: x <> ''))"
    listed = f"CASE WHEN {fields} >= 9 THEN {name} ELSE st END"
    return f"""
kinds AS (SELECT *, {CAP_KIND} AS cap FROM (SELECT run_id, pos, text, {plain_of('text')} AS st FROM {source}) x),
unlisted AS (SELECT * FROM kinds WHERE cap <> 'l'),
{cap_ctes('unlisted', 'g', 'g', grep, 'grep_omitted', 'search hits', END)},
rest AS (SELECT run_id, pos, text, cap FROM g_seen WHERE NOT hit AND NOT released),
{cap_ctes('rest', 'f', 'f', stack, 'frames_omitted', 'frames', END + 1)},
capped AS (
   SELECT run_id, pos * 2 + 1 AS pos, 'name' AS kind, 1 AS n, {listed} AS sample, {listed} AS text FROM kinds WHERE cap = 'l'
   UNION ALL SELECT run_id, pos, kind, n, sample, text FROM g_rows WHERE hit OR released
   UNION ALL SELECT run_id, pos, kind, n, sample, text FROM f_rows)"""


COLUMNS = "run_id, pos, kind, CAST(n AS BIGINT) AS n, sample, text"


def compact_lines_sql(lines: str) -> str:
    return (
        f"WITH {place_ctes(lines)}, {FOLD_CTES}, {BLOCK_CTES} "
        f"SELECT {COLUMNS} FROM (SELECT * FROM folded UNION ALL SELECT * FROM blocks) x"
    )


def suppressed(text: str) -> str:
    rules = [r.match for r in A.PROJECT_RULES if r.action == "suppress"]
    return any_regex(text, rules)


def compact_plain_sql(lines: str) -> str:
    return f"""WITH {place_ctes(lines)}, {FOLD_CTES}, {BLOCK_CTES},
compacted AS (SELECT run_id, pos, text FROM folded UNION ALL SELECT run_id, pos, text FROM blocks),
{caps_ctes('compacted')} SELECT {COLUMNS} FROM capped"""


DEDUP_DOC = f"""WITH placed AS (
  SELECT run_id, line_no, text, {plain_of('text')} AS st, {plain_of('text')} = '' AS b, false AS inb, false AS col,
         false AS p, 0 AS isl FROM ({DOC_LINES}) d),
{FOLD_CTES} SELECT {COLUMNS} FROM folded"""


def rule_choice(rules: tuple[Rule, ...], command: str = "command || ' ' || args") -> str:
    cases = " ".join(
        f"WHEN regexp_matches({command}, {q(r.match_command)}) THEN {i}" for i, r in enumerate(rules)
    )
    return f"CASE {cases} END"


def duck_replacement(text: str) -> str:
    return text.replace("$", "\\")


def rule_sql(place: int, rule: Rule) -> str:
    """The stages of one rule as CTEs; the last is r<place>_out (run_id, pos, kind, text)."""
    n = f"r{place}"
    text = "text"
    if rule.strip_ansi:
        text = f"regexp_replace({text}, {q(CSI)}, '', 'g')"
    for pattern, replacement in rule.replace:
        text = f"regexp_replace({text}, {q(pattern)}, {q(duck_replacement(replacement))}, 'g')"
    chosen = " ".join(
        f"WHEN regexp_matches(coalesce(full_text, ''), {q(m.pattern)})"
        + (f" AND NOT regexp_matches(coalesce(full_text, ''), {q(m.unless)})" if m.unless else "")
        + f" THEN {q(m.message)}"
        for m in rule.match_output
    )
    chosen = f"CASE {chosen} END" if chosen else "CAST(NULL AS VARCHAR)"
    test = "true"
    if rule.strip_lines:
        test += f" AND NOT {any_regex('text', rule.strip_lines)}"
    if rule.keep_lines:
        test += f" AND {any_regex('text', rule.keep_lines)}"
    cut = f"left(text, {rule.truncate_at})" if rule.truncate_at else "text"
    head = f"up <= {rule.max_lines}" if rule.max_lines else "true"
    tail = f"down <= {rule.tail_lines}" if rule.tail_lines else "true"
    return f"""
{n}_runs AS (SELECT run_id FROM ruled WHERE rule = {place}),
{n}_clean AS (SELECT run_id, line_no, {text} AS text FROM lines_all JOIN {n}_runs USING (run_id)),
{n}_full AS (SELECT run_id, string_agg(text, chr(10) ORDER BY line_no) AS full_text FROM {n}_clean GROUP BY run_id),
{n}_said AS (SELECT run_id, {chosen} AS message FROM {n}_runs LEFT JOIN {n}_full USING (run_id)),
{n}_kept AS (SELECT c.run_id, line_no, {cut} AS text FROM {n}_clean c JOIN {n}_said s ON c.run_id = s.run_id
   WHERE s.message IS NULL AND {test.replace('text', 'c.text')}),
{n}_up AS (SELECT *, row_number() OVER {W} AS up FROM {n}_kept),
{n}_down AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) AS down FROM {n}_up WHERE {head}),
{n}_out AS (
   SELECT run_id, line_no AS pos, 'line' AS kind, text FROM {n}_down WHERE {tail}
   UNION ALL SELECT run_id, 1, 'message', message FROM {n}_said WHERE message <> ''
   UNION ALL SELECT run_id, 1, 'message', {q(rule.on_empty)} FROM {n}_said
   WHERE message IS NULL AND {q(rule.on_empty)} <> '' AND run_id NOT IN (SELECT run_id FROM {n}_down WHERE {tail}))"""


def rules_ctes(ruled: str, lines: str, rules: tuple[Rule, ...] = A.RULES) -> str:
    parts = [f"ruled AS ({ruled})", f"lines_all AS ({lines})"]
    parts += [rule_sql(i, r) for i, r in enumerate(rules)]
    union = " UNION ALL ".join(f"SELECT * FROM r{i}_out" for i in range(len(rules)))
    return ",\n".join([*parts, f"rules_out AS ({union})"])


RULED = f"SELECT run_id, {rule_choice(A.RULES)} AS rule FROM ({A.USER_RUNS}) u"
APPLY_RULES = f"WITH {rules_ctes(RULED, A.USER_LINES)} SELECT run_id, pos, kind, text FROM rules_out"

SECURITY = (
    "("
    + " OR ".join(f"contains(lower(command || ' ' || args), '{k}')" for k in SECURITY_KEYWORDS)
    + ")"
)


def loop_sql(runs: str) -> str:
    return f"""
SELECT key, run_id, count, count >= 3 AS loop FROM (
  SELECT key, run_id, row_number() OVER (PARTITION BY key, session ORDER BY ts, run_id) AS count FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts, run_id) AS session FROM (
      SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY key ORDER BY ts, run_id) IS NULL
        OR ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, run_id) > INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS fresh
      FROM (SELECT md5(command || ' ' || args) AS key, run_id, ts FROM ({runs}) r WHERE NOT {SECURITY}) k) f) s) n"""


TOTALS = f"""SELECT count(*) AS total_runs, CAST(sum(saved_tokens) AS BIGINT) AS total_saved,
  floor(avg(CASE WHEN NOT bypassed THEN savings_pct END) * 10 + 0.5) / 10.0 AS avg_savings_pct,
  bool_and(exact_tokens) AS exact_tokens FROM ({A.EVENT_HISTORY}) h"""
BY_COMMAND = f"""SELECT cmd, count(*) AS runs, CAST(sum(saved_tokens) AS BIGINT) AS total_saved,
  floor(avg(savings_pct) * 10 + 0.5) / 10.0 AS avg_pct, CAST(sum(exec_ms) // count(*) AS BIGINT) AS avg_exec_ms
  FROM ({A.EVENT_HISTORY}) h GROUP BY cmd"""
TOP = f"SELECT * FROM ({BY_COMMAND}) c ORDER BY total_saved DESC, cmd LIMIT 3"
RECENT = f"""SELECT run_id, cmd, args, saved_tokens, savings_pct, exec_ms, bypassed
  FROM ({A.EVENT_HISTORY}) h ORDER BY ts DESC, run_id DESC LIMIT 10"""
REGISTRY = ", ".join(f"({q(b)}, {q(c)}, {p})" for b, c, _, p in registry_rows())

TAIL_REPORT = """
SELECT 1 AS section, CAST(ord AS BIGINT) AS ord, text FROM (SELECT unnest([1, 2, 3, 4]) AS ord, unnest([
   'Runs: ' || format('{:,}', total_runs), 'Tokenizer: ' || CASE WHEN exact_tokens THEN 'byte pairs' ELSE 'estimate, bytes/4' END,
   'Tokens saved: ' || format('{:,}', total_saved), 'Mean saving: ' || printf('%.1f%%', avg_savings_pct)]) AS text
   FROM totals) a"""
REPORT = f"""WITH totals AS ({TOTALS}), top AS ({TOP.replace('LIMIT 3', 'LIMIT 10')}),
recent AS (SELECT h.*, row_number() OVER (ORDER BY ts DESC, run_id DESC) AS ord FROM ({A.EVENT_HISTORY}) h
   ORDER BY ts DESC, run_id DESC LIMIT 10)
{TAIL_REPORT}
UNION ALL SELECT 2, row_number() OVER (ORDER BY total_saved DESC, cmd), printf('%-30s %5d runs %7.1f%% %20s tokens %8s',
   cmd, runs, avg_pct, format('{{:,}}', total_saved), printf('%.1fs', avg_exec_ms / 1000.0)) FROM top
UNION ALL SELECT 3, ord, printf('%s  %-28s  %-25s  %s tokens  (%dms)', strftime(ts, '%Y-%m-%d %H:%M:%S'), cmd || ' ' || args,
   CASE WHEN bypassed THEN 'not compacted' ELSE printf('%.1f%% saved', savings_pct) END,
   format('{{:,}}', saved_tokens), exec_ms) FROM recent"""

NORMALIZED = f"""
SELECT event_id, trimmed, env_prefix,
  CASE WHEN head = '' THEN '.' WHEN rtrim(head, '/') = '' THEN '/' ELSE string_split(rtrim(head, '/'), '/')[-1] END AS base,
  trim(substr(call, length(head) + 2)) AS args
FROM (SELECT *, split_part(call, ' ', 1) AS head FROM (
  SELECT *, substr(bare, length(env_prefix) + 1) AS call FROM (
    SELECT *, regexp_extract(bare, {q(ENV_PREFIX)}, 0) AS env_prefix FROM (
      SELECT event_id, trimmed, CASE WHEN regexp_matches(trimmed, '^sudo($|[ -])')
        THEN regexp_replace(trim(regexp_replace(substr(trimmed, 5), '\\s+', ' ', 'g')), {q(SUDO_FLAGS)}, '') ELSE trimmed END AS bare
      FROM (SELECT event_id, trim(command_line) AS trimmed FROM ({A.EVENT_COMMANDS}) c) t) s) e) d) h"""

INTERACTIVE = (
    "("
    + " OR ".join(
        f"(base = {q(b)} AND (args = {q(p)} OR starts_with(args, {q(p + ' ')})))"
        for b, _, prefixes, _ in registry_rows()
        for p in prefixes
    )
    + " OR ((starts_with(lower(args), 'run ') OR starts_with(lower(args), 'exec '))"
    " AND (contains(args, '-it') OR contains(args, '-i ') OR contains(args, '--interactive'))))"
)


def names(values) -> str:
    return ", ".join(q(v) for v in values)


CLASSIFIED = f"""
SELECT event_id, category, typical_pct, verdict, CASE WHEN verdict = 0 THEN env_prefix || base ||
   CASE WHEN args = '' THEN '' ELSE ' ' || args END ELSE trimmed END AS normalized
FROM (SELECT n.*, category, typical_pct, CAST(CASE WHEN trimmed = '' THEN 1 WHEN regexp_matches(trimmed, {q(SHELL_META)}) THEN 1
   WHEN base IN ({names([*IGNORED_COMMANDS, *OWN_NAMES])}) THEN 1 WHEN base IN ({names(DENIED_COMMANDS)}) THEN 2
   WHEN category IS NULL THEN 1 WHEN {INTERACTIVE} THEN 1 ELSE 0 END AS INT) AS verdict
  FROM ({NORMALIZED}) n LEFT JOIN (SELECT col0 AS base, col1 AS category, CAST(col2 AS DOUBLE) AS typical_pct FROM (VALUES {REGISTRY}) v) r USING (base)) x"""

def events_sql(lines: str) -> str:
    return f"""
SELECT run_id, line_no, text, good, json_extract_string(j, '$.Action') AS action, json_extract_string(j, '$.Package') AS package,
  coalesce(json_extract_string(j, '$.Test'), '') AS test, coalesce(json_extract_string(j, '$.Output'), '') AS output,
  CAST(json_extract(j, '$.Elapsed') AS DOUBLE) AS elapsed
FROM (SELECT *, CASE WHEN good THEN text END AS j FROM (
  SELECT run_id, line_no, text, CASE WHEN json_valid(text) THEN json_type(text, '$.Elapsed') IN ('DOUBLE', 'UBIGINT', 'BIGINT')
    ELSE false END AS good FROM ({lines}) t) v) w"""


EVENTS_PARSED = events_sql(A.USER_TESTS)

PACKAGES = """
SELECT run_id, package, count(*) FILTER (test <> '' AND action = 'pass') AS passed,
  count(*) FILTER (test <> '' AND action = 'fail') AS failed, count(*) FILTER (test <> '' AND action = 'skip') AS skipped,
  coalesce(arg_max(elapsed, line_no) FILTER (test = '' AND action IN ('pass', 'fail')), 0.0) AS elapsed,
  bool_or(test = '' AND action = 'fail') AS pkg_failed, min(line_no) AS first_line
FROM parsed WHERE good GROUP BY run_id, package"""


def test_summary_sql(lines: str) -> str:
    return f"""WITH parsed AS ({events_sql(lines)}),
packages AS (SELECT *, NOT pkg_failed AND failed = 0 AS ok,
   CASE WHEN elapsed > 0 THEN printf(' (%.3fs)', elapsed) ELSE '' END AS took FROM ({PACKAGES}) p),
kept AS (SELECT e.run_id, e.package, p.first_line, e.test, e.line_no, rtrim(e.output, chr(10)) AS text,
    min(e.line_no) OVER (PARTITION BY e.run_id, e.package, e.test) AS test_line
  FROM parsed e JOIN packages p ON e.run_id = p.run_id AND e.package = p.package
  LEFT JOIN (SELECT run_id, package, test, max(line_no) AS last_pass FROM parsed WHERE good AND action = 'pass' GROUP BY ALL) l
    ON l.run_id = e.run_id AND l.package = e.package AND l.test = e.test AND e.test <> ''
  WHERE e.good AND e.action = 'output' AND NOT p.ok AND (e.test <> '' OR p.pkg_failed)
    AND (last_pass IS NULL OR e.line_no > last_pass))
SELECT run_id, CAST(0 AS BIGINT) AS a, line_no AS b, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS d, text FROM parsed WHERE NOT good
UNION ALL SELECT run_id, 1, first_line, 0, 0, CASE WHEN ok THEN 'ok   ' || package || took
   ELSE 'FAIL ' || package || took || ': ' || failed || '/' || (passed + failed + skipped) || ' failed' END FROM packages
UNION ALL SELECT run_id, 1, first_line, test_line, 0, '  --- FAIL: ' || test FROM kept WHERE test <> '' AND line_no = test_line
UNION ALL SELECT run_id, 1, first_line, CASE WHEN test = '' THEN {(1 << 62) - 1} ELSE test_line END, line_no,
   CASE WHEN test = '' THEN text ELSE '    ' || text END FROM kept WHERE trim(text) <> ''"""


TEST_SUMMARY = test_summary_sql(A.USER_TESTS)


def tap_summary_sql(lines: str) -> str:
    return f"""WITH t AS (SELECT run_id, line_no, trim(text) AS line FROM ({lines}) x),
m AS (SELECT *, regexp_matches(line, '^1\\.\\.\\d+') AS plan,
   coalesce(sum((line = '---')::INT) OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM t),
k AS (SELECT *, CASE WHEN plan THEN 'plan' WHEN line = '---' THEN 'mark' WHEN inside THEN 'diag'
   WHEN regexp_matches(line, '^ok\\s+\\d+') THEN CASE WHEN regexp_matches(regexp_extract(line, '^ok\\s+(\\d+)\\s*-?\\s*(.*)', 2), '(?i)#\\s*(skip|todo)') THEN 'skip' ELSE 'ok' END
   WHEN regexp_matches(line, '^not ok\\s+\\d+') THEN 'fail' ELSE 'other' END AS what FROM m),
o AS (SELECT *, last_value(CASE WHEN what IN ('ok', 'skip') THEN 0 WHEN what = 'fail' THEN line_no END IGNORE NULLS) OVER {W} AS owner FROM k),
c AS (SELECT run_id, coalesce(arg_max(TRY_CAST(regexp_extract(line, '^1\\.\\.(\\d+)', 1) AS BIGINT), line_no) FILTER (what = 'plan'), 0) AS total,
   count(*) FILTER (what = 'ok') AS passed, count(*) FILTER (what = 'fail') AS failed, count(*) FILTER (what = 'skip') AS skipped FROM k GROUP BY run_id)
SELECT run_id, CAST(1 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS d, CASE WHEN failed = 0 THEN '[TAP] ' || passed || '/' || total || ' passed'
   || CASE WHEN skipped > 0 THEN ', ' || skipped || ' skipped' ELSE '' END
   ELSE '[TAP] ' || passed || '/' || total || ' passed, ' || failed || ' FAILED:' END AS text FROM c
UNION ALL SELECT run_id, 1, owner, 0, line_no, '  not ok: ' || trim(regexp_extract(line, '^not ok\\s+(\\d+)\\s*-?\\s*(.*)', 2)) FROM o WHERE what = 'fail'
UNION ALL SELECT run_id, 1, owner, 1, line_no, '  ' || line FROM o WHERE what = 'diag' AND owner > 0"""


TAP_SUMMARY = tap_summary_sql(A.USER_TAP)

JUNIT_SUMMARY = f"""WITH u AS (SELECT user_id AS run_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY user_id),
x AS (SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS case_no, event_type FROM events
      WHERE user_id % 13 <> 0)
SELECT run_id, CAST(1 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS d, '[JUnit] u' || run_id || ': ' || (n - bad) || '/' || n || ' passed (1.250s)'
   || CASE WHEN bad = 0 THEN '' ELSE ', ' || bad || ' FAILED:' END AS text FROM u WHERE run_id % 13 <> 0
UNION ALL SELECT run_id, 1, 0, case_no, r, CASE r WHEN 0 THEN '  FAIL: c.t' || event_id WHEN 1 THEN '    bad' ELSE '    a' END
   FROM x, range(0, 3) t(r) WHERE event_type = 'error'
UNION ALL SELECT run_id, 0, line_no, 0, 0, text FROM ({A.USER_JUNIT}) j WHERE run_id % 13 = 0
UNION ALL SELECT run_id, 2, 0, 0, 0, '' FROM u WHERE run_id % 13 = 0"""

KIND = """CASE WHEN starts_with(trim(text), '<?xml') OR starts_with(trim(text), '<testsuite') THEN 'junit'
   WHEN starts_with(trim(text), 'TAP version') THEN 'tap'
   WHEN starts_with(trim(text), '{') AND json_valid(text) AND json_extract(CASE WHEN json_valid(text) THEN text END, '$.Action') IS NOT NULL
   THEN 'ndjson' ELSE 'plain' END"""


def routes_sql(runs: str, lines: str) -> str:
    return f"""WITH loops AS ({loop_sql(runs)}),
firsts AS (SELECT run_id, {KIND} AS kind FROM (SELECT run_id, arg_min(text, line_no) AS text FROM ({lines}) l GROUP BY run_id) f),
routed AS (SELECT u.run_id, {rule_choice(A.RULES)} AS rule, kind,
   {SECURITY} OR lower(command) = 'cargo' AND args = 'never' OR coalesce(loop, false) OR no_filter AS bypassed
   FROM ({runs}) u JOIN firsts USING (run_id) LEFT JOIN loops USING (run_id))
SELECT run_id, CAST(rule AS INT) AS rule, kind, bypassed,
   CASE WHEN bypassed THEN 'bypass' WHEN rule IS NOT NULL THEN 'rule' ELSE kind END AS branch FROM routed"""


def plain_lines_sql(runs: str, lines: str) -> str:
    return f"SELECT l.* FROM ({profiled_sql(runs, lines)}) l WHERE text <> '' AND NOT {suppressed('text')}"


def compact_ctes(runs: str, lines: str) -> str:
    """CTEs ending in ``capped`` (plain and bypassed runs) and ``rules_out``."""
    return f"""WITH routes AS ({routes_sql(runs, lines)}),
{place_ctes(plain_lines_sql(runs, lines) + " AND run_id IN (SELECT run_id FROM routes WHERE branch = 'plain')")},
{FOLD_CTES}, {BLOCK_CTES},
compacted AS (SELECT run_id, pos, text FROM folded UNION ALL SELECT run_id, pos, text FROM blocks
   UNION ALL SELECT run_id, line_no * 2, text FROM ({lines}) l WHERE run_id IN (SELECT run_id FROM routes WHERE branch = 'bypass')),
{caps_ctes('compacted')},
{rules_ctes("SELECT run_id, rule FROM routes WHERE branch = 'rule'", lines)}"""


def history_sql(ctes: str, runs: str, lines: str) -> str:
    return f"""{ctes}, raw AS (SELECT run_id, sum(strlen(text) + 1) AS n FROM ({lines}) l GROUP BY run_id),
    kept AS (SELECT run_id, sum(strlen(text) + 1) AS n FROM output_lines GROUP BY run_id)
    SELECT r.run_id, command AS cmd, args, CAST(raw.n AS BIGINT) AS raw_bytes, CAST(coalesce(kept.n, 0) AS BIGINT) AS filtered_bytes,
    CAST(greatest(raw.n // 4 - coalesce(kept.n, 0) // 4, 0) AS BIGINT) AS saved_tokens, routes.bypassed
    FROM ({runs}) r JOIN raw USING (run_id) LEFT JOIN kept USING (run_id) JOIN routes USING (run_id)"""


PLAIN_LINES = plain_lines_sql(A.USER_RUNS, A.USER_LINES)
ROUTES = routes_sql(A.USER_RUNS, A.USER_LINES)
COMPACT_CTES = f"""{compact_ctes(A.USER_RUNS, A.USER_LINES)},
output_lines AS (SELECT run_id, pos AS place, text FROM capped UNION ALL SELECT run_id, pos, text FROM rules_out)"""

# Runs of every format: all six branches, and the whole place of a line.
MIXED_ROUTES = routes_sql(A.MIXED_RUNS, A.MIXED_LINES)


def _of_branch(branch: str) -> str:
    return f"SELECT run_id, line_no, text FROM ({A.MIXED_LINES}) l WHERE run_id IN (SELECT run_id FROM routes WHERE branch = '{branch}')"


MIXED_CTES = f"""{compact_ctes(A.MIXED_RUNS, A.MIXED_LINES)},
output_lines AS (SELECT run_id, pos AS a, 0 AS b, 0 AS c, 0 AS d, text FROM capped
   UNION ALL SELECT run_id, pos, 0, 0, 0, text FROM rules_out
   UNION ALL SELECT * FROM ({test_summary_sql(_of_branch('ndjson'))}) e
   UNION ALL SELECT * FROM ({tap_summary_sql(_of_branch('tap'))}) t
   UNION ALL SELECT * FROM (SELECT run_id * 4 + 3 AS run_id, a, b, c, d, text FROM ({JUNIT_SUMMARY}) s) j
      WHERE run_id IN (SELECT run_id FROM routes WHERE branch = 'junit'))"""
