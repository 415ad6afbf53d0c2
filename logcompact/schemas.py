"""Schemas of the tables the operators read and write."""

RUNS = (
    "run_id BIGINT, ts TIMESTAMP, command STRING, args STRING, "
    "exit_code INT, exec_ms BIGINT, no_filter BOOLEAN"
)

LINES = "run_id BIGINT, line_no BIGINT, is_err BOOLEAN, text STRING"

HISTORY = (
    "ts TIMESTAMP, cmd STRING, args STRING, raw_bytes BIGINT, filtered_bytes BIGINT, "
    "raw_tokens BIGINT, filtered_tokens BIGINT, saved_tokens BIGINT, savings_pct DOUBLE, "
    "exec_ms BIGINT, bypassed BOOLEAN, exact_tokens BOOLEAN"
)

RULES = (
    "priority INT, source STRING, name STRING, match_command STRING, strip_ansi BOOLEAN, "
    "replace ARRAY<STRUCT<pattern: STRING, replacement: STRING>>, "
    "match_output ARRAY<STRUCT<pattern: STRING, message: STRING, unless: STRING>>, "
    "strip_lines ARRAY<STRING>, keep_lines ARRAY<STRING>, "
    "truncate_at INT, max_lines INT, tail_lines INT, on_empty STRING"
)

RULE_TESTS = "rule STRING, name STRING, input STRING, expected STRING"

PROJECT_RULES = "match STRING, action STRING"
