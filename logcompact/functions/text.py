"""Expressions over one line of text. All are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logcompact.functions.dialect import replacement_to_java, to_java

# The white space that trimming removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Terminal control sequences, numbers and file references.
CSI = r"\x1b\[[0-9;]*[a-zA-Z]"
OSC = r"\x1b\][^\x07]*\x07"
NUMBER = r"\b\d+(\.\d+)?\b"
# The same with its word edges, which always lie at a digit, written as one look each.
NUMBER_AT_EDGES = r"(?<![A-Za-z0-9_])\d+(?:\.\d+)?(?![A-Za-z0-9_])"
FILE_REF = r"^([^:\s][^:\n]*?)(?::(\d+)|\((\d+),\d+\))[:\s]"


def trim_space(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def strip_ansi(col: Column, osc: bool = True) -> Column:
    """Remove colour and cursor codes; ``osc`` also removes operating-system commands."""
    # Only a line with an escape character pays for the regular expression.
    cleaned = F.regexp_replace(col, to_java(f"{CSI}|{OSC}" if osc else CSI), "")
    return F.when(col.contains("\x1b"), cleaned).otherwise(col)


def normalize_numbers(col: Column) -> Column:
    """Replace every whole-word number by ``N``; ``30ms`` is one word and stays."""
    return F.regexp_replace(col, NUMBER_AT_EDGES, "N")


def replace_chain(col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) pairs in order, each to the result of the one before."""
    for pattern, replacement in rules:
        col = F.regexp_replace(
            col, F.lit(to_java(pattern)), F.lit(replacement_to_java(replacement, pattern))
        )
    return col


def truncate_bytes(col: Column, n: Column | int) -> Column:
    """Cut text longer than n bytes; a code point cut in two becomes U+FFFD. n <= 0 keeps all."""
    n = n if isinstance(n, Column) else F.lit(n)
    cut = F.make_valid_utf8(F.substring(col.cast("binary"), F.lit(1), n.cast("int")))
    return F.when((n > 0) & (F.octet_length(col) > n), cut).otherwise(col)


def words(col: Column) -> Column:
    """White-space separated fields; the empty text has none."""
    parts = F.split(trim_space(col), f"[{WHITE_SPACE}]+")
    return F.filter(parts, lambda word: word != "")


def ls_name(col: Column) -> Column:
    """The name at the end of a long directory listing line: its fields from the ninth on."""
    fields = words(col)
    return F.when(
        F.size(fields) >= 9, F.array_join(F.slice(fields, F.lit(9), F.size(fields)), " ")
    ).otherwise(col)


def file_ref(col: Column) -> Column:
    """Struct (file, rest) of a line that starts with ``path:LINE`` or ``path(LINE,COL)``; else null."""
    file = F.regexp_extract(col, to_java(FILE_REF), 1)
    rest = F.substring(col, F.char_length(file) + 1, F.char_length(col))
    return F.when(file != "", F.struct(file.alias("file"), F.ltrim(rest, F.lit(":")).alias("rest")))


def file_of(col: Column) -> Column:
    """The file of a line, or the empty text when it refers to none."""
    # A reference needs a digit after a colon or bracket, so most lines skip the expression.
    return F.when(
        col.contains(":") | col.contains("("), F.regexp_extract(col, to_java(FILE_REF), 1)
    ).otherwise("")


def rest_after(col: Column, file: Column) -> Column:
    tail = F.substring(col, F.char_length(file) + 1, F.char_length(col))
    return F.ltrim(tail, F.lit(":"))


def token_estimate(col: Column) -> Column:
    """About one token per four bytes of UTF-8."""
    return F.floor(F.octet_length(col) / 4)


def tokens_of_bytes(n_bytes: Column) -> Column:
    return F.floor(n_bytes / 4)


def saved_tokens(raw: Column, filtered: Column) -> Column:
    return F.greatest(raw - filtered, F.lit(0).cast("bigint"))


def savings_pct(raw: Column, filtered: Column) -> Column:
    """Percent saved with one decimal; zero when there was nothing to save."""
    share = saved_tokens(raw, filtered).cast("double") / raw.cast("double")
    return F.when(raw > 0, F.floor(share * 1000 + 0.5) / 10.0).otherwise(F.lit(0.0))


def savings(raw: Column, filtered: Column) -> Column:
    return F.struct(
        saved_tokens(raw, filtered).alias("saved_tokens"),
        savings_pct(raw, filtered).alias("savings_pct"),
    )


def summary_text(kind: Column, n: Column, sample: Column) -> Column:
    """Render a marker row: what was folded away, how often, and a sample of it."""
    count = n.cast("string")
    return (
        F.when(kind == "repeated", F.concat(F.lit("["), count, F.lit(" times]: "), sample))
        .when(
            kind == "ok",
            F.when(n == 1, sample).otherwise(F.concat(F.lit("["), count, F.lit(" ok lines]"))),
        )
        .when(kind == "grep_omitted", F.concat(F.lit("["), count, F.lit(" more search hits]")))
        .when(kind == "frames_omitted", F.concat(F.lit("["), count, F.lit(" more frames]")))
        .when(kind == "file", F.concat(sample, F.lit(": "), count, F.lit(" errors")))
        .otherwise(sample)
    )


def is_json_object(col: Column) -> Column:
    """True for text that is one JSON object and nothing else."""
    text = trim_space(col)
    # Parsed inside an array, because the parser stops at the end of the first value.
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    second = F.try_variant_get(parsed, "$[1]", "variant")
    return text.startswith("{") & text.endswith("}") & parsed.isNotNull() & second.isNull()


def detect_kind(first_line: Column) -> Column:
    """Report format of a run, told from its first line: junit, tap, ndjson or plain."""
    text = trim_space(F.coalesce(first_line, F.lit("")))
    has_action = F.array_contains(F.json_object_keys(text), "Action")
    return (
        F.when(text.startswith("<?xml") | text.startswith("<testsuite"), "junit")
        .when(text.startswith("TAP version"), "tap")
        .when(
            F.when(text.startswith("{"), is_json_object(text) & has_action).otherwise(False),
            "ndjson",
        )
        .otherwise("plain")
    )
