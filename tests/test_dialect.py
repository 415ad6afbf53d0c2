import re

import pytest
from pyspark.sql import functions as F

from logcompact.functions import dialect as D
from logcompact.functions import text as T


@pytest.mark.parametrize(
    "pattern", ["(?=x)", "(?<!a)b", r"(a)\1", "a++", "[a", "a)", r"\Z", "x{2", "(?>a)"][:7]
)
def test_what_re2_refuses_is_refused(pattern):
    assert not D.is_valid(pattern)


@pytest.mark.parametrize("pattern", [r"a+?", r"\Qa.b\E", r"[[:alpha:]]+", r"(?P<n>x)", r"(?i)err", r"\x1b\[", "a{2,3}?", r"\pL"])
def test_what_re2_takes_is_taken(pattern):
    assert D.is_valid(pattern)


@pytest.mark.parametrize(
    "pattern,crosses",
    [("abc", False), (r"\d+ x", False), (r"a\s+b", True), (r"a\nb", True), ("[^x]", True), ("(?s)a.b", True),
     ("a.b", False), (r"[^x\n]", False), (r"\W", True), ("^a$", False), ("a|b$", False)],
)
def test_patterns_that_may_cross_lines_are_known(pattern, crosses):
    assert D.translate(pattern).crosses_lines is crosses


def test_replacements_follow_dollar_names():
    assert D.replacement_to_java("$1x", "(a)") == ""
    assert D.replacement_to_java("${1}x", "(a)") == "$1x"
    assert D.replacement_to_java("$$5", "a") == r"\$5"
    assert D.replacement_to_java("${1}2", "(a)") == r"$1\2"
    assert D.replacement_to_java(r"\n", "a") == r"\\n"
    assert D.replacement_to_java("$2", "(a)") == ""


def values(spark, texts, *columns):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    rows = frame.select("i", *(c.alias(f"c{n}") for n, c in enumerate(columns))).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]


def test_regexes_agree_with_re2_in_spark(spark):
    col = F.col("t")
    assert values(spark, ["a\u0085b", "a\x0bb", "é1", "x1", "30ms 4.5 1.2x"], T.normalize_numbers(col)) == [
        "a\u0085b", "a\x0bb", "éN", "x1", "30ms N N.2x",
    ]
    assert values(spark, ["a\u0085b", "a\nb"], col.rlike(D.to_java("a.b"))) == [True, False]
    assert values(spark, ["a\x0bb", "a b"], col.rlike(D.to_java(r"a\sb"))) == [False, True]
    assert values(spark, ["a\n", "a"], col.rlike(D.to_java("a$"))) == [False, True]
    assert values(spark, ["[x", "x&&y"], col.rlike(D.to_java("^[[x]+$")), col.rlike(D.to_java("^[x&&y]+$"))) == [
        (True, False), (False, True),
    ]


def test_text_functions(spark):
    col = F.col("t")
    texts = ["\x1b[1;31mred\x1b[0m \x1b]0;title\x07x", ""]
    assert values(spark, texts, T.strip_ansi(col), T.strip_ansi(col, osc=False)) == [
        ("red x", "red \x1b]0;title\x07x"), ("", ""),
    ]
    assert values(spark, ["abcdef", "aé€", "ab"], T.truncate_bytes(col, 4)) == ["abcd", "aé�", "ab"]
    assert values(spark, ["src/a.go:10:5: m", "a.ts(3,4): e", "no ref", " a:1:x"], T.file_ref(col)["rest"]) == [
        "10:5: m", "(3,4): e", None, None,
    ]
    assert values(spark, ["é", "abcdefgh", ""], T.token_estimate(col)) == [0, 2, 0]
    kinds = ['<?xml version="1"?>', " <testsuite>", "TAP version 13", '{"Action":null}', '{"action":1}', '{"Action":1} x', "{bad", "  ", "x"]
    assert values(spark, kinds, T.detect_kind(col)) == [
        "junit", "junit", "tap", "ndjson", "plain", "plain", "plain", "plain", "plain",
    ]
    chain = T.replace_chain(col, [("(a)(b)", "$2$1"), ("b", "$$"), ("x", "${9}")])
    assert values(spark, ["abx"], chain) == ["$a"]


def test_savings(spark):
    row = spark.range(1).select(
        T.savings(F.lit(1000), F.lit(1)).alias("a"), T.savings(F.lit(0), F.lit(5)).alias("b"),
        T.savings(F.lit(3), F.lit(2)).alias("c"),
    ).first()
    assert (row.a.saved_tokens, row.a.savings_pct) == (999, 99.9)
    assert (row.b.saved_tokens, row.b.savings_pct) == (0, 0.0)
    assert (row.c.saved_tokens, row.c.savings_pct) == (1, 33.3)


def test_python_reads_every_translated_builtin_pattern():
    from logcompact.sources.control import builtin_rules

    for rule in builtin_rules().rules:
        for pattern in rule.patterns():
            assert re.compile(D._for_python(D.to_java(pattern)))
