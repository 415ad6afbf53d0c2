import pytest
from pyspark.sql import functions as F

from logcompact.functions.dialect import UnsupportedPattern, to_java, translate

CASES = [  # pattern, text, what the first match is
    (r"\p{Greek}+", "abc αβγ", "αβγ"), (r"[\p{Greek}x]+", "abc xαβ", "xαβ"), (r"\P{Greek}+", "αb1", "b1"),
    (r"\p{^Greek}+", "αb1", "b1"), (r"\P{^Greek}+", "bα", "α"), (r"\pL+", "12ab", "ab"), (r"\p{Lu}+", "abCD", "CD"),
    (r"(?U)a+", "aaa", "a"), (r"(?U)a+?", "aaa", "aaa"), (r"(?U)a{1,3}", "aaa", "a"), (r"(?U:a+)b*", "aabb", "a"),
    (r"(a+(?U)b+)c*", "aabbcc", "aab"), (r"(?iU)A+", "aa", "a"), (r"x*(?-U)y+", "xyy", "xyy"),
    (r"(?m)^b", "a\nb", "b"), (r"(?m)\Ab", "a\nb", ""), (r"(?m)a\z", "a\nb", ""), (r"(?m)b\z", "a\nb", "b"), (r"\Aa", "ab", "a"),
]


def test_matches(spark):
    text = spark.createDataFrame([(k, c[1]) for k, c in enumerate(CASES)], "k int, text string")
    chosen = F.lit(None).cast("string")
    for k, (pattern, _, _) in enumerate(CASES):
        chosen = F.when(F.col("k") == k, F.regexp_extract("text", to_java(pattern), 0)).otherwise(chosen)
    found = {r["k"]: r["m"] for r in text.select("k", chosen.alias("m")).collect()}
    assert [found[k] for k in range(len(CASES))] == [c[2] for c in CASES]


def test_unknown_names_are_refused(spark):
    for pattern in (r"\p{Nonsense}", r"[\p{Grekish}]", r"\p{x"):
        with pytest.raises(UnsupportedPattern):
            translate(pattern)


def test_ends_of_the_text_need_the_text():
    assert translate(r"(?m)\Aa").crosses_lines and translate(r"(?m)a\z").crosses_lines
    assert not translate(r"\Aa\z").crosses_lines and translate(r"\Aa\z").anchored
