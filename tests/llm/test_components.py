import random

from logcompact.llm.components import components
from logcompact.session import Scratch


def test_chains_stars_and_cycles(spark):
    pairs = [(k, k + 1) for k in range(1, 40)] + [(100, 200 + k) for k in range(30)] + [(301, 300), (302, 301), (300, 302)]
    random.Random(1).shuffle(pairs)
    rows = [*pairs, (7, 7), (None, 5), (500, None), (500, 501), (501, 500)]
    links = spark.createDataFrame(rows, "a long, b long")
    found = {r["node"]: r["component"] for r in components(links, Scratch(spark, "t")).collect()}
    assert found == (
        dict.fromkeys(range(1, 41), 1) | dict.fromkeys([100, *range(200, 230)], 100) | dict.fromkeys([300, 301, 302], 300)
        | dict.fromkeys([500, 501], 500)
    )


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
