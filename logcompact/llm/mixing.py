"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logcompact.llm.common import WORD, ranked, text_or_empty
from logcompact.session import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source its share of all words: by weight, at most `most` times its own, the excess shared out again.

    `sources` (source, source_size) is staged. Weights repeat in code-point order, null last. The share of a unit of weight
    rises until no further source meets its limit; each step is one aggregate of one row.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.pmod(place, F.lit(len(weights)))
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    limit = most * F.col("source_size")
    unit = 0.0
    while True:
        full = F.col("weight") * F.lit(unit) >= limit
        x = rows.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, limit).otherwise(0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not x["open"]:
            break
        step = (x["total"] - x["fixed"]) / x["open"]
        if step <= unit:
            break
        unit = step
    target = F.least(F.col("weight") * F.lit(unit), limit.cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def offsets(seed: int):
    """One offset in [0, 1) for each source, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\x00"))), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """How many words of every row the mix takes: each row appears once per whole number its prefix sum crosses.

    All rows of a source have the same expected copies (target / source_size), so the prefix sum of the row of rank r
    is (r + 1) times that; a row's copies are the whole numbers between the sums before and after it, shifted by one
    offset of its source. Ranks follow the size, which makes the taken words miss the target by about one document
    at most. Ranks are counted over range-partitioned rows, so a hot source spreads over all tasks.

    Null text has size 0, null source is a source. Sources without words have target 0 and nothing is taken. Repeated
    rows count each. Reruns agree, since order and offsets depend on the data only. Columns other than doc_id, text and
    source are not read. Returns doc_id, size, source, source_size, target, copies, taken.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size")
    rows = scratch.write(docs.select("doc_id", F.col("source").cast("string").alias("source"), size), "sizes")
    sources = scratch.write(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = scratch.write(source_targets(sources, weights, most), "targets")
    found = ranked(rows, ["source"], ["size", "doc_id"], scratch, "rank")
    scratch.drop(rows, sources)
    found = found.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most))))
    rate = F.coalesce(rate, F.lit(0.0))
    crossed = lambda n: F.floor(n * rate + offsets(seed))
    copies = crossed(F.col("rank") + 1) - crossed(F.col("rank"))
    return found.select(
        "doc_id", "size", "source", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
