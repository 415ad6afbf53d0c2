"""Sharding by longest processing time: whole groups to the least loaded shard."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logcompact.llm.common import ranked, text_or_empty
from logcompact.session import Scratch

#: Groups within 2^(1/128) of each other in bytes are dealt together; a long has at most 63 * 128 such classes.
CLASSES_PER_DOUBLING = 128


def deal(load: list[float], size: float, n: int) -> list[int]:
    """How many of `n` items of one size each shard gets, as if each item in turn went to the least loaded one.

    The level below which every shard is surely filled is found by halving; the few items left go through the heap.
    """
    lo, hi = min(load), min(load) + size * (n + 1)
    filled = lambda level: [max(0, math.floor((level - x) / size)) for x in load]
    while hi - lo > size / 4:
        middle = (lo + hi) / 2
        lo, hi = (middle, hi) if sum(filled(middle)) <= n else (lo, middle)
    got = filled(lo)
    heap = [(x + k * size, s) for s, (x, k) in enumerate(zip(load, got, strict=True))]
    heapq.heapify(heap)
    for _ in range(n - sum(got)):
        level, s = heapq.heappop(heap)
        got[s] += 1
        heapq.heappush(heap, (level + size, s))
    return got


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(class, first rank, end, shard) for size classes (class, groups, bytes), largest sizes first."""
    load, out = [0.0] * shards, []
    for name, n, total in sorted(classes, reverse=True):
        at = 0
        for s, k in enumerate(deal(load, max(total / n, 1e-9), n)):
            if k:
                out.append((name, at, at + k, s))
                load[s] += k * total / n
                at += k
    return out


def shard_groups(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row's shard: rows of equal text stay together, and shards get nearly the same bytes.

    Groups are put in classes of nearly equal size. The driver reads one row per class (8,064 at most, whatever the
    data), deals the classes in descending size through a heap of shard loads, and sends back ranges of ranks. Ranks
    within a class are counted over range-partitioned groups in an order by hash, so each range is an even sample of its
    class. Shards differ by about the largest group, which cannot be split.

    Size is the text's UTF-8 bytes plus 1, a null text 1. Null and empty texts are two groups. Repeated rows are rows
    of one group. Returns doc_id, size, text_crc32 (0 for null and empty), law, shard, slot (rank in the shard by doc_id), grown_shard.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.encode(text_or_empty(), "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(F.col("text").cast("string"), 256)), F.lit(b"")).alias("_text_id"),
    )
    rows = scratch.write(rows, "rows")
    groups = rows.groupBy("_text_id").agg(F.sum("size").alias("_bytes"))
    step = F.floor(F.log2(F.col("_bytes")) * CLASSES_PER_DOUBLING).cast("int")
    groups = scratch.write(groups.withColumn("_class", step), "groups")
    classes = groups.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("b")).collect()
    ranges = schedule([(r["_class"], r["n"], r["b"]) for r in classes], shards)
    table = spark.createDataFrame(ranges, "c int, lo long, hi long, shard int")
    places = ranked(groups, ["_class"], ["_text_id"], scratch, "_rank").join(
        F.broadcast(table), (F.col("_class") == F.col("c")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    )
    placed = rows.join(places.select("_text_id", "shard"), "_text_id").drop("_text_id")
    placed = scratch.write(placed, "placed")
    scratch.drop(rows, groups)
    return ranked(placed, ["shard"], ["doc_id"], scratch, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
