"""Nearest vectors by inner product: vantage-point trees per shard, pruned by a relaxed triangle inequality."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logcompact.llm.common import parallelism
from logcompact.llm.vantage import Nearest, Shard
from logcompact.session import Scratch

#: Distinct vectors of a shard, queries of a block, and most shards that one task searches one after another.
SHARD, QUERIES, TOGETHER = 8192, 4096, 8
#: Queries of a block that are searched exactly to set the factor, the share of their results to be kept, the largest factor.
AUDITED, RECALL, LOOSEST = 48, 0.96, 64.0


def fitted_factor(shards: list[Shard], queries: np.ndarray, k: int, recall: float) -> float:
    """The largest factor with which the audited queries keep `recall` of their exact results.

    An exact search tells every result's leaf, and by what factor its bound could grow until it passes the distance of the
    k-th. The factor that keeps the wanted share is tried, and brought closer to 1 until the share is really kept.
    """
    some = queries[np.unique(np.linspace(0, len(queries) - 1, min(len(queries), AUDITED)).astype(np.int64))]
    exact = Nearest(some, k)
    for number, shard in enumerate(shards):
        exact.search(shard, number, 1.0)
    q, place = np.nonzero(exact.point >= 0)
    number, member = exact.point[q, place] >> 32, exact.point[q, place] & 0xFFFFFFFF
    room = np.full(len(q), np.inf)
    above = np.concatenate([some, np.zeros((len(some), 1))], axis=1)
    for k_, shard in enumerate(shards):
        own = number == k_
        if own.any():
            leaf_of = np.empty(len(shard.points), dtype=np.int64)
            leaf_of[shard.tree.order] = np.repeat(np.arange(len(shard.tree.first) - 1), np.diff(shard.tree.first))
            bound = shard.tree.bounds(shard.lifted, above)[q[own], leaf_of[member[own]]]
            room[own] = exact.limit(shard.longest)[q[own]] / np.maximum(bound, 1e-300)
    if not len(room):
        return 1.0
    factor = float(np.clip(np.quantile(room, 1 - recall, method="lower"), 1.0, LOOSEST))
    wanted = {(a, b) for a, b in zip(q.tolist(), exact.point[q, place].tolist(), strict=True)}
    while factor > 1.0:
        tried = Nearest(some, k)
        for number, shard in enumerate(shards):
            tried.search(shard, number, factor)
        a, b = np.nonzero(tried.point >= 0)
        kept = len(wanted & set(zip(a.tolist(), tried.point[a, b].tolist(), strict=True)))
        if kept >= recall * len(wanted):
            break
        factor = 1.0 if factor < 1.02 else factor**0.8
    return factor


def search_block(shards: list[Shard], own: np.ndarray, queries: np.ndarray, k: int, factor: float | None, recall: float):
    """(query's place, vec_id, score) of each query's k best ids other than its own, from shards searched in turn."""
    # one more than k, as the query's own vector may be among them
    factor = fitted_factor(shards, queries, k + 1, recall) if factor is None else factor
    found = Nearest(queries, k + 1)
    for number, shard in enumerate(shards):
        found.search(shard, number, factor)
    out: list[tuple[int, int, float]] = []
    for q in range(len(queries)):
        rows = []
        for point, score in zip(found.point[q].tolist(), found.score[q].tolist(), strict=True):
            if point >= 0:
                rows += [(-score, i) for i in shards[point >> 32].ids[point & 0xFFFFFFFF] if i != own[q]]
        rows.sort()
        out += [(q, i, -s) for s, i in rows[:k]]
    return out


def nearest_vectors(
    vectors: DataFrame, is_query: Column, k: int = 20, factor: float | None = None, recall: float = RECALL, shard: int = SHARD,
    block: int = QUERIES, together: int = TOGETHER,
) -> DataFrame:
    """The k nearest vectors of each query by inner product, among all rows but those of the query's own vec_id.

    `is_query` is a condition on vec_id. Equal vectors are one point with its k + 1 smallest ids (more can't be among k
    results), so copies cost nothing, however many. Points are dealt into shards of about `shard` by a hash, and each shard's
    tree is built once and stored. In a space with one more component, where all points of a shard have one length, the
    largest product is the least distance, so the triangle inequality bounds what a leaf can hold. Every query is searched in every
    shard: a block of queries meets up to `together` shards in one task, each shard beginning with the limits of those before.

    A leaf is left out when `factor` times its bound passes the limit. Factor 1 is exact. None fits the factor in each task: at most
    48 queries of the block, spread evenly, are searched exactly, and the factor is the largest with which they keep
    `recall` of their results, 1 if it must be.

    The work is queries x vectors, less what is pruned; (queries / block) x (vectors / shard) pairs of a block and a tree
    move between tasks, and k rows a query and `together` shards.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without vec_id, take no part. Vectors meet
    only those of their own length. Rows that repeat a vec_id and vector count once; a vec_id with several vectors is
    several queries. Ties go to the smaller vec_id. Fewer than k candidates give all; an empty table gives none. Products
    beyond the range of doubles are infinite. Columns other than vec_id and embedding are not read. Returns query_id, rank (from 1),
    vec_id, score (the product in doubles, added from the first component to the last).
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    numbers = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0 becomes 0
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("v")).where("vec_id IS NOT NULL")
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    rows = scratch.write(rows.groupBy("vec_id", "v").agg(F.size(F.first("v")).alias("d")), "rows")

    lowest = Window.partitionBy("v").orderBy("vec_id")
    points = rows.withColumn("_n", F.row_number().over(lowest)).where(F.col("_n") <= k + 1)
    points = points.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.size(F.first("v")).alias("d"))
    points = scratch.write(points, "points")
    sizes = points.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    asked = rows.where(is_query).withColumn("row", F.monotonically_increasing_id())
    blocks = asked.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    plan = scratch.write(sizes.join(blocks, "d"), "plan")
    most = plan.agg(F.max("shards"), F.max("blocks")).first()
    # few shards are spread over tasks rather than put together
    together = max(1, min(together, (most[0] or 0) * (most[1] or 0) // parallelism(spark)))
    plan = plan.withColumn("groups", F.ceil(F.col("shards") / together).cast("int"))

    def flat(table: pa.Table, d: int) -> np.ndarray:
        return table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)

    def build(table: pa.Table) -> pa.Table:
        ids, d = table.column("ids").to_pylist(), table.column("d")[0].as_py()
        order = sorted(range(len(ids)), key=lambda x: ids[x][0])
        made = Shard(flat(table, d)[order], [ids[x] for x in order])
        return table.select(["d", "shard", "blocks", "groups"])[:1].append_column("data", pa.array([made.dump()], pa.binary()))

    dealt = points.join(plan, "d").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    trees = dealt.select("d", "shard", "blocks", "groups", "ids", "v").groupBy("d", "shard")
    trees = scratch.write(trees.applyInArrow(build, "d int, shard int, blocks int, groups int, data binary"), "trees")

    def gather(table: pa.Table) -> pa.Table:
        out, d = io.BytesIO(), table.column("d")[0].as_py()
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        np.savez(out, own=table.column("vec_id").to_numpy()[order], row=table.column("row").to_numpy()[order], v=flat(table, d)[order])
        return table.select(["d", "block", "groups"])[:1].append_column("data", pa.array([out.getvalue()], pa.binary()))

    asked = asked.join(plan, "d").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asked = asked.select("d", "block", "groups", "vec_id", "row", "v").groupBy("d", "block")
    asked = scratch.write(asked.applyInArrow(gather, "d int, block int, groups int, data binary"), "queries")

    left = asked.select("d", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "data")
    right = trees.select(
        "d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod("shard", "groups").alias("group"), "shard", "data"
    )

    def meet(queries: pa.Table, trees: pa.Table) -> pa.Table:
        if not len(queries) or not len(trees):
            found, own, row = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            with np.load(io.BytesIO(queries.column("data")[0].as_py())) as x:
                own, row, v = x["own"], x["row"], x["v"]
            order = np.argsort(trees.column("shard").to_numpy())
            shards = [Shard.load(trees.column("data")[int(i)].as_py()) for i in order]
            found = search_block(shards, own, v, k, factor, recall)
        at = np.array([q for q, _, _ in found], dtype=np.int64)
        return pa.table({
            "row": row[at], "query_id": own[at], "vec_id": np.array([i for _, i, _ in found], dtype=np.int64),
            "score": np.array([s for _, _, s in found], dtype=float),
        })

    found = left.groupBy("d", "block", "group").cogroup(right.groupBy("d", "block", "group"))
    found = scratch.write(found.applyInArrow(meet, "row long, query_id long, vec_id long, score double"), "found")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
