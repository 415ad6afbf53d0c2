"""Near-duplicate embeddings: a graph index per shard, every shard searched for every vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcompact.llm.components import components
from logcompact.llm.hnsw import Graph
from logcompact.session import Scratch

COSINE = 0.98
#: Vectors of one shard; points compared with all of their shard to measure recall, and what recall must reach.
SHARD, AUDITED, RECALL = 8192, 128, 0.98
FIRST_BEAM, LAST_BEAM, AT_ONCE = 16, 128, 512


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _pairs(queries: np.ndarray, points: np.ndarray, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All links of some queries, by comparing them with every point of the shard."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(rows), AT_ONCE):
        block = rows[at : at + AT_ONCE]
        q, p = np.nonzero(queries[block] @ points.T >= least)
        found.append((block[q], p))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shard_links(graph: Graph, points: np.ndarray, queries: np.ndarray, least: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) links of cosine `least` or more that a search of the graph finds.

    The beam is doubled until an audit passes: for evenly spread queries, the links found are held against those of a
    comparison with all points. A query whose beam is full of links may have more, so its beam is widened too;
    those still full at LAST_BEAM are compared with the whole shard, which is bounded. If the audit fails even at LAST_BEAM, all are.
    """
    n = len(queries)
    audited = np.unique(np.linspace(0, n - 1, min(n, AUDITED)).astype(np.int64))
    todo, done, beam = np.arange(n), [], FIRST_BEAM
    single = queries.astype(np.float32)
    while True:
        pairs, full = [], []
        for at in range(0, len(todo), AT_ONCE):
            rows = todo[at : at + AT_ONCE]
            start = graph.descend(single[rows], 0)
            ids, sims = graph.search(single[rows], start[:, None], 0, beam)
            q, k = np.nonzero(sims >= least - 1e-4)
            p = ids[q, k]
            sure = np.einsum("kd,kd->k", queries[rows[q]], points[p]) >= least
            full.append(rows[(sims >= least - 1e-4).all(axis=1) & (ids >= 0).all(axis=1)])
            pairs.append((rows[q[sure]], p[sure]))
        q, p = (np.concatenate(x) for x in zip(*pairs, strict=True))
        full = np.concatenate(full)
        whole = ~np.isin(q, full)
        good = np.isin(audited, todo) & ~np.isin(audited, full)
        want = len(_pairs(queries, points, audited[good], least)[0]) if good.any() else 0
        got = np.isin(q[whole], audited[good]).sum()
        if want and got < RECALL * want:
            if beam >= LAST_BEAM:
                return _without_self(*_pairs(queries, points, np.arange(n), least), own)
            beam *= 2
            continue
        done.append((q[whole], p[whole]))
        if beam >= LAST_BEAM or not len(full):
            done.append(_pairs(queries, points, full, least))
            return _without_self(*(np.concatenate(x) for x in zip(*done, strict=True)), own)
        todo, beam = full, beam * 2


def _without_self(q: np.ndarray, p: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    keep = q != p if own else np.ones(len(q), dtype=bool)
    return q[keep], p[keep]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest point that links join each of n points to, by spreading minima over the links."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def near_duplicates(vectors: DataFrame, least: float = COSINE, shard: int = SHARD) -> DataFrame:
    """Links of vectors with one label and cosine `least` or more, counted, and joined to components.

    Equal vectors of one label are one class with a count, so copies cost nothing, however many. Classes are dealt into
    shards of about `shard` by a hash. Each shard becomes one row with its vectors; a pair of shards of one label is one
    task's work at a time: it builds the graph of the one, searches it for the vectors of the other, widening the beam
    until an audit against all of the shard passes, and verifies each cosine in double precision. What leaves the task is
    a count per vector and a link to the smallest vector of its local component, so groups of copies never appear as pairs.
    Spark adds the counts and joins the components.

    A label of n vectors makes (n / shard)^2 / 2 pairs of shards; that is the method's cost, spread over tasks.

    Null labels, null, empty and zero vectors and ones with null or non-finite components link with nothing: n_links 0, their own
    component, kept. Vectors of different lengths don't link. Rows that repeat a vec_id are rows of their own: copies of one vector
    link with each other. A null vec_id counts as a copy but names no component unless all are null. Columns other than
    vec_id, embedding and label are not read. Returns vec_id, n_links, component_id, kept.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), numbers.alias("v"))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0)
    rows = scratch.write(rows.withColumn("usable", F.coalesce(usable, F.lit(False))), "rows")
    # adding 0 makes -0 and 0 the same component
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    classes = rows.where("usable").groupBy("label", F.size("v").alias("d"), "v").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")
    )
    classes = scratch.write(classes.withColumn("key", F.xxhash64("label", "v")), "classes")
    counts = classes.groupBy("label", "d").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = classes.join(counts.withColumnsRenamed({"label": "_l", "d": "_d"}), F.col("label").eqNullSafe(F.col("_l")) & (F.col("d") == F.col("_d")))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        d = table.column("d")[0].as_py()
        flat = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)[order]
        return pa.table({
            "label": table.column("label")[:1], "d": table.column("d")[:1], "shard": table.column("shard")[:1],
            "shards": table.column("shards")[:1], "keys": [key[order].tobytes()],
            "copies": [table.column("copies").to_numpy()[order].tobytes()], "vectors": [unit(flat).tobytes()],
        })

    label = dict(classes.dtypes)["label"]
    schema = f"label {label}, d int, shard int, shards int, keys binary, copies binary, vectors binary"
    parts = dealt.select("label", "d", "shard", "shards", "key", "copies", "v").groupBy("label", "d", "shard")
    parts = scratch.write(parts.applyInArrow(build, schema), "shards")
    # pairs (i, j) with i up to j: the one row of i and the one row of j
    left = parts.select("*", F.explode(F.sequence("shard", F.col("shards") - 1)).alias("other")).withColumnRenamed("shard", "i").withColumnRenamed("other", "j")
    right = parts.select("*", F.explode(F.sequence(F.lit(0), "shard")).alias("i")).withColumnRenamed("shard", "j")

    def open_row(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = table.column("d")[0].as_py()
        keys, copies, flat = (np.frombuffer(table.column(c)[0].as_py(), t) for c, t in (("keys", np.int64), ("copies", np.int64), ("vectors", float)))
        return keys, copies, flat.reshape(-1, d)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        own = a.column("i")[0].as_py() == a.column("j")[0].as_py()
        (qk, qc, queries), (pk, pc, points) = open_row(a), open_row(b)
        q, p = shard_links(Graph(points), points, queries, least, own)
        links_q = np.bincount(q, pc[p], len(qk)).astype(np.int64)
        if own:
            joined = roots(len(pk), q, p)
            keys, links, root = qk, links_q, qk[joined]
        else:
            joined = roots(len(qk) + len(pk), q, len(qk) + p)
            keys = np.concatenate([qk, pk])
            links = np.concatenate([links_q, np.bincount(p, qc[q], len(pk)).astype(np.int64)])
            root = keys[joined]
        some = links > 0
        return pa.table({"key": keys[some], "links": links[some], "root": root[some]})

    found = left.groupBy("label", "d", "i", "j").cogroup(right.groupBy("label", "d", "i", "j"))
    found = scratch.write(found.applyInArrow(search, "key long, links long, root long"), "links")
    groups = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), scratch)
    more = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.select("key", "label", "v", "rep", "copies").join(more, "key", "left")
    named = named.join(groups, F.col("key") == F.col("node"), "left").withColumn("group", F.coalesce("component", "key"))
    smallest = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = scratch.write(named.join(smallest, "group").select(
        F.col("key").alias("_key"), F.col("v").alias("_v"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    ), "named")
    rows = rows.withColumn("_of", F.when(F.col("usable"), F.xxhash64("label", "v")))
    out = rows.join(named, (F.col("_of") == F.col("_key")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
