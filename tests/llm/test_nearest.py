import numpy as np
import pytest
from pyspark.sql import functions as F

from logcompact.llm.nearest import fitted_factor, nearest_vectors, search_block
from logcompact.llm.vantage import Nearest, Shard, Tree, distances, lifted, products

SCHEMA = "vec_id long, embedding array<double>, label int, row long, rank string, score int"


def brute(rows, k, step):
    ok = {(i, tuple(x + 0.0 for x in v)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, a in ok:
        if q % step == 0:
            near = sorted((-sum_in_order(a, b), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v, *_ in rows], SCHEMA).repartition(3)


def sample(seed):
    r = np.random.default_rng(seed)
    rows = [(k, (r.normal(size=6) * r.choice([0.1, 1, 3])).tolist()) for k in range(300)]
    rows += [(400 + k, rows[5][1]) for k in range(60)] + [rows[10], rows[10], (20, rows[11][1])]
    rows += [(500 + k, [float(k % 2), 1.0, 0.0, 0.0, 0.0, 0.0]) for k in range(30)]  # ties of different vectors
    rows += [(600, [1.0, 2.0]), (620, [2.0, 1.0]), (640, [-0.0, 1.0]), (660, [7.0])]
    return rows + [(700, None), (720, []), (740, [0.0] * 6), (760, [1.0, None]), (780, [float("nan")] * 6), (800, [float("inf")] * 6), (None, [1.0] * 6)]


@pytest.mark.parametrize("shard, block, together, k", [(8192, 4096, 8, 20), (40, 5, 3, 7), (16, 100, 1, 1)])
def test_factor_one_is_exact(spark, shard, block, together, k):
    rows = sample(shard)
    found = nearest_vectors(table_of(spark, rows), F.col("vec_id") % 20 == 0, k, factor=1.0, shard=shard, block=block, together=together)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()) == brute(rows, k, 20)


def test_fitted_factor_over_several_shards(spark):
    r = np.random.default_rng(1)
    centers = r.normal(size=(30, 16))
    x = centers[r.integers(0, 30, 9000)] + 0.5 * r.normal(size=(9000, 16))
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = nearest_vectors(table, F.col("vec_id") % 20 == 0, 20, shard=2000, block=200, together=2).toPandas()
    got = found.groupby("query_id")["vec_id"].agg(set)
    kept = 0
    for q in range(0, 9000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        kept += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 450 and kept >= 0.93 * 450 * 20
    assert (found.groupby("query_id")["rank"].agg(list).map(lambda a: sorted(a) == list(range(1, 21)))).all()


def test_larger_factors_look_into_fewer_leaves():
    r = np.random.default_rng(4)
    points = r.normal(size=(3000, 5))
    shard = Shard.load(Shard(points, [[k] for k in range(3000)]).dump())
    queries, leaves, kept = points[:100], [], []
    exact = None
    for factor in (1.0, 2.0, 8.0):
        found = Nearest(queries, 10)
        found.search(shard, 0, factor)
        exact = exact or found
        leaves.append(found.leaves)
        kept.append(np.mean([len(np.intersect1d(a, b)) for a, b in zip(found.point, exact.point, strict=True)]))
    want = np.sort(queries @ points.T, axis=1)[:, ::-1][:, :10]
    assert np.allclose(exact.score, want) and leaves[0] < 100 * (len(shard.tree.first) - 1) and leaves[0] > leaves[1] > leaves[2] and kept[0] >= kept[1] >= kept[2]
    assert fitted_factor([shard], queries, 10, 0.95) > 1.0
    rows = search_block([shard], np.arange(100), queries, 10, None, 0.95)
    assert len(rows) == 1000 and all(q != i for q, i, _ in rows)


def test_bounds_never_exceed_distances():
    r = np.random.default_rng(5)
    for n in (1, 2, 33, 500):
        points = lifted(r.normal(size=(n, 4)) * r.choice([0.01, 1, 50], (n, 1)), 300.0)
        points[n // 2 :] = points[0]  # many equal points
        tree = Tree.build(points, leaf=4)
        queries = r.normal(size=(20, 5))
        bounds = tree.bounds(points, queries)
        for leaf in range(len(tree.first) - 1):
            own = tree.order[tree.first[leaf] : tree.first[leaf + 1]]
            assert (distances(queries, points[own]).min(axis=1) >= bounds[:, leaf] - 1e-7 * 300).all()
        assert sorted(tree.order.tolist()) == list(range(n))


def test_no_vectors_no_queries(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nearest_vectors(none, F.col("vec_id") % 20 == 0).count() == 0
    assert nearest_vectors(table_of(spark, [(1, [1.0]), (2, [2.0])]), F.col("vec_id") % 20 == 0).count() == 0
    alone = table_of(spark, [(20, [1.0])])
    assert nearest_vectors(alone, F.col("vec_id") % 20 == 0).collect() == []


def test_products_are_added_in_order():
    a, b = np.array([[1e16, 1.0, -1e16]]), np.array([[1.0, 1.0, 1.0]])
    assert products(a, b).tolist() == [sum_in_order(a[0], b[0])]
