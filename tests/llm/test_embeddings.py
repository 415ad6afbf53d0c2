import numpy as np

from logcompact.llm.embedding_dedup import near_duplicates, shard_links, unit
from logcompact.llm.hnsw import Graph


def brute(rows, least=0.98):
    ok = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, dtype=float)
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= least:
                    links[a].add(b)
    group = {k: rows[k][0] for k in links}
    changed = True
    while changed:
        changed = False
        for a in links:
            for b in links[a]:
                if group[b] < group[a]:
                    group[a], changed = group[b], True
    return {rows[k][0]: (len(links[k]), group[k], group[k] == rows[k][0]) for k in links}


def vectors(seed: int):
    r = np.random.default_rng(seed)
    rows = []
    for cluster in range(12):
        base = r.normal(size=8)
        for _ in range(int(r.integers(1, 14))):
            rows.append((len(rows), (base + r.normal(size=8) * 0.12).astype(np.float32).tolist(), cluster % 3))
    rows += [(len(rows) + k, rows[k % 3][1], rows[k % 3][2]) for k in range(20)]  # copies
    for v in (None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0], [-0.0, 1.0], [0.0, 1.0]):
        rows.append((len(rows), v, 1))
    return rows + [(len(rows), rows[0][1], None)]


def test_against_all_pairs_in_small_shards(spark):
    rows = vectors(3)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, key long, v string")
    for shard in (8192, 10):
        found = near_duplicates(table.repartition(3), shard=shard).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == brute(rows)


def test_no_vectors_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    found = near_duplicates(spark.createDataFrame([(5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], schema)).collect()
    assert [(r["n_links"], r["component_id"]) for r in found] == [(2, 5)] * 3


def test_recall_with_a_cluster_wider_than_the_beam():
    r = np.random.default_rng(1)
    base = r.normal(size=32)
    points = unit(np.concatenate([base + 0.02 * r.normal(size=(400, 32)), r.normal(size=(1500, 32))]))
    q, p = shard_links(Graph(points), points, points, 0.98, own=True)
    sims = points @ points.T >= 0.98
    np.fill_diagonal(sims, False)
    assert sims[q, p].all() and len(set(zip(q.tolist(), p.tolist(), strict=True))) >= 0.98 * sims.sum()
