import hashlib

import numpy as np
import pytest

from logcompact.llm import hilbert
from logcompact.llm.hilbert import hilbert_keys
from logcompact.llm.vector_codes import compress, nearest, shortlists, with_label_errors

SCHEMA = "vec_id long, embedding array<double>, label int, row long, code string, error long"


def brute(rows, parts, entries, rounds, scale=256):
    """Codes by comparing every part with every entry, in Python's integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(r[1]) for r in kept), default=0) // parts))
    whole = [[int(np.floor(scale * x)) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in kept]
    cells = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k]))[:entries]
    books = [[cells[k][p] for k in first] for p in range(parts)]

    def assign():
        return [
            [min((sum((a - b) ** 2 for a, b in zip(c, e, strict=True)), i) for i, e in enumerate(book)) for c, book in zip(v, books, strict=True)]
            for v in cells
        ]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(first)):
                own = [cells[k][p] for k in range(len(kept)) if found[k][p][1] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    out = []
    for r, f in zip(kept, assign(), strict=True):
        out.append((r[0], r[2], bytes(i for _, i in f), sum(d for d, _ in f)))
    return out, books


def sample(seed, n=150):
    r = np.random.default_rng(seed)
    rows = [(k, (r.normal(size=8) * (0.3 if k % 3 else 4)).tolist(), k % 4 if k % 5 else None) for k in range(n)]
    rows += [(1000 + k, rows[3][1], 1) for k in range(60)] + [rows[7], rows[7]]  # ties, repeated rows
    rows += [(2000, None, 1), (2001, [1.0, None] + [0.0] * 6, 1), (2002, [float("nan")] * 8, 2), (2003, [float("inf")] * 8, 2)]
    return rows + [(2004, [], 1), (2005, [0.5, -0.25], None), (None, [0.0] * 8, 3), (-5, [100.0] * 8, 0)]


@pytest.mark.parametrize("parts, entries, rounds, block", [(4, 8, 2, 16), (16, 64, 2, 256), (3, 5, 1, 1), (1, 2, 0, 7)])
def test_against_every_entry(spark, parts, entries, rounds, block):
    rows = sample(parts)
    table = spark.createDataFrame([(*x, 9, "c", 1) for x in rows], SCHEMA).repartition(3)
    found = compress(table, parts=parts, entries=entries, rounds=rounds, block=block)
    want, books = brute(rows, parts, entries, rounds)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0, x[2])
    got = sorted(((r["vec_id"], r["label"], bytes(r["code"]), r["error"]) for r in found.codes.collect()), key=key)
    assert got == sorted(want, key=key)
    assert found.books.tolist() == [[list(e) for e in book] for book in books]
    flat = ",".join(str(x) for book in books for e in book for x in e)
    assert found.digest() == hashlib.sha256(flat.encode()).hexdigest()
    labels = {}
    for _, label, _, error in want:
        labels[label] = labels.get(label, 0) + error
    assert {(r["label"], r["label_error"]) for r in with_label_errors(found.codes).collect()} == set(labels.items())


def test_no_vectors_few_vectors_and_too_large_ones(spark):
    none = compress(spark.createDataFrame([], SCHEMA))
    assert none.codes.count() == 0 and none.digest() == hashlib.sha256(b"").hexdigest()
    one = compress(spark.createDataFrame([(5, [1.0] * 32, None, 0, "", 0)], SCHEMA))
    assert [(bytes(r["code"]), r["error"]) for r in one.codes.collect()] == [(bytes(16), 0)] and one.books.shape == (16, 1, 2)
    assert with_label_errors(one.codes).first()["label_error"] == 0
    with pytest.raises(ValueError, match="do not fit"):
        compress(spark.createDataFrame([(5, [1e300], 1, 0, "", 0)], SCHEMA))


def test_shortlists_hold_the_nearest_entry_of_every_point_of_the_box():
    r = np.random.default_rng(2)
    for _ in range(200):
        points, entries = r.integers(-9, 10, (int(r.integers(1, 9)), 3)), r.integers(-9, 10, (12, 3))
        fits = shortlists(points.min(axis=0)[None], points.max(axis=0)[None], entries[None])[0]
        best = nearest(points, entries, 10)[0]
        assert fits[best].all()


def test_large_components_are_compared_in_integers():
    points, entries = np.array([[1 << 28, 1]]), np.array([[0, 0], [(1 << 28) + 1, 1], [1 << 28, 2]])
    best, error = nearest(points, entries, 1 << 29)
    assert best.tolist() == [1] and error.tolist() == [1]


@pytest.mark.parametrize("width, bits", [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_touch(monkeypatch, width, bits):
    monkeypatch.setattr(hilbert, "curve_bits", lambda _: bits)
    side = 1 << bits
    grid = np.stack(np.meshgrid(*[np.arange(side)] * width, indexing="ij"), -1).reshape(-1, width)
    keys = hilbert_keys(grid, 0, side - 1)
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert sorted(keys.tolist()) == list(range(side**width)) and set(steps.tolist()) == {1}
