import re
from itertools import combinations

import numpy as np
import pytest

from logcompact.llm import jaccard as J
from logcompact.llm.exact_dedup import exact_dedup
from logcompact.llm.jaccard import jaccard_components
from logcompact.llm.shingles import shingle_sets

from .conftest import SCHEMA, prose, rows_of


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_dedup_of_odd_documents(odd_docs, odd_texts, bits):
    """With identifiers of one bit nearly all chunks clash, and the digests decide."""
    found = exact_dedup(odd_docs, id_bits=bits).collect()
    assert len(found) == len(odd_texts) + 2
    groups = {}
    for k, t in [*odd_texts.items(), (10, odd_texts[10]), (None, "no id here")]:
        groups.setdefault(normal(t), []).append((-len(t or ""), k))
    for row in found:
        text = odd_texts[row["doc_id"]] if row["doc_id"] else "no id here"
        group = groups[normal(text)]
        assert row["group_size"] == len(group)
        best = min(group, key=lambda g: (g[0], g[1] is None, g[1] or 0))[1]
        assert row["keep_id"] == best and row["kept"] == (row["doc_id"] == best)


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup(no_docs).count() == 0


def brute_sets(texts):
    out = {}
    for k, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        whole = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}
        out[k] = whole if words else set()
    return out


def brute_components(texts):
    sets = brute_sets(texts)
    group = {k: k for k in sets}
    changed = True
    pairs = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(group[a], group[b])
            if (group[a], group[b]) != (low, low):
                group[a] = group[b] = low
                changed = True
    return {k: (len(sets[k]), group[k]) for k in sets}


def near_copies(seed: int) -> dict:
    """Families of texts with more and more words changed, of sizes around the borders of the bands."""
    r = np.random.default_rng(seed)
    out, k = {}, 0
    for size in (5, 6, 8, 12, 20, 24, 28, 29, 30, 35, 48, 52, 53, 60, 80, 100, 130, 190, 200, 260, 400):
        base = prose(int(r.integers(1 << 30)), size).split()
        for changes in (0, 0, 1, 1, 2, 3, 5, 8):
            words = list(base)
            for _ in range(min(changes, size // 4)):
                at = int(r.integers(len(words)))
                how = r.integers(3)
                words[at : at + 1] = [f"new{r.integers(99)}"] if how == 0 else [] if how == 1 else [words[at], f"more{r.integers(99)}"]
            out[k := k + 1] = " ".join(words)
    return out


@pytest.mark.parametrize("spare", [1.0, 0.0])
def test_jaccard_components_against_all_pairs(spark, odd_texts, spare):
    """Without spare segments, sets fall short of them and use deletion neighbours or the comparison with all documents."""
    texts = {**{1000 + k: t for k, t in odd_texts.items()}, **near_copies(7)}
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, spare=spare).collect()}
    assert found == brute_components(texts)


def test_sets_without_segments_are_served(spark, monkeypatch):
    """With far too few segments no allocation is enough, and all links come from the comparison in blocks."""
    monkeypatch.setattr(J, "AT_ONCE", 3)
    texts = {k: t for k, t in near_copies(9).items() if 200 < len(t.split()) < 450}
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, spare=-5.0).collect()}
    assert found == brute_components(texts)


def test_jaccard_edge_rows(odd_docs, no_docs):
    found = jaccard_components(odd_docs).collect()
    assert sum(r["doc_id"] == 10 for r in found) == 2 and sum(r["doc_id"] is None for r in found) == 1
    assert jaccard_components(no_docs).count() == 0


def test_hot_signatures(spark, monkeypatch):
    """More near copies than a buffer's limit for one signature: they form one group by one pair each."""
    base = prose(5, 120)
    texts = {k: f"{base} tail{k}" for k in range(1, 150)}
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(2)
    found = {r["component_id"] for r in jaccard_components(docs).collect()}
    assert found == {1}


def test_segments_outnumber_differences():
    n = np.arange(25, 5000)
    top = J.top_of_band(n)
    assert (top >= n).all() and (top < 2 * n + 2).all()
    assert (J.segments(top) > J.differ(n, n * 4 // 3)).all()


def test_shingles_are_those_of_words():
    texts = [None, "", " ", "a", "A", "a b", "b a", "a b c d e f", "a\tb\nc  d e f", "x " * 30]
    sizes = [len(s) for s in shingle_sets(texts)]
    assert sizes == [0, 0, 0, 1, 1, 1, 1, 2, 2, 1]
    a, b = list(shingle_sets(["one two three four five six", "ONE two\x0bthree four five six"]))
    assert (a == b).all()


def test_a_crowd_around_the_threshold(spark):
    """Hundreds of edited copies of one text, about half of whose pairs are links, among others and at any size of blocks."""
    r = np.random.default_rng(11)
    base = [f"b{k}" for k in range(150)]
    texts = {}
    for k in range(260):
        words = list(base)
        for _ in range(int(r.integers(1, 5))):
            words[int(r.integers(150))] = f"e{r.integers(10**6)}"
        if k % 5 == 0:
            words = words[: int(r.integers(105, 151))]
        texts[k] = " ".join(words)
    texts |= {1000 + k: texts[k] for k in range(30)} | {2000 + k: " ".join(f"o{r.integers(40)}" for _ in range(120)) for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    sets = {k: set(s.tolist()) for k, s in zip(texts, shingle_sets(list(texts.values())), strict=True)}
    group = {k: k for k in sets}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    links = 0
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = sorted((root(a), root(b)))
                group[y] = x
    assert 0.3 < links / (290 * 289 / 2) < 0.8
    found = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()}
    assert found == {k: root(k) for k in keys}


def test_shared_shingles_are_counted_in_blocks(monkeypatch):
    monkeypatch.setattr(J, "DENSE", 7)
    monkeypatch.setattr(J, "SPARSE", 50)
    r = np.random.default_rng(1)
    for n_a, n_b in ((1, 1), (5, 7), (40, 30)):
        base = r.integers(0, 1 << 60, 200)
        a, b = ([np.unique(np.concatenate([r.choice(base, r.integers(1, 150)), r.integers(0, 1 << 60, 9)])) for _ in range(n)] for n in (n_a, n_b))
        of = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
        got = J.intersections(of[0], np.concatenate(a), n_a, of[1], np.concatenate(b), n_b)
        assert (got == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
