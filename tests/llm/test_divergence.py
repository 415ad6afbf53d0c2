import random
import re
from collections import Counter

import numpy as np

from logcompact.llm.divergence import Tile, audit_sources, shares
from logcompact.llm.quadtree import COLUMNS, ROWS, Quadtree, joint

SCHEMA = "doc_id long, text string, lang string, source string, n long, total string, r int, term int, value long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, least, top=50):
    """Every share of every kept term, compared for every pair."""
    count, seen, groups = Counter(), Counter(), set()
    for text, lang, source in docs:
        text, lang, source = (x or "" for x in (text, lang, source))
        groups.add((lang, source))
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        for t in terms:
            count[lang, source, t] += 1
        for t in set(terms):
            seen[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (of, t), n in seen.items() if of == lang and n >= least)
        sources = [s for of, s in groups if of == lang]

        def share(n, total):
            return 1 + 1_000_000_000 * (n + 5) // (total + 5 * len(kept))

        n = {s: [count[lang, s, t] for t in kept] for s in sources}
        totals = {s: sum(n[s]) for s in sources}
        p = {s: np.array([share(x, totals[s]) for x in n[s]], dtype=np.int64) for s in sources}
        whole = [sum(x) for x in zip(*n.values(), strict=True)]
        all_ = sum(whole)
        q = [share(x, all_) for x in whole]
        for s in sources:
            pairs = [(-int(np.abs(p[s] - p[o]).sum()), o.encode(), o) for o in sources if o != s]
            terms = [(b - a, t.encode(), t) for t, x, a, b in zip(kept, n[s], p[s].tolist(), q, strict=True) if x and a > b]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(rows)]
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame([(k, *d, 1, "x", 2, 3, 4) for k, d in enumerate(docs)], SCHEMA).repartition(3)


def test_small_languages_nulls_and_odd_texts(spark):
    r = random.Random(3)
    docs = [(" ".join(r.choice("Alpha beta gamma Ünï ünï x-y z9z".split()) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None])) for _ in range(120)]
    docs += [(None, "fr", "s1"), ("", "fr", "s2"), ("nothing kept", "fr", None), ("\x00 [] `{ 12 \x7f", "xx", "é"), ("alone", "yy", "z")]
    docs += [("word " * 40_000, "en", "s1"), ("x" * 300_000, "de", "s2"), docs[0], docs[0], docs[0]]
    for least in (1, 3, 30):
        assert found(audit_sources(frame(spark, docs), least=least)) == brute(docs, least)


def test_more_groups_and_terms_than_a_tile_holds(spark):
    r = random.Random(5)
    docs = []
    for k in range(260):
        own = [f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(60)]
        docs.append((" ".join(own) + " the THE", "en" if k % 13 else "de", f"s{k % 150:03}"))
    assert len({t for d in docs for t in d[0].split()}) > COLUMNS and 150 > 2 * ROWS
    assert found(audit_sources(frame(spark, docs), least=1, top=7)) == brute(docs, 1, 7)


def test_no_documents(spark, no_docs):
    assert audit_sources(no_docs).count() == 0


def tile(r, rows, terms, density):
    counts = np.where(r.random((rows, terms)) < density, r.integers(1, 50, (rows, terms)), 0)
    counts[: rows // 2, terms // 2 :] = 0  # a large empty quadrant
    at = np.nonzero(counts)
    return counts, Tile(counts.sum(axis=1), terms, Quadtree.build(*at, counts[at]), [], np.zeros(0, np.int64), np.zeros(0, np.int64))


def test_pairs_of_trees_equal_whole_matrices():
    r = np.random.default_rng(1)
    for rows, others, terms, density in ((1, 1, 1, 1.0), (5, 64, 300, 0.02), (64, 3, 4096, 0.001), (17, 9, 50, 0.0), (9, 30, 100, 0.6)):
        (a, first), (b, second) = tile(r, rows, terms, density), tile(r, others, terms, density / 2)
        p, q = (shares(x, x.sum(axis=1)[:, None], terms) for x in (a, b))
        first, second = Tile.load(first.dump()), Tile.load(second.dump())
        want = np.abs(p[:, None, :] - q[None, :, :]).sum(axis=2)
        assert (first.differences(second, True) == want).all()
        own = np.abs(p[:, None, :] - p[None, :, :]).sum(axis=2)
        assert (np.triu(first.differences(first, True)) == np.triu(own)).all()


def test_empty_quadrants_are_not_visited():
    tree = Quadtree.build(np.array([0, 1]), np.array([0, 4000]), np.array([3, 4]))
    assert len(tree) == 2 and sum(len(x[0]) for x in joint(tree, tree, 64, 64)) == 2 * 16
    none = Quadtree.build(*[np.zeros(0, np.int64)] * 3)
    assert sum(len(x[0]) for x in joint(none, none, 64, 64)) == 0


def test_counts_beyond_longs():
    n = np.array([10**13, 0])
    assert shares(n, np.array([10**13] * 2), 2).tolist() == [1 + 10**9 * (10**13 + 5) // (10**13 + 10), 1 + 5 * 10**9 // (10**13 + 10)]
