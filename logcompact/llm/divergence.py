"""How far the sources of a language differ in their words: exact sums over quadtrees of the counts."""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logcompact.llm.common import ranked
from logcompact.llm.quadtree import COLUMNS, ROWS, K, Quadtree, joint
from logcompact.session import Scratch

LEAST_DOCUMENTS, TOP = 30, 50
#: Shares are whole numbers: UNIT times a count smoothed by PRIOR.
UNIT, PRIOR = 1_000_000_000, 5
#: Distinct terms of a task before its counts are passed on.
HELD = 500_000

# Terms are runs of ASCII letters and of bytes beyond ASCII; only A-Z change.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTED = "lang string, source string, term string, n long, docs long"
TILE = "lang string, i int, c int, blocks int, v long, data binary"
_TILE = pa.schema(
    [("lang", pa.string()), ("i", pa.int32()), ("c", pa.int32()), ("blocks", pa.int32()), ("v", pa.int64()), ("data", pa.binary())]
)


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): parts of the counts, added up within a task as far as its memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in counts.items():
                terms = list(n)
                for a in range(0, len(terms), 50_000):
                    some = terms[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                         pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([d[t] for t in some], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            counts.clear()

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                own = Counter(text.as_py().translate(_TERMS).split())
                n, d = counts.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(own)
                d.update(own.keys())
                held += len(n) - before
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.mapInArrow(run, COUNTED)


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), in Python's integers where longs would not hold the product."""
    if int(counts.max(initial=0)) >= (1 << 62) // UNIT:
        counts, total = counts.astype(object), total.astype(object)
    return (1 + UNIT * (counts + PRIOR) // (total + PRIOR * terms)).astype(np.int64)


class Tile:
    """The counts of up to ROWS groups and COLUMNS terms of a language."""

    def __init__(self, totals: np.ndarray, terms: int, tree: Quadtree, names: list[str], wide: np.ndarray, columns: np.ndarray):
        self.totals, self.terms, self.tree = totals, terms, tree
        self.names, self.wide, self.columns = names, wide, columns  # terms that occur, the language's shares of them, their columns

    @classmethod
    def gather(cls, table: pa.Table) -> Tile:
        """From rows of groups (no term) and rows of cells."""
        t = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("r", "total", "col", "n", "of_lang", "n_lang")}
        cell = np.array([x is not None for x in table.column("term").to_pylist()], dtype=bool)
        v = table.column("v")[0].as_py()
        totals = np.zeros(int(t["r"][~cell].max()) % ROWS + 1, dtype=np.int64)
        totals[t["r"][~cell].astype(np.int64) % ROWS] = t["total"][~cell].astype(np.int64)
        column, first = np.unique(t["col"][cell].astype(np.int64) % COLUMNS, return_index=True)
        names = table.column("term").filter(pa.array(cell)).take(pa.array(first)).to_pylist()
        wide = shares(t["of_lang"][cell][first].astype(np.int64), t["n_lang"][cell][first].astype(np.int64), v)
        place = (t[c][cell].astype(np.int64) % side for c, side in (("r", ROWS), ("col", COLUMNS)))
        return cls(totals, v, Quadtree.build(*place, t["n"][cell].astype(np.int64)), names, wide, column)

    def dump(self) -> bytes:
        out, words = io.BytesIO(), self.tree.words
        names = "\n".join(self.names).encode()
        np.savez(
            out, totals=self.totals, terms=self.terms, leaves=self.tree.leaves, names=np.frombuffer(names, np.uint8), wide=self.wide,
            columns=self.columns, depth=len(words), **{f"word{k}": w for k, w in enumerate(words)},
        )
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tile:
        with np.load(io.BytesIO(data)) as x:
            names = x["names"].tobytes().decode()
            tree = Quadtree([x[f"word{k}"] for k in range(int(x["depth"]))], x["leaves"])
            return cls(x["totals"], int(x["terms"]), tree, names.split("\n") if names else [], x["wide"], x["columns"])

    def empty(self) -> np.ndarray:
        """Each row's share of a term that it hasn't got."""
        out = np.zeros(ROWS, dtype=np.int64)
        if self.terms:
            out[: len(self.totals)] = shares(np.zeros(len(self.totals), np.int64), self.totals, self.terms)
        return out

    def _shares(self, rows: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Shares of the cells of leaves (m, K, K) that begin at these rows; places beyond the rows hold anything."""
        totals = np.concatenate([self.totals, np.zeros(ROWS + K - len(self.totals), np.int64)])
        return shares(leaves, totals[rows[:, None] + np.arange(K)][:, :, None], self.terms)

    def differences(self, other: Tile, first: bool) -> np.ndarray:
        """For each row here and in the other tile, the sum of differences of shares.

        Terms that both lack differ by the same amount everywhere: with `first` (one tile of a strip) all terms of the
        language are priced so, at once. Leaves that either has add what their terms really differ by, less that price.
        """
        mine, theirs = self.empty(), other.empty()
        price = np.abs(mine[:, None] - theirs[None, :])
        out = price * self.terms if first else np.zeros_like(price)
        if not self.terms:
            return out[: len(self.totals), : len(other.totals)]
        span = np.arange(K)
        blank = np.zeros((1, K, K), dtype=np.int64)
        a_leaves, b_leaves = (np.concatenate([t.tree.leaves, blank]) for t in (self, other))  # -1 is the blank one
        out = np.pad(out, (0, K))
        price = np.pad(price, (0, K))
        for ra, rb, _, a, b in joint(self.tree, other.tree, len(self.totals), len(other.totals)):
            pa_, pb = self._shares(ra, a_leaves[a]), other._shares(rb, b_leaves[b])
            rows_a, rows_b = ra[:, None] + span, rb[:, None] + span
            real = np.abs(pa_[:, :, None, :] - pb[:, None, :, :]).sum(axis=3)
            real -= K * price[rows_a[:, :, None], rows_b[:, None, :]]
            np.add.at(out, (rows_a[:, :, None], rows_b[:, None, :]), real)
        return out[: len(self.totals), : len(other.totals)]

    def over(self, top: int) -> Iterator[tuple[int, str, int]]:
        """(row, term, share less the language's) of each row's `top` terms that it has more often than the language."""
        rows, columns, gains = [], [], []
        wide = np.zeros(COLUMNS + K, dtype=np.int64)
        wide[self.columns] = self.wide
        span = np.arange(K)
        for row, column, leaves in self.tree.cells():
            gain = self._shares(row, leaves) - wide[column[:, None, None] + span[None, None, :]]
            m, x, y = np.nonzero((leaves > 0) & (gain > 0))
            rows.append(row[m] + x)
            columns.append(column[m] + y)
            gains.append(gain[m, x, y])
        if not rows:
            return
        r, c, g = (np.concatenate(x) for x in (rows, columns, gains))
        name = dict(zip(self.columns.tolist(), self.names, strict=True))
        for row in np.unique(r).tolist():
            own = np.flatnonzero(r == row)
            if len(own) > top:  # ties with the last are settled by name
                least = np.partition(g[own], len(own) - top)[len(own) - top]
                own = own[g[own] >= least]
            best = sorted((-int(g[k]), name[int(c[k])].encode(), int(c[k])) for k in own)[:top]
            yield from ((row, name[k], -value) for value, _, k in best)


def audit_sources(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """For every (lang, source): how far each other source of the language is, and which terms set it apart.

    Words are counted per task and added by Spark; a language keeps the terms of at least `least` of its documents.
    Groups and kept terms are numbered within their language (by ranges, no task holds a language), and the matrix of groups
    by terms is cut into tiles of 64 x 4,096. Each tile is a tree of 4 x 4 quadrants: empty quadrants take no room, and pairs of
    groups don't visit them, as a term that two groups both lack differs by one amount that is priced once for all. A pair of
    strips of groups meets tile by tile; both trees are walked down the same columns, and leaves that either has are
    evaluated for all pairs of their groups. Tasks hold two tiles; sums per pair of groups are added by Spark. Pairs of groups are
    the result, so it grows with their square by contract.

    Parts: `pair` has every other source of the language as item and the sum over kept terms of abs(p - q) as value, `term` up to
    `top` kept terms that the group has and whose p exceeds the language's, with p - q. All numbers are exact integers. Null lang, source
    and text count as ''; texts without terms still give their group; a language without kept terms has pairs of value 0. Rows that
    repeat count each. An empty table gives no rows. Columns other than text, lang and source are not read.
    Returns lang, source, part, item, value, rank.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.write(counts, "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = scratch.write(kept.drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("of_lang").alias("n_lang"))
    columns = scratch.write(ranked(kept, ["lang"], ["term"], scratch, "col"), "columns")
    groups = scratch.write(docs.select("lang", "source").distinct(), "groups")
    groups = ranked(groups, ["lang"], ["source"], scratch, "r")

    cells = counts.drop("docs").join(columns, ["lang", "term"])
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    some = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("blocks"))
    groups = groups.join(totals, ["lang", "source"], "left").join(some, "lang").join(langs, "lang", "left")
    facts = groups.select(
        "lang", "source", "r", F.coalesce("total", F.lit(0)).alias("total"), "blocks", F.coalesce("v", F.lit(0)).alias("v"), "n_lang"
    )
    facts = scratch.write(facts, "facts")

    strip = F.floor(F.col("r") / ROWS).cast("int").alias("i")
    wide = F.greatest(F.ceil(F.col("v") / COLUMNS) - 1, F.lit(0)).cast("int")
    heads = facts.select("lang", "r", strip, F.explode(F.sequence(F.lit(0), wide)).alias("c"), "total", "blocks", "v", "n_lang")
    cells = cells.join(facts.select("lang", "source", "r", "v", "n_lang"), ["lang", "source"])
    cells = cells.select(
        "lang", "r", strip, F.floor(F.col("col") / COLUMNS).cast("int").alias("c"), "v", "n_lang", "term", "col", "n", "of_lang"
    )
    rows = heads.unionByName(cells, allowMissingColumns=True)

    def build(table: pa.Table) -> pa.Table:
        head = {c: table.column(c)[0].as_py() for c in ("lang", "i", "c", "v")}
        blocks = max(x for x in table.column("blocks").to_pylist() if x is not None)
        row = head | {"blocks": blocks, "data": Tile.gather(table).dump()}
        return pa.Table.from_pylist([row], schema=_TILE)

    tiles = scratch.write(rows.groupBy("lang", "i", "c").applyInArrow(build, TILE), "tiles")
    left = tiles.select("lang", "c", "i", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"), "data")
    right = tiles.select("lang", "c", F.explode(F.sequence(F.lit(0), "i")).alias("_i"), F.col("i").alias("j"), "data")
    right = right.withColumnRenamed("_i", "i")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j = a.column("i")[0].as_py(), a.column("j")[0].as_py()
        mine = Tile.load(a.column("data")[0].as_py())
        theirs = mine if i == j else Tile.load(b.column("data")[0].as_py())
        first = a.column("c")[0].as_py() == 0
        value = mine.differences(theirs, first)
        g, h = np.triu_indices(len(value), 1) if i == j else (x.reshape(-1) for x in np.indices(value.shape))
        some = np.ones(len(g), dtype=bool) if first else value[g, h] != 0
        g, h = g[some], h[some]
        lang = pa.array([a.column("lang")[0].as_py()] * len(g), pa.string())
        return pa.table({"lang": lang, "g": i * ROWS + g, "h": j * ROWS + h, "value": value[g, h]})

    met = left.groupBy("lang", "c", "i", "j").cogroup(right.groupBy("lang", "c", "i", "j"))
    met = met.applyInArrow(meet, "lang string, g long, h long, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    met = scratch.write(met, "pairs")
    both = met.unionByName(met.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    names = facts.select("lang", F.col("r").alias("g"), "source")
    items = facts.select("lang", F.col("r").alias("h"), F.col("source").alias("item"))
    pairs = both.join(names, ["lang", "g"]).join(items, ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, i, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = list(Tile.load(data).over(top))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array([i * ROWS + r for r, _, _ in found], pa.int64()),
                     pa.array([t for _, t, _ in found], pa.string()), pa.array([x for _, _, x in found], pa.int64())],
                    names=["lang", "g", "item", "value"],
                )

    terms = tiles.select("lang", "i", "data").mapInArrow(apart, "lang string, g long, item string, value long")
    terms = terms.join(names, ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranks = [x.withColumn("rank", F.row_number().over(best)) for x in (pairs, terms)]
    return ranks[0].unionByName(ranks[1].where(F.col("rank") <= top))
