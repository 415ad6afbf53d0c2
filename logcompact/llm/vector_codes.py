"""Codes of vectors: codebooks per part learned in whole numbers, over blocks of points that lie close together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcompact.llm.common import parallelism
from logcompact.llm.hilbert import hilbert_keys
from logcompact.session import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Points of a block.
BLOCK = 256

CELLS = "part int, key long, row long, point binary"
BLOCKS = "part int, n int, low binary, high binary, sums binary, points binary, rows binary"


@dataclass
class Compressed:
    """`codes` has vec_id, label, code (a byte for each part) and error; `books` is (part, entry, component)."""

    codes: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """SHA-256 of the entries' components in decimal, by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def cut_blocks(part: np.ndarray, rows: np.ndarray, points: np.ndarray, size: int) -> Iterator[tuple]:
    """Blocks of at most `size` consecutive points of one part, with the corners of their box and their sums."""
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for first, end in zip(edges, np.append(edges[1:], len(part)), strict=True):
        for a in range(first, end, size):
            p = points[a : min(a + size, end)]
            facts = (p.min(axis=0), p.max(axis=0), p.sum(axis=0), p, rows[a : min(a + size, end)])
            yield (int(part[a]), len(p), *(x.astype(np.int64).tobytes() for x in facts))


def box_distances(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance of any place in each box (m, w) from each of its entries (m, k, w)."""
    below, above = low[:, None, :] - entries, entries - high[:, None, :]
    least = np.maximum(np.maximum(below, above), 0)
    return (least**2).sum(axis=2), (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries may be the nearest of some point of each box: those no farther than what some entry can't exceed."""
    least, most = box_distances(low, high, entries)
    return least <= most.min(axis=1, keepdims=True)


def nearest(points: np.ndarray, entries: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, the first of equals, and its squared distance; all in whole numbers.

    `reach` bounds the components. Doubles hold the products as whole numbers while they stay below 2^53, and then serve
    the faster product of matrices; beyond that the differences are squared as integers.
    """
    if 4 * points.shape[1] * (reach + 1) ** 2 < 1 << 52:
        p, e = points.astype(float), entries.astype(float)
        squares = (p**2).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e**2).sum(axis=1)
    else:
        squares = np.stack([((points - x) ** 2).sum(axis=1) for x in entries], axis=1)
    best = squares.argmin(axis=1)
    return best, squares[np.arange(len(points)), best].astype(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(-1, width)


def _cells(rows: DataFrame, parts: int, width: int, low: int, high: int) -> DataFrame:
    """One row per part of each vector: its place on the curve, the vector's row and the components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.num_rows, batch.column(1)
            if not n:
                continue
            sizes = np.diff(lists.offsets.to_numpy())
            whole = np.zeros((n, parts * width), dtype=np.int64)
            whole[np.arange(parts * width) < sizes[:, None]] = lists.flatten().to_numpy()
            for part in range(parts):
                points = np.ascontiguousarray(whole[:, part * width : (part + 1) * width])
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * width), n, [None, pa.py_buffer(points)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(hilbert_keys(points, low, high)), batch.column(0), data.cast(pa.binary())],
                    names=["part", "key", "row", "point"],
                )

    return rows.select("row", "q").mapInArrow(run, CELLS)


def _blocks(cells: DataFrame, width: int, size: int) -> DataFrame:
    """Blocks of rows that come in the order of part and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            part, rows, points = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(part)
            if not last:  # the block still open at the end waits for the next rows
                end -= (end - int(np.searchsorted(part, part[-1]))) % size or size
            held[:] = [(part[end:], rows[end:], points[end:])]
            found = list(cut_blocks(part[:end], rows[:end], points[:end], size))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int32() if k < 2 else pa.binary()) for k, x in enumerate(zip(*found, strict=True))],
                    names=["part", "n", "low", "high", "sums", "points", "rows"],
                )

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), width)))
            if sum(len(x[0]) for x in held) >= 32 * size:
                yield from flush(False)
        if held:
            yield from flush(True)

    return cells.select("part", "row", "point").mapInArrow(run, BLOCKS)


def _sums(blocks: DataFrame, books: np.ndarray, reach: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """How many points each used entry has, and their sums; (parts x entries x width) numbers reach the driver."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            part, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            low, high, total = (_matrix(batch.column(k), width) for k in (2, 3, 4))
            fits = shortlists(low, high, books[part])
            alone = fits.sum(axis=1) == 1
            only = fits.argmax(axis=1)
            np.add.at(counts, (part[alone], only[alone]), n[alone])
            np.add.at(sums, (part[alone], only[alone]), total[alone])
            for k in np.flatnonzero(~alone):
                some = np.flatnonzero(fits[k])
                points = np.frombuffer(batch.column(5)[int(k)].as_py(), dtype=np.int64).reshape(-1, width)
                best = some[nearest(points, books[part[k]][some], reach)[0]]
                counts[part[k]] += np.bincount(best, minlength=entries)
                np.add.at(sums[part[k]], best, points)
        p, e = np.nonzero(counts)
        at = np.repeat(np.arange(len(p)), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p[at].astype(np.int32)), pa.array(e[at].astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))),
             pa.array(counts[p, e][at]), pa.array(sums[p, e].reshape(-1))],
            names=["part", "entry", "place", "n", "total"],
        )

    found = blocks.drop("rows").mapInArrow(run, "part int, entry int, place int, n long, total long")
    found = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in found.orderBy("part", "entry", "place").collect():
        out.setdefault((r["part"], r["entry"]), (r["n"], []))[1].append(int(r["total"]))
    return out


def _assigned(blocks: DataFrame, books: np.ndarray, reach: int) -> DataFrame:
    """For every vector's row: the codes of its parts as words of eight bytes, and its squared distance."""
    parts, _, width = books.shape
    words = [f"word_{k}" for k in range((parts + 7) // 8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fits = shortlists(*(_matrix(batch.column(k), width) for k in (2, 3)), books[part])
            codes, errors = [], []
            for k, data in enumerate(batch.column(4).to_pylist()):
                some = np.flatnonzero(fits[k])
                best, error = nearest(np.frombuffer(data, dtype=np.int64).reshape(-1, width), books[part[k]][some], reach)
                codes.append(some[best])
                errors.append(error)
            rows = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.int64)
            of = np.repeat(part, n)
            code = np.concatenate(codes).astype(np.uint64) << (8 * (7 - of % 8)).astype(np.uint64)
            out = [np.where(of // 8 == k, code, np.uint64(0)).view(np.int64) for k in range(len(words))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows, *out, np.concatenate(errors))], names=["_row", *words, "error"])

    schema = ", ".join(f"{c} long" for c in ("_row", *words, "error"))
    found = blocks.select("part", "n", "low", "high", "points", "rows").mapInArrow(run, schema)
    found = found.groupBy("_row").agg(*[F.bit_or(w).alias(w) for w in words], F.sum("error").alias("error"))
    code = F.unhex(F.substring(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words]), 1, 2 * parts))
    return found.select("_row", code.alias("code"), "error")


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK
) -> Compressed:
    """Codes of vectors by `parts` codebooks of at most `entries` entries, learned in `rounds` rounds over all vectors.

    Components become floor(scale * x). Every part of every vector is a point; points of one part position are laid out
    along a Hilbert curve (by range over part, place and row, so equal points spread over tasks) and cut into flat blocks
    of `block` points with the corners of their box and their sums. In each round the distances of box and entries leave a shortlist for
    a block. With one entry left, the block's sums count for it and no point is read; else its points are compared with the
    shortlist in whole numbers, ties to the lower index. Tasks add up sums per entry, Spark adds the tasks, and the driver
    gets the new entries only (floor of sum by count; unused entries stay). The last pass writes a code and a distance per point,
    joined per vector by or and sum. Driver memory depends on parts x entries x width, task memory on a batch of blocks.

    The codebooks start from the vectors of the smallest vec_ids (nulls last, ties by components); with fewer vectors than
    `entries` there are fewer entries. Left out are rows whose vector is null or holds null or non-finite components. Where
    lengths differ, or don't divide into equal parts, vectors count as continued by zeros up to the next length that
    the longest fits; so an empty vector is one of zeros. Rows that repeat a vec_id are rows of their own, null ids and labels pass through.
    An empty table has no entries and no codes. Components so large that a squared distance could pass a long are refused with an
    error. Columns other than vec_id, embedding and label are not read.
    """
    if not (1 <= entries <= 256 and parts >= 1):
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", numbers.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", fine))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))
    rows = scratch.write(rows, "rows")
    size = F.max(F.size("q")).alias("size")
    known = rows.agg(F.min(F.array_min("q")).alias("low"), F.max(F.array_max("q")).alias("high"), size).first()
    low, high, width = min(known["low"] or 0, 0), max(known["high"] or 0, 0), max(-(-(known["size"] or 0) // parts), 1)
    reach = max(-low, high)
    if parts * width * (2 * reach + 1) ** 2 >= 1 << 62:
        raise ValueError(f"components up to {reach / scale:g}: their squared distances do not fit a long")

    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()
    books = np.zeros((len(seeds), parts * width), dtype=np.int64)
    for k, r in enumerate(seeds):
        books[k, : len(r["q"])] = r["q"]
    books = np.ascontiguousarray(books.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    if not len(seeds):
        nothing = rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        return Compressed(nothing, books)

    cells = _cells(rows, parts, width, low, high)
    laid = cells.repartitionByRange(parallelism(spark), "part", "key", "row").sortWithinPartitions("part", "key", "row")
    blocks = scratch.write(_blocks(laid, width, block), "blocks")
    for _ in range(rounds):
        for (part, entry), (n, total) in _sums(blocks, books, reach).items():
            books[part, entry] = [x // n for x in total]
    found = _assigned(blocks, books, reach)
    codes = rows.join(found, F.col("row") == F.col("_row")).select("vec_id", "label", "code", "error")
    return Compressed(codes, books)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """The codes with the error summed over rows of equal labels, nulls being one label."""
    staged = Scratch(codes.sparkSession, "label-errors").write(codes, "codes")
    sums = staged.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return staged.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
