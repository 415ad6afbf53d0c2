"""Packing documents into sequences: dominance reduction, then best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcompact.llm.common import ranked, text_or_empty
from logcompact.llm.tokens import TokenIds
from logcompact.session import Scratch

CAPACITY = 2048
SEPARATOR = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# --- tokens ----------------------------------------------------------------------------------

def token_pieces(docs: DataFrame, definition: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids, each document closed by the separator; only longer documents are cut."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = TokenIds(shared.value)
        close, width = np.uint32(SEPARATOR).tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encode(batch["_text"].tolist()), strict=True):
                ids = ids.astype("<u4").tobytes() + close
                rows += [
                    (doc_id, k, at // 4, (min(at + width, len(ids)) - at) // 4, zlib.crc32(ids[at : at + width]))
                    for k, at in enumerate(range(0, len(ids), width))
                ]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("_text")).mapInPandas(cut, PIECES)


# --- the plan for a histogram of lengths -------------------------------------------------------

Pattern = tuple[tuple[int, int], ...]  # (length, how many) in order


def _take(counts: dict[int, int], lengths: list[int], items: list[int], times: int) -> None:
    for x in items:
        counts[x] -= times
        if not counts[x]:
            del counts[x]
            lengths.pop(bisect_left(lengths, x))


def _largest(lengths: list[int], counts: dict[int, int], most: int, used: list[int]) -> int | None:
    """The largest length up to `most` of which a copy is left beside those used."""
    at = bisect_left(lengths, most + 1) - 1
    while at >= 0 and counts[lengths[at]] <= used.count(lengths[at]):
        at -= 1
    return lengths[at] if at >= 0 else None


def _smallest(lengths: list[int], counts: dict[int, int], but: int, n: int) -> list[int]:
    """The n smallest items left beside one of length `but`."""
    out: list[int] = []
    for x in lengths:
        out += [x] * min(n - len(out), counts[x] - (x == but))
        if len(out) == n:
            break
    return out


def dominating(lengths: list[int], counts: dict[int, int], first: int, capacity: int) -> list[int] | None:
    """A set with `first` that no other set with it can beat, or None if none of up to three items is known.

    Another set is beaten when its items can be shared out over the places of this one.
    """
    room = capacity - first
    one = _largest(lengths, counts, room, [first])
    if one is None:
        return [first]
    small = _smallest(lengths, counts, first, 3)
    if one == room or len(small) < 2 or small[0] + small[1] > room:
        return [first, one]
    if len(small) < 3 or sum(small) > room:  # two companions at most
        two = _largest(lengths, counts, min(one, room - one), [first, one])
        if two is not None:
            at = bisect_left(lengths, two + 1)
            if at == len(lengths) or 2 * lengths[at] > room:
                return [first, one, two]
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Martello and Toth's reduction on a histogram: fixed (pattern, times), and the lengths that stay open."""
    counts, fixed = dict(counts), []
    lengths = sorted(counts)
    changed = True
    while changed:
        changed = False
        for length in sorted(counts, reverse=True):
            while counts.get(length) and (items := dominating(lengths, counts, length, capacity)):
                times = min(counts[x] // items.count(x) for x in items)
                fixed.append((tuple((x, 1) for x in items), times))
                _take(counts, lengths, items, times)
                changed = True
    return fixed, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit in descending order on a histogram; equal bins are filled together."""
    bins: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if not bins.setdefault(room, []):
                insort(rooms, room)
            bins[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, pattern, times = capacity, (), left
            else:
                room = rooms[at]
                pattern, times = bins[room].pop()
                if not bins[room]:
                    rooms.pop(at)
            each = min(room // length, left)
            used = min(times, left // each)
            put(room - each * length, (*pattern, (length, each)), used)
            if room < capacity:
                put(room, pattern, times - used)
            left -= used * each
    return [x for of in bins.values() for x in of]


def places(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Intervals of ranks per length with the sequence and offset of their items, sorted by (length, first rank)."""
    rows, seen, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            at = seen.get(length, 0)
            rows.append((length, at, sequence, each, offset))
            seen[length] = at + each * times
            offset += length * each
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True))


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """(pattern, times) for a histogram of lengths; its cost depends on the capacity, not on the number of items."""
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


# --- the operator ------------------------------------------------------------------------------


def pack(docs: DataFrame, definition: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents into sequences of at most `capacity` ids.

    `definition` is a tokenizer's JSON. Pieces are staged; the driver reads how many there are of each length
    (`capacity` rows at most), and plans patterns of lengths with how often each is used: sets that dominate all others
    with their longest piece are fixed first, the rest goes by best fit. A piece finds its place by its rank among
    those of its length, counted over range-partitioned rows; so no task holds all pieces of a common length, and the
    tables sent to the tasks are bounded by the capacity.

    Null and empty texts are a separator alone. Rows that repeat a doc_id or text are packed each. Other columns than
    doc_id and text are not read. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.write(token_pieces(docs, definition, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    shared = spark.sparkContext.broadcast(places(pack_plan(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = shared.value
        key = table["length"] << 48 | table["rank"]
        at = np.searchsorted(key, length.to_numpy() << 48 | rank.to_numpy(), side="right") - 1
        turn = rank.to_numpy() - table["rank"][at]
        each = table["each"][at]
        offset = table["offset"][at] + turn % each * length.to_numpy()
        return pd.DataFrame({"sequence_id": table["sequence"][at] + turn // each, "offset": offset})

    rows = ranked(pieces, ["length"], ["doc_id", "piece"], scratch, "_rank")
    scratch.drop(pieces)
    return rows.withColumn("_place", place("length", "_rank")).select(*pieces.columns, "_place.*")
