"""Near-duplicate texts: an exact Jaccard join of shingle sets by a partition of the universe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logcompact.llm.components import components
from logcompact.llm.common import parallelism, ranked
from logcompact.llm.embedding_dedup import roots
from logcompact.llm.shingles import shingle_sets
from logcompact.llm.wordkeys import mixed
from logcompact.session import Scratch

#: Link where PERCENT of the union is shared. With it, sizes n <= N can differ in (n + N) * (100 - P) / (100 + P) elements.
PERCENT = 75
#: Sets up to so many shingles are indexed by single shingles; above, bands double.
SMALL = 24
#: One-deletion neighbourhoods are indexed in bands up to so many shingles.
DELETIONS = 192
#: A signature met so often in one buffer of a task is hot.
HOT, BUFFER = 64, 700_000
#: A signature of more sets than this is not joined by pairs: its sets are compared in blocks of FAMILY_BLOCK sets.
CROWD, FAMILY_BLOCK = 48, 1024
#: Columns of a dense product, and pairs of a sparse one, at once.
DENSE, SPARSE = 2048, 4_000_000
#: Sets that the driver holds at once in the last resort, and ids that are sent to every task.
AT_ONCE, SENT = 500, 1_000_000
OWN, PROBE = 0, 1  # roles of a row: in the scheme of its own band, or looking into the band below
DELETED, STARVED, KNOWN = 2, 4, 8  # marks: a deletion neighbour; of a set with too few segments; counted elsewhere
TAG_BITS, ROW = 36, np.dtype([("low", "<u4"), ("high", "u1"), ("owner", "<u8")])
HOT_ROW = np.dtype([*ROW.descr, ("home", "<u4")])  # rows that are not where their signature is at home


def differ(small: np.ndarray | int, large: np.ndarray | int, percent: int = PERCENT):
    """Most elements by which two linked sets of these sizes differ."""
    return (small + large) * (100 - percent) // (100 + percent)


def top_of_band(n: np.ndarray) -> np.ndarray:
    """Largest size in the band of n: SMALL, then doubling."""
    n = np.maximum(n, 1)
    return SMALL << np.ceil(np.log2(np.maximum(n / SMALL, 1)) - 1e-12).astype(np.int64)


def segments(top: np.ndarray, percent: int = PERCENT, spare: float = 1.0) -> np.ndarray:
    """Parts of the universe for a band: more than sets with partners above the band differ in, with some to spare.

    Of m segments, linked sets agree on m less those they differ in. Small ones may be empty, so there are a seventh more, and
    more by the root where chance moves counts most.
    """
    most = top * 100 / percent
    differing = (most + top) * (100 - percent) / (100 + percent)
    return np.maximum(np.ceil(differing * (1 + 0.14 * spare) + 1.5 * spare * np.sqrt(top)), 1).astype(np.int64)


def units_needed(n: np.ndarray, role: int, percent: int = PERCENT) -> np.ndarray:
    """Units a set must look up as the larger one of a pair: one more than the elements the pair can differ in."""
    if role == OWN:
        return differ(n, n, percent) + 1
    return differ(np.minimum(n, top_of_band(n) // 2), n, percent) + 1


def key_of(shingles: np.ndarray, seed: int = 0) -> int:
    """A sum of hashes that names a set."""
    return int(mixed(shingles ^ np.uint64(seed)).sum(dtype=np.uint64).view(np.int64)) if len(shingles) else 0


class Signer:
    """Signatures of sets: per segment a hash of the subset in it, and where bands are low, of its one-deletion neighbours."""

    def __init__(self, percent: int = PERCENT, spare: float = 1.0):
        self.percent, self.spare = percent, spare

    def scheme(self, sets, n, tops, role):
        """Rows (signature, row's set, tag) of the sets in the schemes of these bands, and segments each of them fills."""
        which = np.repeat(np.arange(len(n)), n)
        flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        salt = mixed(tops.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        single = tops == SMALL
        tag = np.uint64(role)
        alone = single[which]
        out = [(mixed(flat[alone] ^ salt[which[alone]]), which[alone], np.full(alone.sum(), tag))]
        filled = np.where(single, n, 0)
        which, flat = which[~alone], flat[~alone]
        if not len(flat):
            return out, filled
        m = np.where(single, 0, segments(tops, self.percent, self.spare))
        base = np.cumsum(m) - m
        segment = (mixed(flat ^ salt[which]) >> np.uint64(33)).astype(np.int64) % m[which]
        cell = base[which] + segment
        value = mixed(flat + salt[which])
        low = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(float), m.sum()).astype(np.uint64)
        high = np.bincount(cell, (value >> np.uint64(32)).astype(float), m.sum()).astype(np.uint64)
        total = low + (high << np.uint64(32))
        count = np.bincount(cell, minlength=m.sum())
        owner = np.repeat(np.arange(len(n)), m)
        place = mixed(np.arange(m.sum(), dtype=np.uint64) - base[owner].astype(np.uint64) + salt[owner])
        full = count > 0
        filled += np.bincount(owner[full], minlength=len(n))
        starved = ~single & (filled < units_needed(n, role, self.percent))
        mark = np.where(starved, np.uint64(STARVED), np.uint64(0))
        out.append((mixed(total[full] ^ place[full]), owner[full], tag | mark[owner[full]]))
        near = (tops <= DELETIONS)[which]
        if near.any():
            w, c = which[near], cell[near]
            out.append((mixed((total[c] - value[near]) ^ place[c]), w, tag | np.uint64(DELETED) | mark[w]))
            none = ~full & (tops <= DELETIONS)[owner]  # what a set with one shingle there may have as its neighbour
            out.append((mixed(place[none]), owner[none], tag | np.uint64(DELETED) | mark[owner[none]]))
        return out, filled

    def __call__(self, sets: list[np.ndarray]):
        """(signatures, owners as places in the list, tags), segments filled in both roles, units lacking even so."""
        n = np.array([len(s) for s in sets], dtype=np.int64)
        tops = top_of_band(n)
        own, filled = self.scheme(sets, n, tops, OWN)
        below = np.flatnonzero((tops > SMALL) & (n * self.percent <= tops // 2 * 100))
        probes, probed = self.scheme([sets[k] for k in below], n[below], tops[below] // 2, PROBE)
        filled_below = np.zeros(len(n), dtype=np.int64)
        filled_below[below] = probed
        rows = own + [(s, below[w], t) for s, w, t in probes]
        lacking = (n > 0) & self.lacks(n, tops, filled, OWN)
        lacking[below] |= self.lacks(n[below], tops[below] // 2, probed, PROBE)
        return [np.concatenate(x) for x in zip(*rows, strict=True)], filled, filled_below, lacking

    def lacks(self, n, tops, filled, role):
        each = np.where((tops > SMALL) & (tops <= DELETIONS), 2, 1)
        return (tops > SMALL) & (each * filled < units_needed(n, role, self.percent))


SIGNED = (
    "bucket int, data binary, doc_id long, n long, key long, key2 long, filled long, filled_below long, lacking boolean"
)
_SIGNED = pa.schema(
    [("bucket", pa.int32()), ("data", pa.binary()), *[(c, pa.int64()) for c in ("doc_id", "n", "key", "key2", "filled", "filled_below")],
     ("lacking", pa.bool_())]
)


def packed(bucket, signature, tag, owner, home=None) -> pa.RecordBatch:
    """One row per bucket with its rows as bytes: 36 bits of the signature, the tag, the owner, and the home if it differs."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    word = (signature[order] & np.uint64((1 << TAG_BITS) - 1)) << np.uint64(4) | tag[order].astype(np.uint64)
    rows = np.empty(len(word), dtype=ROW if home is None else HOT_ROW)
    if home is not None:
        rows["home"] = home[order]
    rows["low"], rows["high"], rows["owner"] = word & np.uint64(0xFFFFFFFF), word >> np.uint64(32), owner[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    data = [rows[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(rows)), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first], pa.int32()), pa.array(data, pa.binary()), *[pa.nulls(len(first), f.type) for f in list(_SIGNED)[2:]]],
        schema=_SIGNED,
    )


def sign(docs: DataFrame, buckets: int, percent: int, spare: float) -> DataFrame:
    """One row per document with the key of its set, and rows of signatures by bucket; each set is signed once a task."""

    def flush(parts) -> Iterator[pa.RecordBatch]:
        signature, owner, tag = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((owner, signature))
        signature, owner, tag = signature[order], owner[order], tag[order].astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
        length = np.diff(np.append(first, len(signature)))
        hot = np.repeat(length > HOT, length)
        home = (signature >> np.uint64(40)).astype(np.int64) % buckets
        if hot.any():  # known to be shared: spread by owner; one stands for them where the signature's other rows meet
            spread = buckets + (owner[hot] >> np.uint64(8)).astype(np.int64) % buckets
            yield packed(spread, signature[hot], tag[hot] | np.uint64(KNOWN), owner[hot], home[hot])
            keep = ~hot
            keep[first[length > HOT]] = True
            known = np.where(hot[keep], np.uint64(KNOWN), np.uint64(0))
            signature, owner, tag, home = signature[keep], owner[keep], tag[keep] | known, home[keep]
        yield packed(home, signature, tag, owner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen, parts, held = Signer(percent, spare), set(), [], 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            for chunk in _chunks(shingle_sets(texts)):
                keys = np.array([key_of(x) for x in chunk], dtype=np.int64)
                keys2 = np.array([key_of(x, 77) for x in chunk], dtype=np.int64)
                (signature, which, tag), filled, below, lacking = signer(chunk)
                n = np.array([len(x) for x in chunk], dtype=np.int64)
                new = np.zeros(len(chunk), dtype=bool)
                for k, key in enumerate(keys.tolist()):
                    if n[k] and key not in seen:
                        seen.add(key)
                        new[k] = True
                fresh = new[which]
                parts.append((signature[fresh], keys.view(np.uint64)[which[fresh]], tag[fresh]))
                held += len(parts[-1][0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(-1 - np.arange(at, at + len(chunk)) % buckets, pa.int32()), pa.nulls(len(chunk), pa.binary()), ids.slice(at, len(chunk)),
                     *[pa.array(x) for x in (n, keys, keys2, filled, below, lacking)]],
                    schema=_SIGNED,
                )
                at += len(chunk)
                if held > BUFFER:
                    yield from flush(parts)
                    parts, held = [], 0
                    if len(seen) > 1_000_000:
                        seen.clear()
        if held:
            yield from flush(parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNED)


def _chunks(sets: Iterator[np.ndarray], most: int = 120_000) -> Iterator[list[np.ndarray]]:
    out, held = [], 0
    for s in sets:
        out.append(s)
        held += len(s) + 1
        if held > most:
            yield out
            out, held = [], 0
    if out:
        yield out


MET = "signature long, owner long, tag int, doc_id long, n long, key long, key2 long, filled long, filled_below long, lacking boolean"


def meet(signed: DataFrame, buckets: int) -> DataFrame:
    """Rows of signatures that several sets have, one of them in its own band; document rows pass through."""

    def distinct(signature, owner, tag):
        order = np.lexsort((tag, owner, signature))
        signature, owner, tag = signature[order], owner[order], tag[order]
        bare = tag & ~KNOWN
        new = np.ones(len(order), dtype=bool)
        new[1:] = (signature[1:] != signature[:-1]) | (owner[1:] != owner[:-1]) | (bare[1:] != bare[:-1])
        return signature[new], owner[new], tag[new]

    def shared(signature, owner, tag):
        group = np.cumsum(np.concatenate([[True], signature[1:] != signature[:-1]])) - 1
        has = lambda mask: np.bincount(group, mask, minlength=group[-1] + 1) > 0
        other = np.concatenate([[False], (signature[1:] == signature[:-1]) & (owner[1:] != owner[:-1])])
        whole, starved = (tag & DELETED) == 0, has((tag & STARVED) > 0)
        useful = has(other) & has((tag & PROBE) == 0) & (has(whole) | starved) | has((tag & KNOWN) > 0)
        # deletion neighbours count only where a set with too few segments meets them
        keep = useful[group] & (whole | starved[group]) & ((tag & KNOWN) == 0)
        return signature[keep], owner[keep], tag[keep]

    def run(table: pa.Table) -> pa.Table:
        n, bucket = len(table), table.column("bucket")[0].as_py()
        if bucket < 0:
            rows = table.drop_columns(["bucket", "data"])
            for k, (name, kind) in enumerate((("signature", pa.int64()), ("owner", pa.int64()), ("tag", pa.int32()))):
                rows = rows.add_column(k, name, pa.nulls(n, kind))
            return rows
        rows = np.frombuffer(b"".join(table.column("data").to_pylist()), dtype=ROW if bucket < buckets else HOT_ROW)
        word = rows["low"].astype(np.uint64) | rows["high"].astype(np.uint64) << np.uint64(32)
        signature = (word >> np.uint64(4)) | (np.uint64(bucket) if bucket < buckets else rows["home"].astype(np.uint64)) << np.uint64(TAG_BITS)
        found = distinct(signature, rows["owner"], (word & np.uint64(15)).astype(np.int32))
        if bucket < buckets:
            found = shared(*found)
        signature, owner, tag = found
        out = {"signature": signature.view(np.int64), "owner": owner.view(np.int64), "tag": tag & ~np.int32(KNOWN)}
        out = {k: pa.array(v) for k, v in out.items()}
        return pa.table(out | {f.name: pa.nulls(len(signature), f.type) for f in list(_SIGNED)[2:]})

    return signed.groupBy("bucket").applyInArrow(run, MET)


SETS = "owner long, n long, shingles array<long>"


def sets_of(docs: DataFrame) -> DataFrame:
    """(owner, n, shingles) of rows (owner, text) whose text has the set so named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for chunk in _chunks(shingle_sets(batch.column(1).to_pylist())):
                n = np.array([len(x) for x in chunk], dtype=np.int64)
                flat = pa.array(np.concatenate(chunk).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), flat)
                owner = batch.column(0).slice(at, len(chunk))
                rows = pa.RecordBatch.from_arrays([owner, pa.array(n), lists], names=["owner", "n", "shingles"])
                yield rows.filter(pa.array(owner.to_numpy() == [key_of(x) for x in chunk]))
                at += len(chunk)

    return docs.select("owner", "text").mapInArrow(run, SETS)


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of owners whose sets share enough, counted on the sets themselves."""
    a = sets.select(F.col("owner").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("owner").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    enough = 100 * both >= percent * (F.col("na") + F.col("nb") - both)
    return pairs.join(b, "b").join(a, "a").where(enough).select("a", "b")


def intersections(a_of: np.ndarray, a: np.ndarray, n_a: int, b_of: np.ndarray, b: np.ndarray, n_b: int) -> np.ndarray:
    """How many shingles each set of one block shares with each of another; `a_of` tells whose each shingle is.

    Shingles that many sets have are columns of a dense product; those that few have add one to each of their few pairs.
    """
    column = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    col_a, col_b = column[: len(a)], column[len(a) :]
    size = int(column.max(initial=-1)) + 1
    f_a, f_b = np.bincount(col_a, minlength=size), np.bincount(col_b, minlength=size)
    pairs = f_a * f_b
    dense = pairs > n_a * n_b // 100
    out = np.zeros((n_a, n_b), dtype=np.float32)
    number = np.cumsum(dense) - 1
    for first in range(0, int(dense.sum()), DENSE):
        blocks = []
        for of, col, n in ((a_of, col_a, n_a), (b_of, col_b, n_b)):
            own = dense[col] & (number[col] >= first) & (number[col] < first + DENSE)
            block = np.zeros((n, DENSE), dtype=np.float32)
            block[of[own], number[col[own]] - first] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    few = ~dense & (pairs > 0)
    order = np.argsort(col_b, kind="stable")
    start = np.cumsum(f_b) - f_b
    mine = np.flatnonzero(few[col_a])
    ends = np.cumsum(f_b[col_a[mine]])
    at = 0
    while at < len(mine):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SPARSE)))
        some = mine[at:to]
        each = f_b[col_a[some]]
        turn = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        theirs = b_of[order[np.repeat(start[col_a[some]], each) + turn]]
        out += np.bincount(np.repeat(a_of[some], each) * n_b + theirs, minlength=n_a * n_b).reshape(n_a, n_b)
        at = to
    return out


PACKED = "family long, shard long, least long, most long, owners binary, sizes binary, shingles binary"


def family_links(families: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b) that join the linked sets of each family (owner, family), every two of its sets being compared.

    A family is cut into blocks by size, blocks whose sizes are too far apart are left out, and a task compares two blocks
    at a time. Only a spanning forest of the links it finds leaves it, so rows grow with the sets and not with their pairs.
    """
    spark = families.sparkSession
    own = families.join(sets.withColumnRenamed("owner", "_owner"), F.col("owner") == F.col("_owner")).drop("_owner")
    sized = scratch.write(own.select("family", "owner", "n"), "sized")
    placed = ranked(sized, ["family"], ["n", "owner"], scratch, "_rank")
    placed = placed.select("family", F.floor(F.col("_rank") / FAMILY_BLOCK).alias("shard"), F.col("owner").alias("_owner"))
    rows = placed.join(sets, F.col("owner") == F.col("_owner")).select("family", "shard", "owner", "n", "shingles")

    def pack(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        flat = table.column("shingles").combine_chunks().flatten().to_numpy()
        return pa.table({
            "family": table.column("family")[:1], "shard": table.column("shard")[:1], "least": [int(n.min())], "most": [int(n.max())],
            "owners": [table.column("owner").to_numpy().tobytes()], "sizes": [n.tobytes()], "shingles": [flat.tobytes()],
        })

    packed_sets = scratch.write(rows.groupBy("family", "shard").applyInArrow(pack, PACKED), "packed")
    ends = packed_sets.select("family", F.col("shard").alias("j"), "least", "most")
    pairs = packed_sets.select("family", F.col("shard").alias("i"), F.col("most").alias("_most")).join(ends, "family")
    pairs = pairs.where((F.col("i") <= F.col("j")) & (F.col("_most") * 100 >= F.col("least") * percent))
    data = ["owners", "sizes", "shingles"]
    a = packed_sets.select("family", F.col("shard").alias("i"), *[F.col(c).alias(f"a_{c}") for c in data])
    b = packed_sets.select("family", F.col("shard").alias("j"), *[F.col(c).alias(f"b_{c}") for c in data])
    both = pairs.select("family", "i", "j").repartition(parallelism(spark), "family", "i", "j").join(a, ["family", "i"]).join(b, ["family", "j"])
    both = both.select((F.col("i") == F.col("j")).alias("same"), *[f"a_{c}" for c in data], *[f"b_{c}" for c in data])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                read = lambda c, kind: np.frombuffer(batch.column(c)[k].as_py(), dtype=kind)  # noqa: B023, E731
                same = batch.column(0)[k].as_py()
                (oa, na, sa), (ob, nb, sb) = ((read(c, np.int64), read(c + 1, np.int64), read(c + 2, np.int64)) for c in (1, 4))
                shared = intersections(np.repeat(np.arange(len(na)), na), sa, len(na), np.repeat(np.arange(len(nb)), nb), sb, len(nb))
                link = 100 * shared >= percent * (na[:, None] + nb[None, :] - shared)
                x, y = np.nonzero(np.triu(link, 1) if same else link)
                owners = oa if same else np.concatenate([oa, ob])
                root = roots(len(owners), x, y if same else len(oa) + y)
                tied = np.flatnonzero(root != np.arange(len(owners)))
                yield pa.RecordBatch.from_arrays([pa.array(owners[tied]), pa.array(owners[root[tied]])], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def from_lacking(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links of the few sets that no allocation serves: blocks of them against all documents.

    It needs many shingles of one text in very few segments, so there are next to none whatever the input; all the same
    they are counted, and served however many there are.
    """
    todo = classes.where("lacking").select("owner", "doc")
    ids = [(r["owner"], r["doc"]) for r in todo.toLocalIterator()]
    out = docs.sparkSession.createDataFrame([], "a long, b long")
    for k in range(0, len(ids), AT_ONCE):
        owners = dict((d, o) for o, d in ids[k : k + AT_ONCE])
        rows = docs.where(F.col("doc_id").isin(list(owners))).select("doc_id", "text").dropDuplicates(["doc_id"]).collect()
        block = {owners[r["doc_id"]]: s for r, s in zip(rows, shingle_sets([r["text"] for r in rows]), strict=True)}

        def compare(batches, block=block):
            for batch in batches:
                found = []
                for key, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist()), strict=True):
                    for owner, t in block.items():
                        if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                            both = len(np.intersect1d(s, t, assume_unique=True))
                            if len(s) and 100 * both >= percent * (len(s) + len(t) - both):
                                found.append((owner, key_of(s)))
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

        out = out.union(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(compare, "a long, b long"))
    return out


def jaccard_components(docs: DataFrame, percent: int = PERCENT, spare: float = 1.0) -> DataFrame:
    """Groups of documents linked by shingle sets of Jaccard similarity of `percent` or more.

    Texts give sets of word shingles; equal sets are one class. The universe of shingles is cut by a hash into segments,
    more of them than two linked sets of a size band can differ in, so linked sets agree on some segment. A set is indexed
    by its subset in each segment, in the scheme of its band and, where partners reach below, in that of the band below.

    1. Signatures are packed by bucket, so one text costs 13 bytes for each; what only one set has ends there.
    2. Hubs: a sample of the shared signatures links each set with the smallest it meets; verified links give first groups.
       This settles large groups of near copies with one pair each.
    3. Allocation: a segment that no other group shares is a unit for nothing. A set that has as many of them as two
       linked sets can differ in, and one more, is proven to have no link outside its group. The others look up their
       cheapest segments until they have enough units; sets with too few segments use one-deletion neighbours too, and
       if even these don't suffice they are compared with all documents.
    4. Pairs found are verified on the sets, and the links joined to groups. A crowd, that is a signature of more than 48 sets that
       some set must look up, makes no pairs: sets that crowds tie together are a family, whose blocks are compared whole, and
       only a spanning forest of the links found leaves a task.

    Texts without words and null texts have no shingles and are linked with nothing; their doc_id is their group. Rows that
    repeat a doc_id or a text are one row each. Null doc_ids get the group of their text. Other columns are not read.
    `spare` below 1 is for tests: fewer segments. Returns doc_id, n_shingles, component_id, class_id (smallest doc_id of
    the equal sets).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    buckets = 4 * parallelism(spark)
    met = scratch.write(meet(sign(docs, buckets, percent, spare), buckets), "met")
    rows = met.where("n IS NOT NULL").select("doc_id", "n", "key", "key2", "filled", "filled_below", "lacking")
    shared = met.where("signature IS NOT NULL").select("signature", "owner", "tag")

    named = [F.first(c).alias(c) for c in ("n", "filled", "filled_below", "lacking")]
    checked = [F.min("key2").alias("lo"), F.max("key2").alias("hi")]
    classes = rows.where("n > 0").groupBy(F.col("key").alias("owner")).agg(F.min("doc_id").alias("doc"), *named, *checked)
    classes = scratch.write(classes, "classes")
    if classes.where("lo <> hi").limit(1).count():
        raise RuntimeError("two different sets have one 64-bit key: seed key_of anew")

    n, role, whole = F.col("n"), F.col("tag").bitwiseAND(PROBE), F.col("tag").bitwiseAND(DELETED) == 0
    has = F.when(F.col("role") == OWN, F.col("filled")).otherwise(F.col("filled_below"))
    needed = _differ(F.when(F.col("role") == OWN, n).otherwise(F.least(n, (_top(n) / 2).cast("long"))), n, percent) + 1
    at_all = F.when(F.col("role") == OWN, _differ(n, F.floor(n * 100 / percent), percent) + 1).otherwise(needed)

    # 2. which sets can have links at all, and their shingles
    spent = shared.groupBy("owner", role.alias("role")).agg(F.sum(whole.cast("int")).alias("cost"))
    spent = spent.join(classes, "owner").where(at_all > has - F.col("cost"))
    opened = scratch.write(spent.select("owner", "doc", "n", "filled", "filled_below").distinct(), "open")
    some = opened.select(F.col("owner"), F.col("doc"))
    some = F.broadcast(some) if opened.count() <= SENT else some
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(some, F.col("_id").eqNullSafe(F.col("doc")))
    sets = scratch.write(sets_of(texts), "sets")

    part = shared.where((F.col("tag") == OWN) & (F.pmod(F.xxhash64("signature"), F.lit(8)) == 0))
    part = part.join(opened.select("owner"), "owner", "left_semi")
    hubs = part.groupBy("signature").agg(F.min("owner").alias("hub"))
    best = part.join(hubs, "signature").where("owner <> hub").groupBy("owner", "hub").count()
    best = best.groupBy("owner").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    first = scratch.write(linked(best.select(F.col("owner").alias("a"), F.col("hub").alias("b")), sets, percent), "first")
    groups = scratch.write(components(first, scratch), "groups")

    # 3. what other groups share, and whom that leaves with too few free units
    facts = opened.join(groups, F.col("owner") == F.col("node"), "left").select(
        "owner", "n", "filled", "filled_below", F.coalesce("component", "owner").alias("group")
    )
    met_rows = shared.join(facts, "owner").withColumn("role", role)
    stats = met_rows.groupBy("signature").agg(
        F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("size"), F.min("owner").alias("head")
    )
    costly = scratch.write(met_rows.join(stats.where("lo <> hi"), "signature").drop("lo", "hi"), "costly")
    lack = costly.groupBy("owner", "role").agg(
        F.sum(whole.cast("int")).alias("cost"), *[F.first(c).alias(c) for c in ("n", "filled", "filled_below")]
    )
    lack = lack.select("owner", "role", (needed - has + F.col("cost")).alias("want")).where("want > 0")
    cheapest = Window.partitionBy("owner", "role").orderBy(~whole, "size", "signature")
    starved = F.col("tag").bitwiseAND(STARVED) != 0
    looked = costly.join(lack, ["owner", "role"]).withColumn("_rank", F.row_number().over(cheapest))
    looked = looked.where((whole & (F.col("_rank") <= F.col("want"))) | starved).select(
        "signature", F.col("owner").alias("a"), F.col("n").alias("na"), F.col("group").alias("ga"), starved.alias("all"), "size", "head"
    )
    looked = scratch.write(looked, "looked")
    crowded = F.col("size") > CROWD
    # a crowd's sets are tied to its first set; the many crowds of one family have few such heads
    heads = looked.where(crowded).select("head").distinct()
    ties = costly.where(crowded).select("owner", "head").distinct().join(heads, "head", "left_semi")
    ties = ties.select(F.col("owner").alias("a"), F.col("head").alias("b"))
    families = components(ties, scratch).select(F.col("node").alias("owner"), F.col("component").alias("family"))
    third = scratch.write(family_links(scratch.write(families, "families"), sets, scratch, percent), "third")
    looked = looked.where(~crowded)
    index = costly.where((F.col("role") == OWN) & ~crowded).select(
        "signature", F.col("owner").alias("b"), F.col("n").alias("nb"), F.col("group").alias("gb"), whole.alias("whole")
    )
    pairs = looked.join(index, "signature").where("ga <> gb AND nb <= na AND (whole OR all)")
    pairs = pairs.where(F.col("nb") * 100 >= F.col("na") * percent)
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    second = linked(pairs, sets, percent).union(third).union(from_lacking(docs, classes, percent))

    # 4. groups of all
    known = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    whole_groups = components(known.union(second), scratch)
    of_class = classes.join(whole_groups, F.col("owner") == F.col("node"), "left").select(
        "owner", "doc", F.coalesce("component", "owner").alias("group")
    )
    smallest = of_class.groupBy("group").agg(F.min("doc").alias("component_id"))
    of_class = of_class.join(smallest, "group").select("owner", "doc", "component_id")
    out = rows.join(of_class, (F.col("key") == F.col("owner")) & (F.col("n") > 0), "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("doc", "doc_id").alias("class_id"),
    )


def _differ(small, large, percent: int):
    return F.floor((small + large) * (100 - percent) / (100 + percent))


def _top(n):
    return (SMALL * F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n / SMALL, F.lit(1.0))) - 1e-12))).cast("long")
