"""Jaccard self-join of shingle sets with signature trees.

**Classes.** Documents with equal shingle sets form a class, found by a digest of the set. Only one
representative of a class goes on.

**Signature trees.** The sets of a block, in the order of their least hashes, are the leaves of a tree
whose nodes hold the bitwise OR of the token bitmaps and the range of set sizes below them. Two trees (or
one with itself) are traversed together. A pair of nodes is dropped if the size ranges cannot reach
the threshold, if even the largest possible overlap, bounded by the bits that both bitmaps have and
by shingles that share a bit, is too small, or if all sets below them are known to be connected already.
Pairs that remain are compared exactly, hash by hash.

**Hopeless sets.** A set with a link shares ``percent`` of its shingles with its partner. So a set of which more
shingles than the rest are in no other set has no link. Half of all shingles, chosen by hash, are counted: one that
stands alone there stands alone everywhere, so none is left out wrongly. Only sets with a chance are kept as a table.

**Blocks.** Two rounds find all links.

1. *Neighbours.* A few least hashes under different permutations group likely partners around the
   smallest id among them. Each group is joined in blocks of bounded size that all contain that centre.
   This connects nearly everything, but promises nothing.
2. *The rest, exactly.* If two sets reach the threshold, then, in any common order of shingles, the first
   ``size - ceil(threshold * size) + 1`` shingles of both have one in common. The order is rare
   shingles first: shingles that many documents share are ranked by their counts, others before them by
   hash. A shingle whose documents are all in one component of round 1 has nothing to add. The documents of
   every other shingle are cut into chunks; each pair of chunks that holds two components is a block of
   its own, so that no shingle, however frequent, meets in one task. These blocks are traversed with the
   signatures alone; full sets travel only for the few pairs that sizes and bitmaps let through. Before
   that, sets are judged hopeless once more, where now only shingles of other components count as shared.

Links found in both rounds give the components. A pair of sets that is already connected through others
is not compared, so groups of thousands of copies do not grow quadratically.

Shingle hashes have 64 bits, of which 40 travel. Frequent-shingle ranks and the bitmap of ids that limits the second reading
of texts have fixed sizes and influence cost only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.scratch import settled

from .bits import bit_table, packed_longs, slot_of, unpacked_longs
from .components import components
from .words import LOWER, SMALL_SLICE_BYTES, VISIBLE, find_words, hash_runs, mixed, shingle_hashes, slices

SHINGLE = 5
PERCENT = 75
PERMUTATIONS = 4
BLOCK_DOCS = 192
LEAF_DOCS = 8
BITS_A_SHINGLE = 4
RANKED_SHINGLES = 1 << 17
FREQUENT_IN_TASK = 4
#: Shingles among which a task counts the frequent ones at a time.
COUNTED_SHINGLES = 2_000_000
ID_BITS = 1 << 23
TOKENS_A_PART = 1_500_000
HOT_SHINGLE = 100_000
#: Shingles a task holds before it packs them for their parts.
HELD_SHINGLES = 400_000
#: Shingles whose rows the scan hands on at a time.
ROW_SHINGLES = 250_000
#: Rows of whole texts or sets that go to a Python worker at a time, and that it unpacks at a time.
BATCH_ROWS, PIECE_ROWS = 1_000, 200

_U = np.uint64


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every row of a text column."""
    for part in slices(column, SMALL_SLICE_BYTES):
        data = LOWER[part.data]
        words = find_words(data, part.offsets, VISIBLE)
        hashes = hash_runs(data, words.begin, words.end)
        keys, whole = shingle_hashes(hashes, words.rows, shingle)
        for r in range(part.last - part.first):
            lo, hi = int(words.rows[r]), int(words.rows[r + 1])
            if hi - lo >= shingle:
                yield part.first + r, np.unique(keys[lo:hi][whole[lo:hi]])
            elif hi > lo:
                short, _ = shingle_hashes(hashes[lo:hi], np.array([0, hi - lo]), hi - lo)
                yield part.first + r, short[:1]
            else:
                yield part.first + r, np.zeros(0, dtype=_U)


def packed_set(hashes: np.ndarray) -> bytes:
    """The low 40 bits of every hash: what travels of a set. Two sets of 500 shingles then take two different
    shingles for one about once in four million pairs."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked_in_order(body: bytes) -> np.ndarray:
    """40-bit hashes as they were packed."""
    wide = np.zeros((len(body) // 5, 8), dtype=np.uint8)
    wide[:, :5] = np.frombuffer(body, dtype=np.uint8).reshape(-1, 5)
    return wide.view(_U).ravel()


def unpacked_set(body: bytes) -> np.ndarray:
    """Sorted 40-bit hashes."""
    return np.sort(unpacked_in_order(body))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def signature(hashes: np.ndarray) -> bytes:
    """Bitmap of a set with four to eight bits a shingle; the number of bits is a power of two."""
    bits = 1 << max(6, (BITS_A_SHINGLE * len(hashes) - 1).bit_length())
    marks = np.zeros(bits, dtype=bool)
    marks[(hashes & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


class SignatureTree:
    """Leaves of a few sets each, nodes of two children, level by level from the leaves up.

    Bitmaps of different lengths are repeated up to the longest: a shingle's bit is its hash modulo the
    length, so a repeated bitmap still has every bit that the longer one would have.
    """

    def __init__(self, bitmaps: list[bytes], sizes: np.ndarray, labels: np.ndarray, width: int):
        packed = np.empty((len(bitmaps), width), dtype=np.uint8)
        #: How many shingles share bits with others: those can all lie in one overlap.
        self.surplus = np.empty(len(bitmaps), dtype=np.int64)
        for i, bitmap in enumerate(bitmaps):
            own = np.frombuffer(bitmap, dtype=np.uint8)
            self.surplus[i] = sizes[i] - int(np.bitwise_count(own).sum())
            packed[i] = np.tile(own, width // len(own))
        self.bitmap, self.sizes, self.labels = packed.view(_U), sizes, labels
        starts = np.arange(0, len(bitmaps), LEAF_DOCS)
        self.levels = [self._level((self.bitmap, sizes, sizes, self.surplus, labels, labels), starts)]
        while len(self.levels[-1][1]) > 1:
            self.levels.append(self._level(self.levels[-1], np.arange(0, len(self.levels[-1][1]), 2)))

    @staticmethod
    def _level(below, starts):
        bits, low, high, spare, least, most = below
        return (
            np.bitwise_or.reduceat(bits, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts),
            np.maximum.reduceat(spare, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts),
        )

    def children(self, level: int, node: int) -> list[int]:
        return [c for c in (2 * node, 2 * node + 1) if c < len(self.levels[level - 1][1])]

    def leaf(self, node: int) -> slice:
        return slice(node * LEAF_DOCS, min(len(self.sizes), (node + 1) * LEAF_DOCS))


def _possible(low_a, high_a, low_b, high_b, shared, percent: int):
    """Whether sets of sizes in the two ranges, with at most ``shared`` common shingles, may be linked."""
    sized = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    return sized & ((100 + percent) * shared >= percent * (low_a + low_b))


class _Union:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, label: int) -> int:
        while (up := self.parent.get(label, label)) != label:
            label = up
        return label

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def dual_links(left: SignatureTree, right: SignatureTree | None, percent: int, verify=None) -> list[tuple[int, int]]:
    """Pairs of two trees, or within one, with different labels.

    With ``verify(i, j)``: links, as many as connect what can be connected. Without: every pair that the
    signatures let through.
    """
    same = right is None
    right = left if same else right
    union, found = _Union(), []
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        level_a, a, level_b, b = stack.pop()
        bits_a, low_a, high_a, spare_a, least_a, most_a = left.levels[level_a]
        bits_b, low_b, high_b, spare_b, least_b, most_b = right.levels[level_b]
        itself = same and level_a == level_b and a == b
        if min(least_a[a], least_b[b]) == max(most_a[a], most_b[b]):
            continue
        if not itself:
            common = int(np.bitwise_count(bits_a[a] & bits_b[b]).sum())
            shared = min(common + min(int(spare_a[a]), int(spare_b[b])), int(high_a[a]), int(high_b[b]))
            if not _possible(int(low_a[a]), int(high_a[a]), int(low_b[b]), int(high_b[b]), shared, percent):
                continue
        if level_a == 0 and level_b == 0:
            at, bt = left.leaf(a), right.leaf(b)
            n, m = left.sizes[at, None], right.sizes[None, bt]
            common = np.bitwise_count(left.bitmap[at, None, :] & right.bitmap[None, bt, :]).sum(axis=2, dtype=np.int64)
            shared = np.minimum(common + np.minimum(left.surplus[at, None], right.surplus[None, bt]), np.minimum(n, m))
            hit = _possible(n, n, m, m, shared, percent) & (left.labels[at, None] != right.labels[None, bt])
            if itself:
                hit = np.triu(hit, 1)
            for i, j in np.argwhere(hit).tolist():
                i, j = i + at.start, j + bt.start
                if verify is None:
                    found.append((i, j))
                    continue
                one, two = int(left.labels[i]), int(right.labels[j])
                if union.find(one) != union.find(two) and verify(i, j):
                    union.join(one, two)
                    found.append((i, j))
        elif itself:
            below = left.children(level_a, a)
            stack.extend((level_a - 1, c, level_a - 1, d) for c in below for d in below if c <= d)
        elif level_a >= level_b:
            stack.extend((level_a - 1, c, level_b, b) for c in left.children(level_a, a))
        else:
            stack.extend((level_a, a, level_b - 1, c) for c in right.children(level_b, b))
    return found


def _block_pairs(rows: list[tuple], percent: int, exact: bool) -> list[tuple[int, int]]:
    """Of one block's rows ``(side, id, label, n, body)``: pairs of ids. ``body``: hashes or a signature."""
    sides = []
    for side in (0, 1):
        own = [r for r in rows if r[0] == side]
        if not own:
            continue
        sets = [unpacked_set(r[4]) for r in own] if exact else None
        bitmaps = [signature(x) for x in sets] if exact else [r[4] for r in own]
        labels = np.array([r[2] for r in own])
        _, which, members = np.unique(labels, return_inverse=True, return_counts=True)
        # What is connected already stands together, everything else by its first bits or hashes.
        group = np.where(members[which] > 1, which, -1)
        order = sorted(range(len(own)), key=lambda i: (group[i], sets[i][:3].tolist() if exact else own[i][4][:24], own[i][1]))
        sides.append(([own[i][1] for i in order], [bitmaps[i] for i in order], np.array([own[i][3] for i in order]), labels[order], [sets[i] for i in order] if exact else None))
    if not sides:
        return []
    width = max(len(x) for side in sides for x in side[1])
    trees = [SignatureTree(bitmaps, sizes, labels, width) for _, bitmaps, sizes, labels, _ in sides]
    left, right = sides[0], sides[-1]
    verify = (lambda i, j: linked(left[4][i], right[4][j], percent)) if exact else None
    pairs = dual_links(trees[0], trees[1] if len(trees) > 1 else None, percent, verify)
    return [(left[0][i], right[0][j]) for i, j in pairs]


def _pairs_of_blocks(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """``(a, b)`` from rows ``(block, side, id, label, n, body)``: one block after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def out():
            pairs = _block_pairs(held, percent, exact)
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"]
            )

        names = ("block", "side", "id", "label", "n", "body")
        for piece in (b.slice(i, PIECE_ROWS) for b in batches for i in range(0, b.num_rows, PIECE_ROWS)):
            for row in zip(*(piece.column(c).to_pylist() for c in names), strict=True):
                if row[0] != block:
                    if len(held) > 1:
                        yield out()
                    block, held = row[0], []
                # Of rows with one id the largest set comes first and speaks for all.
                if not held or held[-1][:2] != row[1:3]:
                    held.append(row[1:])
        if len(held) > 1:
            yield out()

    dealt = rows.repartition("block").sortWithinPartitions("block", "side", "id", F.desc("n"), F.desc("digest"))
    return dealt.select("block", "side", "id", "label", "n", "body").mapInArrow(run, "a bigint, b bigint")


def _scan(docs: DataFrame, shingle: int) -> DataFrame:
    """One row per document: size, digest, signature and least hashes; and the frequent shingles of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "digest", "signature", "least", "key", "count"]
        seen_keys, seen_counts = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
        pending, held = [], 0

        def counted():
            new = np.concatenate(pending)
            pending.clear()
            new.sort()
            # A key that stands there n times is equal to the one ``more`` places on n - more times.
            more = FREQUENT_IN_TASK - 1
            first = new[: max(0, len(new) - more)]
            new, n = np.unique(first[first == new[more:]], return_counts=True)
            n += more
            kinds, where = np.unique(np.append(seen_keys, new), return_inverse=True)
            return kinds, np.bincount(where, weights=np.append(seen_counts, n), minlength=len(kinds)).astype(np.int64)

        for batch in batches:
            ids, sets, sizes, digests, signatures = [], [], [], [], []
            waiting = 0
            for row, keys in shingle_sets(batch.column("text"), shingle):
                ids.append(row)
                sets.append(keys)
                sizes.append(len(keys))
                digests.append(blake2b(keys.tobytes(), digest_size=16).digest() if len(keys) else None)
                signatures.append(signature(keys) if len(keys) else None)
                held += len(keys)
                waiting += len(keys)
                if held > COUNTED_SHINGLES or waiting > ROW_SHINGLES:
                    pending.extend(sets)
                    yield rows_of(batch, ids, sets, sizes, digests, signatures, names)
                    ids, sets, sizes, digests, signatures = [], [], [], [], []
                    waiting = 0
                if held > COUNTED_SHINGLES:
                    seen_keys, seen_counts = counted()
                    held = 0
            pending.extend(sets)
            yield rows_of(batch, ids, sets, sizes, digests, signatures, names)
        if held:
            seen_keys, seen_counts = counted()
        n = len(seen_keys)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
             pa.nulls(n, pa.list_(pa.int64())), pa.array(seen_keys.astype(np.int64)), pa.array(seen_counts)],
            names=names,
        )

    def rows_of(batch, ids, sets, sizes, digests, signatures, names):
        n, filled = len(ids), [i for i, k in enumerate(sizes) if k]
        least = [[] for _ in ids]
        if filled:
            every = np.concatenate([sets[i] for i in filled])
            ends = np.cumsum([sizes[i] for i in filled])
            starts = ends - [sizes[i] for i in filled]
            lows = [np.minimum.reduceat(mixed(every ^ _U(7919 * (k + 1))), starts).astype(np.int64) for k in range(PERMUTATIONS)]
            for i, values in zip(filled, np.stack(lows, axis=1).tolist(), strict=True):
                least[i] = values
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(signatures, pa.binary()), pa.array(least, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
            names=names,
        )

    return docs.mapInArrow(
        run, "id bigint, n bigint, digest binary, signature binary, least array<bigint>, key bigint, count bigint"
    )


def _with_bit(docs: DataFrame, wanted: DataFrame):
    """``docs`` with a slot, and a filter of batches that keeps wanted ids and the few others that share their bit."""
    table = bit_table(wanted, slot_of(ID_BITS, "id"), ID_BITS)

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots = batch.column("slot").to_numpy()
        return batch.filter(pa.array(((table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1) == 1))

    return docs.withColumn("slot", slot_of(ID_BITS, "id")), kept


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(id, n, digest, body)``: the sets of ``wanted(id, n, digest)``, once each."""
    rows, kept = _with_bit(docs, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(kept, batches):
            ids, sets, digests, size = [], [], [], 0
            for row, keys in shingle_sets(batch.column("text"), shingle):
                ids.append(row)
                sets.append(packed_set(keys))
                digests.append(blake2b(keys.tobytes(), digest_size=16).digest())
                size += len(sets[-1])
                if size > 1 << 23:
                    yield rows_of(batch, ids, sets, digests)
                    ids, sets, digests, size = [], [], [], 0
            if ids:
                yield rows_of(batch, ids, sets, digests)

    def rows_of(batch, ids, sets, digests):
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(ids)), pa.array([len(x) // 5 for x in sets], pa.int64()),
             pa.array(digests, pa.binary()), pa.array(sets, pa.binary())],
            names=["id", "n", "digest", "body"],
        )

    sets = rows.mapInArrow(run, "id bigint, n bigint, digest binary, body binary")
    return sets.join(wanted.select("id", "n", "digest"), ["id", "n", "digest"]).groupBy("id", "n", "digest").agg(F.first("body").alias("body"))


def _dealt(sets: Iterator[tuple[int, int, np.ndarray]], hot: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Half of the 40-bit shingles of ``(id, label, shingles)``, packed by part; those in ``hot`` stay behind."""
    held, waiting = [], 0

    def out():
        keys = np.concatenate([x[2] for x in held])
        lengths = [len(x[2]) for x in held]
        ids, labels = (np.repeat(np.array([x[i] for x in held], dtype=np.int64), lengths) for i in (0, 1))
        place = mixed(keys)
        chosen = (place & _U(1)) == 0
        if len(hot):
            chosen &= hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] != keys
        part = ((place[chosen] >> _U(1)) % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        keys, ids, labels = keys[chosen][order], ids[chosen][order], labels[chosen][order]
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        filled = [(p, slice(edges[p], edges[p + 1])) for p in range(parts) if edges[p + 1] > edges[p]]
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in filled], pa.int64()), pa.array([packed_set(keys[x]) for _, x in filled], pa.binary()),
             pa.array([packed_longs(ids[x]) for _, x in filled], pa.binary()),
             pa.array([None if np.array_equal(ids[x], labels[x]) else packed_longs(labels[x]) for _, x in filled], pa.binary())],
            names=["part", "keys", "ids", "labels"],
        )

    for row in sets:
        held.append(row)
        waiting += len(row[2])
        if waiting > HELD_SHINGLES:
            yield out()
            held, waiting = [], 0
    if waiting:
        yield out()


def _alone(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one part: how many shingles of every id are in sets of one label only, packed for the ids' own parts."""
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for key, id_, label in zip(*(batch.column(c) for c in ("keys", "ids", "labels")), strict=True):
                own = unpacked_longs(id_.as_py())
                held.append((unpacked_in_order(key.as_py()), own, unpacked_longs(label.as_py()) if label.is_valid else own))
        if not held:
            return
        keys, ids, labels = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        lengths = np.diff(np.append(starts, len(keys)))
        del keys
        labels = labels[order]
        single = np.minimum.reduceat(labels, starts) == np.maximum.reduceat(labels, starts)
        del labels
        own, alone = np.unique(ids[order[np.repeat(single, lengths)]], return_counts=True)
        target = (mixed(own.view(_U)) % _U(parts)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        own, alone = own[order], alone[order].astype(np.int32)
        edges = np.searchsorted(target[order], np.arange(parts + 1))
        filled = np.flatnonzero(np.diff(edges))
        packed = [pa.array([x[edges[p] : edges[p + 1]].tobytes() for p in filled], pa.binary()) for x in (own, alone)]
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), *packed], names=["part", "ids", "alone"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of one part's ids, added up over all tasks that sent some."""
    found = [(x.as_buffer(), y.as_buffer()) for b in batches for x, y in zip(b.column("ids"), b.column("alone"))]
    if found:
        ids = np.concatenate([np.frombuffer(x, dtype=np.int64) for x, _ in found])
        own, where = np.unique(ids, return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([np.frombuffer(y, dtype=np.int32) for _, y in found]))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total.astype(np.int64))], names=["id", "alone"])


def _parts(spark, shingles: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // (4 * TOKENS_A_PART)))


def _with_a_chance(dealt: DataFrame, sets: DataFrame, parts: int, percent: int) -> DataFrame:
    """The ``sets(id, n, ...)`` whose shingles that stand alone leave room for a link, and those whose id has several rows."""
    part = F.col("part").cast("int")
    packed = dealt.repartitionById(parts, part).mapInArrow(_alone(parts), "part int, ids binary, alone binary")
    alone = packed.repartitionById(parts, part).mapInArrow(_added, "id bigint, alone bigint")
    hopeless = 100 * F.coalesce("alone", F.lit(0)) > (100 - percent) * F.col("n")
    return sets.join(alone, "id", "left").filter(~hopeless | F.col("repeated")).select(sets.columns)


def _text_shingles(docs: DataFrame, reps: DataFrame, hot: np.ndarray, shingle: int, parts: int) -> DataFrame:
    """Packed shingles of all representatives, each its own label."""
    rows, kept = _with_bit(docs, reps)
    low = _U((1 << 40) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets():
            for batch in map(kept, batches):
                numbers = batch.column("id").to_pylist()
                for row, keys in shingle_sets(batch.column("text"), shingle):
                    yield numbers[row], numbers[row], keys & low

        yield from _dealt(sets(), hot, parts)

    return rows.mapInArrow(run, "part bigint, keys binary, ids binary, labels binary")


def _set_shingles(sets: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """Packed shingles of ``sets(id, label, body)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpacked():
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("id", "label", "body"))
                for number, label, body in zip(*columns, strict=True):
                    yield number, label, unpacked_in_order(body)

        yield from _dealt(unpacked(), hot, parts)

    return sets.select("id", "label", "body").mapInArrow(run, "part bigint, keys binary, ids binary, labels binary")


def _linked_blocks(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` within ``blocks(block, side, id, label)``."""
    return _pairs_of_blocks(settled(blocks).join(sets.select("id", "n", "digest", "body"), "id"), percent, exact=True)


def _chunk_pairs(rows: DataFrame) -> DataFrame:
    """``rows(key, id, label)``: pairs of chunks of every key that hold two labels, as blocks.

    Chunks have a bounded size. A label of many rows has a home of its own, the others of a key are dealt to as many homes
    as they need, and a home with too many rows is divided again. So the parts of a large label meet what has other
    labels, but not each other, and pairs of chunks with one label need no block.
    """
    large = F.col("in_label") > F.lit(BLOCK_DOCS // 2)
    counted = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("in_label"))
    totals = counted.groupBy("key").agg(
        F.sum(F.when(~large, F.col("in_label")).otherwise(0)).alias("loose"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    shared_home = F.pmod(F.xxhash64("label"), F.greatest(F.lit(1), F.ceil(F.col("loose") / F.lit(BLOCK_DOCS))))
    home = F.struct(large.alias("large"), F.when(large, F.col("label")).otherwise(shared_home).alias("number"))
    labels = counted.join(totals.filter("low < high"), "key").select("key", "label", home.alias("home"))
    homed = rows.join(labels, ["key", "label"]).select("key", "id", "label", "home")
    homes = homed.groupBy("key", "home").agg(F.count(F.lit(1)).alias("in_home"))
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("in_home") / F.lit(BLOCK_DOCS))).cast("int")
    chunked = settled(homed.join(homes, ["key", "home"]).select("key", "id", "label", F.struct("home", part.alias("part")).alias("chunk")))
    facts = chunked.groupBy("key", "chunk").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    other = facts.select("key", F.col("chunk").alias("chunk2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = facts.join(other, "key").filter("chunk <= chunk2 AND least(low, low2) < greatest(high, high2)")
    pairs = pairs.select("key", "chunk", "chunk2", F.xxhash64("key", "chunk", "chunk2").alias("block"))
    sides = pairs.select("key", "chunk", "block", F.lit(0).alias("side")).unionByName(
        pairs.filter("chunk < chunk2").select("key", F.col("chunk2").alias("chunk"), "block", F.lit(1).alias("side"))
    )
    return chunked.join(sides, ["key", "chunk"]).select("block", "side", "id", "label")


def _labelled(rows: DataFrame, connected: DataFrame) -> DataFrame:
    """``rows`` with the component of ``id`` as ``label``."""
    return rows.join(connected, rows["id"] == connected["node"], "left").select(
        *rows.columns, F.coalesce("component", "id").alias("label")
    )


def _likely_blocks(blocks: DataFrame, reps: DataFrame, connected: DataFrame, percent: int) -> DataFrame:
    """Blocks of the pairs within ``blocks`` that sizes and signatures let through.

    Documents are dealt to chunks by the least component among their own and their partners', so that
    what belongs to one dense group shares few chunks. Every pair of chunks with a likely pair is a block,
    and holds only documents of such pairs: a set travels once per block, and never more often than it
    has partners.
    """
    rows = blocks.join(reps.select("id", "n", "digest", F.col("signature").alias("body")), "id")
    pairs = settled(_pairs_of_blocks(rows, percent, exact=False).distinct())
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = _labelled(ends.select(F.col("a").alias("id")).distinct(), connected)
    near = ends.join(own.select(F.col("id").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
    placed = settled(
        own.join(near, own["id"] == near["a"]).select(
            "id", "label", F.least("label", "other").alias("anchor"), (F.col("label") <= F.col("other")).alias("main")
        )
    )
    sizes = placed.groupBy("anchor", "main").agg(F.count(F.lit(1)).alias("rows"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / F.lit(BLOCK_DOCS)))
    chunked = settled(placed.join(sizes, ["anchor", "main"]).select("id", "label", F.xxhash64("anchor", "main", part).alias("chunk")))
    one = chunked.select(F.col("id").alias("a"), F.col("label").alias("label_a"), F.col("chunk").alias("chunk_a"))
    two = chunked.select(F.col("id").alias("b"), F.col("label").alias("label_b"), F.col("chunk").alias("chunk_b"))
    met = pairs.join(one, "a").join(two, "b")
    low, high = F.least("chunk_a", "chunk_b"), F.greatest("chunk_a", "chunk_b")

    def member(c: str):
        return F.struct((F.col(f"chunk_{c}") > low).cast("int").alias("side"), F.col(c).alias("id"), F.col(f"label_{c}").alias("label"))

    return met.select(F.xxhash64(low, high).alias("block"), F.explode(F.array(member("a"), member("b"))).alias("m")).select(
        "block", "m.side", "m.id", "m.label"
    ).distinct()


def _neighbour_blocks(reps: DataFrame) -> DataFrame:
    """Likely partners around a centre, in blocks of bounded size that all contain the centre."""
    keyed = reps.select("id", F.posexplode("least").alias("k", "value"))
    centres = keyed.groupBy("k", "value").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    around = keyed.join(centres, ["k", "value"]).filter("id <> centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("votes"))
    # Every chunk of a centre gets a number; its size is bounded because chunks grow with the group.
    sizes = around.groupBy("centre").agg(F.count(F.lit(1)).alias("rows"))
    chunked = around.join(sizes, "centre").select(
        "id", "centre", F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / F.lit(BLOCK_DOCS))).alias("chunk")
    )
    named = chunked.withColumn("block", F.xxhash64("centre", "chunk"))
    heads = named.select("block", F.col("centre").alias("id")).distinct()
    return named.select("block", "id").unionByName(heads).select(
        "block", F.lit(0).alias("side"), "id", F.col("id").alias("label")
    )


def _prefix_rows(sets: DataFrame, ranks: tuple[np.ndarray, np.ndarray], percent: int, parts: int) -> DataFrame:
    """The shingles of each of ``sets(id, label, body)`` of which partners have one in common, packed.

    Tasks hand packed arrays of (shingle, id, label) to one of ``parts`` parts by shingle.
    """
    ranked_keys, ranked_counts = ranks

    def packed(keys, ids, labels, sizes, rests):
        part = (mixed(keys) % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        filled = [p for p in range(parts) if edges[p + 1] > edges[p]]
        packers = (packed_set, packed_longs, packed_longs, packed_longs, np.ndarray.tobytes)
        columns = zip(packers, (keys, ids, labels, sizes, rests), strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(filled, pa.int64())]
            + [pa.array([pack(x[order[edges[p] : edges[p + 1]]]) for p in filled], pa.binary()) for pack, x in columns],
            names=["part", "keys", "ids", "labels", "sizes", "rests"],
        )

    def of(held):
        lengths = [len(x[0]) for x in held]
        same = (np.repeat(np.array([x[i] for x in held], dtype=np.int64), lengths) for i in (1, 2, 3))
        return packed(np.concatenate([x[0] for x in held]), *same, np.concatenate([x[4] for x in held]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting = 0
        for batch in batches:
            for number, label, body in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "body")), strict=True):
                own = unpacked_set(body)
                n = len(own)
                length = n - math.ceil(percent * n / 100) + 1
                rank = np.zeros(n, dtype=np.int64)
                if len(ranked_keys):
                    at = np.minimum(np.searchsorted(ranked_keys, own), len(ranked_keys) - 1)
                    hit = ranked_keys[at] == own
                    rank[hit] = ranked_counts[at[hit]]
                # Within a rank the order of hashes, which are sorted already.
                first = own[np.argsort(rank, kind="stable")[:length]]
                held.append((first, number, label, n, _rest(n, np.arange(length))))
                waiting += length
                if waiting > HELD_SHINGLES:
                    yield of(held)
                    held, waiting = [], 0
        if held:
            yield of(held)

    return sets.select("id", "label", "body").mapInArrow(run, "part bigint, keys binary, ids binary, labels binary, sizes binary, rests binary")


def _rest(n: int, places: np.ndarray) -> np.ndarray:
    """How many of ``n`` shingles stand at a place or after it, in steps of n / 255, rounded up to one byte."""
    return np.ceil((n - places) * (255 / n)).clip(0, 255).astype(np.uint8)


def _top_two(u1, l1, u2, v1, m1, v2):
    """Of two sides, each with its largest value, that value's label and the largest of other labels: the same of both."""
    first = u1 >= v1
    top, label = np.where(first, u1, v1), np.where(first, l1, m1)
    second = np.where(l1 == m1, np.maximum(u2, v2), np.where(first, np.maximum(u2, v1), np.maximum(u1, v2)))
    return top, label, second


def _partnered(starts, labels, sizes, rests, percent: int) -> np.ndarray:
    """Which rows may have a partner of another label in their shingle's group: by size, and by what can follow in the order.

    If the shingle is the first that two sets share, both must have enough shingles from it on. So a row has a
    largest size that its partner may have, its reach, and two rows may be partners if neither is larger than the other's
    reach. Rows come by group and, within it, by size: a row asks for the farthest reach of another label among the sizes that
    suit it, and ranges are answered from runs of 1, 2, 4, ... rows, whatever the size of a group.
    """
    n = len(sizes)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    reach = np.floor(((100 + percent) * (rests * sizes / 255 + 1e-6) - percent * sizes) / percent).astype(np.int64)
    step = int(sizes.max()) + 2
    place = group * step + sizes
    low = np.searchsorted(place, group * step + -(-percent * sizes // 100))
    most = np.minimum(np.minimum(100 * sizes // percent, reach), step - 1)
    high = np.searchsorted(place, group * step + np.maximum(most, 0), side="right")
    length = np.maximum(high - low, 0)
    kept = np.zeros(n, dtype=bool)
    asked = np.flatnonzero(length)
    level = np.frexp(length[asked])[1] - 1
    top, owner, second = reach, labels, np.full(n, -1, dtype=np.int64)
    for k in range(int(level.max()) + 1 if len(asked) else 0):
        rows = asked[level == k]
        left, right = low[rows], high[rows] - (1 << k)
        best, whose, other = _top_two(*(x[at] for at in (left, right) for x in (top, owner, second)))
        kept[rows] = np.where(whose == labels[rows], other, best) >= sizes[rows]
        if n > (half := 1 << k):
            top, owner, second = _top_two(top[:-half], owner[:-half], second[:-half], top[half:], owner[half:], second[half:])
    return kept


def _shared_keys(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Of one part: the shingles that documents of two labels have, with their documents."""
        unpack = {"keys": unpacked_in_order, "ids": unpacked_longs, "labels": unpacked_longs, "sizes": unpacked_longs}
        unpack["rests"] = lambda body: np.frombuffer(body, dtype=np.uint8).astype(np.int64)
        rows = [np.concatenate([f(x) for x in frame[c]]) for c, f in unpack.items()]
        order = np.lexsort((rows[3], rows[0]))
        keys, ids, labels, sizes, rests = (x[order] for x in rows)
        edge = np.append(True, keys[1:] != keys[:-1])
        keep = ~(edge & np.append(edge[1:], True))
        keys, ids, labels, sizes, rests = (x[keep] for x in (keys, ids, labels, sizes, rests))
        if len(keys):
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keep = _partnered(starts, labels, sizes, rests, percent)
            keys, ids, labels = keys[keep], ids[keep], labels[keep]
        if not len(keys):
            return pd.DataFrame({"key": [], "id": [], "label": []}, dtype="int64")
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.diff(np.append(starts, len(keys)))
        # Shingles with the same documents say the same; one of them goes on.
        spread = mixed(ids.view(_U))
        sums = np.stack([counts.astype(_U), np.add.reduceat(spread, starts), np.add.reduceat(mixed(spread), starts)])
        _, first = np.unique(sums, axis=1, return_index=True)
        picked = np.zeros(len(starts), dtype=bool)
        picked[first] = True
        rows = np.repeat(picked, counts)
        return pd.DataFrame({"key": keys[rows].astype(np.int64), "id": ids[rows], "label": labels[rows]})

    return run


def _rest_blocks(shared: DataFrame) -> DataFrame:
    """Pairs of chunks, of every shingle, that hold two components."""
    labelled = settled(shared)
    keys = labelled.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.hash("id")).alias("s"),
    ).filter("low < high")
    # Shingles with the same documents need one block between them.
    chosen = keys.groupBy("rows", "x", "s").agg(F.min("key").alias("key")).select("key")
    return _chunk_pairs(labelled.join(chosen, "key", "left_semi"))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While jobs run in it, rows go to Python workers in batches that suit rows of whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def jaccard_components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per distinct id: id, ``n_shingles`` (set size) and ``component_id``.

    Words are what white space (space, tab to carriage return) separates, with A-Z lower-cased. A
    document's set are its distinct shingles of ``shingle`` words; with fewer words the whole sequence
    is one shingle; without words the set is empty and linked with nothing. Documents are linked
    when 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest id reachable by
    links. Ids must be whole numbers; rows with a null id are left out, since nothing could name them.
    If rows repeat with one id, the row with the most shingles speaks for it.
    """
    with _small_batches(docs.sparkSession):
        return _components_of(docs, id_column, text_column, shingle, percent)


def _components_of(docs: DataFrame, id_column: str, text_column: str, shingle: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")).filter("id IS NOT NULL")
    scanned = settled(_scan(rows, shingle))
    described = (
        scanned.filter("key IS NULL").groupBy("id")
        .agg(F.max(F.struct("n", "digest", "signature", "least")).alias("d"), (F.count(F.lit(1)) > 1).alias("repeated")).select("id", "repeated", "d.*")
    )
    classes = described.filter("n > 0").groupBy("n", "digest").agg(
        F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("least").alias("least"), F.max("repeated").alias("repeated")
    )
    reps = settled(classes.select("id", "n", "digest", "signature", "least", "repeated"))
    frequent = (
        scanned.filter("key IS NOT NULL").groupBy("key").agg(F.sum("count").alias("count"))
        .orderBy(F.desc("count"), "key").limit(RANKED_SHINGLES).toPandas()
    )
    keys = frequent["key"].to_numpy(dtype=np.int64).view(_U) & _U((1 << 40) - 1)
    order = np.argsort(keys)
    ranks = keys[order], frequent["count"].to_numpy(dtype=np.int64)[order]
    hot = ranks[0][ranks[1] > HOT_SHINGLE]

    parts = _parts(spark, (reps.agg(F.sum("n").alias("n")).first()["n"] or 0) // 2)
    possible = settled(_with_a_chance(_text_shingles(rows, reps, hot, shingle, parts), reps, parts, percent))
    sets = settled(_sets_of(rows, possible, shingle))
    near = settled(_linked_blocks(sets, _neighbour_blocks(possible), percent))
    connected = components(near)

    total = possible.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = _parts(spark, total // 2)
    labelled = settled(_labelled(possible.select("id", "n", F.lit(False).alias("repeated")), connected))
    open_sets = settled(_with_a_chance(_set_shingles(sets.select("id", "body").join(labelled, "id"), hot, parts), labelled, parts, percent))

    parts = _parts(spark, total)
    labels = open_sets.select("id", "label").distinct()
    packed = _prefix_rows(sets.join(labels, "id"), ranks, percent, parts)
    shared = packed.repartition(parts, "part").groupBy("part").applyInPandas(_shared_keys(percent), "key bigint, id bigint, label bigint")
    far = _linked_blocks(sets, _likely_blocks(_rest_blocks(shared), possible, connected, percent), percent)
    final = components(near.unionByName(far))

    named = described.join(reps.select("n", "digest", F.col("id").alias("rep")), ["n", "digest"], "left")
    return named.join(final, F.col("rep") == F.col("node"), "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id")
    )
