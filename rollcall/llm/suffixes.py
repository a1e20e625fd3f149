"""Removal of repeated byte strings by column-wise construction over many documents.

A byte goes if it lies in a string of 50 bytes that also starts in a document with a smaller id. So of
the sorted suffixes of all documents only the first 50 bytes matter, and the collection is built to
that depth: the pieces' suffixes are kept in sorted order, every round inserts one more symbol (a pair
of bytes) in front of each of them, the order is updated by one stable pass over the new symbols (the
current column of the Burrows-Wheeler transform), and the flags that tell which neighbours share
their whole prefix are updated with it. After 25 rounds suffixes that share 50 bytes stand together. Arrays
are read and written front to back only. Suffixes that no longer share a prefix with a neighbour
leave the collection early.

Building one collection for everything would be one sequential task, so suffixes are dealt first, in a
way that equal strings always meet. Every string of 50 bytes is represented by its anchor, the least
hash among its substrings of 20 bytes; neighbouring strings mostly have the same anchor, and all
strings of one anchor form one piece of text. Anchors that occur in one document only cannot repeat; a bitmap of fixed
size keeps them from leaving the second scan. A task sends each distinct piece once, for the smallest
document that has it: the others it holds are repeated for certain. Pieces of very frequent anchors
are cut into single strings and dealt by their own hash, so that a passage that stands in a third of all
documents, with other text around it each time, is spread too.

Whole copies of a text are settled before, by a digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.scratch import settled

from .bits import bit_table, packed_longs, slot_of, unpacked_longs
from .words import BYTE_VALUES, mixed, powers, slices

DEPTH = 50
ANCHOR = 20
ROW_BITS = 1 << 23
KEY_BITS = 1 << 26
HOT_KEYS = 1 << 20
HOT_PIECES = 20_000
BYTES_A_PART = 6 << 20
HELD_ANCHORS = 400_000

_U = np.uint64
_HIGH, _LOW = _U(0xFFFFFFFF00000000), _U(0xFFFFFFFF)


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, size: int = ANCHOR):
    """Of a slice: ``(key, row, first, count)`` of every anchor.

    The ``count`` strings that start at bytes ``first``, ``first + 1``, ... of ``data`` have the anchor.
    """
    nothing = tuple(np.zeros(0, dtype=t) for t in (_U, np.int64, np.int64, np.int64))
    if len(data) < depth:
        return nothing
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    keys = mixed((sums[size:] - sums[:-size]) * down[: len(data) - size + 1])
    packed = (keys & _HIGH) | np.arange(len(keys), dtype=_U)
    least = _least_in_windows(packed, depth - size + 1)
    # Strings that start in a row and end in it.
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + depth <= offsets[1:][row])
    if not len(start):
        return nothing
    place, row = (least[start] & _LOW).astype(np.int64), row[start]
    fresh = np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1]))
    head = np.flatnonzero(fresh)
    return keys[place[head]], row[head], start[head], np.diff(np.append(head, len(start)))


def equal_prefixes(buffer: np.ndarray, starts: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Strings of ``depth`` bytes at ``starts`` that occur more than once.

    Returns their numbers in sorted order, and where a new string begins in that order. ``depth`` is even.
    """
    pairs = buffer[:-1].astype(np.uint16) << 8 | buffer[1:]
    order = np.arange(len(starts))
    group = np.zeros(len(starts), dtype=np.int32)
    for column in range(depth - 2, -1, -2):
        symbols = pairs[starts[order] + column]
        move = np.argsort(symbols, kind="stable")
        order, symbols, group = order[move], symbols[move], group[move]
        fresh = np.append(True, (symbols[1:] != symbols[:-1]) | (group[1:] != group[:-1]))
        if column % 10 == 0:
            alone = fresh & np.append(fresh[1:], True)
            order, fresh = order[~alone], fresh[~alone]
            if not len(order):
                break
        group = np.cumsum(fresh, dtype=np.int32)
    return order, np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(order) else np.zeros(0, dtype=np.int64)


def _packed(parts: int, part: np.ndarray, arrays: list[np.ndarray], names: list[str], texts=None) -> pa.RecordBatch:
    """One row per part that occurs, with each array's share as bytes; ids of documents are packed. ``texts``: (data, first, length)."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    filled = np.flatnonzero(np.diff(edges))
    columns = [pa.array(filled, pa.int64())]
    for name, values in zip(names, arrays, strict=True):
        values, pack = values[order], packed_longs if name == "docs" else np.ndarray.tobytes
        columns.append(pa.array([pack(values[edges[p] : edges[p + 1]]) for p in filled], pa.binary()))
    if texts is not None:
        data, first, length = texts
        first, length = first[order], length[order]
        cut = []
        for p in filled:
            f, n = first[edges[p] : edges[p + 1]], length[edges[p] : edges[p + 1]]
            cut.append(data[np.repeat(f - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes())
        columns.append(pa.array(cut, pa.binary()))
        names = [*names, "bytes"]
    return pa.RecordBatch.from_arrays(columns, names=["part", *names])


def _joined(values, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=kind) for x in values])


def _joined_ids(values) -> np.ndarray:
    return np.concatenate([unpacked_longs(x) for x in values])


def _anchored_slices(batches, table):
    """Slices of the rows that the bitmap knows: ``(batch, part, key, row, first, count)``."""
    for batch in batches:
        slots = batch.column("slot").to_numpy()
        batch = batch.filter(pa.array(((table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1) == 1))
        for part in slices(batch.column("text")):
            yield batch, part, *anchors(part.data, part.offsets)


def _shared_bits(texts: DataFrame, table: np.ndarray, parts: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap of anchors that two documents have, and the anchors with more than ``hot`` documents."""
    width = KEY_BITS // parts

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, held = [], [], 0

        def out():
            key, doc = np.concatenate(keys), np.concatenate(docs)
            part = ((key & _U(KEY_BITS - 1)) // _U(width)).astype(np.int64)
            return _packed(parts, part, [key, doc], ["keys", "docs"])

        for batch, part, key, row, _, _ in _anchored_slices(batches, table):
            # A document counts once per slice and anchor.
            number = batch.column("doc").to_numpy()[part.first : part.last]
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            once = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])) if len(key) else np.zeros(0, dtype=bool)
            keys.append(key[once])
            docs.append(number[row[once]])
            held += int(once.sum())
            if held > HELD_ANCHORS:
                yield out()
                keys, docs, held = [], [], 0
        if held:
            yield out()

    def judged(frame: pd.DataFrame) -> pd.DataFrame:
        key, doc = _joined(frame["keys"], _U), _joined_ids(frame["docs"])
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        shared = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
        count = np.diff(np.append(head, len(key)))
        low = int(frame["part"].iloc[0]) * width
        bits = np.zeros(width, dtype=np.uint8)
        bits[(key[head[shared]] & _U(KEY_BITS - 1)).astype(np.int64) - low] = 1
        often = key[head[count > hot]].astype(np.int64)
        return pd.DataFrame({"part": [low // width], "bits": [np.packbits(bits, bitorder="little").tobytes()], "often": [often.tobytes()]})

    packed = texts.mapInArrow(scanned, "part bigint, keys binary, docs binary")
    rows = packed.repartition(parts, "part").groupBy("part").applyInPandas(judged, "part bigint, bits binary, often binary").collect()
    bits, often = np.zeros(KEY_BITS // 8, dtype=np.uint8), []
    for r in rows:
        bits[r["part"] * width // 8 : (r["part"] + 1) * width // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
        often.append(np.frombuffer(r["often"], dtype=np.int64).view(_U))
    return bits, np.sort(np.concatenate(often)) if often else np.zeros(0, dtype=_U)


def _piece_rows(texts: DataFrame, table: np.ndarray, shared: np.ndarray, often: np.ndarray, parts: int) -> DataFrame:
    """Packed pieces of shared anchors (kind 0), and spans that are repeated within the task (kind 1)."""

    def split(key, row, first, count, data):
        """Pieces of frequent anchors become single strings, each dealt by its own hash."""
        if len(often):
            at = np.minimum(np.searchsorted(often, key), len(often) - 1)
            hot = often[at] == key
            if hot.any():
                n = count[hot]
                single = np.repeat(first[hot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                first, row = np.append(first[~hot], single), np.append(row[~hot], np.repeat(row[hot], n))
                count = np.append(count[~hot], np.ones(len(single), dtype=np.int64))
                key = np.append(key[~hot], mixed(hash_at(data, single, DEPTH) ^ _U(1)))
        return key, row, first, count

    def hash_at(data, first, length):
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
        return mixed((sums[first + length] - sums[first]) * down[first])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out():
            key, whole, doc, rid, place, count, length = (np.concatenate([h[i] for h in held]) for i in range(7))
            bases = np.cumsum([0, *(len(h[7]) for h in held)])
            data = np.concatenate([h[7] for h in held])
            first = np.concatenate([h[8] + b for h, b in zip(held, bases, strict=False)])
            # Of equal pieces the one of the smallest document goes on.
            order = np.lexsort((doc, whole, key))
            head = np.append(True, (key[order][1:] != key[order][:-1]) | (whole[order][1:] != whole[order][:-1]))
            least = doc[order][np.flatnonzero(head)][np.cumsum(head) - 1]
            repeated = order[doc[order] > least]
            kept = order[doc[order] == least]
            if len(repeated):
                part = (mixed(rid[repeated].view(_U)) % _U(parts)).astype(np.int64)
                spans = _packed(parts, part, [rid[repeated], place[repeated], length[repeated]], ["rids", "places", "lengths"])
                yield _filled(spans, 1)
            part = (mixed(key[kept]) % _U(parts)).astype(np.int64)
            yield _filled(
                _packed(parts, part, [doc[kept], rid[kept], place[kept], length[kept]], ["docs", "rids", "places", "lengths"], (data, first[kept], length[kept])), 0
            )

        for batch, part, key, row, first, count in _anchored_slices(batches, table):
            slot = key & _U(KEY_BITS - 1)
            hit = (shared[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & 1 == 1
            if not hit.any():
                continue
            key, row, first, count = split(key[hit], row[hit], first[hit], count[hit], part.data)
            length = count + DEPTH - 1
            doc = batch.column("doc").to_numpy()[part.first : part.last][row]
            rid = batch.column("rid").to_numpy()[part.first : part.last][row]
            held.append((key, hash_at(part.data, first, length), doc, rid, first - part.offsets[row], count, length, part.data, first))
            size += len(key)
            if size > HELD_ANCHORS:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    schema = "kind int, part bigint, docs binary, rids binary, places binary, lengths binary, bytes binary"
    return texts.mapInArrow(scanned, schema)


def _filled(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    names = ["part", "docs", "rids", "places", "lengths", "bytes"]
    n = batch.num_rows
    columns = [batch.column(c) if c in batch.schema.names else pa.nulls(n, pa.binary()) for c in names]
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), *columns], names=["kind", *names])


def _repeated_spans(parts: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Spans of one part's pieces that a smaller document has too, packed by row; spans that are known already pass."""
        pieces = frame["kind"] == 0
        known = frame.loc[~pieces, ["part", "rids", "places", "lengths"]]
        return pd.concat([known, found_in(frame[pieces])]) if pieces.any() else known

    def found_in(frame: pd.DataFrame) -> pd.DataFrame:
        doc, rid = _joined_ids(frame["docs"]), _joined(frame["rids"], np.int64)
        place, length = _joined(frame["places"], np.int64), _joined(frame["lengths"], np.int64)
        buffer = _joined(frame["bytes"], np.uint8)
        base = np.cumsum(length) - length
        count = length - DEPTH + 1
        piece = np.repeat(np.arange(len(doc)), count)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        order, head = equal_prefixes(buffer, base[piece] + nth)
        if not len(order):
            return pd.DataFrame({"part": [], "rids": [], "places": [], "lengths": []})
        docs = doc[piece[order]]
        least = np.minimum.reduceat(docs, head)
        sizes = np.diff(np.append(head, len(order)))
        found = np.sort(order[docs > np.repeat(least, sizes)])
        if not len(found):
            return pd.DataFrame({"part": [], "rids": [], "places": [], "lengths": []})
        # Strings of one piece that follow each other make one span.
        fresh = np.append(True, (found[1:] != found[:-1] + 1) | (piece[found][1:] != piece[found][:-1]))
        at = np.flatnonzero(fresh)
        first = found[at]
        n = np.diff(np.append(at, len(found))) + DEPTH - 1
        rows = rid[piece[first]]
        part = (mixed(rows.view(_U)) % _U(parts)).astype(np.int64)
        out = _packed(parts, part, [rows, place[piece[first]] + nth[first], n], ["rids", "places", "lengths"])
        return out.to_pandas()

    return run


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per text: the union of its spans."""
    rid, place, length = (_joined(frame[c], np.int64) for c in ("rids", "places", "lengths"))
    order = np.lexsort((place, rid))
    rid, place, end = rid[order], place[order], (place + length)[order]
    rows = np.flatnonzero(np.append(True, rid[1:] != rid[:-1]))
    out = {"rid": rid[rows], "spans": []}
    for lo, hi in zip(rows, np.append(rows[1:], len(rid)), strict=True):
        reach = np.maximum.accumulate(end[lo:hi])
        fresh = np.flatnonzero(np.append(True, place[lo + 1 : hi] > reach[:-1]))
        ends = reach[np.append(fresh[1:] - 1, hi - lo - 1)]
        out["spans"].append(np.stack([place[lo:hi][fresh], ends]).T.astype(np.int64).tobytes())
    return pd.DataFrame(out)


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts and spans.

    Texts: ``(id, doc, rid, text)`` of every row of ``docs``, null texts empty, with ``rid`` a hash of id and text. Spans:
    ``(rid, spans)``, the disjoint byte ranges to remove, as pairs of 64-bit numbers, for every text
    that has some.
    """
    spark = docs.sparkSession
    doc = F.coalesce(F.col(id_column).cast("bigint"), F.lit(2**63 - 1))
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = docs.select(F.col(id_column).alias("id"), doc.alias("doc"), text.alias("text")).withColumn(
        "rid", F.xxhash64("doc", "text")
    )
    sized = settled(
        texts.select("doc", "rid", F.octet_length("text").cast("bigint").alias("n"), F.md5("text").alias("digest")).filter(F.col("n") >= DEPTH)
    )
    first = sized.groupBy("n", "digest").agg(F.min("doc").alias("first"))
    placed = settled(sized.join(first, ["n", "digest"]).select("doc", "rid", "n", (F.col("doc") > F.col("first")).alias("copy")))
    table = bit_table(placed.filter("NOT copy").select("rid"), slot_of(ROW_BITS, "rid"), ROW_BITS)
    total = placed.filter("NOT copy").agg(F.sum("n").alias("n")).first()["n"] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BYTES_A_PART)
    parts = 1 << min(20, max(3, (wanted - 1).bit_length()))

    rows = texts.withColumn("slot", slot_of(ROW_BITS, "rid"))
    hot = max(HOT_PIECES, total // (ANCHOR // 2) // HOT_KEYS)
    shared, often = _shared_bits(rows, table, parts, hot)
    # Pieces and spans that are known already go the same way, so the pieces are shuffled but not stored.
    pieces = _piece_rows(rows, table, shared, often, parts)
    schema = "part bigint, rids binary, places binary, lengths binary"
    met = pieces.repartition(parts, "part").groupBy("part").applyInPandas(_repeated_spans(parts), schema)
    merged = met.repartition(parts, "part").groupBy("part").applyInPandas(_merged, "rid bigint, spans binary")
    whole = placed.filter("copy").select("rid", "n").distinct().select(
        "rid", F.lit(None).cast("binary").alias("spans"), "n"
    )
    # The bitmap may have let some whole copies through to the pieces.
    partly = merged.join(whole.select("rid"), "rid", "left_anti").withColumn("n", F.lit(None).cast("bigint"))
    return texts, partly.unionByName(whole)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes that stay).

    Texts are UTF-8 bytes, null counts as empty, matches never cross documents, and strings are
    compared in the input, not in what is left. Rows with one id do not remove each other's bytes; a
    null id counts as larger than all others. An empty table gives an empty result.
    """
    texts, spans = repeated_spans(docs, id_column, text_column)
    spans = settled(spans)
    table = bit_table(spans, slot_of(ROW_BITS, "rid"), ROW_BITS)
    id_type = docs.schema[id_column].dataType.simpleString()
    slotted = texts.select("id", "rid", "text", slot_of(ROW_BITS, "rid").alias("slot"))
    schema = f"id {id_type}, rid bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that the bitmap rules out keep everything."""
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array(((table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1) == 0))
            kept = batch.column("text").cast(pa.binary())
            sizes = np.array([len(x.as_buffer()) for x in kept], dtype=np.int64)
            none = pa.array(np.zeros(batch.num_rows, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rid"), pa.array(sizes), none, none, kept],
                names=["id", "rid", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            yield batch.filter(pa.array(((table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1) == 1)).select(["id", "rid", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, kept = [], [], [], []
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_buffer().to_pybytes()
                spans = batch.column("spans")[i].as_py()
                if batch.column("whole")[i].as_py():
                    pairs = [(0, len(text))]
                else:
                    pairs = np.frombuffer(spans or b"", dtype=np.int64).reshape(-1, 2).tolist()
                edges = [0, *(x for pair in pairs for x in pair), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                counts.append(len(pairs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rid"), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(kept, pa.binary())],
                names=["id", "rid", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    touched = slotted.mapInArrow(candidates, f"id {id_type}, rid bigint, text string").join(spans, "rid", "left").select(
        "id", "rid", "text", "spans", F.col("n").isNotNull().alias("whole")
    ).mapInArrow(cut, schema)
    return slotted.mapInArrow(untouched, schema).unionByName(touched).select(
        F.col("id").alias(id_column), "n_bytes", "n_removed", "n_spans", "kept"
    )
