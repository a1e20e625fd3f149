"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ten words (a shorter item is one window), every window into
shingles of five. A window can only stand in a document that has all its shingles, so one shingle
per window is the necessary prefix, and the rarest one over all documents is taken. A shingle that no
document has rules its window out.

Documents are scanned twice. The first scan counts the benchmark's shingles, the second one yields the
places of prefix shingles with the few words around them. Both drop what a bitmap of fixed size rules
out, so only a small part of the words leaves the scan, and the bitmap is all that is broadcast. Places
meet windows in a join on the shingle; the positional bound (the window must start at the place minus
the shingle's offset) and the length bound (it must end within the text) follow, then its words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.scratch import settled

from .bits import bit_table
from .words import ALNUM, LOWER, SMALL_SLICE_BYTES, find_words, hash_runs, shingle_hashes, slices

WINDOW = 10
SHINGLE = 5
FILTER_BITS = 1 << 23


def _slot(key: Column) -> Column:
    return key.bitwiseAND(F.lit(FILTER_BITS - 1))


def _hit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slots = keys & np.uint64(FILTER_BITS - 1)
    return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def item_windows(items: DataFrame, id_column: str, text_column: str, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``(item, words, length, keys)``: every window of every item, with the hashes of its shingles."""
    item_type = items.schema[id_column].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                data = LOWER[part.data]
                words = find_words(data, part.offsets, ALNUM)
                hashes = hash_runs(data, words.begin, words.end)
                picked, texts, lengths, keys = [], [], [], []
                for r in range(part.last - part.first):
                    lo, hi = int(words.rows[r]), int(words.rows[r + 1])
                    length = min(window, hi - lo)
                    if not length:
                        continue
                    size = min(shingle, length)
                    spelled = [data[words.begin[k] : words.end[k]].tobytes().decode("utf-8", "replace") for k in range(lo, hi)]
                    own, _ = shingle_hashes(hashes[lo:hi], np.array([0, hi - lo]), size)
                    for k in range(hi - lo - length + 1):
                        picked.append(part.first + r)
                        texts.append(" ".join(spelled[k : k + length]))
                        lengths.append(length)
                        keys.append(own[k : k + length - size + 1].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").take(pa.array(picked, pa.int64())), pa.array(texts, pa.string()),
                     pa.array(lengths, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["item", "words", "length", "keys"],
                )

    rows = items.select(F.col(id_column).alias("item"), F.col(text_column).alias("text"))
    return rows.mapInArrow(cut, f"item {item_type}, words string, length int, keys array<bigint>")


def _found(part, table, sizes):
    """Places of a slice whose shingles the bitmap lets through: ``(data, words, place, key, size)``."""
    data = LOWER[part.data]
    words = find_words(data, part.offsets, ALNUM)
    hashes = hash_runs(data, words.begin, words.end)
    places, keys = [], []
    for size in sizes:
        key, whole = shingle_hashes(hashes, words.rows, size)
        at = np.flatnonzero(whole & _hit(table, key))
        places.append(at)
        keys.append(key[at])
    return data, words, np.concatenate(places), np.concatenate(keys)


def document_hits(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, hits and windows.

    Rows: ``(row, id, n_words)``, one per row of ``docs``. Hits: ``(row, start, length, words)``, one
    per place where a window stands in a document. Windows: ``(words, item)``.
    """
    windows = settled(item_windows(items, item_id_column, item_text_column, window, shingle))
    distinct = windows.dropDuplicates(["words"]).select("words", "length", F.posexplode("keys").alias("offset", "key"))
    sizes = [r["s"] for r in windows.select(F.least("length", F.lit(shingle)).alias("s")).distinct().collect()] or [shingle]
    known = bit_table(distinct, _slot(F.col("key")), FILTER_BITS)
    id_type = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text"), SMALL_SLICE_BYTES):
                _, _, _, keys = _found(part, known, sizes)
                keys, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["key", "n"])

    seen = texts.select("text").mapInArrow(counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset"))
    prefixes = settled(
        distinct.join(seen, "key", "left").groupBy("words", "length").agg(rarest.alias("p")).filter("p.n > 0")
        .select("words", "length", F.col("p.key").alias("key"), F.col("p.offset").alias("offset"))
    )
    chosen = bit_table(prefixes, _slot(F.col("key")), FILTER_BITS)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "n_words", "key", "place", "around_from", "around"]
        for batch in batches:
            for part in slices(batch.column("text"), SMALL_SLICE_BYTES):
                data, words, at, keys = _found(part, chosen, sizes)
                rows = np.searchsorted(words.rows, at, side="right") - 1
                around, around_from = [], np.maximum(words.rows[rows], at - window)
                for lo, hi in zip(around_from, np.minimum(words.rows[rows + 1], at + window), strict=True):
                    around.append(" ".join(data[words.begin[k] : words.end[k]].tobytes().decode("utf-8", "replace") for k in range(lo, hi)))
                n_words = np.diff(words.rows)
                index = np.concatenate([np.arange(part.last - part.first), rows])
                blank = [None] * (part.last - part.first)
                take = pa.array(index + part.first)
                first = words.rows[rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(take), batch.column("id").take(take), pa.array(n_words[index]),
                     pa.array([*blank, *keys.astype(np.int64).tolist()], pa.int64()),
                     pa.array([*blank, *(at - first).tolist()], pa.int64()),
                     pa.array([*blank, *(around_from - first).tolist()], pa.int64()),
                     pa.array([*blank, *around], pa.string())],
                    names=names,
                )

    scanned = settled(
        texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            placed, f"row bigint, id {id_type}, n_words bigint, key bigint, place bigint, around_from bigint, around string"
        )
    )
    rows = scanned.filter("key IS NULL").select("row", "id", "n_words")
    start = F.col("place") - F.col("offset")
    hits = (
        scanned.filter("key IS NOT NULL").join(prefixes, "key")
        .withColumn("start", start)
        .filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
        .filter(
            F.array_join(F.slice(F.split("around", " "), (F.col("start") - F.col("around_from") + 1).cast("int"), F.col("length")), " ")
            == F.col("words")
        )
        .select("row", "start", "length", "words").distinct()
    )
    return rows, hits, windows.select("words", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", **names) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit``, ``n_items``, ``items`` and ``contaminated``.

    Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. ``n_hit`` counts
    document words inside any occurrence of a window, ``items`` are the ids of items with occurring
    windows, as strings in order. Null and empty texts have no words; items without words match
    nothing. Repeated rows are judged one by one. Columns are taken by name, others are not read.
    """
    rows, hits, windows = document_hits(docs, items, id_column, **names)
    hits = settled(hits)
    ends = F.col("start") + F.col("length")
    before = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(ends - F.greatest(F.col("start"), F.coalesce("reached", F.lit(0))), F.lit(0))
    words = (
        hits.groupBy("row", "start").agg(F.max("length").alias("length"))
        .withColumn("reached", F.max(ends).over(before))
        .groupBy("row").agg(F.sum(fresh).alias("n_hit"))
    )
    found = hits.select("row", "words").distinct().join(windows, "words").select("row", F.col("item").cast("string").alias("item"))
    items_of = found.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return rows.join(words, "row", "left").join(items_of, "row", "left").select(
        F.col("id").alias(id_column), "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
