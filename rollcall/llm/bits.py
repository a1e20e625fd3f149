"""Membership bitmaps of a fixed size: the only thing about many keys that is ever broadcast. Below: packed integers.

A bitmap has as many bits as its caller says, whatever the number of keys. With more keys it lets more
rows through, which costs time but never changes a result, since an exact join follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slot_of(bits: int, *key: Column | str) -> Column:
    """The bit of a key in a bitmap of ``bits`` bits (a power of two)."""
    return F.pmod(F.xxhash64(*key), F.lit(bits))


def bit_table(rows: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """``bits / 8`` bytes in which the bits named by ``slot`` are set.

    At most ``bits / 64`` words reach the driver; they are combined on the map side.
    """
    words = (
        rows.select(slot.alias("slot")).filter(F.col("slot").isNotNull())
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
        .toPandas()
    )
    table = np.zeros(bits // 64, dtype=np.int64)
    table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return table.view(np.uint8)


def passed(rows: DataFrame, table: np.ndarray, slot: Column, wanted: bool) -> DataFrame:
    """The rows whose bit is set (``wanted``), or those whose bit is not; null slots count as not set."""
    marked = rows.withColumn("__slot", F.coalesce(slot, F.lit(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column("__slot").to_numpy()
            at = np.maximum(slots, 0)
            hit = (((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1) == 1) & (slots >= 0)
            yield batch.filter(pa.array(hit == wanted)).select(batch.schema.names[:-1])

    return marked.mapInArrow(run, rows.schema)


def without_keys(rows: DataFrame, keys: DataFrame, key: str, bits: int = 1 << 23) -> DataFrame:
    """``rows`` whose ``key`` is not among ``keys``; rows with a null key stay.

    Only rows that share a bit with a key are shuffled for the exact join.
    """
    keys = keys.select(key).distinct()
    table = bit_table(keys, slot_of(bits, key), bits)
    slot = F.when(F.col(key).isNotNull(), slot_of(bits, key))
    return passed(rows, table, slot, False).unionByName(passed(rows, table, slot, True).join(keys, key, "left_anti").select(rows.columns))


def packed_longs(values: np.ndarray) -> bytes:
    """64-bit integers as their least, a width, and distances from the least in that many bytes."""
    least = values.min()
    far = values.view(np.uint64) - least.view(np.uint64)
    width = max(1, (int(far.max()).bit_length() + 7) // 8)
    return least.tobytes() + bytes([width]) + far.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_longs(body: bytes) -> np.ndarray:
    """What ``packed_longs`` was given."""
    width = body[8]
    wide = np.zeros(((len(body) - 9) // width, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(body, dtype=np.uint8, offset=9).reshape(-1, width)
    return (wide.view(np.uint64).ravel() + np.frombuffer(body[:8], dtype=np.uint64)).view(np.int64)
