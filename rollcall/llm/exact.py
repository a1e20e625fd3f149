"""Exact de-duplication by progressive refinement: length, then a hash of the start, then all of it.

White space (space, tab to carriage return) is deleted before anything is compared. The first scan yields
the length and the hash of the first characters, a few bytes per document. Documents whose length and
start occur twice survive. They are told to the second scan by a bitmap of fixed size, so the scan
hashes whole contents of survivors (and of the few that share a bit) only, and no text is shuffled.

Groups are aggregated before they are exchanged: a text that a third of all rows carry is one row per
map task. Its rows meet their group again in a join that the adaptive planner can split.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import bit_table, slot_of

PREFIX_CHARS = 64
FILTER_BITS = 1 << 22
_SPACES = " \t\n\x0b\x0c\r"
_DROP = bytes(_SPACES, "ascii")


def without_spaces(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _SPACES, "")


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and the carried columns.

    Equal texts form a group; null counts as empty and empty texts are equal. The row with the most
    characters in the original text stays, then the smallest id (null ids last). If rows repeat with
    one id, all of them carry ``kept``. ``carry`` names expressions over ``docs`` that are wanted in
    the result. An empty table gives an empty result.
    """
    carry = carry or {}
    short = without_spaces(F.col(text_column))
    start = F.xxhash64(F.substring(short, 1, PREFIX_CHARS))
    sized = docs.select(F.length(short).alias("n"), start.alias("start"))
    lengths = sized.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("n")
    starts = (
        sized.groupBy("n", "start").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        .join(lengths, "n", "left_semi")
    )
    table = bit_table(starts, slot_of(FILTER_BITS, "n", "start"), FILTER_BITS)

    keyed = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
        F.length(short).alias("n"),
        start.alias("start"),
        F.coalesce(F.length(text_column), F.lit(0)).alias("chars"),
        slot_of(FILTER_BITS, F.length(short), start).alias("slot"),
        *[expr.alias(f"carry_{i}") for i, expr in enumerate(carry.values())],
    )
    id_type = docs.schema[id_column].dataType.simpleString()
    extra = [(f"carry_{i}", keyed.schema[f"carry_{i}"].dataType.simpleString()) for i in range(len(carry))]
    schema = ", ".join(
        [f"id {id_type}", "n int", "start bigint", "chars int", "full binary", *(f"{n} {t}" for n, t in extra)]
    )
    kept_columns = ["id", "n", "start", "chars"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            hit = (table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1
            texts, full = batch.column("text"), [None] * batch.num_rows
            for i in np.flatnonzero(hit):
                full[i] = sha256(texts[int(i)].as_buffer().to_pybytes().translate(None, _DROP)).digest()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept_columns), pa.array(full, pa.binary()), *(batch.column(c) for c, _ in extra)],
                names=[*kept_columns, "full", *(c for c, _ in extra)],
            )

    rows = keyed.mapInArrow(hashed, schema)
    order = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("late"), F.col("id").alias("id"))
    groups = (
        rows.filter("full IS NOT NULL").groupBy("n", "start", "full")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size"))
        .filter("size > 1")
        .select(
            F.col("n").alias("g_n"), F.col("start").alias("g_start"), F.col("full").alias("g_full"),
            F.col("first.id").alias("g_keep"), F.lit(True).alias("g_found"), "size",
        )
    )
    same = (F.col("n") == F.col("g_n")) & (F.col("start") == F.col("g_start")) & (F.col("full") == F.col("g_full"))
    keep = F.when(F.col("g_found"), F.col("g_keep")).otherwise(F.col("id"))
    return rows.join(groups, same, "left").select(
        F.col("id").alias(id_column),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        *[F.col(f"carry_{i}").alias(name) for i, name in enumerate(carry)],
    )
