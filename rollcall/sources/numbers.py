"""Dense row numbers over files: counts per split, running sums over the splits, one offset per split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from ..labels import DEFAULT_LABELS, Labels
from ..operators.lookup import lookup_join
from ..scratch import settled

FILE, BLOCK, POSITION = "__file", "__block", "__pos"


def running_starts(counts: DataFrame, order: list[str], n: str, start: str) -> DataFrame:
    """Adds the sum of ``n`` over all rows before, in the order of the columns ``order``.

    The rows are sorted over all partitions; sums run inside each partition, and the driver adds up one
    total per partition. No task gets all rows.
    """
    placed = settled(counts.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    totals = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.sum(n).alias("n")).collect())
    before, so_far = [], 0
    for part, total in totals:
        before.append((part, so_far))
        so_far += total
    earlier = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = counts.sparkSession.createDataFrame(before, "__part int, __before bigint")
    sums = F.col("__before") + F.coalesce(F.sum(n).over(earlier), F.lit(0))
    return placed.join(F.broadcast(known), "__part").withColumn(start, sums).drop("__part", "__before")


def placed_rows(rows: DataFrame, row_index: bool = False) -> DataFrame:
    """Adds file, split and position in it to rows straight from a file source.

    ``row_index=True`` uses the position that the Parquet source knows itself.
    """
    block = F.lit(0).cast("long") if row_index else F.col("_metadata.file_block_start")
    position = F.col("_metadata.row_index") if row_index else F.monotonically_increasing_id()
    return rows.select("*", F.col("_metadata.file_path").alias(FILE), block.alias(BLOCK), position.alias(POSITION))


def split_offsets(placed: DataFrame, code_rows: bool = False) -> DataFrame:
    """One row per split of placed rows: what turns a position in it into a number of the whole list.

    With ``code_rows`` the first row of each file is no row of the list.
    """
    blocks = placed.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("__n"), F.min(POSITION).alias("__first"))
    nth = F.row_number().over(Window.partitionBy(FILE).orderBy(BLOCK))  # splits of one file
    code = (nth == 1).cast("bigint") if code_rows else F.lit(0).cast("bigint")
    blocks = blocks.withColumn("__code", code).withColumn("__rows", F.col("__n") - F.col("__code"))
    return running_starts(blocks, [FILE, BLOCK], "__rows", "__start").select(
        _split().alias("__split"),
        (F.col("__start") - F.col("__first") - F.col("__code")).alias("__offset"),
        F.when(F.col("__code") == 1, F.col("__first")).alias("__code_at"),
        "__n",
    )


def _split() -> Column:
    return F.concat(F.col(BLOCK).cast("string"), F.lit(":"), F.col(FILE))


def with_numbers(placed: DataFrame, offsets: DataFrame, start: int = 1, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Placed rows with dense row numbers in the order of files, splits and positions; 0 for code rows.

    The offsets are measured. They are broadcast while they are small; beyond that a split's rows are
    salted by their exact number, and never meet in one task.
    """
    joined = lookup_join(placed, offsets, _split(), "__split", F.col(POSITION), key_rows="__n")
    number = F.when(F.col("__code_at") == F.col(POSITION), F.lit(0).cast("bigint")).otherwise(F.col("__offset") + F.col(POSITION) + F.lit(start))
    return joined.select(*[col(name) for name in placed.columns], number.alias(labels.row_num))
