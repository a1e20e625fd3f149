"""De-duplication inside one list.

A key's first row number and row count come from an aggregation with map-side combine, so a key
that fills a third of the list reaches the reducers as one row per map task. The result is joined
back with the skew-safe lookup; no window ever gathers all rows of one key in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, fixed, match_key
from ..labels import DEFAULT_LABELS, Labels
from .lookup import lookup_join
from .rules import is_valid

_FIRST, _SIZE = "__first_row", "__group_size"


def _group_key(key: str, normalize: bool) -> Column:
    """The compared key: the raw text, or trimmed lower-case text where blanks count as null."""
    return match_key(key) if normalize else col(key).cast("string")


def _tagged(key: Column) -> Column:
    """Key text with a tag, so that rows without a key form an ordinary group.

    The result is never null and known to be so: no null filter is planned below the groups, and
    both uses of them share one shuffle.
    """
    return F.coalesce(F.concat(F.lit("k"), key), F.lit("n"))


def key_groups(
    rows: DataFrame,
    key: str,
    labels: Labels = DEFAULT_LABELS,
    normalize: bool = False,
    valid_only: bool = True,
    stored: bool = False,
) -> DataFrame:
    """One row per key of the participating rows: tagged key, first row number, row count.

    Rows that do not take part are left out inside the aggregates, not by a filter below them: the
    status is then computed once per row, whatever it costs. Where the status is ``stored``, the scan
    leaves them out.
    """
    part = is_valid(rows.columns, labels) if valid_only else F.lit(True)
    if stored:
        rows = rows.filter(part)
    return (
        rows.groupBy(_tagged(_group_key(key, normalize)).alias("group_key"))
        .agg(F.min(F.when(part, col(labels.row_num))).alias(_FIRST), F.count_if(part).alias(_SIZE))
        .filter(F.col(_SIZE) > 0)
    )


def _mark(
    rows: DataFrame, joined: DataFrame, key: str, labels: Labels, normalize: bool, valid_only: bool
) -> DataFrame:
    taking_part = is_valid(rows.columns, labels) if valid_only else F.lit(True)
    group_key = _group_key(key, normalize)
    mark = (
        F.when(~taking_part, labels.skipped)
        .when(group_key.isNull(), labels.unknown)
        .when(col(labels.row_num) == F.col(_FIRST), labels.original)
        .otherwise(labels.repeat)
    )
    return joined.select(
        *[col(name) for name in rows.columns],
        mark.alias(labels.dedup),
        F.when(taking_part, group_key).alias(labels.dup_key),
        F.when(taking_part, F.col(_SIZE)).otherwise(F.lit(0)).cast("int").alias(labels.occurrences),
    )


def dedup_mark(
    rows: DataFrame,
    key: str,
    labels: Labels = DEFAULT_LABELS,
    normalize: bool = False,
    valid_only: bool = True,
    strategy: str = "salted",
    stored: bool = False,
) -> DataFrame:
    """Marks first and repeated rows of every key; adds mark, key echo and occurrence count.

    Rows whose status columns say "failed" are skipped (count 0), rows without a key are unknown
    (their count is the number of such rows). ``strategy="join"`` joins without salting and leaves
    skewed partitions to the adaptive planner, which saves the salting columns on even keys.
    ``stored`` says that the status columns are read from a written table (``key_groups``).
    """
    groups = key_groups(rows, key, labels, normalize, valid_only, stored)
    taking_part = is_valid(rows.columns, labels) if valid_only else F.lit(True)
    lookup_key = F.when(taking_part, _tagged(_group_key(key, normalize)))
    if strategy == "join":
        joined = rows.withColumn("group_key", lookup_key).join(groups, "group_key", "left")
    elif strategy == "salted":
        joined = lookup_join(rows, groups, lookup_key, "group_key", col(labels.row_num), key_rows=_SIZE)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return _mark(rows, joined, key, labels, normalize, valid_only)


def repeated_rows(marked: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Full rows marked as repeats."""
    return marked.filter(col(labels.dedup) == labels.repeat)


def first_rows(marked: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """The clean list: the first row of every key."""
    return marked.filter(col(labels.dedup) == labels.original)


def dedup_metrics(marked: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Counts per mark and the share of repeats among rows that have a key, in percent."""
    mark = col(labels.dedup)
    counts = marked.agg(
        F.count_if(mark == labels.original).alias("original_rows"),
        F.count_if(mark == labels.repeat).alias("repeat_rows"),
        F.count_if(mark == labels.unknown).alias("unknown_rows"),
        F.count_if(mark == labels.skipped).alias("skipped_rows"),
    )
    keyed = F.col("original_rows") + F.col("repeat_rows")
    rate = F.coalesce(F.try_divide(F.col("repeat_rows") * 100.0, keyed.cast("double")), F.lit(0.0))
    return counts.withColumn("repeat_rate", F.concat(fixed(rate, 1), F.lit("%")))


def duplicate_groups(
    rows: DataFrame, key: str, labels: Labels = DEFAULT_LABELS
) -> DataFrame:
    """Every member of every key that occurs more than once (trimmed, lower-cased, no blanks).

    Only keys with more than one row enter the lookup table, so the table stays small when
    duplicates are rare.
    """
    key_text = match_key(key)
    groups = (
        rows.filter(key_text.isNotNull())
        .groupBy(key_text.alias("group_key"))
        .agg(F.min(col(labels.row_num)).alias(_FIRST), F.count(F.lit(1)).alias(_SIZE))
        .filter(F.col(_SIZE) > 1)
    )
    joined = lookup_join(
        rows.select(col(labels.row_num), col(key)), groups, key_text, "group_key",
        col(labels.row_num), key_rows=_SIZE,
    )
    return joined.filter(F.col(_SIZE).isNotNull()).select(
        col(labels.row_num),
        key_text.alias(labels.dup_key),
        F.col(_SIZE).cast("int").alias(labels.occurrences),
        F.when(col(labels.row_num) == F.col(_FIRST), labels.original)
        .otherwise(labels.repeat)
        .alias(labels.dedup),
    )


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Whole-row distinct; partial aggregation removes copies before the shuffle."""
    return rows.distinct()
