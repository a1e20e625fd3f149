"""Matching lists against each other by a normalised key.

The reference side is always reduced to distinct keys before the join, so a match can never
multiply rows, and both membership flags of the vendor list come from one tagged key set and
one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, match_key
from ..labels import DEFAULT_LABELS, Labels
from .lookup import lookup_join
from .rules import is_valid


def key_set(rows: DataFrame, key: str, where: Column | None = None, stored: bool = False) -> DataFrame:
    """Distinct normalised keys of a list (one column ``match_key``); blanks and nulls dropped.

    ``where`` limits the set to some rows. It is evaluated inside the aggregate, which keeps an
    expensive status out of the filters below it. ``stored`` says that what it looks at is read from a
    written table: then the scan leaves the other rows out, and their keys are not made.
    """
    text = match_key(key).alias("match_key")
    if where is not None and stored:
        rows, where = rows.filter(where), None
    if where is None:
        return rows.select(text).filter("match_key is not null").distinct()
    some = rows.groupBy(text).agg(F.bool_or(where).alias("__some"))
    return some.filter("__some and match_key is not null").drop("__some")


def _flag(hit: Column, labels: Labels) -> Column:
    return F.when(hit, labels.yes).otherwise(labels.no)


def flag_membership(
    rows: DataFrame,
    key: str,
    reference: DataFrame,
    reference_key: str,
    flag: str,
    labels: Labels = DEFAULT_LABELS,
    where: Column | None = None,
    stored: bool = False,
) -> DataFrame:
    """Adds a yes/no column: is the row's key among the keys of the reference list (``where``)?"""
    table = key_set(reference, reference_key, where, stored).withColumn("__hit", F.lit(True))
    joined = lookup_join(rows, table, match_key(key), "match_key", _row_id(rows, labels))
    return joined.select(
        *[col(name) for name in rows.columns], _flag(F.col("__hit"), labels).alias(flag)
    )


def _row_id(rows: DataFrame, labels: Labels) -> Column:
    """What spreads a hot key's rows: the row number, or the row's place in its scan where there is none.

    Never a hash of the row: equal rows would stay together.
    """
    if labels.row_num in rows.columns:
        return col(labels.row_num)
    return F.monotonically_increasing_id()


def flag_partner(
    partner: DataFrame, primary: DataFrame, key: str, labels: Labels = DEFAULT_LABELS, stored: bool = False
) -> DataFrame:
    """Partner rows flagged by the keys of the valid primary rows; ``stored`` as in ``key_set``."""
    where = is_valid(primary.columns, labels)
    return flag_membership(partner, key, primary, key, labels.in_primary, labels, where, stored)


def flag_vendor(
    vendor: DataFrame,
    primary: DataFrame,
    partner: DataFrame | None,
    key: str,
    labels: Labels = DEFAULT_LABELS,
    stored: bool = False,
) -> DataFrame:
    """Vendor rows flagged by the valid primary rows and, if given, by all partner rows; ``stored`` as in ``key_set``."""
    if partner is None:
        return flag_partner(vendor, primary, key, labels, stored)
    text = match_key(key).alias("match_key")
    if stored:
        primary = primary.filter(is_valid(primary.columns, labels))
    primary_side = F.when(is_valid(primary.columns, labels), 1).otherwise(0).alias("side")
    tagged = (
        primary.select(text, primary_side)
        .unionByName(partner.select(text, F.lit(2).alias("side")))
        .groupBy("match_key")
        .agg(F.bit_or("side").alias("__sides"))
        .filter("__sides <> 0")
    )
    joined = lookup_join(vendor, tagged, match_key(key), "match_key", _row_id(vendor, labels))
    sides = F.coalesce(F.col("__sides"), F.lit(0))
    return joined.select(
        *[col(name) for name in vendor.columns],
        _flag(sides.bitwiseAND(1) != 0, labels).alias(labels.in_primary),
        _flag(sides.bitwiseAND(2) != 0, labels).alias(labels.in_partner),
    )


def match_summary(
    flagged: dict[str, DataFrame], labels: Labels = DEFAULT_LABELS
) -> DataFrame:
    """Per flagged list: rows, rows found in primary, rows found in partner, new rows."""
    parts = []
    for name, rows in flagged.items():
        in_partner = (
            F.count_if(col(labels.in_partner) == labels.yes)
            if labels.in_partner in rows.columns
            else F.lit(0).cast("long")
        )
        parts.append(
            rows.agg(
                F.count(F.lit(1)).alias("total_rows"),
                F.count_if(col(labels.in_primary) == labels.yes).alias("in_primary"),
                in_partner.alias("in_partner"),
            ).select(F.lit(name).alias("list"), "*", (F.col("total_rows") - F.col("in_primary")).alias("new_rows"))
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def new_rows(flagged: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Rows of a flagged list whose key is not in the primary list."""
    return flagged.filter(col(labels.in_primary) == labels.no)


def overlap_rows(flagged: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Rows of a flagged list whose key is in the primary list."""
    return flagged.filter(col(labels.in_primary) == labels.yes)
