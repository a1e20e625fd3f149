"""Left join to a table with one row per key that stays balanced under hot keys.

A list may carry one value in a third of its rows, and null or blank keys may be just as frequent. A
plain shuffle join would send each such group to one task. The table is written and measured first:

* a table of at most ``SMALL_BYTES`` is broadcast, and the list is not shuffled at all;
* beyond that, a key with more rows than a task should take is salted. The number of its salts is its row
  count by that target, so it grows with the list and no key is left out; only its table row is
  replicated. Row counts are exact: from the table, if it was made by grouping the list, else from
  one aggregate with map-side combine;
* rows without a key match nothing and are spread by their row id.

How a key is treated never changes the result, only where its rows are processed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import measured

SMALL_BYTES = 8 << 20
TARGET_ROWS = 500_000
#: Keys that hold more than this part of all hot rows are fewer than this number: the bound of what is broadcast.
MOST_HOT = 100_000
_ROW_BYTES = 32

_KEY, _SALT, _SALTS = "__lookup_key", "__lookup_salt", "__lookup_salts"


def table_bytes(table: DataFrame, where: Column | None = None) -> Column:
    """Aggregate: about how many bytes the rows of ``table`` (``where``) take in memory."""
    texts = [c for c, kind in table.dtypes if kind == "string"]
    width = F.lit(_ROW_BYTES + 8 * len(table.columns))
    for name in texts:
        width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    width = width.cast("bigint")
    return F.coalesce(F.sum(width if where is None else F.when(where, width)), F.lit(0).cast("bigint"))


def hot_keys(counts: DataFrame, key: str, rows: str, target: int = TARGET_ROWS) -> DataFrame | None:
    """Keys with more than ``target`` rows and their number of salts; None if there are no such keys.

    There are at most ``MOST_HOT``: where the list is so large that more keys exceed the target, the
    target grows.
    """
    above = counts.filter(F.col(rows) > target).select(F.col(key).alias(_KEY), F.col(rows).alias("n"))
    hot, found = measured(above, keys=F.count(F.lit(1)), n=F.sum("n"))
    if not found["keys"]:
        return None
    if found["keys"] > MOST_HOT:
        target = max(target, found["n"] // MOST_HOT)
    return hot.filter(F.col("n") > target).select(_KEY, F.ceil(F.col("n") / F.lit(target)).cast("int").alias(_SALTS))


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: Column,
    table_key: str,
    row_id: Column,
    key_rows: str | None = None,
    small_bytes: int | None = None,
    target: int | None = None,
) -> DataFrame:
    """``rows`` with the non-key columns of ``table``; null where ``key`` has no match.

    ``table`` must hold one row per ``table_key``; ``key_rows`` names its column with the number of list
    rows of the key, if it has one. ``row_id`` spreads the rows of a hot key and should differ between them.
    On a stream, whose keys cannot be counted, a large table is joined without salts.
    """
    small_bytes = SMALL_BYTES if small_bytes is None else small_bytes
    target = TARGET_ROWS if target is None else target
    table = table.withColumnRenamed(table_key, _KEY).filter(F.col(_KEY).isNotNull())
    most = F.max(key_rows) if key_rows else F.lit(target + 1)
    table, size = measured(table, bytes=table_bytes(table), most=F.coalesce(most, F.lit(0)).cast("bigint"))
    keyed = rows.withColumn(_KEY, key)
    if size["bytes"] <= small_bytes:
        return keyed.join(F.broadcast(table), _KEY, "left").drop(_KEY)
    if rows.isStreaming:
        return keyed.join(table, _KEY, "left").drop(_KEY)
    hot = None
    if size["most"] > target:
        if key_rows:
            counts, count = table, key_rows
        else:
            counts, count = rows.groupBy(key.alias(_KEY)).agg(F.count(F.lit(1)).alias("n")).filter(F.col(_KEY).isNotNull()), "n"
        hot = hot_keys(counts, _KEY, count, target)
    spread = F.xxhash64(row_id)
    salt = F.when(F.col(_KEY).isNull(), spread)
    if hot is None:
        salted = keyed.withColumn(_SALT, salt.otherwise(F.lit(0).cast("bigint")))
        replicated = table.withColumn(_SALT, F.lit(0).cast("bigint"))
    else:
        hot = F.broadcast(hot)
        some = salt.when(F.col(_SALTS).isNotNull(), F.pmod(spread, F.col(_SALTS).cast("bigint")))
        salted = keyed.join(hot, _KEY, "left").withColumn(_SALT, some.otherwise(F.lit(0).cast("bigint"))).drop(_SALTS)
        every_salt = F.sequence(F.lit(0).cast("bigint"), F.coalesce(_SALTS, F.lit(1)).cast("bigint") - 1)
        replicated = table.join(hot, _KEY, "left").withColumn(_SALT, F.explode(every_salt)).drop(_SALTS)
    return salted.join(replicated, [_KEY, _SALT], "left").drop(_KEY, _SALT)
