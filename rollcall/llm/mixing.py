"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: its share of the output divided by its share of the input.
A document is repeated as often as a Poisson distribution with that mean says, inverted at a number
between 0 and 1 that is a hash of the seed and the document id. So the draw needs no state, a lost
task draws the same again, and no source is gathered anywhere: rates come from one aggregate with one
row per source. The copies are then dealt by a hash of (seed, id, copy) and sorted by it within each
partition, which is a global shuffle in one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators.lookup import lookup_join
from rollcall.scratch import measured, settled

#: The steps of all sources together are broadcast up to this size; beyond it they are joined with salted hot sources.
BROADCAST_BYTES = 8 << 20
_BITS = 52
_UNSEEN = 2.0 ** -(_BITS + 1)


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    bits = F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(2.0**_BITS)


def poisson_steps(mean: float) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... as far as 52 bits can tell them from 1.

    Terms are summed from their logarithms, so large means do not underflow.
    """
    if not mean or mean <= 0 or math.isnan(mean):
        return []
    steps, total, k = [], 0.0, 0
    while True:
        term = math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
        total += term
        steps.append(total)
        k += 1
        if k > mean and (1.0 - total < _UNSEEN or term < _UNSEEN * 1e-3):
            return steps


def _with_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["steps"] = [poisson_steps(x) for x in batch["rate"]]
        yield batch


def source_rates(
    docs: DataFrame,
    source_column: str = "source",
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    size: Column | None = None,
    epochs: float = 1.0,
) -> DataFrame:
    """``(source, input_size, target_weight, rate)``, one row per source, the null source included.

    ``weights`` are target shares (normalised; sources that are not named get 0). Without them a
    source weighs its input size to the power ``temperature``. ``size`` is what is mixed: rows by
    default. ``epochs`` scales the expected output against the input.
    """
    sizes = settled(
        docs.groupBy(F.col(source_column).alias("source")).agg(
            F.sum(size if size is not None else F.lit(1)).cast("double").alias("input_size")
        )
    )
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("input_size", F.lit(temperature)))
    else:
        listed = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "source string, weight double"
        )
        weighed = sizes.join(listed, sizes["source"].eqNullSafe(listed["source"]), "left").select(
            sizes["source"], "input_size", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    totals = weighed.agg(F.sum("input_size").alias("all_size"), F.sum("weight").alias("all_weight")).first()
    share = F.col("weight") / F.lit(totals["all_weight"] or 1.0)
    expected = F.lit(float(epochs) * (totals["all_size"] or 0.0))
    return weighed.select(
        "source", "input_size", share.alias("target_weight"),
        F.when(F.col("input_size") > 0, share * expected / F.col("input_size")).otherwise(0.0).alias("rate"),
    )


def poisson_mix(
    docs: DataFrame,
    rates: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    seed: int = 0,
    copy_column: str = "mix_copy",
    key_column: str = "mix_key",
) -> DataFrame:
    """All columns of ``docs``, each row once per copy, plus ``mix_copy`` (from 0) and ``mix_key``.

    ``rates`` has ``source`` and ``rate``. The number of copies follows from seed and id alone, so
    repeated rows with one id get equal numbers of copies; a null id counts as the text ``null``. A
    source without a rate, or with rate 0, vanishes. Rows come in the order of ``mix_key`` within
    each partition. An empty table stays empty. Columns of ``docs`` that are named like the two new ones
    (in any case) are replaced by them; other names for the new ones keep such columns.
    """
    # A null source and the text it might be written as are different keys.
    source_key = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))
    steps, found = measured(
        rates.select("source", "rate").mapInPandas(_with_steps, "source string, rate double, steps array<double>")
        .filter(F.size("steps") > 0).select(source_key(F.col("source")).alias("__source"), F.col("steps").alias("__steps")),
        bytes=F.coalesce(F.sum(F.octet_length("__source") + F.lit(8) * F.size("__steps") + F.lit(64)), F.lit(0)).cast("bigint"),
    )
    number = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    key = source_key(F.col(source_column))
    # Drawn below the join, so that the hash is computed once a row and not once a step.
    drawn = docs.withColumn("__drawn", unit_hash(F.lit(str(seed)), number))
    if found["bytes"] <= BROADCAST_BYTES:
        joined = drawn.withColumn("__key", key).join(F.broadcast(steps), F.col("__key") == F.col("__source"))
    else:
        joined = lookup_join(drawn, steps, key, "__source", F.xxhash64(number), small_bytes=0).filter(F.col("__steps").isNotNull())
    new = (copy_column.lower(), key_column.lower())
    return (
        joined.withColumn("__copies", F.size(F.filter("__steps", lambda s: s <= F.col("__drawn"))))
        .filter(F.col("__copies") > 0)
        .select(
            number.alias("__number"),
            *[F.col(c) for c in docs.columns if c.lower() not in new],
            F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias(copy_column),
        )
        .withColumn(key_column, F.xxhash64(F.lit(seed), "__number", copy_column))
        .drop("__number")
        .repartition(key_column)
        .sortWithinPartitions(key_column)
    )
