"""Connected components of a link table by large-star and small-star steps.

Every step is a join-free aggregate and an explode over links. A vertex with very many links is
handled by sums of its own minimum only: neighbours are never gathered into a list. The links shrink
to stars within a number of rounds that grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.scratch import settled


def _least(directed: DataFrame) -> DataFrame:
    """``(u, m)``: the smallest of a vertex and its neighbours."""
    return directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    directed = both.select(F.col("a").alias("u"), F.col("b").alias("v"))
    return (
        directed.join(_least(directed), "u").filter(F.col("v") > F.col("u")).filter(F.col("v") != F.col("m"))
        .select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    directed = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = _least(directed)
    near = directed.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return near.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every vertex with a link; the component is its smallest vertex.

    Links may repeat, run either way or loop. Null ends are ignored.
    """
    now = settled(
        links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    )
    before = None
    while True:
        now = settled(_small_star(_large_star(now)))
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.hash("a", "b")).alias("s")
        ).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
