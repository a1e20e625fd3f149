"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group, and a group must not be cut. A partial partition is a tuple of one
load per shard. Two partial partitions are combined by adding the largest load of one to the smallest
of the other, and so on; the pair with the largest spread (largest minus smallest load) is always
combined next, so differences cancel until one tuple is left.

At scale this runs as a tree. Groups are dealt by hash to blocks of bounded size; every block
differences its groups, in a task of its own, down to one partial partition; partial partitions of
blocks are differenced in the same way, ``fan_in`` at a time, until one is left. Each step remembers
which load went where, and the final shard of a group is the composition of those permutations, read
back by joins. Only sizes travel, never texts, and the driver sees a few totals.

Heavy groups (more than 1/512 of a shard's even share) skip the blocks and enter the last step as
partial partitions of their own, so that the small ones fill up around them. A group that is larger
than an even share of what is left cannot be balanced: it gets a shard to itself and the others
share the rest evenly. There are fewer such groups than shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.scratch import settled

BLOCK_GROUPS = 20_000
FAN_IN = 2_000
HEAVY_PART = 512
ROWS_A_BUCKET = 100_000


def difference(tuples: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Combines partial partitions to one.

    Returns its loads, and for every input tuple the final place of each of its loads.
    """
    width = len(tuples[0])
    heap = []
    for i, loads in enumerate(tuples):
        order = sorted(range(width), key=lambda k: -loads[k])
        heap.append((min(loads) - max(loads), i, [loads[k] for k in order], [[(i, k)] for k in order]))
    heapq.heapify(heap)
    serial = len(tuples)
    while len(heap) > 1:
        _, _, a, a_parts = heapq.heappop(heap)
        _, _, b, b_parts = heapq.heappop(heap)
        joined = []
        for k in range(width):
            mine, other = a_parts[k], b_parts[width - 1 - k]
            if len(mine) < len(other):
                mine, other = other, mine
            mine.extend(other)
            joined.append((a[k] + b[width - 1 - k], mine))
        joined.sort(key=lambda x: -x[0])
        loads = [x[0] for x in joined]
        heapq.heappush(heap, (loads[-1] - loads[0], serial, loads, [x[1] for x in joined]))
        serial += 1
    _, _, loads, parts = heap[0]
    places = [[0] * width for _ in tuples]
    for place, members in enumerate(parts):
        for i, k in members:
            places[i][k] = place
    return loads, places


def _block_of_groups(width: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "h1", "h2"])
        loads, places = difference([[int(s)] + [0] * (width - 1) for s in frame["size"]])
        out = frame[["h1", "h2", "block"]].copy()
        out["place"] = [p[0] for p in places]
        out["loads"] = [loads] * len(out)
        return out

    return run


def _block_of_partials(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("block")
    loads, places = difference([[int(x) for x in row] for row in frame["loads"]])
    return pd.DataFrame(
        {"block": frame["block"], "up": frame["up"], "places": places, "loads": [loads] * len(frame)}
    )


def _own_shards(heaviest: list[int], total: int, shards: int) -> int:
    """How many of the heaviest groups exceed an even share of what is left, one after the other."""
    alone, left = 0, total
    for size in heaviest:
        if shards - alone > 1 and size * (shards - alone) > left:
            alone, left = alone + 1, left - size
        else:
            break
    return alone


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def group_shards(groups: DataFrame, shards: int, block_groups: int = BLOCK_GROUPS, fan_in: int = FAN_IN) -> DataFrame:
    """``groups(h1, h2, size)``, one row per group, as ``(h1, h2, shard)``."""
    spark = groups.sparkSession
    groups = settled(groups)
    totals = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    if not totals["n"]:
        return _empty(spark, "h1 bigint, h2 bigint, shard int")
    total = int(totals["bytes"])
    order = [F.desc("size"), F.col("h1"), F.col("h2")]
    top = groups.orderBy(*order).limit(shards).collect()
    alone = _own_shards([int(r["size"]) for r in top], total, shards)
    giants = [(r["h1"], r["h2"], i) for i, r in enumerate(top[:alone])]
    width = shards - alone
    left = total - sum(int(r["size"]) for r in top[:alone])
    giant_rows = spark.createDataFrame(giants, "h1 bigint, h2 bigint, shard int") if giants else None
    rest = groups.join(giant_rows, ["h1", "h2"], "left_anti") if giants else groups

    is_heavy = F.col("size") * F.lit(width * HEAVY_PART) > F.lit(left)
    blocks = max(1, -(-int(totals["n"]) // block_groups))
    dealt = rest.filter(~is_heavy).withColumn("block", F.pmod("h1", F.lit(blocks)))
    placed = settled(
        dealt.groupBy("block").applyInPandas(
            _block_of_groups(width), "h1 bigint, h2 bigint, block bigint, place int, loads array<bigint>"
        )
    )
    heavy = rest.filter(is_heavy).withColumn("block", -F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    single = F.concat(F.array("size"), F.array_repeat(F.lit(0).cast("bigint"), width - 1))
    partials = placed.groupBy("block").agg(F.first("loads").alias("loads")).unionByName(
        heavy.select("block", single.alias("loads"))
    )
    chain = placed.select("h1", "h2", "block", "place").unionByName(
        heavy.select("h1", "h2", "block", F.lit(0).alias("place"))
    )
    count = blocks
    while True:
        ups = -(-count // fan_in)
        last = ups == 1
        # Heavy groups (negative numbers) wait for the last step.
        now = partials if last else partials.filter("block >= 0")
        up = F.lit(0).cast("bigint") if last else F.pmod(F.xxhash64("block"), F.lit(ups))
        stepped = settled(
            now.withColumn("up", up).groupBy("up").applyInPandas(
                _block_of_partials, "block bigint, up bigint, places array<int>, loads array<bigint>"
            )
        )
        moved = stepped.select("block", "up", "places")
        chain = chain.join(moved, "block", "left").select(
            "h1", "h2",
            F.coalesce("up", "block").alias("block"),
            F.coalesce(F.get("places", F.col("place")), F.col("place")).alias("place"),
        )
        if last:
            break
        partials = stepped.groupBy(F.col("up").alias("block")).agg(F.first("loads").alias("loads")).unionByName(
            partials.filter("block < 0")
        )
        count = ups
    result = chain.select("h1", "h2", (F.col("place") + F.lit(alone)).cast("int").alias("shard"))
    return result.unionByName(giant_rows) if giants else result


def _free_names(carry: list[str], taken: list[str]) -> list[tuple[str, str]]:
    """Carried columns with names that neither the new columns nor each other have."""
    used = {c.lower() for c in [*taken, *carry]}
    names = []
    for column in carry:
        name = column
        if column.lower() in {c.lower() for c in taken}:
            while name.lower() in used:
                name = f"carried_{name}"
            used.add(name.lower())
        names.append((column, name))
    return names


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``shard``, ``slot`` and the carried columns.

    ``size`` is the number of UTF-8 bytes of the text (null: 0) plus 1. Rows with equal texts share a
    shard; a null text is a group apart from the empty text. ``slot`` numbers the rows of a shard from
    0 without gaps. Rows with one id and one text are numbered in any order among themselves. An
    empty table gives an empty result. A carried column whose name (in any case) is that of the id or of a
    new column gets ``carried_`` before its name, as often as it takes to be unique.
    """
    digest = F.coalesce(F.md5(F.col(text_column)), F.lit("null"))
    count = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    buckets = max(1, -(-count // ROWS_A_BUCKET)) * 4
    rows = docs.select(
        F.col(id_column).alias("__id"),
        (F.coalesce(F.octet_length(text_column), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.xxhash64(digest).alias("h1"),
        F.xxhash64(F.lit(1), digest).alias("h2"),
        *[F.col(c).alias(f"__carry_{c}") for c in carry or []],
    ).withColumn("bucket", F.pmod(F.xxhash64("__id", "h1"), F.lit(buckets)).cast("int"))
    narrow = settled(rows.groupBy("h1", "h2", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")))
    shard_of = settled(group_shards(narrow.groupBy("h1", "h2").agg(F.sum("size").alias("size")), shards))
    # Counts per shard and bucket give every bucket its first slot; there are few of them.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = narrow.join(shard_of, ["h1", "h2"]).groupBy("shard", "bucket").agg(F.sum("rows").alias("rows")).select(
        "shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("shard", "bucket").orderBy("__id", "h1", "h2")
    numbered = rows.join(shard_of, ["h1", "h2"]).withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        F.col("__id").alias(id_column),
        "size", "shard", (F.col("offset") + F.col("nth")).cast("bigint").alias("slot"),
        *[F.col(f"__carry_{c}").alias(name) for c, name in _free_names(carry or [], [id_column, "size", "shard", "slot"])],
    )
