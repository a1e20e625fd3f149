"""URL rules by a sort-merge range join.

A host is written back to front, every label followed by a mark: ``www.example.org`` becomes
``org·example·www·``. All hosts below a rule's host begin with its key and so form one interval of
the keys; intervals of different rules are nested or apart. Rules and urls are sorted together by key
and swept once. A rule pushes itself on the stack at the place of its depth, the number of its
labels. Two rules of one depth are apart, so the newer one has closed the older one's interval; a rule
whose interval the sweep has left is told by its key, which no longer begins the url's. No rule is
compared with another one, whatever their number. The longest rule of the stack whose path begins
the url's path decides.

Rules and urls are dealt by the first two labels, which are intervals of the keys too. An interval with
many urls is split into lanes by a hash of the page, as many as its exact count asks for, and a rule goes
only to the lanes of its own interval; rules of a single label go to all. Only key columns are sorted.
Everything is built from SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARK = "\x01"
_ROWS_A_LANE, _FEWEST_ROWS_A_LANE = 50_000, 500
#: Most intervals that are counted, so the broadcast table of their lanes stays below 3 MB; lanes have no bound.
_MOST_BUCKETS = 100_000


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) text between the first ``://`` and ``/``, ``?``, ``#`` or the end; else empty."""
    text = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(text), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by the mark."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), _MARK), F.lit(_MARK))


def rule_keys(rules: DataFrame) -> DataFrame:
    """``rules(host, path, verdict)`` as one row per key: ``key``, ``depth`` (labels) and its ``rules``."""
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), "host", "path", "verdict")
    return (
        rules.filter(F.col("host").isNotNull())
        .select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy(host_key(F.col("host")).alias("key"))
        .agg(F.collect_set(rule).alias("rules"))
        .withColumn("depth", F.length("key") - F.length(F.replace("key", F.lit(_MARK), F.lit(""))))
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    default_verdict: str = "allow",
    rows_a_lane: int = _ROWS_A_LANE,
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, ``rule`` (host + path, or null) and ``verdict``.

    Null urls and urls without ``://`` have an empty host and path, fit no rule and get the default.
    Repeated rows stay repeated. Of several fitting rules the one with the most characters wins, ties
    go to the later host, path and verdict in text order; null hosts in ``rules`` are ignored, and null
    paths are empty. Urls of any length are judged whole; no pages give no rows. Other columns of
    ``pages`` are not read, so their names cannot clash. A row carries the rules of the hosts above
    its own while it is swept.
    """
    keyed = pages.select(
        F.col(id_column).alias("id"),
        host_of(F.col(url_column)).alias("host"),
        path_of(F.col(url_column)).alias("path"),
    ).withColumn("key", host_key(F.col("host")))
    spark = pages.sparkSession
    rows = pages.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    # Several intervals a task, so that tasks come out even.
    wanted = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_a_lane))
    buckets = min(wanted, _MOST_BUCKETS)
    bucket = F.pmod(F.xxhash64(F.substring_index("key", _MARK, 2)), F.lit(buckets)).alias("bucket")
    a_lane = min(rows_a_lane, max(-(-rows // wanted), _FEWEST_ROWS_A_LANE))
    lanes = keyed.groupBy(bucket).agg(F.ceil(F.count(F.lit(1)) / a_lane).alias("lanes"))

    listed = rule_keys(rules)
    # A row per label count, of which a host name has 127 at most.
    depths = sorted(r["depth"] for r in listed.select("depth").distinct().collect())
    everywhere = F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))
    reached = F.when(F.col("depth") == 1, everywhere).otherwise(F.array(bucket))
    pushed = (
        listed.withColumn("bucket", F.explode(reached)).join(F.broadcast(lanes), "bucket")
        .select(
            "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lanes") - 1)).alias("lane"),
            "key", F.lit(0).alias("kind"), "depth", "rules",
        )
    )
    urls = keyed.withColumn("bucket", bucket).join(F.broadcast(lanes), "bucket").select(
        "bucket", F.pmod(F.xxhash64("id", "host", "path"), F.col("lanes")).alias("lane"),
        "key", F.lit(1).alias("kind"), "id", "host", "path",
    )
    both = urls.unionByName(pushed, allowMissingColumns=True)
    sweep = (
        Window.partitionBy("bucket", "lane").orderBy("key", "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    pushed_at = {f"at_{d}": F.last(F.when(F.col("depth") == d, F.col("rules")), ignorenulls=True).over(sweep) for d in depths}

    def fits(r: Column) -> Column:
        below = F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))
        return ((F.col("host") == r["host"]) | below) & F.startswith(F.col("path"), r["path"])

    # The result of array_max is null for a place that is empty or whose interval the sweep has left.
    best = [F.array_max(F.filter(name, fits)) for name in pushed_at]
    nothing = F.lit(None).cast(listed.schema["rules"].dataType.elementType)
    won = F.greatest(nothing, *best) if best else nothing
    return (
        both.withColumns(pushed_at)
        .filter(F.col("kind") == 1)
        .withColumn("won", won)
        .select(
            F.col("id").alias(id_column),
            "host",
            "path",
            F.concat(F.col("won.host"), F.col("won.path")).alias("rule"),
            F.coalesce(F.col("won.verdict"), F.lit(default_verdict)).alias("verdict"),
        )
    )
