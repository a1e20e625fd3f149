"""From raw documents to shards for training, in five stages.

Every stage gets the rows that its predecessor kept, written as Parquet and read again, so a lost
executor costs a part of one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import bits, jaccard, leaks, mixing, quality, sharding
from rollcall.llm.queries import MIX_SEED, QUALITY_CUT, SHARDS, fitted_quality
from rollcall.scratch import scratch_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Rows that go to a Python worker at a time: rows are whole texts here, and a batch of Spark's usual 10,000 is large.
BATCH_ROWS = 1_000


def _in_small_batches(stage: Stage) -> Stage:
    """The stage in a session whose batches suit rows of whole texts, also while its result is written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Without labels nothing is rejected."""
    model = fitted_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs, model, score_column="__quality")
    return scored.filter(F.col("__quality") >= QUALITY_CUT).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one whose id names the group.

    Rows that repeat an id are one document, of which the row with the longest text stays (ties: the
    largest in the order of the columns). Rows with a null id stay as they are.
    """
    groups = jaccard.jaccard_components(docs)
    dropped = groups.filter("component_id <> doc_id").select("doc_id")
    kept = bits.without_keys(docs, dropped, "doc_id")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    # Both kinds of ids leave in one pass: a task of two passes in a row would hold two Python workers.
    ids = dropped.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).unionByName(repeated)
    once = bits.without_keys(docs, ids, "doc_id")
    again = kept.join(repeated, "doc_id", "left_semi").select(docs.columns)
    row = F.struct(F.length("text").alias("__size"), *[F.col(c) for c in docs.columns])
    return once.unionByName(again.groupBy("doc_id").agg(F.max(row).alias("row")).select([F.col(f"row.{c}") for c in docs.columns]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    judged = leaks.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column="__key")
    return bits.without_keys(keyed, judged.filter("contaminated").select("__key"), "__key").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, in global random order."""
    return mixing.poisson_mix(docs, mixing.source_rates(docs), seed=MIX_SEED).select(docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard, their slot in it and their size; copies of a text share a shard."""
    return sharding.shard_documents(docs, SHARDS, carry=[c for c in docs.columns if c != "doc_id"])


STAGES: list[tuple[str, Stage]] = [
    (name, _in_small_batches(stage))
    for name, stage in (
        ("quality classifier", quality_stage),
        ("n-gram Jaccard join", near_duplicate_stage),
        ("benchmark decontamination", decontamination_stage),
        ("mixing sources to target weights", mixing_stage),
        ("sharding", sharding_stage),
    )
]

#: The classifier is trained by gradient descent, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark)
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
