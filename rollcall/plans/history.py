"""Run history, dictionary versions and settings as append-only tables.

Each table is a log: a change appends a row, and the current state is the latest row per key, taken
by partial aggregation. Nothing is updated in place, so concurrent runs only append. The log of runs is
stored by month, so that deleting runs rewrites the months that hold them and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, duration_text, short_path
from ..schemas import RUN_SCHEMA, VERSION_SCHEMA
from ..scratch import settled

# The keys of the input map of a run.
INPUT_KEYS = ("primary", "partner", "vendor", "dict", "spec")
#: Column by which a log of runs is stored; events without a time have a month of their own.
MONTH, _NO_MONTH = "month", "none"


def append_runs(log: DataFrame, path: str) -> None:
    """Appends run events to the log at ``path``, dealt to one folder per month of ``event_time``."""
    month = F.coalesce(F.date_format("event_time", "yyyy-MM"), F.lit(_NO_MONTH))
    log.withColumn(MONTH, month).write.mode("append").partitionBy(MONTH).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The log at ``path`` with its month as text, whatever the months look like."""
    columns = [f for f in spark.read.parquet(path).schema.fields if f.name != MONTH]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    return spark.read.schema(f"{schema}, {MONTH} string").parquet(path)


def delete_runs(spark: SparkSession, path: str, run_ids: DataFrame) -> list[str]:
    """Deletes all events of the given runs from the log at ``path``; returns the months that changed.

    Months without such a run are neither read in full nor written. The rows that stay are written to
    scratch first, and then they replace their months in one commit; a month of which nothing stays is
    removed. A second call with the same ids finishes what a crash left. Null ids delete nothing. An
    event that is appended to a changed month meanwhile may be lost, so runs should not be writing to it.
    """
    log, gone = read_runs(spark, path), run_ids.select("run_id").distinct()
    # A row per month, whatever the size of the log.
    touched = sorted(r[MONTH] for r in log.select("run_id", MONTH).join(gone, "run_id", "left_semi").select(MONTH).distinct().collect())
    if not touched:
        return []
    kept = settled(without_runs(log.filter(F.col(MONTH).isin(touched)), gone))
    left = {r[MONTH] for r in kept.select(MONTH).distinct().collect()}
    columns = [c for c in log.columns if c != MONTH]
    kept.select(*columns, MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for month in touched:
        if month not in left:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{MONTH}={month}"), True)
    spark.catalog.refreshByPath(path)
    return touched


def _append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def start_run(spark: SparkSession, path: str, inputs: dict[str, str]) -> str:
    """Appends a run in state running and returns its id."""
    given = {k: inputs.get(k) for k in INPUT_KEYS}
    row = spark.range(1).select(
        F.uuid().alias("run_id"),
        F.current_timestamp().alias("event_time"),
        F.lit("running").alias("status"),
        F.current_timestamp().alias("start_time"),
        F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(v).cast("string"))]).alias("inputs"),
    )
    run_id = row.select("run_id").first()["run_id"]
    append_runs(_as_run(row.withColumn("run_id", F.lit(run_id))), path)
    return run_id


def finish_run(
    spark: SparkSession,
    path: str,
    run_id: str,
    status: str,
    totals: DataFrame | None = None,
    summary: Column | None = None,
    output_dir: str | None = None,
) -> None:
    """Appends the final state of a run. ``totals`` is the row of ``run_totals``."""
    base = totals if totals is not None else spark.range(1)
    has = set(base.columns)

    def pick(name: str) -> Column:
        return F.col(name) if name in has else F.lit(0).cast("long")

    append_runs(
        _as_run(
            base.select(
                F.lit(run_id).alias("run_id"),
                F.current_timestamp().alias("event_time"),
                F.lit(status).alias("status"),
                F.current_timestamp().alias("end_time"),
                pick("input_rows").alias("total_records"),
                pick("sum_success").alias("output_records"),
                pick("sum_fail").alias("error_records"),
                pick("rejected_rows").alias("duplicate_count"),
                (summary if summary is not None else F.lit(None).cast("string")).alias("summary"),
                F.lit(output_dir).cast("string").alias("output_dir"),
            )
        ),
        path,
    )


def _as_run(rows: DataFrame) -> DataFrame:
    """All run columns in schema order; missing ones are null."""
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RUN_SCHEMA.fields
        ]
    )


def latest_runs(log: DataFrame) -> DataFrame:
    """Current state per run: each column's latest non-null value."""
    others = [c for c in log.columns if c not in ("run_id", "event_time", MONTH)]
    return log.groupBy("run_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("event_time"))).alias(c) for c in others]
    )


def newest_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    """The latest ``n`` runs, newest first (a bounded top-n, no global sort)."""
    return runs.orderBy(F.desc("start_time"), "run_id").limit(n)


def run_inputs(runs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replaces one column per input by a map; ``columns`` maps input key to column."""
    pairs = [x for key, name in columns.items() for x in (F.lit(key), F.col(name).cast("string"))]
    kept = [c for c in runs.columns if c not in columns.values()]
    return runs.select(*kept, F.create_map(*pairs).alias("inputs"))


def one_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def without_runs(log: DataFrame, run_ids: DataFrame) -> DataFrame:
    """The log without the given runs; ``delete_runs`` takes them out of a stored log."""
    return log.join(run_ids.select("run_id").distinct(), "run_id", "left_anti")


def runs_for_display(runs: DataFrame) -> DataFrame:
    """Columns of the history view: file name, shortened output folder, duration text."""
    micros = F.unix_micros("end_time") - F.unix_micros("start_time")
    return runs.select(
        "run_id",
        "start_time",
        F.coalesce(base_name(F.col("inputs")["primary"]), F.lit("-")).alias("file_name"),
        short_path("output_dir").alias("output_dir"),
        "status",
        F.coalesce(duration_text(micros / 1e6), F.lit("-")).alias("duration"),
    )


def summary_of(runs: DataFrame, schema: str) -> DataFrame:
    """Adds the parsed summary; broken or missing JSON gives a struct of nulls."""
    parsed = F.from_json("summary", schema, {"mode": "PERMISSIVE"})
    return runs.withColumn("parsed", F.coalesce(parsed, F.from_json(F.lit("{}"), schema)))


def record_versions(fingerprints: DataFrame, path: str, run_id: str) -> None:
    """Appends the fingerprints (path, md5_hash) used by a run."""
    _append(
        fingerprints.select(
            F.lit(run_id).alias("run_id"),
            F.col("path").alias("dict_file"),
            base_name("path").alias("file_name"),
            "md5_hash",
            F.current_timestamp().alias("recorded_at"),
        ).to(VERSION_SCHEMA),
        path,
    )


def version_history(versions: DataFrame, dict_file: str, n: int = 10) -> DataFrame:
    """The latest ``n`` versions of one dictionary file, newest first."""
    return (
        versions.filter(F.col("dict_file") == dict_file)
        .select("run_id", "md5_hash", "recorded_at")
        .orderBy(F.desc("recorded_at"), "run_id")
        .limit(n)
    )


def current_settings(log: DataFrame) -> DataFrame:
    """Settings from their change log: latest value, description of the first write.

    A row with a null value deletes the key; a later write creates it anew, with its own
    description.
    """
    deleted = log.groupBy("key").agg(
        F.max(F.when(F.col("value").isNull(), F.col("updated_at"))).alias("deleted_at"),
        F.max_by("value", "updated_at").alias("value"),
        F.max("updated_at").alias("updated_at"),
        F.min_by("description", "updated_at").alias("first_description"),
    )
    alive = deleted.filter("value is not null")
    never = alive.filter("deleted_at is null").select(
        "key", "value", F.col("first_description").alias("description"), "updated_at"
    )
    # Keys that were deleted and written again are rare: only they look at the log once more.
    again = (
        log.join(alive.filter("deleted_at is not null").select("key", "deleted_at"), "key")
        .filter(F.col("updated_at") > F.col("deleted_at"))
        .groupBy("key")
        .agg(
            F.max_by("value", "updated_at").alias("value"),
            F.min_by("description", "updated_at").alias("description"),
            F.max("updated_at").alias("updated_at"),
        )
    )
    return never.unionByName(again)


def setting(settings: DataFrame, key: str) -> DataFrame:
    return settings.filter(F.col("key") == key).select("key", "value")


def stage_log(metrics: DataFrame, run_id: str, elapsed_ms: dict[str, int]) -> DataFrame:
    """Stage log rows of a run from its stage metrics."""
    times = F.create_map(*[x for k, v in elapsed_ms.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return metrics.select(
        F.lit(run_id).alias("run_id"),
        F.col("stage").alias("module"),
        F.lit("execute").alias("phase"),
        F.lit("completed").alias("status"),
        F.concat_ws("/", "success", "fail", "skip").alias("message"),
        F.lit(None).cast("string").alias("detail"),
        F.try_element_at(times, F.col("stage")).alias("elapsed_ms"),
        F.current_timestamp().alias("created_at"),
    )
