"""Result sinks: one batch folder per run, one folder per list and data set."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from ..labels import DEFAULT_LABELS, PRIMARY, Labels
from ..operators.dedup import dedup_metrics, repeated_rows
from ..operators.encode import dict_check_errors
from ..operators.rules import errors_for_export
from ..scratch import shared_root
from ..sources.lists import header_codes
from .run import INTERNAL_DEDUP, ListRun, facts_row, list_expressions
from .summary import summary_table

# A long list gets files of this many rows; a short one is dealt to all cores, down to the lower bound.
ROWS_PER_FILE, FEWEST_ROWS_PER_FILE = 1_000_000, 20_000
DICT_ERRORS = "dictionary"


def header_map(rows: DataFrame, codes: dict[str, str] | None = None, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Second header line: position, column name and its code; generated columns get a fixed word."""
    codes = header_codes(rows) if codes is None else codes
    entries = [(i, name, codes.get(name, labels.generated)) for i, name in enumerate(rows.columns)]
    return rows.sparkSession.createDataFrame(entries, "pos int, name string, code string")


def original_columns(rows: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    return rows.select(*[col(c) for c in rows.columns if not labels.is_generated(c)])


def in_row_order(rows: DataFrame, order: str, last: int) -> DataFrame:
    """Rows dealt to partitions by row number and sorted inside: files follow each other in order.

    The partition follows from the row number alone, so no sampling pass over the list is needed
    and every file holds the same number of rows, whatever the data look like.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    per_file = min(max(-(-last // cores), FEWEST_ROWS_PER_FILE), ROWS_PER_FILE)
    file = ((col(order) - 1) / per_file).cast("int")
    return rows.repartitionById((last - 1) // per_file + 1, file).sortWithinPartitions(col(order))


def write_dataset(rows: DataFrame, path: str, fmt: str) -> None:
    writer = rows.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def _last_row(rows: DataFrame, labels: Labels) -> int | None:
    """Highest row number of a list, None for an empty list; reads one column of the input."""
    if labels.row_num not in rows.columns:
        return None if rows.isEmpty() else 0
    return rows.agg(F.max(col(labels.row_num)).alias("last")).first()["last"]


def export_run(
    run: ListRun,
    output: str,
    fmt: str = "parquet",
    timestamp: str | None = None,
    repeats: bool = False,
    start: str | None = None,
    end: str | None = None,
) -> dict[str, str]:
    """Writes data, header, summary and error tables per list; returns the folder per list.

    Empty lists are left out (rows are never removed, so an empty input is an empty result). The
    data set is written first, and what the summary counts is observed by that write; dictionary errors
    and repeats are then read from it instead of computing the marks again.
    """
    labels = run.labels
    spark: SparkSession = run.primary.sparkSession
    batch = f"{output}/批次_{timestamp or datetime.now().strftime('%Y%m%d_%H%M%S')}"
    written: dict[str, str] = {}
    expressions, found = list_expressions(run), {}
    kept = replace(run, lists=dict(run.lists), errors=dict(run.errors))
    for key, rows in run.lists.items():
        last = _last_row(run.inputs.get(key, rows), labels)
        if last is None:
            continue
        folder = written[key] = f"{batch}/list={key}"
        seen = Observation()
        counted = [F.expr(f"cast({e} as long)").alias(n) for n, e in expressions[key].items()]
        write_dataset((in_row_order(rows, labels.row_num, last) if last else rows).observe(seen, *counted), f"{folder}/data", fmt)
        found |= seen.get
        if fmt == "parquet":
            kept.lists[key] = spark.read.schema(rows.schema).parquet(f"{folder}/data")
        codes = header_codes(rows)
        if codes:
            write_dataset(header_map(rows, codes, labels), f"{folder}/header", fmt)
    if DICT_ERRORS in kept.errors:
        kept.errors[DICT_ERRORS] = dict_check_errors(kept.primary, labels)
    facts = facts_row(spark, found)
    for key, folder in written.items():
        write_dataset(summary_table(kept, key, start=start, end=end, facts=facts), f"{folder}/summary", fmt)
        if key == PRIMARY:
            for name, errors in kept.errors.items():
                write_dataset(errors_for_export(errors), f"{folder}/errors_{name}", fmt)
            if repeats and run.ran(INTERNAL_DEDUP):
                some = (found.get("repeat_rows") or 0) > 0
                marked = kept.primary
                write_dataset(
                    repeated_rows(marked, labels) if some else dedup_metrics(marked, labels),
                    f"{folder}/repeats",
                    fmt,
                )
    return written


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the folder that driver and executors share."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
