"""Runs that are executed stage by stage, with a journal, and go on where an earlier call ended.

Every stage ends with a write of the lists that it changed. What the stage counts is observed by that
write, so there are no count jobs. The journal is an append-only table with one row per stage and
attempt: its state, time, folder and counts. A failure of a stage's jobs fails that stage only; the run goes
on with the lists as they were. A second call with the same run id takes the stages that were
completed in a row from their folders and executes the rest.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..labels import PRIMARY
from ..operators.encode import dict_check_errors, encoded_fields
from ..schemas import JOURNAL_SCHEMA
from .run import (
    COMPLETED, DICT_CHECK, DICT_ENCODE, FAILED, FIELD_RULES, LOAD, SKIPPED, STAGES, ListRun,
    errors_of_failing, facts_row, run_lists, stage_counts, stage_expressions,
)

RESUMED = "resumed"


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The journal table; empty before its first run."""
    try:
        return spark.read.schema(JOURNAL_SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], JOURNAL_SCHEMA)


def latest_attempts(journal: DataFrame, run_id: str) -> DataFrame:
    """The last journal row of every stage of a run (a few rows)."""
    newest = Window.partitionBy("stage").orderBy(F.desc("created_at"), F.desc("attempt"))
    rows = journal.filter(F.col("run_id") == run_id)
    return rows.withColumn("__nth", F.row_number().over(newest)).filter("__nth = 1").drop("__nth")


class Journal:
    """The boundary of the stages of one run: writes lists, observes counts, keeps the journal."""

    def __init__(self, spark: SparkSession, path: str, work_dir: str, run_id: str):
        self.spark, self.path, self.work_dir, self.run_id = spark, path, work_dir, run_id
        self.attempt = uuid.uuid4().hex
        self.counted: dict[str, int | None] = {}
        past = {r["stage"]: r for r in latest_attempts(read_journal(spark, path), run_id).collect()}
        #: Stages that need not run again: completed ones, up to the first that is not.
        self.done: dict[str, Any] = {}
        for stage in (LOAD, *STAGES):
            row = past.get(stage)
            if row is None or row["status"] not in (COMPLETED, RESUMED):
                break
            self.done[stage] = row
        self.began = time.monotonic()

    def _append(self, stage: str, status: str, folder: str | None, facts: dict[str, int | None], message: str | None = None) -> None:
        elapsed = int((time.monotonic() - self.began) * 1000)
        row = self.spark.createDataFrame([(self.run_id, self.attempt, stage, status, elapsed, folder, json.dumps(facts), message)], ", ".join(
            f"{f.name} {f.dataType.simpleString()}" for f in JOURNAL_SCHEMA.fields[:-1]
        ))
        row.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)
        self.counted |= facts
        self.began = time.monotonic()

    def _write(self, run: ListRun, stage: str, keys: Sequence[str], named: dict[str, dict[str, str]]) -> tuple[str, dict[str, int | None]]:
        """Writes lists, each with what is to be counted in it, and reads them back."""
        folder = f"{self.work_dir}/{self.run_id}/{stage}-{self.attempt}"
        facts: dict[str, int | None] = {}
        for key in keys:
            rows, wanted = run.lists[key], named.get(key, {})
            seen = Observation() if wanted else None
            if seen:
                rows = rows.observe(seen, *[F.expr(f"cast({e} as long)").alias(n) for n, e in wanted.items()])
            rows.write.parquet(f"{folder}/{key}")
            facts |= seen.get if seen else {}
            run.lists[key] = self.spark.read.schema(run.lists[key].schema).parquet(f"{folder}/{key}")
        return folder, facts

    def load(self, run: ListRun) -> None:
        """Writes the lists as they come in, each read once for all stages, and counts their rows."""
        row = self.done.get(LOAD)
        if row is not None:
            self._reread(run, row["folder"], list(run.lists))
            return self._append(LOAD, RESUMED, row["folder"], json.loads(row["facts"]))
        folder, facts = self._write(run, LOAD, list(run.lists), {key: {f"{key}_rows": "count(1)"} for key in run.lists})
        self._append(LOAD, COMPLETED, folder, facts)

    def _reread(self, run: ListRun, folder: str, keys: Sequence[str]) -> None:
        for key in keys:
            run.lists[key] = self.spark.read.parquet(f"{folder}/{key}")

    def execute(self, run: ListRun, stage: str, action: Callable[[ListRun], None]) -> None:
        self.began = time.monotonic()
        row = self.done.get(stage)
        tag = f"rollcall {self.run_id} {stage}"
        self.spark.sparkContext.addJobTag(tag)
        try:
            if row is not None:
                facts = json.loads(row["facts"])
                self._reread(run, row["folder"], (row["message"] or "").split("|") if row["message"] else [])
                self._append(stage, RESUMED, row["folder"], facts, row["message"])
            else:
                before = dict(run.lists)
                action(run)
                changed = [key for key in run.lists if run.lists[key] is not before.get(key)]
                folder, facts = self._write(run, stage, changed, stage_expressions(run, stage))
                self._append(stage, COMPLETED, folder, facts, "|".join(changed))
            if stage == FIELD_RULES:
                run.stored = True
                errors_of_failing(run)
            elif stage == DICT_ENCODE:
                run.encoded = encoded_fields(run.spec, run.inputs[PRIMARY].columns)
            elif stage == DICT_CHECK:
                run.errors["dictionary"] = dict_check_errors(run.primary, run.labels)
        finally:
            self.spark.sparkContext.removeJobTag(tag)

    def skipped(self, run: ListRun, stage: str, reason: str) -> None:
        self.done = {}
        self._append(stage, SKIPPED, None, {}, reason)

    def failed(self, run: ListRun, stage: str, error: str) -> None:
        self.done = {}
        self._append(stage, FAILED, None, {}, error.split("\n")[0][:500])

    def facts(self) -> DataFrame:
        """All counts of the run as one row, as ``run_facts`` gives them, without another scan."""
        return facts_row(self.spark, self.counted)


def run_staged(lists, spec=None, dictionary=None, *, journal: str, work_dir: str, run_id: str, **options) -> tuple[ListRun, Journal]:
    """``run_lists`` with every stage executed where it ends; see the module for what that means.

    ``journal`` and ``work_dir`` are folders that all workers share. The lists of a stage stay in
    ``work_dir/run_id`` until the caller deletes it. Returns the run and its journal.
    """
    spark = lists[PRIMARY].sparkSession
    account = Journal(spark, journal, work_dir, run_id)
    loaded = ListRun(dict(lists), spec, dictionary, None)
    account.load(loaded)
    return run_lists(loaded.lists, spec, dictionary, boundary=account, **options), account


def stage_log(run: ListRun, journal: DataFrame, run_id: str) -> DataFrame:
    """The last state of every stage: status, success, fail and skip counts (null unless it was completed), message."""
    counts = stage_counts(run)
    names = sorted({n for row in counts.values() for text in row for n in _facts_in(text)})
    parsed = F.from_json("facts", ", ".join(f"{n} bigint" for n in names) or "none bigint")
    rows = latest_attempts(journal, run_id).select("stage", "status", parsed.alias("f"), "message", "elapsed_ms")
    totals = rows.agg(*[F.coalesce(F.max(f"f.{n}"), F.lit(0)).alias(n) for n in names] or [F.count(F.lit(1)).alias("none")])
    order = {stage: i for i, stage in enumerate((LOAD, *STAGES))}
    table = totals.selectExpr("inline(array(" + ", ".join(
        f"struct('{stage}' as stage, {order[stage]} as pos, {ok} as success, {fail} as fail, {skip} as skip)" for stage, (ok, fail, skip) in counts.items()
    ) + "))")
    joined = rows.drop("f").join(F.broadcast(table), "stage", "left")
    position = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return joined.withColumn("pos", position[F.col("stage")]).select("pos", "stage", "status", "success", "fail", "skip", "message", "elapsed_ms")


def _facts_in(text: str) -> list[str]:
    from .run import FACTS

    return [name for name in FACTS if name in text.replace("(", " ").replace(")", " ").replace(",", " ").split()]
