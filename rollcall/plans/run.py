"""One run over the three lists: chosen stages in the fixed order, all of them lazy.

Order: field rules → in-list de-duplication → dictionary encoding → dictionary check →
cross-list matching. Rows are never removed; every stage adds marker columns.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CriticalError, InputError, StageError
from ..functions.text import col, sql_name, sql_text
from ..labels import DEFAULT_LABELS, PARTNER, PRIMARY, VENDOR, Labels
from ..operators.dedup import dedup_mark
from ..operators.encode import dict_check_errors, encode_labels, encoded_fields, mark_dictionary
from ..operators.keys import resolve_key
from ..operators.match import flag_partner, flag_vendor
from ..operators.rules import FieldSpec, mark_rules, valid_rows, validation_errors

log = logging.getLogger(__name__)

LOAD, OUTPUT = "load", "output"
FIELD_RULES, INTERNAL_DEDUP, DICT_ENCODE = "field_validation", "internal_dedup", "dict_encode"
DICT_CHECK, CROSS_DEDUP = "dict_validation", "cross_dedup"
STAGES = (FIELD_RULES, INTERNAL_DEDUP, DICT_ENCODE, DICT_CHECK, CROSS_DEDUP)

COMPLETED, SKIPPED, FAILED = "completed", "skipped", "failed"


@dataclass(frozen=True)
class StageState:
    stage: str
    status: str
    message: str = ""


@dataclass
class ListRun:
    """Lazy result of a run: marked lists, error tables, what each stage did."""

    lists: dict[str, DataFrame]
    spec: FieldSpec | None
    dictionary: DataFrame | None
    key: str | None
    labels: Labels = DEFAULT_LABELS
    errors: dict[str, DataFrame] = field(default_factory=dict)
    stages: list[StageState] = field(default_factory=list)
    encoded: dict[str, str] = field(default_factory=dict)
    inputs: dict[str, DataFrame] = field(default_factory=dict)
    #: The rule markers of the primary list are read from a written table.
    stored: bool = False

    @property
    def primary(self) -> DataFrame:
        return self.lists[PRIMARY]

    def status_of(self, stage: str) -> str:
        return next((s.status for s in self.stages if s.stage == stage), SKIPPED)

    def ran(self, stage: str) -> bool:
        return self.status_of(stage) == COMPLETED

    @property
    def failed(self) -> bool:
        return any(s.status == FAILED for s in self.stages)


class StageBoundary(Protocol):
    """Executes stages where they end and keeps account of them."""

    def execute(self, run: ListRun, stage: str, action: Callable[[ListRun], None]) -> None: ...

    def skipped(self, run: ListRun, stage: str, reason: str) -> None: ...

    def failed(self, run: ListRun, stage: str, error: str) -> None: ...


def _need_spec(run: ListRun) -> str | None:
    return None if run.spec is not None else "请先执行字段规范导入"


def _need_dictionary(run: ListRun) -> str | None:
    return None if run.dictionary is not None else "数据字典加载失败"


def _need_key(run: ListRun, lists: Sequence[str]) -> str | None:
    if run.key is None:
        return "去重字段未识别"
    missing = [k for k in lists if k in run.lists and run.key not in run.lists[k].columns]
    return f"去重字段 '{run.key}' 在 {'、'.join(missing)} 名单中不存在" if missing else None


def _need_valid_rows(run: ListRun) -> str | None:
    return "一线名单无有效数据" if valid_rows(run.primary, run.labels).isEmpty() else None


def stored(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` as a written table: cuts the lineage and lets later readers prune columns."""
    rows.write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _field_rules(run: ListRun) -> None:
    run.errors[PRIMARY] = validation_errors(run.primary, run.spec, run.labels)
    run.lists[PRIMARY] = mark_rules(run.primary, run.spec, run.labels)


def _store_marked(run: ListRun, folder: str) -> None:
    """Writes the marked list; the error table then looks at the failing rows only."""
    run.lists[PRIMARY] = stored(run.primary, folder)
    run.stored = True
    errors_of_failing(run)


def errors_of_failing(run: ListRun) -> None:
    """Takes the error table from the failing rows of a marked list that is already written."""
    columns = [col(c) for c in run.inputs[PRIMARY].columns]
    failing = run.primary.filter(col(run.labels.rule_status) == run.labels.failed).select(*columns)
    run.errors[PRIMARY] = validation_errors(failing, run.spec, run.labels)


def _internal_dedup(run: ListRun) -> None:
    run.lists[PRIMARY] = dedup_mark(run.primary, run.key, run.labels, stored=run.stored)


def _dict_encode(run: ListRun) -> None:
    run.encoded = encoded_fields(run.spec, run.primary.columns)
    if run.encoded:
        run.lists[PRIMARY] = encode_labels(run.primary, run.encoded, run.dictionary, run.labels)


def _dict_check(run: ListRun) -> None:
    run.errors["dictionary"] = dict_check_errors(run.primary, run.labels)
    run.lists[PRIMARY] = mark_dictionary(run.primary, run.labels)


def _cross_dedup(run: ListRun) -> None:
    # The primary side counts by its field rules alone, also when the dictionary check ran.
    compliant = run.primary.drop(run.labels.dict_status)
    partner, vendor = run.lists.get(PARTNER), run.lists.get(VENDOR)
    if partner is not None:
        run.lists[PARTNER] = flag_partner(partner, compliant, run.key, run.labels, run.stored)
    if vendor is not None:
        run.lists[VENDOR] = flag_vendor(vendor, compliant, partner, run.key, run.labels, run.stored)


def _has_codes(run: ListRun) -> str | None:
    coded = any(c.endswith(run.labels.code_suffix) for c in run.primary.columns)
    return None if coded else "请先执行字典上码"


_ACTIONS: dict[str, Callable[[ListRun], None]] = {
    FIELD_RULES: _field_rules,
    INTERNAL_DEDUP: _internal_dedup,
    DICT_ENCODE: _dict_encode,
    DICT_CHECK: _dict_check,
    CROSS_DEDUP: _cross_dedup,
}
_PLAN_CHECKS: dict[str, tuple[Callable[[ListRun], str | None], ...]] = {
    FIELD_RULES: (_need_spec,),
    INTERNAL_DEDUP: (lambda run: _need_key(run, (PRIMARY,)),),
    DICT_ENCODE: (_need_spec, _need_dictionary),
    DICT_CHECK: (_need_dictionary, _has_codes),
    CROSS_DEDUP: (lambda run: _need_key(run, (PRIMARY, PARTNER, VENDOR)),),
}
_NEEDS_VALID_ROWS = (INTERNAL_DEDUP, DICT_CHECK, CROSS_DEDUP)


def run_lists(
    lists: Mapping[str, DataFrame],
    spec: FieldSpec | None = None,
    dictionary: DataFrame | None = None,
    key: str | None = None,
    stages: Sequence[str] = STAGES,
    configured_keys: Sequence[str] = (),
    check_rows: bool = True,
    work_dir: str | None = None,
    labels: Labels = DEFAULT_LABELS,
    boundary: StageBoundary | None = None,
) -> ListRun:
    """Applies the chosen stages; a stage whose precondition fails is skipped with its reason.

    ``work_dir`` is a folder all workers share. With it the rule markers are computed once and
    written there; de-duplication and matching then read the few columns they need from the written
    table, and a lost executor costs no second pass over the rules. Without it the plan stays lazy
    from end to end, and each consumer of the markers evaluates the rules for itself.

    ``check_rows`` also checks that there are rows to work on (a look for one row, not a count).
    Input errors abort the run, other errors fail their stage and the run goes on with the lists as they
    were before it. ``boundary`` executes every stage where it ends (``plans.journal``), so that errors of
    its jobs fail the stage too.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise InputError(f"unknown stages: {sorted(unknown)}", code="STAGE")
    if PRIMARY not in lists:
        raise InputError("the primary list is mandatory", code="PRIMARY_MISSING")
    chosen_key = key or resolve_key(
        [c for c in lists[PRIMARY].columns if not labels.is_generated(c)], configured_keys
    )
    run = ListRun(dict(lists), spec, dictionary, chosen_key, labels, inputs=dict(lists))
    empty = check_rows and run.primary.isEmpty()
    some_valid = False
    for stage in STAGES:
        if stage not in stages:
            run.stages.append(StageState(stage, SKIPPED, "not selected"))
            continue
        reason = next((r for check in _PLAN_CHECKS[stage] if (r := check(run))), None)
        if reason is None and empty:
            reason = "一线名单为空"
        if reason is None and check_rows and stage in _NEEDS_VALID_ROWS and not some_valid:
            reason = _need_valid_rows(run)
            some_valid = reason is None
        if reason is not None:
            log.warning("stage %s skipped: %s", stage, reason)
            run.stages.append(StageState(stage, SKIPPED, reason))
            if boundary:
                boundary.skipped(run, stage, reason)
            continue
        before = replace(run, lists=dict(run.lists), errors=dict(run.errors), encoded=dict(run.encoded))
        try:
            if boundary:
                boundary.execute(run, stage, _ACTIONS[stage])
            else:
                _ACTIONS[stage](run)
            if stage == FIELD_RULES and work_dir and not boundary:
                _store_marked(run, f"{work_dir}/marked-{uuid.uuid4().hex}")
        except (InputError, CriticalError):
            raise
        except (StageError, PySparkException, Py4JError, TypeError, ValueError, AttributeError) as e:
            log.exception("stage %s failed", stage)
            run.lists, run.errors, run.encoded = before.lists, before.errors, before.encoded
            run.stages.append(StageState(stage, FAILED, f"执行异常: {e}"))
            if boundary:
                boundary.failed(run, stage, str(e))
            continue
        run.stages.append(StageState(stage, COMPLETED))
    return run


def stage_expressions(run: ListRun, stage: str) -> dict[str, dict[str, str]]:
    """What a stage counts, per list: name of the fact and its aggregate as SQL text."""
    labels = run.labels

    def hits(frame: DataFrame, column: str, value: str) -> str:
        present = column in frame.columns
        return f"count_if({sql_name(column)} = {sql_text(value)})" if present else "max(0L)"

    facts: dict[str, str] = {}
    if stage == FIELD_RULES:
        facts["passed_rows"] = hits(run.primary, labels.rule_status, labels.passed)
        facts["failed_rows"] = hits(run.primary, labels.rule_status, labels.failed)
        facts["rule_problems"] = f"sum({sql_name(labels.rule_count)})"
        types = sql_name(labels.rule_types)
        for code in PROBLEM_CODES:
            # No code is part of another one, so removing it shows how often it occurs.
            removed = f"octet_length({types}) - octet_length(replace({types}, '{code}', ''))"
            facts[code] = f"sum(case when contains({types}, '{code}') then ({removed}) div {len(code)} else 0L end)"
    elif stage == INTERNAL_DEDUP:
        for fact, mark in (
            ("original_rows", labels.original),
            ("repeat_rows", labels.repeat),
            ("unknown_rows", labels.unknown),
            ("skipped_rows", labels.skipped),
        ):
            facts[fact] = hits(run.primary, labels.dedup, mark)
    elif stage == DICT_ENCODE and run.encoded:
        unmatched = sql_text(labels.unmatched)
        codes = [sql_name(name + labels.code_suffix) for name in run.encoded]
        facts["matched_codes"] = " + ".join(f"count_if({c} <> {unmatched})" for c in codes)
        facts["all_codes"] = f"count(1) * {len(codes)}"
    elif stage == DICT_CHECK:
        facts["dict_problems"] = f"sum({sql_name(labels.dict_count)})"
    elif stage == CROSS_DEDUP:
        return {
            key: {
                f"{key}_in_primary": hits(run.lists[key], labels.in_primary, labels.yes),
                f"{key}_in_partner": hits(run.lists[key], labels.in_partner, labels.yes),
            }
            for key in (PARTNER, VENDOR)
            if key in run.lists
        }
    return {PRIMARY: facts} if facts else {}


def list_expressions(run: ListRun) -> dict[str, dict[str, str]]:
    """Everything a run counts, per list; the cross matching counts nothing where it did not run."""
    found = {key: {f"{key}_rows": "count(1)"} for key in run.lists}
    for stage in STAGES:
        if run.ran(stage):
            for key, named in stage_expressions(run, stage).items():
                found[key] |= named
    return found


def facts_row(spark: SparkSession, counted: Mapping[str, int | None]) -> DataFrame:
    """One row with all facts; those that were not counted are 0."""
    schema = ", ".join(f"{name} bigint" for name in FACTS)
    return spark.createDataFrame([tuple(int(counted.get(name) or 0) for name in FACTS)], schema)


def run_facts(run: ListRun) -> DataFrame:
    """All counts of a run in one row; each list is read once, however many counts come from it."""

    def counts(frame: DataFrame, named: dict[str, str]) -> DataFrame:
        pairs = ", ".join(f"struct('{n}' as fact, cast({n} as long) as value)" for n in named)
        return frame.agg(*[F.expr(f"{e} as {n}") for n, e in named.items()]).selectExpr(f"inline(array({pairs}))")

    parts = [counts(run.lists[key], named) for key, named in list_expressions(run).items()]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    return long.groupBy().agg(
        *[F.expr(f"coalesce(max(case when fact = '{n}' then value end), 0L) as {n}") for n in FACTS]
    )


PROBLEM_CODES = (
    "REQUIRED_MISSING", "REQUIRED_EMPTY", "TYPE_MISMATCH", "LENGTH_EXCEED", "REGEX_FAILED",
)
FACTS = (
    "primary_rows", "passed_rows", "failed_rows", "rule_problems", *PROBLEM_CODES,
    "original_rows", "repeat_rows", "unknown_rows", "skipped_rows", "matched_codes", "all_codes",
    "dict_problems",
    "partner_rows", "partner_in_primary", "partner_in_partner",
    "vendor_rows", "vendor_in_primary", "vendor_in_partner",
)


def stage_counts(run: ListRun) -> dict[str, tuple[str, str, str]]:
    """Success, fail and skip count per executed stage, as SQL over the facts row."""
    valid = "passed_rows" if run.ran(FIELD_RULES) else "primary_rows"
    coded = ("matched_codes", "all_codes - matched_codes", "0L")
    counts = {
        LOAD: ("primary_rows + partner_rows + vendor_rows", "0L", "0L"),
        FIELD_RULES: ("passed_rows", "failed_rows", "0L"),
        INTERNAL_DEDUP: ("original_rows", "repeat_rows", "skipped_rows"),
        DICT_ENCODE: coded if run.encoded else ("primary_rows", "0L", "0L"),
        DICT_CHECK: (f"{valid} - dict_problems", "dict_problems", "0L"),
        CROSS_DEDUP: (
            "greatest(partner_rows - partner_in_primary, 0L)",
            "partner_in_primary + vendor_in_primary",
            "0L",
        ),
    }
    return {stage: c for stage, c in counts.items() if stage == LOAD or run.ran(stage)}


def stage_metrics(run: ListRun, facts: DataFrame | None = None) -> DataFrame:
    """One row per executed stage: success, fail and skip counts as the stage defines them.

    The dictionary check counts ``valid rows - unmatched codes`` as success, which is negative when
    rows have several unmatched codes.
    """
    facts = run_facts(run) if facts is None else facts
    order = (LOAD, *STAGES)
    rows = [
        f"struct({order.index(stage)} as pos, '{stage}' as stage, {ok} as success, {fail} as fail, {skip} as skip)"
        for stage, (ok, fail, skip) in stage_counts(run).items()
    ]
    return facts.selectExpr(f"inline(array({', '.join(rows)}))")
