"""Field rules: a spec is compiled into column expressions that check a whole list in one pass.

Rule groups run in the order required, type, length, pattern and, inside a group, in spec order.
Every failure becomes one struct in an array column, so error table, row markers, histogram and
sample all come from the same narrow expression and need no shuffle to be built.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.text import col, sql_name, sql_text, sql_utrim, utrim
from ..labels import DEFAULT_LABELS, Labels

log = logging.getLogger(__name__)

# Problem codes, type words and cut-off of echoed values.
REQUIRED_MISSING, REQUIRED_EMPTY = "REQUIRED_MISSING", "REQUIRED_EMPTY"
TYPE_MISMATCH, LENGTH_EXCEED, REGEX_FAILED = "TYPE_MISMATCH", "LENGTH_EXCEED", "REGEX_FAILED"
INTEGER_WORDS = ("integer", "int", "数值型")
DECIMAL_WORDS = ("decimal", "float", "小数")
DATE_WORDS = ("date", "日期型")
REQUIRED_WORDS = ("是", "√")
SHOWN_CHARS = 50

_FOUND = "__problems"


@dataclass(frozen=True)
class FieldRule:
    name: str
    attr_code: str | None = None
    category: str | None = None
    type: str | None = None
    sub_type: str | None = None
    dict_id: str | None = None
    regex: str | None = None
    required: bool | str | None = False
    max_length: int | float | str | None = 0

    @property
    def is_required(self) -> bool:
        """Words other than the two accepted ones mean optional; other values go by truth."""
        if isinstance(self.required, str):
            return self.required.strip() in REQUIRED_WORDS
        return bool(self.required)

    @property
    def length_limit(self) -> int:
        """0 = no limit; text that is not a number sets no limit either."""
        try:
            return max(int(float(self.max_length or 0)), 0)
        except (TypeError, ValueError, OverflowError):
            return 0

    @property
    def pattern_label(self) -> str | None:
        """The rule's own pattern or pattern name, else the field's name if it names a pattern."""
        if self.regex:
            return self.regex
        lowered = self.name.lower()
        return lowered if lowered in checks.NAMED_PATTERNS else None


@dataclass(frozen=True)
class FieldSpec:
    fields: tuple[FieldRule, ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, rules: Iterable[FieldRule]) -> FieldSpec:
        return cls(tuple(rules))

    def required_names(self) -> list[str]:
        return [f.name for f in self.fields if f.is_required]

    def attr_codes(self) -> dict[str, str]:
        return {f.name: f.attr_code for f in self.fields if f.attr_code}


@dataclass(frozen=True)
class Check:
    """One compiled rule as SQL text: where it fails and how the failure is reported."""

    group: int
    field: str
    problem: str
    fails: str
    raw_value: str
    detail: str


def _trimmed(name: str) -> str:
    return sql_name(f"__trimmed_{name}")


def _type_pattern(word: str | None) -> str | None:
    for words, pattern in (
        (INTEGER_WORDS, checks.INTEGER_PATTERN),
        (DECIMAL_WORDS, checks.DECIMAL_PATTERN),
        (DATE_WORDS, checks.DATE_PATTERN),
    ):
        if word in words:
            return pattern
    return None


def _mismatch(name: str, pattern: str) -> str:
    text = _trimmed(name)
    return f"{text} <> '' and not {text} rlike {sql_text(pattern)}"


def compile_checks(
    spec: FieldSpec, columns: Sequence[str], labels: Labels = DEFAULT_LABELS
) -> list[Check]:
    """The checks of ``spec`` for a list with ``columns``, in reporting order.

    Trimmed text is read from ``__trimmed_<field>`` columns (see ``with_trimmed``), so that it is
    computed once per value however many rules look at it. Checks are SQL text: a spec of many
    fields becomes one parsed projection.
    """
    present = set(columns)
    found: list[Check] = []
    for rule in spec.fields:
        if not rule.is_required:
            continue
        if rule.name not in present:
            detail = f"必填字段 '{rule.name}' 在数据中不存在"
            found.append(
                Check(0, rule.name, REQUIRED_MISSING, "true", sql_text(labels.absent_value), sql_text(detail))
            )
        else:
            blank = f"{sql_name(rule.name)} is null or {_trimmed(rule.name)} = ''"
            detail = f"必填字段 '{rule.name}' 值为空"
            found.append(
                Check(0, rule.name, REQUIRED_EMPTY, blank, sql_text(labels.blank_value), sql_text(detail))
            )

    here = [rule for rule in spec.fields if rule.name in present]
    for rule in here:
        pattern = _type_pattern(rule.type)
        if pattern is None:
            continue
        shown = f"left(cast({sql_name(rule.name)} as string), {SHOWN_CHARS})"
        expected = sql_text(f"期望类型 '{rule.type}'，实际 '")
        detail = f"concat({expected}, {shown}, '\\'')"
        found.append(Check(1, rule.name, TYPE_MISMATCH, _mismatch(rule.name, pattern), shown, detail))

    for rule in here:
        if rule.length_limit == 0:
            continue
        text = f"cast({sql_name(rule.name)} as string)"
        shown = (
            f"case when char_length({text}) > {SHOWN_CHARS} "
            f"then concat(left({text}, {SHOWN_CHARS}), '...') else {text} end"
        )
        too_long = f"char_length({text}) > {rule.length_limit}"
        detail = sql_text(f"长度超过上限 {rule.length_limit}")
        found.append(Check(2, rule.name, LENGTH_EXCEED, too_long, shown, detail))

    for rule in here:
        label, pattern = rule.pattern_label, usable_pattern(rule)
        if pattern is None:
            continue
        shown = f"left(cast({sql_name(rule.name)} as string), {SHOWN_CHARS})"
        fails = _mismatch(rule.name, checks.search_pattern(pattern))
        found.append(Check(3, rule.name, REGEX_FAILED, fails, shown, sql_text(f"不符合正则规则: {label}")))
    return found


def usable_pattern(rule: FieldRule) -> str | None:
    """The rule's pattern; None if it has none, or one that does not compile and is skipped."""
    if rule.pattern_label is None:
        return None
    named = checks.NAMED_PATTERNS.get(rule.pattern_label.lower())
    if named:
        return named
    if checks.is_usable_pattern(rule.pattern_label):
        return rule.pattern_label
    log.warning("pattern of field %s does not compile and is skipped: %s", rule.name, rule.pattern_label)
    return None


def with_trimmed(rows: DataFrame, spec: FieldSpec) -> DataFrame:
    """``rows`` plus one trimmed text column per checked field, in one projection."""
    present = set(rows.columns)
    names = [
        rule.name
        for rule in spec.fields
        if rule.name in present and (rule.is_required or _type_pattern(rule.type) or rule.pattern_label)
    ]
    return rows.selectExpr("*", *[f"{sql_utrim(name)} as {_trimmed(name)}" for name in dict.fromkeys(names)])


def error_rows(rows: DataFrame, spec: FieldSpec, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """All failures, one row per rule and list row, with the rule's position (no shuffle)."""
    compiled = compile_checks(spec, rows.columns, labels)
    failures = [
        f"case when {c.fails} then named_struct('rule_group', {c.group}, 'rule_ord', {pos}, "
        f"'field', {sql_text(c.field)}, 'raw_value', {c.raw_value}, "
        f"'problem', {sql_text(c.problem)}, 'detail', {c.detail}) end"
        for pos, c in enumerate(compiled)
    ]
    if not failures:
        return rows.sparkSession.createDataFrame(
            [], "rule_group int, rule_ord int, field string, row_num long, raw_value string, "
            "problem string, detail string"
        )
    return (
        with_trimmed(rows, spec)
        .selectExpr(
            f"cast({sql_name(labels.row_num)} as long) as row_num",
            f"explode(array({', '.join(failures)})) as e",
        )
        .filter("e is not null")
        .select("e.rule_group", "e.rule_ord", "e.field", "row_num", "e.raw_value", "e.problem", "e.detail")
    )


def validation_errors(rows: DataFrame, spec: FieldSpec, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Error table with the fixed columns field, row_num, raw_value, problem, detail."""
    return error_rows(rows, spec, labels).drop("rule_group", "rule_ord")


def mark_rules(rows: DataFrame, spec: FieldSpec, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Adds status, error count and comma-joined problem codes (rule order, repeats kept).

    The joined codes are built once (``concat_ws`` leaves out the rules that hold); status and
    count follow from them. Everything stays in generated code: no higher-order functions.
    """
    compiled = compile_checks(spec, rows.columns, labels)
    codes = [f"case when {c.fails} then {sql_text(c.problem)} end" for c in compiled]
    kept = [sql_name(name) for name in rows.columns]
    commas = f"char_length({_FOUND}) - char_length(replace({_FOUND}, ',', ''))"
    return (
        with_trimmed(rows, spec)
        .selectExpr(*kept, f"concat_ws({', '.join([sql_text(','), *codes])}) as {_FOUND}")
        .selectExpr(
            *kept,
            f"case when {_FOUND} = '' then {sql_text(labels.passed)} else {sql_text(labels.failed)} end"
            f" as {sql_name(labels.rule_status)}",
            f"case when {_FOUND} = '' then 0 else {commas} + 1 end as {sql_name(labels.rule_count)}",
            f"{_FOUND} as {sql_name(labels.rule_types)}",
        )
    )


def valid_rows(marked: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Rows that passed the checks whose status columns exist; all rows if there are none.

    On a list that is not stored yet the optimizer copies the rules into this filter, so operators
    that also need other markers test ``is_valid`` inside their aggregates instead.
    """
    return marked.filter(is_valid(marked.columns, labels))


def is_valid(columns: Sequence[str], labels: Labels = DEFAULT_LABELS) -> Column:
    condition = F.lit(True)
    for status in (labels.rule_status, labels.dict_status):
        if status in columns:
            condition = condition & (col(status) == labels.passed)
    return condition


def validation_summary(marked: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Stage metrics of a marked list: rows, passing rows, failing rows, problems."""
    status = col(labels.rule_status)
    return marked.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(status == labels.passed).alias("passed_rows"),
        F.count_if(status == labels.failed).alias("failed_rows"),
        F.coalesce(F.sum(col(labels.rule_count).cast("long")), F.lit(0)).alias("problems"),
    )


def error_type_counts(errors: DataFrame) -> DataFrame:
    """Histogram of problem codes."""
    return errors.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def error_sample(errors: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` failures in reporting order; takes the table of ``error_rows``."""
    return errors.orderBy("rule_ord", "row_num").limit(n)


def error_sample_per_group(errors: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` failures of every rule group; ranks are cut per task before the shuffle."""
    order = Window.partitionBy("rule_group").orderBy("rule_ord", "row_num")
    return (
        errors.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
    )


def errors_for_export(errors: DataFrame) -> DataFrame:
    """Error table with the column names and order of the exported data set."""
    # Headings of the exported error table.
    headings = {
        "row_num": "行号",
        "field": "字段名",
        "raw_value": "原始值",
        "problem": "问题类型",
        "detail": "说明",
    }
    return errors.select(*[F.col(name).alias(title) for name, title in headings.items()])


def row_verdict(
    rows: DataFrame, reasons: Sequence[tuple[str, Column]], name: str = "verdict"
) -> DataFrame:
    """Adds one text per row: the reasons that apply, joined with ``/``; null for a valid row."""
    hits = [F.when(F.coalesce(test, F.lit(False)), F.lit(reason)) for reason, test in reasons]
    return rows.withColumn(name, F.nullif(F.concat_ws("/", *hits), F.lit("")))


def verdict_reasons(spec: FieldSpec) -> list[tuple[str, Column]]:
    """Reasons for ``row_verdict``: blank required fields and failed patterns of non-blank values."""
    reasons = []
    for rule in spec.fields:
        text = F.coalesce(utrim(rule.name), F.lit(""))
        if rule.is_required:
            reasons.append((f"{rule.name}必填为空", text == ""))
        pattern = usable_pattern(rule)
        if pattern:
            failed = (text != "") & ~text.rlike(checks.search_pattern(pattern))
            reasons.append((f"{rule.name}格式校验失败", failed))
    return reasons
