"""Queries of the field rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions.text import utrim
from rollcall.labels import DEFAULT_LABELS as L
from rollcall.operators import rules
from rollcall.operators.rules import FieldRule, FieldSpec

from .registry import query
from .views import view, with_views

SPEC = FieldSpec.of(
    [
        FieldRule("name", "name", type="文本型", required=True),
        FieldRule("email", "email", type="text", required="是"),
        FieldRule("mobile", "mobile"),
        FieldRule("birthday", "birthday", type="日期型"),
        FieldRule("amount", "amount", type="小数"),
        FieldRule("units", "units", type="数值型"),
        FieldRule("status_label", "status", required=True, dict_id="status"),
        FieldRule("priority_label", "priority", dict_id="priority"),
        FieldRule("nation_label", "nation", dict_id="nation"),
        FieldRule("remark", "remark", max_length=72),
        FieldRule("id_card", "id_card", regex="id_card"),
    ]
)
DICT_FIELDS = {"status_label": "status", "priority_label": "priority", "nation_label": "nation"}

BLANK = "({0} IS NULL OR trim({0}) = '')"
_MAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
_PHONE = r"^1[3-9]\d{9}$"
_CARD = r"^[1-9]\d{5}(18|19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[\dXx]$"
_DATES = "['%Y-%m-%d', '%Y/%m/%d', '%Y.%m.%d', '%Y%m%d', '%d/%m/%Y', '%m/%d/%Y']"


def _sql(ord_: int, group: int, field: str, problem: str, test: str, raw: str, detail: str) -> str:
    return (
        f"SELECT {ord_} AS rule_ord, {group} AS rule_group, '{field}' AS field, _row_num AS row_num, "
        f"{raw} AS raw_value, '{problem}' AS problem, {detail} AS detail FROM primary_list WHERE {test}"
    )


def _required(o, f):
    return _sql(o, 0, f, "REQUIRED_EMPTY", BLANK.format(f), "'(空值)'", f"'必填字段 ''{f}'' 值为空'")


def _typed(o, f, word, bad):
    shown = f"left({f}, 50)"
    return _sql(o, 1, f, "TYPE_MISMATCH", f"NOT {BLANK.format(f)} AND {bad}", shown,
                f"concat('期望类型 ''{word}''，实际 ''', {shown}, '''')")


def _pattern(o, f, label, pattern):
    bad = f"NOT {BLANK.format(f)} AND NOT regexp_matches(trim({f}), '{pattern}')"
    return _sql(o, 3, f, "REGEX_FAILED", bad, f"left({f}, 50)", f"'不符合正则规则: {label}'")


_RULES = {
    "name": _required(0, "name"),
    "email_required": _required(1, "email"),
    "status": _required(2, "status_label"),
    "birthday": _typed(3, "birthday", "日期型", f"try_strptime(trim(birthday), {_DATES}) IS NULL"),
    "amount": _typed(4, "amount", "小数", r"NOT regexp_matches(trim(amount), '^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$')"),
    "units": _typed(5, "units", "数值型", r"NOT regexp_matches(trim(units), '^-?\d+$')"),
    "remark": _sql(6, 2, "remark", "LENGTH_EXCEED", "length(remark) > 72",
                   "CASE WHEN length(remark) > 50 THEN concat(left(remark, 50), '...') ELSE remark END",
                   "'长度超过上限 72'"),
    "email": _pattern(7, "email", "email", _MAIL),
    "mobile": _pattern(8, "mobile", "mobile", _PHONE),
    "id_card": _pattern(9, "id_card", "id_card", _CARD),
}
ERROR_COLUMNS = "field, row_num, raw_value, problem, detail"


def errors_cte() -> str:
    """CTE ``errs`` with all failures of ``SPEC``; needs ``primary_list``."""
    return "errs AS (" + "\nUNION ALL ".join(_RULES.values()) + ")"


def marked_cte() -> str:
    """CTE ``marked``: primary rows with status, count and types."""
    return errors_cte() + """,
per_row AS (SELECT row_num, count(*) AS n, string_agg(problem, ',' ORDER BY rule_ord) AS types FROM errs GROUP BY row_num),
marked AS (SELECT p.*, CASE WHEN e.row_num IS NULL THEN '通过' ELSE '不通过' END AS status,
  cast(coalesce(e.n, 0) AS int) AS n_errors, coalesce(e.types, '') AS types
  FROM primary_list p LEFT JOIN per_row e ON p._row_num = e.row_num)"""


MARKS = 'status AS "合规检查_状态", n_errors AS "合规检查_错误数", types AS "合规检查_错误类型"'
BASE = with_views("primary_list")


def marked_primary(spark, sf):
    return rules.mark_rules(view(spark, sf, "primary_list"), SPEC)


def _one_rule(name: str, rule: FieldRule, *keys: str) -> None:
    sql = BASE + "\nUNION ALL ".join(f"SELECT {ERROR_COLUMNS} FROM ({_RULES[k]}) r_{k}" for k in keys)

    @query(name, sql)
    def run(spark, sf):
        return rules.validation_errors(view(spark, sf, "primary_list"), FieldSpec.of([rule]))


_one_rule("rule_required_empty", FieldRule("name", "name", required=True), "name")
_one_rule("rule_type_integer", FieldRule("units", type="数值型"), "units")
_one_rule("rule_type_decimal", FieldRule("amount", type="小数"), "amount")
_one_rule("rule_type_date", FieldRule("birthday", type="日期型"), "birthday")
_one_rule("rule_max_length", FieldRule("remark", max_length="72.0"), "remark")
_one_rule("rule_regex_email", FieldRule("email", regex="email"), "email")
_one_rule("rule_regex_id_card", FieldRule("id_card", regex="id_card"), "id_card")
_one_rule("rule_regex_default_by_name", FieldRule("mobile"), "mobile")


@query(
    "rule_regex_phone",
    BASE + f"SELECT {ERROR_COLUMNS} FROM ({_pattern(0, 'mobile', 'phone', _PHONE)}) r",
)
def rule_regex_phone(spark, sf):
    spec = FieldSpec.of([FieldRule("mobile", regex="phone")])
    return rules.validation_errors(view(spark, sf, "primary_list"), spec)


@query(
    "rule_regex_custom",
    BASE + f"SELECT {ERROR_COLUMNS} FROM ({_pattern(0, 'nation_label', '_[01][0-9]$', '_[01][0-9]$')}) r",
)
def rule_regex_custom(spark, sf):
    spec = FieldSpec.of([FieldRule("nation_label", regex="_[01][0-9]$"), FieldRule("remark", regex="([")])
    return rules.validation_errors(view(spark, sf, "primary_list"), spec)


@query(
    "rule_required_missing",
    BASE + """SELECT 'region_label' AS field, _row_num AS row_num, '(字段缺失)' AS raw_value,
'REQUIRED_MISSING' AS problem, '必填字段 ''region_label'' 在数据中不存在' AS detail FROM primary_list""",
)
def rule_required_missing(spark, sf):
    spec = FieldSpec.of([FieldRule("region_label", "region", required="√")])
    return rules.validation_errors(view(spark, sf, "primary_list"), spec)


@query("validation_errors", BASE + ", " + errors_cte() + f" SELECT {ERROR_COLUMNS} FROM errs")
def validation_errors(spark, sf):
    return rules.validation_errors(view(spark, sf, "primary_list"), SPEC)


@query(
    "errors_export_order",
    BASE + ", " + errors_cte()
    + ' SELECT row_num AS "行号", field AS "字段名", raw_value AS "原始值", problem AS "问题类型", detail AS "说明" FROM errs',
)
def errors_export_order(spark, sf):
    return rules.errors_for_export(validation_errors(spark, sf))


@query("validation_markers", BASE + ", " + marked_cte() + f" SELECT _row_num, email, {MARKS} FROM marked")
def validation_markers(spark, sf):
    return marked_primary(spark, sf).select("_row_num", "email", L.rule_status, L.rule_count, L.rule_types)


@query(
    "validation_summary",
    BASE + ", " + marked_cte() + """ SELECT count(*) AS total_rows, count(*) FILTER (WHERE status = '通过') AS passed_rows,
count(*) FILTER (WHERE status = '不通过') AS failed_rows, cast(sum(n_errors) AS bigint) AS problems FROM marked""",
)
def validation_summary(spark, sf):
    return rules.validation_summary(marked_primary(spark, sf))


@query("error_type_counts", BASE + ", " + errors_cte() + " SELECT problem, count(*) AS n FROM errs GROUP BY problem")
def error_type_counts(spark, sf):
    return rules.error_type_counts(validation_errors(spark, sf))


@query(
    "error_sample",
    BASE + ", " + errors_cte()
    + f" SELECT rule_ord, {ERROR_COLUMNS} FROM errs ORDER BY rule_ord, row_num LIMIT 20",
)
def error_sample(spark, sf):
    errors = rules.error_rows(view(spark, sf, "primary_list"), SPEC)
    return rules.error_sample(errors).drop("rule_group")


@query(
    "error_sample_per_group",
    BASE + ", " + errors_cte() + f""" SELECT rule_group, position, {ERROR_COLUMNS} FROM (
SELECT *, cast(row_number() OVER (PARTITION BY rule_group ORDER BY rule_ord, row_num) AS int) AS position FROM errs) r
WHERE position <= 10""",
)
def error_sample_per_group(spark, sf):
    errors = rules.error_rows(view(spark, sf, "primary_list"), SPEC)
    return rules.error_sample_per_group(errors).drop("rule_ord")


@query("valid_rows", BASE + ", " + marked_cte() + " SELECT _row_num, name, email, mobile FROM marked WHERE status = '通过'")
def valid_rows(spark, sf):
    return rules.valid_rows(marked_primary(spark, sf)).select("_row_num", "name", "email", "mobile")


@query(
    "row_verdict",
    BASE + f""" SELECT * FROM (SELECT _row_num, email, concat_ws('/',
CASE WHEN {BLANK.format('name')} THEN 'name必填为空' END,
CASE WHEN {BLANK.format('email')} THEN 'email必填为空' END,
CASE WHEN NOT {BLANK.format('email')} AND NOT regexp_matches(trim(email), '{_MAIL}') THEN 'email格式校验失败' END) AS verdict
FROM primary_list) v WHERE verdict <> ''""",
)
def row_verdict(spark, sf):
    spec = FieldSpec.of([FieldRule("name", required=True), FieldRule("email", required=True)])
    rows = view(spark, sf, "primary_list").select("_row_num", "name", "email")
    judged = rules.row_verdict(rows, rules.verdict_reasons(spec))
    return judged.filter("verdict is not null").drop("name")


@query(
    "rate_summary",
    BASE + ", " + marked_cte() + """ SELECT count(*) AS total, count(*) FILTER (WHERE status = '通过') AS ok,
count(*) FILTER (WHERE status = '不通过') AS failed,
printf('%.1f%%', count(*) FILTER (WHERE status = '通过') / count(*) * 100) AS rate FROM marked""",
)
def rate_summary(spark, sf):
    from rollcall.functions.text import percent_text

    s = rules.validation_summary(marked_primary(spark, sf))
    return s.select(
        F.col("total_rows").alias("total"),
        F.col("passed_rows").alias("ok"),
        F.col("failed_rows").alias("failed"),
        percent_text("passed_rows", "total_rows").alias("rate"),
    )


@query(
    "fn_utrim",
    r"""SELECT doc_id, length(t) AS trimmed_chars, md5(t) AS trimmed_md5 FROM (SELECT doc_id,
regexp_replace(concat(chr(12288), chr(9), text, chr(160), chr(10)),
'^[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$',
'', 'g') AS t FROM documents) d""",
)
def fn_utrim(spark, sf):
    text = F.concat(F.lit("　\t"), F.col("text"), F.lit("\xa0\n"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = utrim(text)
    return docs.select(
        "doc_id",
        F.char_length(t).cast("long").alias("trimmed_chars"),
        F.md5(t.cast("binary")).alias("trimmed_md5"),
    )
