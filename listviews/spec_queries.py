"""Queries of attribute templates and field specs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators import spec as sp

from .registry import query
from .views import view, with_views

# Template headings of the view's columns.
HEADINGS = {
    "t_name": "属性名称",
    "t_code": "属性code",
    "t_required": "属性值必填",
    "t_length": "长度上限",
    "t_type": "数据类型",
    "t_values": "值域",
}
CODED = {**HEADINGS, "t_code": "属性编码"}

SPEC = with_views("template") + """,
named AS (SELECT * FROM template WHERE t_name IS NOT NULL),
last AS (SELECT spec_id, t_name, max(ord) AS ord FROM named GROUP BY spec_id, t_name),
spec AS (SELECT n.spec_id, n.t_name AS name, n.t_code AS attr_code, n.t_type AS type,
  coalesce(trim(n.t_required) IN ('是', '√') OR lower(n.t_required) IN ('true', '1'), false) AS required,
  cast(coalesce(try_cast(n.t_length AS double), 0) AS int) AS max_length, n.ord
  FROM named n JOIN last l ON n.spec_id = l.spec_id AND n.t_name = l.t_name AND n.ord = l.ord)
"""


def template(spark, sf, headings):
    rows = view(spark, sf, "template")
    return rows.select(*[F.col(c).alias(headings.get(c, c)) for c in rows.columns])


def normalized(spark, sf):
    return sp.normalize_spec(template(spark, sf, HEADINGS))


@query("spec_normalize", SPEC + "SELECT spec_id, name, attr_code, type, required, max_length, ord FROM spec")
def spec_normalize(spark, sf):
    return normalized(spark, sf).select("spec_id", "name", "attr_code", "type", "required", "max_length", "ord")


@query(
    "spec_required_policies",
    with_views("template") + """SELECT ord, coalesce(trim(t_required) IN ('是', '√'), false) AS strict,
coalesce(lower(trim(t_required)) IN ('是', '√', '1', 'true'), false) AS template,
coalesce(lower(trim(t_required)) NOT IN ('否', '允许空', 'n', 'no', '0'), true) AS importer FROM template""",
)
def spec_required_policies(spark, sf):
    word = F.col("t_required")
    return view(spark, sf, "template").select(
        "ord", *[sp.required_by(p, word).alias(p) for p in ("strict", "template", "importer")]
    )


@query(
    "spec_template",
    with_views("template") + """SELECT ord, coalesce(trim(t_code), '') AS attr_code, coalesce(trim(t_name), '') AS name,
coalesce(lower(trim(t_required)) IN ('是', '√', '1', 'true'), false) AS required, coalesce(lower(trim(t_type)), 'string') AS type
FROM template WHERE coalesce(t_code, t_name) IS NOT NULL""",
)
def spec_template(spark, sf):
    rows = template(spark, sf, CODED)
    return sp.parse_template(rows, "template", carry=["ord"]).drop("sub_type", "dict_id")


@query(
    "spec_enum_values",
    with_views("template") + """SELECT t.ord, trim(t.t_code) AS attr_code, t.t_name AS name,
coalesce(lower(trim(t.t_required)) NOT IN ('否', '允许空', 'n', 'no', '0'), true) AS required,
coalesce(lower(trim(t.t_type)), 'string') AS type,
concat_ws('|', trim(split_part(t.t_values, ';', 1)), trim(split_part(t.t_values, ';', 3))) AS enum_values
FROM template t WHERE t.t_code IS NOT NULL AND t.t_name IS NOT NULL""",
)
def spec_enum_values(spark, sf):
    rows = sp.parse_template(template(spark, sf, CODED), "importer", carry=["ord"])
    return rows.withColumn("enum_values", F.array_join("enum_values", "|"))


@query(
    "spec_duplicate_codes",
    SPEC + """SELECT spec_id, attr_code, n, first_field, last_field,
concat('字段编码重复: ''', attr_code, '''（对应字段名：', last_field, '、', first_field, '）') AS message FROM (
SELECT spec_id, attr_code, count(*) AS n, arg_min(name, ord) AS first_field, arg_max(name, ord) AS last_field
FROM spec WHERE attr_code IS NOT NULL GROUP BY spec_id, attr_code) x WHERE n > 1""",
)
def spec_duplicate_codes(spark, sf):
    return sp.duplicate_codes(normalized(spark, sf))


@query("spec_required_without_code", SPEC + "SELECT spec_id, name, ord FROM spec WHERE required AND attr_code IS NULL")
def spec_required_without_code(spark, sf):
    return sp.required_without_code(normalized(spark, sf))


@query("spec_attr_codes", SPEC + "SELECT spec_id, name, attr_code FROM spec WHERE attr_code IS NOT NULL")
def spec_attr_codes(spark, sf):
    return sp.attr_code_map(normalized(spark, sf))


@query("spec_required_fields", SPEC + "SELECT spec_id, name FROM spec WHERE required")
def spec_required_fields(spark, sf):
    return sp.required_fields(normalized(spark, sf))


@query(
    "spec_lint_rows",
    with_views("template") + """,
raw AS (SELECT spec_id, ord, coalesce(trim(t_code), '') AS attr_code, coalesce(trim(t_name), '') AS name,
  coalesce(lower(trim(t_required)) IN ('是', '√', '1', 'true'), false) AS required
  FROM template WHERE coalesce(t_code, t_name) IS NOT NULL),
codes AS (SELECT spec_id, attr_code, min(ord) AS other_ord FROM raw WHERE attr_code <> '' GROUP BY spec_id, attr_code),
names AS (SELECT spec_id, name, max(ord) AS other_ord FROM raw WHERE name <> '' GROUP BY spec_id, name)
SELECT r.spec_id, 'repeated_code' AS rule, r.attr_code AS value, r.ord, c.other_ord
FROM raw r JOIN codes c ON r.spec_id = c.spec_id AND r.attr_code = c.attr_code AND r.ord <> c.other_ord
UNION ALL SELECT r.spec_id, 'hidden_row', r.name, r.ord, n.other_ord
FROM raw r JOIN names n ON r.spec_id = n.spec_id AND r.name = n.name AND r.ord <> n.other_ord
UNION ALL SELECT spec_id, 'missing_code', name, ord, NULL FROM raw WHERE required AND attr_code = '' AND name <> ''
UNION ALL SELECT spec_id, 'missing_name', attr_code, ord, NULL FROM raw WHERE name = ''""",
)
def spec_lint_rows(spark, sf):
    return sp.lint_template(sp.parse_template(template(spark, sf, CODED), "template", carry=["spec_id", "ord"]))
