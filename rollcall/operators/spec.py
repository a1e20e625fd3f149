"""Field specs: attribute templates normalised to spec rows, linted, projected, loaded.

Template tables may hold many templates at once (``spec_id``); a run filters one id and turns its
rows into ``FieldSpec``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyInputError, InputError
from ..functions.text import col, pair_key, utrim
from .lookup import lookup_join
from .rules import FieldRule, FieldSpec

# Header words of attribute templates and words of the required column.
HEADER_NAMES = {
    "name": ("属性名称", "名称"),
    "attr_code": ("属性code", "code"),
    "category": ("属性类型", "类型"),
    "type": ("数据类型",),
    "sub_type": ("数据子类型", "子类型"),
    "max_length": ("长度上限", "长度"),
    "dict_id": ("数据字典", "字典"),
    "required": ("属性值必填", "必填"),
    "regex": ("验证规则", "规则"),
}
TEMPLATE_WORDS = (
    ("attr_code", ("属性编码", "属性code")),
    ("name", ("属性名称", "字段名")),
    ("required", ("属性值必填", "必填")),
    ("type", ("数据类型",)),
    ("sub_type", ("数据子类型",)),
    ("dict_id", ("数据字典",)),
)
IMPORTER_WORDS = (
    ("attr_code", ("属性编码", "attr_code")),
    ("name", ("属性名称", "字段名")),
    ("required", ("必填", "允许空")),
    ("type", ("数据类型",)),
    ("enum_values", ("值域", "允许值")),
)
TEMPLATE_REQUIRED = ("是", "√", "1", "true")
IMPORTER_OPTIONAL = ("否", "允许空", "n", "no", "0")
STRICT_REQUIRED = ("是", "√")


def template_columns(columns: Sequence[str], policy: str = "template") -> dict[str, str]:
    """Spec attribute → template column, by header words; a later match replaces an earlier one."""
    words = {"template": TEMPLATE_WORDS, "importer": IMPORTER_WORDS}[policy]
    found: dict[str, str] = {}
    for column in columns:
        title = column.strip()
        for attribute, hints in words:
            if any(h in title or (h.isascii() and h in title.lower()) for h in hints):
                found[attribute] = column
                break
    missing = [a for a in ("attr_code", "name") if a not in found]
    if missing:
        raise InputError(f"属性导入模版缺少必需列: {', '.join(missing)}", code="COL_MISSING")
    return found


def _text(column: str | None) -> Column:
    return F.coalesce(utrim(column), F.lit("")) if column else F.lit("")


def _given(column: str | None) -> Column:
    return F.nullif(_text(column), F.lit(""))


def required_by(policy: str, value: Column) -> Column:
    """The three readings of the "required" word: strict, template (default no), importer (default yes)."""
    text = utrim(value)
    if policy == "strict":
        return F.coalesce(text.isin(*STRICT_REQUIRED), F.lit(False))
    if policy == "template":
        return F.coalesce(F.lower(text).isin(*TEMPLATE_REQUIRED), F.lit(False))
    if policy == "importer":
        return F.coalesce(~F.lower(text).isin(*IMPORTER_OPTIONAL), F.lit(True))
    raise ValueError(f"unknown policy: {policy}")


def normalize_spec(template: DataFrame, spec_id: str = "spec_id", ord_column: str = "ord") -> DataFrame:
    """Attribute template (any of the known header names) to spec rows, one per field name.

    Lengths become integers (0 when missing or not a number), required defaults to false, rows
    without a name are dropped, and the last row of a repeated name wins.
    """
    present = set(template.columns)

    def source(attribute: str) -> Column:
        options = [col(h).cast("string") for h in HEADER_NAMES[attribute] if h in present]
        # A later header name overrides an earlier one where it has a value.
        return F.coalesce(*reversed(options)) if options else F.lit(None).cast("string")

    rows = template.select(
        col(spec_id).alias("spec_id"),
        *[source(a).alias(a) for a in HEADER_NAMES],
        col(ord_column).cast("long").alias("ord"),
    ).filter("name is not null and name <> ''")
    truth = F.coalesce(F.lower(F.col("required")).isin("true", "1"), F.lit(False)) | required_by(
        "strict", F.col("required")
    )
    cleaned = rows.select(
        "spec_id",
        "name",
        "attr_code",
        "category",
        "type",
        "sub_type",
        "dict_id",
        "regex",
        truth.alias("required"),
        F.coalesce(F.col("max_length").try_cast("double").try_cast("int"), F.lit(0)).alias("max_length"),
        "ord",
    )
    others = [c for c in cleaned.columns if c not in ("spec_id", "name")]
    return (
        cleaned.groupBy("spec_id", "name")
        .agg(F.max_by(F.struct(*others), "ord").alias("last"))
        .select("spec_id", "name", *[f"last.{c}" for c in others])
    )


def parse_template(
    template: DataFrame,
    policy: str = "template",
    carry: Sequence[str] = (),
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Template rows to spec rows without merging names; ``carry`` columns pass through.

    ``template``: required only for the accepted words; a row is kept if it has a code or a name.
    ``importer``: required unless one of the optional words; a row needs both code and name;
    ``enum_values`` is split at ``;``.
    """
    found = dict(columns) if columns is not None else template_columns(template.columns, policy)
    get = found.get
    required = required_by(policy, col(found["required"])) if "required" in found else F.lit(policy == "importer")
    selected = [
        *[col(c) for c in carry],
        _text(found["attr_code"]).alias("attr_code"),
        _text(found["name"]).alias("name"),
        required.alias("required"),
        F.coalesce(F.lower(_given(get("type"))), F.lit("string")).alias("type"),
    ]
    if policy == "template":
        keep = (F.col("attr_code") != "") | (F.col("name") != "")
        selected += [
            F.lower(_given(get("sub_type"))).alias("sub_type"),
            _given(get("dict_id")).alias("dict_id"),
        ]
    else:
        keep = (F.col("attr_code") != "") & (F.col("name") != "")
        values = F.filter(
            F.transform(F.split(_text(get("enum_values")), ";"), lambda v: utrim(v)), lambda v: v != ""
        )
        selected.append(F.when(F.size(values) > 0, values).alias("enum_values"))
    return template.select(*selected).filter(keep)


def duplicate_codes(spec: DataFrame) -> DataFrame:
    """Findings: attribute codes used by more than one field, with the first and last field name."""
    return (
        spec.filter("attr_code is not null and attr_code <> ''")
        .groupBy("spec_id", "attr_code")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("name", "ord").alias("first_field"),
            F.max_by("name", "ord").alias("last_field"),
        )
        .filter("n > 1")
        .withColumn(
            "message",
            F.concat(
                F.lit("字段编码重复: '"), "attr_code", F.lit("'（对应字段名："), "last_field",
                F.lit("、"), "first_field", F.lit("）"),
            ),
        )
    )


def lint_template(rows: DataFrame) -> DataFrame:
    """Findings about template rows before names are merged: ``spec_id, rule, value, ord, other_ord``.

    ``rows`` has ``spec_id, ord, attr_code, name, required``, as ``parse_template`` returns them, with ``ord``
    unique in a spec. Blank and null texts count as missing. The rules:

    * ``repeated_code``: an earlier row, ``other_ord``, is the first to use the row's code (``value``);
    * ``hidden_row``: a later row, ``other_ord``, is the last with the row's name (``value``) and replaces it;
    * ``missing_code``: a required row with a name has no code; ``value`` is the name;
    * ``missing_name``: a row without a name, which no spec takes in; ``value`` is the code.

    Rows are never compared in pairs. Codes and names are melted to one key column, an aggregate finds first and
    last row of every key, and one salted lookup brings them back, so a frequent code or name is no hot task.
    """
    clean = rows.select(
        "spec_id", "ord", F.coalesce(utrim("attr_code"), F.lit("")).alias("attr_code"),
        F.coalesce(utrim("name"), F.lit("")).alias("name"), F.coalesce("required", F.lit(False)).alias("required"),
    )
    finding = lambda rule, value: F.struct(F.lit(rule).alias("rule"), F.col(value).alias("value"))
    none = F.lit(None).cast("struct<rule:string,value:string>")
    alone = F.array(
        F.when(F.col("required") & (F.col("attr_code") == "") & (F.col("name") != ""), finding("missing_code", "name")).otherwise(none),
        F.when(F.col("name") == "", finding("missing_name", "attr_code")).otherwise(none),
    )
    single = clean.select("spec_id", "ord", F.explode(F.array_compact(alone)).alias("f")).select(
        "spec_id", "f.rule", "f.value", "ord", F.lit(None).cast(rows.schema["ord"].dataType).alias("other_ord")
    )
    melted = clean.select(
        "spec_id", "ord", F.explode(F.array(finding("repeated_code", "attr_code"), finding("hidden_row", "name"))).alias("f")
    ).select("spec_id", "f.rule", "f.value", "ord").filter("value <> ''")
    spec = F.coalesce(F.concat(F.lit("s"), F.col("spec_id").cast("string")), F.lit("n"))
    key = pair_key(F.concat("rule", F.lit(":"), spec), F.col("value"))
    several = melted.groupBy(key.alias("key"), "rule").agg(
        F.min("ord").alias("first"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").select("key", F.when(F.col("rule") == "hidden_row", F.col("last")).otherwise(F.col("first")).alias("other_ord"), "n")
    found = lookup_join(melted, several, key, "key", F.col("ord"), key_rows="n")
    return found.filter("other_ord <> ord").select("spec_id", "rule", "value", "ord", "other_ord").unionByName(single)


def required_without_code(spec: DataFrame) -> DataFrame:
    """Findings: required fields that have no attribute code."""
    return spec.filter("required and (attr_code is null or attr_code = '')").select("spec_id", "name", "ord")


def attr_code_map(spec: DataFrame) -> DataFrame:
    """Field name → attribute code, for fields that have one."""
    return spec.filter("attr_code is not null and attr_code <> ''").select("spec_id", "name", "attr_code")


def required_fields(spec: DataFrame) -> DataFrame:
    """Names of the required fields."""
    return spec.filter("required").select("spec_id", "name")


def load_spec(spec: DataFrame, spec_id: str | None = None, max_fields: int = 5000) -> FieldSpec:
    """Fetches one spec (tens of rows) for the rule compiler; refuses an empty or faulty one.

    At most ``max_fields + 1`` rows reach the driver; a larger spec is an error, not a cut.
    """
    one = spec if spec_id is None else spec.filter(F.col("spec_id") == spec_id)
    rows = one.orderBy("ord").limit(max_fields + 1).collect()
    if not rows:
        raise EmptyInputError("属性导入模版中未找到有效字段定义", code="SPEC_IMPORT_EMPTY")
    if len(rows) > max_fields:
        raise InputError(f"spec has more than {max_fields} fields", code="SPEC_TOO_LARGE")
    names = {f for f in FieldRule.__dataclass_fields__}
    rules = [FieldRule(**{k: v for k, v in r.asDict().items() if k in names}) for r in rows]
    seen: dict[str, str] = {}
    for rule in rules:
        if rule.attr_code:
            if rule.attr_code in seen:
                raise InputError(
                    f"字段编码重复: '{rule.attr_code}'（对应字段名：{rule.name}、{seen[rule.attr_code]}）",
                    code="SPEC_DUPLICATE_CODE",
                )
            seen[rule.attr_code] = rule.name
    uncoded = [r.name for r in rules if r.is_required and not r.attr_code]
    if uncoded:
        raise InputError(f"必填字段缺少 attr_code: {uncoded}", code="SPEC_MISSING_CODE")
    return FieldSpec.of(rules)


def write_spec(spec: DataFrame, path: str) -> None:
    """Writes a normalised spec table."""
    spec.write.mode("overwrite").parquet(path)
