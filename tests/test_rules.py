import pytest
from helpers import plan_text, values
from pyspark.sql import functions as F

from rollcall.errors import EmptyInputError, InputError
from rollcall.labels import DEFAULT_LABELS as L
from rollcall.labels import Labels
from rollcall.operators import lookup, rules, spec
from rollcall.operators.rules import FieldRule, FieldSpec


def listed(spark, column, cells):
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(cells)], f"_row_num long, `{column}` string")


def failing(spark, rule, cells, column="f"):
    errors = rules.validation_errors(listed(spark, column, cells), FieldSpec.of([rule]))
    return [r["row_num"] for r in errors.orderBy("row_num").collect()]


CELLS = [None, "", " 　", "12", "x"]


@pytest.mark.parametrize(
    "rule,bad",
    [
        (FieldRule("f", required=True), [1, 2, 3]),
        (FieldRule("f", required="是"), [1, 2, 3]),
        (FieldRule("f", required=" √ "), [1, 2, 3]),
        (FieldRule("f", required="否"), []),
        (FieldRule("f", required="true"), []),
        (FieldRule("f", required=None), []),
        (FieldRule("f", type="数值型"), [5]),
        (FieldRule("f", type="int"), [5]),
        (FieldRule("f", type="小数"), [4, 5]),
        (FieldRule("f", type="date"), [4, 5]),
        (FieldRule("f", type="文本型"), []),
        (FieldRule("f", type="Integer"), []),
        (FieldRule("f", max_length=1), [3, 4]),
        (FieldRule("f", max_length="1.0"), [3, 4]),
        (FieldRule("f", max_length="many"), []),
        (FieldRule("f", max_length=-1), []),
        (FieldRule("f", regex=r"^\d+$"), [5]),
        (FieldRule("f", regex="2"), [5]),
        (FieldRule("f", regex="(["), []),
        (FieldRule("f", regex="邮箱"), [4, 5]),
    ],
)
def test_one_rule(spark, rule, bad):
    assert failing(spark, rule, CELLS) == bad


def test_default_pattern_by_name(spark):
    assert failing(spark, FieldRule("Mobile"), ["13812345678", "12812345678", None], "Mobile") == [2]
    assert failing(spark, FieldRule("身份证"), ["1"], "身份证") == []


def test_error_record(spark):
    long = "x" * 60
    spec_ = FieldSpec.of(
        [FieldRule("absent", required=True), FieldRule("f", type="int", max_length=10, regex="^y")]
    )
    got = values(rules.validation_errors(listed(spark, "f", [long]), spec_))
    cut = "x" * 50
    assert got == sorted(
        [
            ("absent", 1, "(字段缺失)", "REQUIRED_MISSING", "必填字段 'absent' 在数据中不存在"),
            ("f", 1, cut, "TYPE_MISMATCH", f"期望类型 'int'，实际 '{cut}'"),
            ("f", 1, cut + "...", "LENGTH_EXCEED", "长度超过上限 10"),
            ("f", 1, cut, "REGEX_FAILED", "不符合正则规则: ^y"),
        ],
        key=repr,
    )


def test_markers_keep_rule_order_and_repeats(spark):
    rows = spark.createDataFrame([(1, "", None, "ok"), (2, "a", "b", "ok")], "_row_num long, a string, b string, c string")
    spec_ = FieldSpec.of(
        [FieldRule("a", required=True), FieldRule("c", type="int"), FieldRule("b", required=True)]
    )
    marked = rules.mark_rules(rows, spec_)
    assert marked.columns == [*rows.columns, L.rule_status, L.rule_count, L.rule_types]
    assert values(marked, "_row_num", L.rule_status, L.rule_count, L.rule_types) == [
        (1, "不通过", 3, "REQUIRED_EMPTY,REQUIRED_EMPTY,TYPE_MISMATCH"),
        (2, "不通过", 1, "TYPE_MISMATCH"),
    ]


def test_no_rules(spark):
    rows = listed(spark, "f", ["a"])
    assert values(rules.mark_rules(rows, FieldSpec()), L.rule_status, L.rule_count, L.rule_types) == [("通过", 0, "")]
    assert rules.validation_errors(rows, FieldSpec()).count() == 0


@pytest.mark.parametrize("name", ["a.b", "客户 来源", "x`y", "[z]", "it's", "a(1)"])
def test_odd_column_names(spark, name):
    rows = spark.createDataFrame([(1, " ")], ["_row_num", name])
    spec_ = FieldSpec.of([FieldRule(name, required=True, type="int", max_length=5, regex="^a")])
    assert values(rules.mark_rules(rows, spec_), L.rule_types) == [("REQUIRED_EMPTY",)]
    assert rules.validation_errors(rows, spec_).first()["field"] == name


def test_labels_can_be_renamed(spark):
    labels = Labels(rule_status="state", passed="ok", failed="bad")
    marked = rules.mark_rules(listed(spark, "f", ["", "a"]), FieldSpec.of([FieldRule("f", required=True)]), labels)
    assert values(marked, "_row_num", "state") == [(1, "bad"), (2, "ok")]
    assert values(rules.valid_rows(marked, labels), "_row_num") == [(2,)]


def wide(spark, fields=60, rows=500):
    data = spark.range(rows).select(
        (F.col("id") + 1).alias("_row_num"),
        *[F.concat(F.lit(f"v{i} "), (F.col("id") % (i + 2)).cast("string")).alias(f"field {i}") for i in range(fields)],
    )
    kinds = ("int", "date", "小数", "text")
    spec_ = FieldSpec.of(
        [
            FieldRule(f"field {i}", required=True, type=kinds[i % 4], max_length=5, regex=r"^v\d+ [0-4]$")
            for i in range(fields)
        ]
    )
    return data, spec_


def test_wide_spec_markers_equal_error_table(spark):
    rows, spec_ = wide(spark)
    marked = rules.mark_rules(rows, spec_)
    per_row = rules.validation_errors(rows, spec_).groupBy("row_num").count()
    joined = marked.join(per_row, marked["_row_num"] == per_row["row_num"], "left")
    assert joined.filter(F.col(L.rule_count) != F.coalesce("count", F.lit(0))).count() == 0
    assert rules.valid_rows(marked).count() == marked.filter(F.col(L.rule_count) == 0).count()


def test_rules_stay_in_the_engine_and_need_no_shuffle(spark):
    rows, spec_ = wide(spark, 8)
    for frame in (rules.mark_rules(rows, spec_), rules.validation_errors(rows, spec_)):
        text = plan_text(frame)
        assert "Python" not in text and "Exchange" not in text


def test_verdict(spark):
    rows = spark.createDataFrame([(1, "", "x"), (2, "n", "a@b.cn"), (3, None, None)], "_row_num long, name string, email string")
    spec_ = FieldSpec.of([FieldRule("name", required=True), FieldRule("email", required=True)])
    judged = rules.row_verdict(rows, rules.verdict_reasons(spec_))
    assert values(judged, "_row_num", "verdict") == [
        (1, "name必填为空/email格式校验失败"),
        (2, None),
        (3, "name必填为空/email必填为空"),
    ]


SPEC_ROWS = "spec_id string, name string, attr_code string, type string, required boolean, max_length int, ord long"


def test_load_spec(spark):
    good = spark.createDataFrame([("s", "b", "B", "int", True, 3, 2), ("s", "a", "A", None, False, 0, 1)], SPEC_ROWS)
    loaded = spec.load_spec(good, "s")
    assert [f.name for f in loaded.fields] == ["a", "b"] and loaded.required_names() == ["b"]
    assert loaded.attr_codes() == {"a": "A", "b": "B"}
    with pytest.raises(EmptyInputError):
        spec.load_spec(good, "other")
    with pytest.raises(InputError, match="重复"):
        spec.load_spec(spark.createDataFrame([("s", "a", "A", None, True, 0, 1), ("s", "b", "A", None, True, 0, 2)], SPEC_ROWS))
    with pytest.raises(InputError, match="attr_code"):
        spec.load_spec(spark.createDataFrame([("s", "a", None, None, True, 0, 1)], SPEC_ROWS))


def test_template_columns():
    assert spec.template_columns(["属性编码", " 属性名称 ", "是否必填", "数据类型", "数据子类型", "数据字典ID"]) == {
        "attr_code": "属性编码", "name": " 属性名称 ", "required": "是否必填", "type": "数据类型",
        "sub_type": "数据子类型", "dict_id": "数据字典ID",
    }
    with pytest.raises(InputError) as e:
        spec.template_columns(["属性名称"])
    assert e.value.code == "COL_MISSING"


@pytest.mark.parametrize(
    "word,strict,template,importer",
    [
        ("是", True, True, True), ("√", True, True, True), ("1", False, True, True), ("TRUE", False, True, True),
        ("否", False, False, False), ("no", False, False, False), ("N", False, False, False), ("0", False, False, False),
        ("允许空", False, False, False), ("", False, False, True), (None, False, False, True), ("Y", False, False, True),
    ],
)
def test_required_words(spark, word, strict, template, importer):
    frame = spark.createDataFrame([(word,)], "w string")
    got = frame.select(*[spec.required_by(p, F.col("w")) for p in ("strict", "template", "importer")]).first()
    assert tuple(got) == (strict, template, importer)


def test_normalize_spec_prefers_later_header_and_last_row(spark):
    rows = spark.createDataFrame(
        [("s", 1, "a", None, "12.0", "是"), ("s", 2, "a", "b", "x", None), ("s", 3, None, "b", "7", "√"), ("s", 4, None, None, "1", "是")],
        "spec_id string, ord long, `属性名称` string, `名称` string, `长度` string, `必填` string",
    )
    assert values(spec.normalize_spec(rows), "name", "max_length", "required") == [("a", 12, True), ("b", 7, True)]


def test_lint_of_raw_rows(spark, monkeypatch):
    rows = [
        ("s", 1, "c1", "a", True), ("s", 2, "c1", "a", False), ("s", 3, " c1 ", "b", False), ("s", 4, None, "b", True),
        ("s", 5, "c2", " ", True), ("t", 6, "c1", "a", None), (None, 7, "x", "n", False), (None, 8, "x", "m", False),
    ]
    frame = spark.createDataFrame(rows, "spec_id string, ord int, attr_code string, name string, required boolean")
    want = [
        ("hidden_row", "a", 1, 2), ("hidden_row", "b", 3, 4), ("missing_code", "b", 4, None), ("missing_name", "c2", 5, None),
        ("repeated_code", "c1", 2, 1), ("repeated_code", "c1", 3, 1), ("repeated_code", "x", 8, 7),
    ]
    for small in (lookup.SMALL_BYTES, 0):
        monkeypatch.setattr(lookup, "SMALL_BYTES", small)
        assert sorted((r["rule"], r["value"], r["ord"], r["other_ord"]) for r in spec.lint_template(frame).collect()) == want
    assert spec.lint_template(frame.limit(0)).collect() == []
