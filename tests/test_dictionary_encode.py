import pytest
from helpers import one_column, plan_text, values
from pyspark.sql import functions as F

from rollcall.labels import DEFAULT_LABELS as L
from rollcall.operators import dictionary as d
from rollcall.operators import encode, lookup
from rollcall.operators.rules import FieldRule, FieldSpec

ENTRIES = [
    ("A1", "01", "New York", 1), ("A1", "02", "Paris ", 2), ("A1", "03", "paris", 3), ("A1", "02", "Lyon", 4),
    ("A1", " ", "blank", 5), ("A1", None, "none", 6), ("A1", "09", None, 7), ("B2", "x", "X", 8),
]


@pytest.fixture
def dictionary(spark):
    return d.dictionary_table(spark.createDataFrame(ENTRIES, "dict_id string, code string, label string, ord int"))


def coded(spark, cells):
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(cells)], "_row_num long, v string")


def test_last_row_wins(dictionary):
    assert values(d.forward_map(dictionary)) == [
        ("A1", "01", "New York"), ("A1", "02", "Lyon"), ("A1", "03", "paris"), ("A1", "09", ""), ("B2", "x", "X"),
    ]
    assert values(d.reverse_map(dictionary)) == [
        ("A1", "lyon", "02"), ("A1", "new york", "01"), ("A1", "paris", "03"), ("B2", "x", "x"),
    ]


def test_code_operators(spark, dictionary):
    rows = coded(spark, ["01", "09", "zz", "", None, "x"])
    assert one_column(d.lookup_labels(rows, dictionary, "v", "A1"), "label") == ["New York", "", None, None, None, None]
    assert one_column(d.code_validity(rows, dictionary, "v", "A1"), "code_valid") == [True, True, False, False, False, False]
    assert one_column(d.code_validity(rows, dictionary, "v", "nope"), "code_valid") == [False] * 6
    assert one_column(d.keep_valid_codes(rows, dictionary, "v", "A1"), "v") == ["01", "09", ""]
    assert one_column(d.code_errors(rows, dictionary, "v", "A1"), "code_error") == [
        None, None, "代码值 'zz' 不在字典 A1 中", None, None, "代码值 'x' 不在字典 A1 中",
    ]
    assert values(d.dictionary_sizes(dictionary)) == [("A1", 4, 3), ("B2", 1, 1)]


@pytest.mark.parametrize("bytes_", [encode.ALL_BROADCASTS, 0])
def test_encode(spark, dictionary, bytes_):
    rows = coded(spark, [" NEW york", "PARIS", "blank", "", None, "Lyon", "none"]).withColumn("w", F.lit("x"))
    fields = {"v": "A1", "w": "missing"}
    got = encode.encode_labels(rows, fields, dictionary, broadcast_bytes=bytes_)
    assert got.columns == ["_row_num", "v", "v_Code", "w", "w_Code"]
    assert one_column(got, "v_Code") == ["01", "03", "未匹配", "未匹配", "未匹配", "02", "未匹配"]
    assert set(one_column(got, "w_Code")) == {"未匹配"}
    stats = encode.encode_stats(got, fields, dictionary)
    assert values(stats) == [("v", "A1", 3, 4, "42.9%", "success"), ("w", "missing", 0, 7, "0.0%", "dict_not_found")]


def test_broadcast_and_shuffle_agree_around_the_limit(spark):
    entries = spark.createDataFrame(
        [("small", str(i), f"l{i}", i) for i in range(3)] + [("large", str(i), f"l{i}", i) for i in range(9)],
        "dict_id string, code string, label string, ord int",
    )
    rows = spark.range(12).select((F.col("id") + 1).alias("_row_num"), F.concat(F.lit("L"), "id").alias("a"), F.concat(F.lit("l"), "id").alias("b"))
    got = encode.encode_labels(rows, {"a": "small", "b": "large"}, d.dictionary_table(entries), broadcast_bytes=300)
    assert one_column(got, "a_Code") == ["0", "1", "2"] + ["未匹配"] * 9
    assert one_column(got, "b_Code") == [str(i) for i in range(9)] + ["未匹配"] * 3


def test_small_dictionaries_do_not_shuffle_the_list(spark, dictionary):
    text = plan_text(encode.encode_labels(coded(spark, ["a"]), {"v": "A1"}, dictionary))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text and "Python" not in text


def test_decode(spark, dictionary):
    got = encode.decode_codes(coded(spark, ["01", "02", "zz", None]), {"v": "A1"}, dictionary, {"v": "name"})
    assert one_column(got, "name") == ["New York", "Lyon", None, None]


def test_dictionary_check(spark):
    rows = spark.createDataFrame(
        [(1, "通过", "x", "未匹配", "y", "未匹配"), (2, "不通过", "x", "未匹配", "y", "1"), (3, "通过", "a", "1", None, "未匹配")],
        f"_row_num long, `{L.rule_status}` string, v string, v_Code string, w string, w_Code string",
    )
    assert values(encode.dict_check_errors(rows)) == sorted(
        [
            ("v", 1, "x", "DICT_NOT_FOUND", "值 'x' 在数据字典中不存在"),
            ("w", 1, "y", "DICT_NOT_FOUND", "值 'y' 在数据字典中不存在"),
            ("w", 3, None, "DICT_NOT_FOUND", "值 'None' 在数据字典中不存在"),
        ],
        key=repr,
    )
    marked = encode.mark_dictionary(rows)
    assert one_column(marked, L.dict_count) == [2, 0, 1]
    assert one_column(marked, L.dict_status) == ["不通过", "通过", "不通过"]
    assert encode.mark_dictionary(marked).columns == marked.columns
    assert values(encode.dict_check_summary(marked)) == [(2, 3, 2, -1)]


def test_encoded_fields():
    spec = FieldSpec.of([FieldRule("a", dict_id="D"), FieldRule("b"), FieldRule("c", dict_id="E")])
    assert encode.encoded_fields(spec, ["a", "b"]) == {"a": "D"}


def grid(spark, rows, path="p"):
    return spark.createDataFrame(
        [(path, "s", i + 1, cells) for i, cells in enumerate(rows)], "path string, sheet string, row_idx long, cells array<string>"
    )


def test_unpivot_business_layout(spark):
    cells = grid(
        spark,
        [
            ["A1", None, " 示例：B2 ", None, None, None, "A1", None],
            ["等级", None, "来源", None],
            ["Code", "Details", "编码", "说明", "code", "标签", "CODE", "details"],
            ["1", " one ", None, "lost", "c", "C", "2", "two"],
            ["1", "eins", " k ", None, None, None, None, None],
        ],
    )
    assert values(d.unpivot_dictionaries(cells), "dict_id", "code", "label", "ord") == [
        ("A1", "2", "two", 4), ("B2", "k", "", 5), ("Dict_4", "c", "C", 4),
    ]


def test_unpivot_template_layout_and_format(spark):
    good = grid(spark, [["字典类型标识", "示例：A1"], ["Dict:A9", None], ["编码", "Details"], ["1", "x"]])
    bad = grid(spark, [["A1", None], ["n", None], ["Key", "Value"], ["1", "x"]], "q")
    cells = good.unionByName(bad)
    assert values(d.unpivot_dictionaries(cells), "dict_id", "code", "label") == [("A9", "1", "x")]
    assert values(d.dictionary_format(cells), "path", "dictionaries", "valid") == [("p", 1, True), ("q", 0, False)]


def test_fingerprints(spark, dictionary):
    first = {r["dict_id"]: r["md5_hash"] for r in d.fingerprint_tables(dictionary).collect()}
    again = {r["dict_id"]: r["md5_hash"] for r in d.fingerprint_tables(dictionary.repartition(3)).collect()}
    assert first == again and len(set(first.values())) == 2
    changed = dictionary.withColumn("label", F.when(F.col("code") == "x", "Y").otherwise(F.col("label")))
    third = {r["dict_id"]: r["md5_hash"] for r in d.fingerprint_tables(changed).collect()}
    assert third["A1"] == first["A1"] and third["B2"] != first["B2"]


def test_changed_versions(spark):
    log = spark.createDataFrame([("r1", "a", "a", "m1", 1), ("r2", "a", "a", "m2", 2), ("r3", "b", "b", "m3", 1)], "run_id string, dict_file string, file_name string, md5_hash string, recorded_at int")
    now = spark.createDataFrame([("a", "m2"), ("b", "other"), ("c", "new"), ("a2", None)], "dict_file string, md5_hash string")
    assert values(d.changed_versions(now, log), "dict_file", "changed") == [("a", False), ("a2", True), ("b", True), ("c", True)]


def test_many_large_dictionaries_are_one_join(spark, folder):
    """Three fields, one of them hot, one unknown, one null in a third of the rows; the list is scanned twice."""
    rows = spark.range(3_000).select(
        (F.col("id") + 1).alias("_row_num"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 50)).alias("a"),
        F.when(F.col("id") % 3 != 1, F.concat(F.lit(" B"), F.col("id") % 7)).alias("b"),
        F.concat(F.lit("c"), "id").alias("c"),
    )
    rows.write.parquet(folder + "/list")
    listed = spark.read.parquet(folder + "/list")
    entries = spark.createDataFrame(
        [("A", f"A{i}", f"a{i}", i) for i in range(50)] + [("A", "H", "hot", 99)] + [("B", f"B{i}", f"b{i}", i) for i in range(5)]
        + [("C", f"C{i}", f"c{i}", i) for i in range(0, 3_000, 2)],
        "dict_id string, code string, label string, ord int",
    )
    got = encode.encode_labels(listed, {"a": "A", "b": "B", "c": "C"}, d.dictionary_table(entries), broadcast_bytes=0)
    want = []
    for i in range(3_000):
        b = f"B{i % 7}" if i % 3 != 1 and i % 7 < 5 else "未匹配"
        want.append((i + 1, "H" if i % 3 == 0 else f"A{i % 50}", b, f"C{i}" if i % 2 == 0 else "未匹配"))
    assert values(got, "_row_num", "a_Code", "b_Code", "c_Code") == sorted(want, key=repr)
    # The first scan, for the combinations, is over; what is left reads the list once.
    assert plan_text(got).count("/list]") == 1


def test_hot_combinations_are_salted(spark, monkeypatch):
    monkeypatch.setattr(lookup, "TARGET_ROWS", 100)
    rows = spark.range(2_000).select((F.col("id") + 1).alias("_row_num"), F.lit("x").alias("v"))
    entries = spark.createDataFrame([("A", "1", "x", 1)], "dict_id string, code string, label string, ord int")
    got = encode.encode_labels(rows, {"v": "A"}, d.dictionary_table(entries), broadcast_bytes=0)
    assert "__lookup_salt" in plan_text(got)
    assert got.filter("v_Code = '1'").count() == 2_000


def test_later_sheets_replace_whole_dictionaries_within_a_file(spark):
    def grid(path, pos, sheet, dict_id, *rows):
        return [(path, pos, sheet, i, list(c)) for i, c in enumerate([(dict_id, None), (None, None), ("code", "details"), *rows], 1)]

    cells = spark.createDataFrame(
        grid("a", 0, "z", "D", ("1", "one"), ("2", "two")) + grid("a", 1, "b", "D", ("1", "uno"))
        + grid("a", 2, "c", "E", ("1", "hidden")) + grid("a", 10, "d", "E") + grid("b", 0, "z", "D", ("2", "zwei"), ("2", "dos")),
        "path string, sheet_pos int, sheet string, row_idx long, cells array<string>",
    )
    entries = d.dictionary_table(d.file_catalogue(cells), within=["path"])
    assert values(d.forward_map(entries, ["path"]), "path", "dict_id", "code", "label") == [("a", "D", "1", "uno"), ("b", "D", "2", "dos")]
    assert values(d.reverse_map(entries, ["path"]), "path", "label_key", "code") == [("a", "uno", "1"), ("b", "dos", "2"), ("b", "zwei", "2")]
    assert d.file_catalogue(cells.limit(0)).collect() == []


def test_equal_positions_do_not_go_to_chance(spark):
    rows = [("A", "1", x, 5) for x in ("b", "c", "a")]
    table = d.dictionary_table(spark.createDataFrame(rows, "dict_id string, code string, label string, ord int").repartition(3))
    assert values(d.forward_map(table), "label") == [("c",)]
