import os
import zipfile

import pytest
from helpers import one_column, plan_text, values
from pyspark.sql import functions as F

from rollcall.errors import EmptyInputError, InputError
from rollcall.labels import DEFAULT_LABELS as L
from rollcall.operators import lookup
from rollcall.operators.rules import FieldRule, FieldSpec
from rollcall.sources import encoding, layouts, lists, workbooks
from rollcall.streaming import mark_stream


def put(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


@pytest.mark.parametrize(
    "data,name",
    [
        ("姓名\n张三".encode(), "utf-8"),
        ("姓名\n张三".encode("utf-8-sig"), "utf-8-sig"),
        ("姓名\n张三".encode("gbk"), "gbk"),
        ("café \n".encode("cp1252"), "cp1252"),
        ("x\x81 y".encode("latin-1"), "latin-1"),
        (b"", "utf-8"),
        (("a" * 4095 + "张三").encode(), "utf-8"),
        (("a" * 4095 + "张三").encode("gbk"), "gbk"),
        ("é".encode()[:1], "cp1252"),
    ],
)
def test_detect(spark, data, name):
    files = spark.createDataFrame([("p", bytearray(data))], "path string, content binary")
    assert encoding.detect_encodings(files).first()["encoding"] == name


def test_folder_of_mixed_encodings(spark, folder):
    body = '姓名,备注\n张三,"a ""b"", c"\n李四,\n'
    put(folder, "a.csv", body.encode())
    put(folder, "b.csv", body.encode("utf-8-sig"))
    put(folder, "c.csv", body.encode("gbk"))
    got = lists.read_csv_folder(spark, folder)
    assert got.columns == ["姓名", "备注"]
    assert values(got) == sorted([("张三", 'a "b", c'), ("李四", None)] * 3, key=repr)


def test_text_is_kept_as_it_is(spark, folder):
    put(folder, "a.csv", b'id,n,note\n007,1.0,"two\nlines"\n1e5, x ,""\n')
    got = lists.read_csv_list(spark, folder)
    assert values(got) == [("007", "1.0", "two\nlines"), ("1e5", " x ", "")]
    assert {t for _, t in got.dtypes} == {"string"}


def test_missing_and_empty(spark, folder):
    with pytest.raises(InputError) as e:
        lists.read_csv_list(spark, folder + "/nothing")
    assert e.value.code == "NOT_FOUND"
    put(folder, "a.csv", b"id,n\n")
    with pytest.raises(EmptyInputError):
        lists.read_csv_list(spark, folder)
    with pytest.raises(InputError):
        lists.load_lists(spark, {"primary": "", "partner": folder})


def test_numbers_follow_files_and_splits(spark, folder):
    for f in range(3):
        rows = "\n".join(f"{f * 1000 + i},{'x' * 20}" for i in range(1000))
        put(folder, f"part-{f}.csv", f"id,pad\n{rows}\n".encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = lists.read_csv_list(spark, folder, multi_line=False)
        assert rows.rdd.getNumPartitions() > 6
        got = lists.number_rows(rows, start=2)
        assert got.filter(F.col("id").cast("long") + 2 != F.col(L.row_num)).count() == 0 and got.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_numbers_on_parquet(spark, folder):
    spark.range(5000).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(folder + "/t")
    got = lists.number_rows(spark.read.parquet(folder + "/t"), row_index=True)
    assert got.filter(F.col("id") + 1 != F.col(L.row_num)).count() == 0 and got.count() == 5000


def test_load_lists(spark, folder):
    os.mkdir(folder + "/p")
    os.mkdir(folder + "/q")
    put(folder + "/p", "a.csv", b"email,n\na,1\nb,2\n")
    put(folder + "/q", "a.csv", b"email\na\n")
    loaded = lists.load_lists(spark, {"primary": folder + "/p", "partner": folder + "/q", "vendor": None})
    assert sorted(loaded) == ["partner", "primary"]
    assert values(loaded["primary"]) == [("a", "1", 1, "primary"), ("b", "2", 2, "primary")]
    assert values(lists.list_counts(loaded)) == [("partner", 1), ("primary", 2)]
    assert values(lists.list_profile(loaded, {"primary": 1})) == [("partner", 1, 1), ("primary", 1, 2)]


def test_header_row(spark):
    rows = spark.createDataFrame([(1, "c_name", None), (2, "x", "1"), (3, "y", "2")], "_row_num long, name string, n string")
    got = lists.split_header_row(rows)
    assert values(got) == [(1, "x", "1"), (2, "y", "2")]
    assert lists.header_codes(got) == {"name": "c_name", "n": ""}
    with pytest.raises(EmptyInputError):
        lists.split_header_row(rows.limit(1))


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
            '<sheet name="名单" sheetId="1" r:id="rId2"/><sheet name="more" sheetId="2" r:id="rId1"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Target="worksheets/s1.xml" Id="rId1"/><Relationship Id="rId2" Target="worksheets/s2.xml"/></Relationships>',
        )
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>name</t></si><si><r><t>Zh</t></r><r><t>ang</t></r></si></sst>")
        z.writestr(
            "xl/styles.xml",
            f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy/mm/dd hh:mm"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        )
        z.writestr(
            "xl/worksheets/s2.xml",
            f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>day</t></is></c>'
            '<c r="C1" t="inlineStr"><is><t>at</t></is></c><c r="D1" t="inlineStr"><is><t>flag</t></is></c></row>'
            '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>45297</v></c><c r="C3" s="2"><v>45297.5</v></c><c r="D3" t="b"><v>1</v></c></row>'
            '<row r="4"><c r="B4"><v>12.5</v></c><c r="D4" t="e"><v>#N/A</v></c></row></sheetData></worksheet>',
        )
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {MAIN}><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>')


def test_workbooks(spark, folder):
    workbook(folder + "/a.xlsx")
    workbook(folder + "/b.xlsx")
    files = encoding.read_binary(spark, folder)
    assert values(workbooks.workbook_sheets(files), "sheet_pos", "sheet") == sorted([(0, "名单"), (1, "more")] * 2, key=repr)
    cells = workbooks.workbook_cells(files)
    got = workbooks.workbook_list(cells).drop("path")
    assert values(got) == sorted(
        [("Zhang", "2024-01-06", "2024-01-06 12:00:00", "true", n + 2) for n in (0, 3)]
        + [(None, "12.5", None, None, n + 3) for n in (0, 3)],
        key=repr,
    )
    assert values(workbooks.pick_sheet(cells, "more"), "cells") == [(["7"],)] * 2


def test_stream_of_rows(spark, folder):
    rows = spark.createDataFrame([(1, "", "a"), (2, "x", "zz")], "_row_num long, name string, kind string")
    rows.write.parquet(folder + "/in")
    entries = spark.createDataFrame([("K", "1", "A", "a", 1)], "dict_id string, code string, label string, label_key string, ord long")
    spec = FieldSpec.of([FieldRule("name", required=True), FieldRule("kind", dict_id="K")])
    stream = spark.readStream.schema(rows.schema).parquet(folder + "/in")
    query = (
        mark_stream(stream, spec, entries).writeStream.format("parquet")
        .option("path", folder + "/out").option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = spark.read.parquet(folder + "/out")
    assert one_column(got, L.rule_status) == ["不通过", "通过"]
    assert one_column(got, "kind_Code") == ["1", "未匹配"]
    assert one_column(got, L.dict_status) == ["通过", "不通过"]


def test_files_with_other_encoding_and_column_order(spark, folder):
    put(folder, "a 1.csv", "姓名,邮箱\n张三,a@x.cn\n李四,b@x.cn,extra\n王五\n".encode())
    put(folder, "b[1].csv", "邮箱,姓名,备注\nc@x.cn,赵六,\"两\n行\"\n".encode("gbk"))
    put(folder, "c.csv", '"姓名","邮箱\n地址","姓名"\n孙七,d@x.cn,八\n'.encode())
    put(folder, "empty.csv", b"")
    found = layouts.csv_layouts(spark, folder)
    assert [(x.encoding, x.names, x.spans) for x in found] == [
        ("utf-8", ["姓名", "邮箱"], False), ("gbk", ["邮箱", "姓名", "备注"], False), ("utf-8", ["姓名", "邮箱\n地址", "姓名_duplicated_0"], True),
    ]
    loaded = lists.load_list(spark, folder)
    assert loaded.rows.columns == ["姓名", "邮箱", "备注", "邮箱\n地址", "姓名_duplicated_0", "_row_num"]
    assert values(loaded.rows, "_row_num", "姓名", "邮箱", "备注", "邮箱\n地址", "姓名_duplicated_0") == [
        (1, "张三", "a@x.cn", None, None, None), (2, "李四", "b@x.cn", None, None, None), (3, "王五", None, None, None, None),
        (4, "赵六", "c@x.cn", "两\n行", None, None), (5, "孙七", None, None, "d@x.cn", "八"),
    ]
    assert values(loaded.findings, "row_num", "first_value", "raw_value", "problem") == [
        (2, "李四", "李四,b@x.cn,extra", "RAGGED_ROW"), (3, "王五", "王五", "RAGGED_ROW"),
    ]
    assert "a%201.csv" in loaded.findings.first()["path"]
    # A count looks at one column at least; it must not depend on which one.
    assert loaded.rows.count() == 5 and loaded.findings.count() == 2


def test_code_row_below_each_header(spark, folder):
    put(folder, "a.csv", b"name,mail\nc_name,\nx,1\ny,2\n")
    put(folder, "b.csv", b"mail,name\nc_mail,c_name\n3,z\n")
    both, findings = lists.load_all(spark, {"primary": folder, "partner": folder, "vendor": ""}, code_rows=["primary"])
    assert values(both["primary"], "_row_num", "name", "mail") == [(1, "x", "1"), (2, "y", "2"), (3, "z", "3")]
    assert lists.header_codes(both["primary"]) == {"name": "c_name", "mail": ""}
    assert both["partner"].count() == 5 and findings.count() == 0
    os.mkdir(folder + "/only")
    put(folder + "/only", "a.csv", b"name,mail\nc_name,c_mail\n")
    with pytest.raises(EmptyInputError):
        lists.load_list(spark, folder + "/only", code_row=True)


def test_heads_look_at_first_splits_only(spark, folder):
    put(folder, "long.csv", ("h" * 5_000 + ",b\n" + "x,y\n" * 40_000).encode())
    put(folder, "plain.csv", b"a,b\n1,2\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        assert sorted(len(r["header"][0]) for r in layouts.csv_heads(spark, folder).collect()) == [1, 5_000]
        assert lists.load_list(spark, folder, multi_line=False).rows.agg(F.max("_row_num")).first()[0] == 40_001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_workbook_lists_with_codes(spark, folder):
    workbook(folder + "/a.xlsx")
    workbook(folder + "/b.xlsx")
    loaded = lists.load_list(spark, folder, sheet="名单", code_row=True)
    # Row 2 of the sheet is blank and not stored, so there is no code; rows 3 and 4 are the list.
    assert values(loaded.rows, "_row_num", "name") == [(1, "Zhang"), (2, None), (3, "Zhang"), (4, None)]
    assert loaded.findings.count() == 0
    one = lists.load_list(spark, folder + "/a.xlsx")
    assert values(one.rows, "_row_num", "name") == [(2, "Zhang"), (3, None)]
    assert "Map" not in plan_text(one.rows), "the fleet is parsed once, by the job that wrote its rows"


def test_offsets_beyond_a_broadcast(spark, folder, monkeypatch):
    monkeypatch.setattr(lookup, "SMALL_BYTES", 0)
    monkeypatch.setattr(lookup, "TARGET_ROWS", 100)
    spark.range(3_000).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(folder + "/t")
    got = lists.number_rows(spark.read.parquet(folder + "/t"), row_index=True)
    assert got.filter(F.col("id") + 1 != F.col(L.row_num)).count() == 0 and got.count() == 3_000
    assert "__lookup_salt" in plan_text(got), "a split's rows are spread"


def test_lists_of_whole_lines_are_split(spark, folder):
    """One large file of whole lines is read by several tasks; the rows are those of one task over the whole file."""
    plain = ['a,b,c', '1,"x, ""y""",', '2,"",z', '"3",数,""""', ' 4 ,"q"', '5,x,y,z'] + [f'{i},"{i}, x",{i * i}' for i in range(4_000)]
    odd = {"break": '6,"two\nlines",z', "inside": '6,5" x,"y" z', "open": '6,"x', "space": '6, "x,y",z', "blank": '6,x,y\n  \n7,x,y', "return": "6,x,y\r\n7,x,y\r", "mark": "6,\x01,y"}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        for name, extra in {"plain": None, **odd}.items():
            os.makedirs(f"{folder}/{name}")
            with open(f"{folder}/{name}/list.csv", "w", encoding="utf-8", newline="") as f:
                f.write("\n".join(plain if extra is None else [*plain, extra]) + "\n")
            got = lists.read_csv_list(spark, f"{folder}/{name}")
            whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"', nullValue="\u0001").csv(f"{folder}/{name}")
            assert got.columns == ["a", "b", "c"]
            assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect())), name
            assert (got.rdd.getNumPartitions() > 1) == (extra is None), name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
