"""Queries of sources: files are written from the tables, then read back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from rollcall.labels import DEFAULT_LABELS as L
from rollcall.plans.export import shared_folder
from rollcall.sources import encoding, layouts, lists, workbooks

from .registry import query
from .views import table, view, with_views

PRIMARY_COLUMNS = (
    "_row_num, name, email, mobile, birthday, amount, units, status_label, priority_label, nation_label, remark, id_card"
)


@query("tag_source", with_views("partner_list") + "SELECT _row_num, kind, email, 'partner' AS \"_来源\" FROM partner_list")
def tag_source(spark, sf):
    return lists.tag_source(view(spark, sf, "partner_list"), "partner")


@query("row_number_dense", "SELECT o_orderkey, o_orderkey + 1 AS _row_num FROM orders")
def row_number_dense(spark, sf):
    """The order keys count up in file order."""
    return lists.number_rows(table(spark, sf, "orders"), row_index=True).select("o_orderkey", L.row_num)


def _write_csv(rows, folder):
    (
        rows.write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(folder)
    )


@query("scan_csv", with_views("primary_list") + f"SELECT {PRIMARY_COLUMNS.replace('_row_num', 'cast(_row_num AS string) AS _row_num')} FROM primary_list")
def scan_csv(spark, sf):
    folder = shared_folder(spark, "scan-csv")
    _write_csv(view(spark, sf, "primary_list"), folder)
    return lists.read_csv_list(spark, folder)


@query("scan_csv_numbered", "SELECT o_orderkey, o_orderkey + 1 AS _row_num, cast(o_custkey AS string) AS cust FROM orders")
def scan_csv_numbered(spark, sf):
    """Row numbers over several CSV files: file order is key order here."""
    folder = shared_folder(spark, "scan-csv-numbered")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("cust")
    )
    sorted_rows = rows.repartitionByRange(6, F.col("o_orderkey").cast("long")).sortWithinPartitions(
        F.col("o_orderkey").cast("long")
    )
    _write_csv(sorted_rows, folder)
    numbered = lists.number_rows(lists.read_csv_list(spark, folder, multi_line=False))
    return numbered.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query(
    "split_header_row",
    with_views("primary_list") + "SELECT _row_num, name, email FROM primary_list",
)
def split_header_row(spark, sf):
    """The list with a second header line in front of its rows."""
    rows = view(spark, sf, "primary_list").select(
        (F.col(L.row_num) + 1).alias(L.row_num), "name", "email"
    )
    header = table(spark, sf, "orders").agg(F.min("o_orderkey").alias(L.row_num)).select(
        (F.col(L.row_num) + 1).alias(L.row_num), F.lit("attr_name").alias("name"), F.lit("attr_email").alias("email")
    )
    return lists.split_header_row(header.unionByName(rows))


def _three(spark, sf):
    return {k: view(spark, sf, f"{k}_list") for k in ("primary", "partner", "vendor")}


LISTS = with_views("primary_list", "partner_list", "vendor_list")


@query(
    "load_lists_counts",
    LISTS + "\nUNION ALL ".join(f"SELECT '{k}' AS \"_来源\", count(*) AS n FROM {k}_list" for k in ("primary", "partner", "vendor")),
)
def load_lists_counts(spark, sf):
    return lists.list_counts(_three(spark, sf))


@query(
    "profile_lists",
    LISTS + """SELECT 'primary' AS list, greatest(count(*) - 1, 0) AS n_rows, 11 AS n_columns FROM primary_list
UNION ALL SELECT 'partner', count(*), 2 FROM partner_list UNION ALL SELECT 'vendor', count(*), 2 FROM vendor_list""",
)
def profile_lists(spark, sf):
    return lists.list_profile(_three(spark, sf), header_rows={"primary": 1})


_CODECS = {"BUILDING": "utf-8", "MACHINERY": "gbk", "FURNITURE": "utf-8-sig", "HOUSEHOLD": "cp1252", "AUTOMOBILE": "latin-1"}
_MARKS = {"BUILDING": "客户", "MACHINERY": "客户", "FURNITURE": "客户", "HOUSEHOLD": "café ", "AUTOMOBILE": "x\x81 "}


def _text_file(batch: pd.DataFrame) -> pd.DataFrame:
    segment = batch["segment"].iloc[0]
    lines = [f"{_MARKS[segment]}{n},{b}" for n, b in zip(batch["c_name"], batch["c_acctbal"])]
    content = "\n".join(["name,balance", *lines]).encode(_CODECS[segment])
    return pd.DataFrame({"path": [batch["path"].iloc[0]], "content": [content]})


@query(
    "detect_encoding",
    """SELECT DISTINCT concat(c_mktsegment, '-', cast(c_custkey // 500 AS string), '.csv') AS path,
CASE c_mktsegment WHEN 'BUILDING' THEN 'utf-8' WHEN 'MACHINERY' THEN 'gbk' WHEN 'FURNITURE' THEN 'utf-8-sig' WHEN 'HOUSEHOLD' THEN 'cp1252' ELSE 'latin-1' END AS encoding
FROM customer""",
)
def detect_encoding(spark, sf):
    """Customers as files of at most 500 keys, encoded by market segment."""
    customers = table(spark, sf, "customer").select(
        F.concat("c_mktsegment", F.lit("-"), F.floor(F.col("c_custkey") / 500).cast("string"), F.lit(".csv")).alias("path"),
        F.col("c_mktsegment").alias("segment"),
        "c_name",
        "c_acctbal",
    )
    files = customers.groupBy("path").applyInPandas(_text_file, "path string, content binary")
    return encoding.detect_encodings(files)


_BOOK = {
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
    '<sheet name="orders" sheetId="1" r:id="rId1"/><sheet name="about" sheetId="2" r:id="rId2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
}


def _sheet_xml(rows: list[list[str | None]]) -> str:
    out = []
    for r, cells in enumerate(rows, 1):
        xml = "".join(
            f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for c, v in enumerate(cells) if v is not None
        )
        out.append(f'<row r="{r}">{xml}</row>')
    head = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    return head + "".join(out) + "</sheetData></worksheet>"


def _workbook(batch: pd.DataFrame) -> pd.DataFrame:
    batch = batch.sort_values("o_orderkey")
    names = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    body = [
        [str(k), None if s == "P" else s, p]
        for k, s, p in zip(batch["o_orderkey"], batch["o_orderstatus"], batch["o_orderpriority"])
    ]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _BOOK.items():
            book.writestr(name, text)
        book.writestr("xl/worksheets/sheet1.xml", _sheet_xml([names, *body]))
        book.writestr("xl/worksheets/sheet2.xml", _sheet_xml([["rows"], [str(len(body))]]))
    return pd.DataFrame({"path": [batch["path"].iloc[0]], "content": [buffer.getvalue()]})


def workbook_files(spark, sf):
    """Orders as workbooks of at most 1000 keys each."""
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("orders-"), F.floor(F.col("o_orderkey") / 1000).cast("string"), F.lit(".xlsx")).alias("path"),
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
    )
    return orders.groupBy("path").applyInPandas(_workbook, "path string, content binary")


@query(
    "scan_workbooks",
    """WITH files AS (SELECT concat('orders-', cast(o_orderkey // 1000 AS string), '.xlsx') AS path, max(o_orderkey % 1000 + 1) AS last FROM orders GROUP BY 1),
starts AS (SELECT path, coalesce(sum(last) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM files)
SELECT path, cast(before + o_orderkey % 1000 + 1 AS bigint) AS _row_num,
cast(o_orderkey AS string) AS o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus, o_orderpriority
FROM orders JOIN starts ON path = concat('orders-', cast(o_orderkey // 1000 AS string), '.xlsx')""",
)
def scan_workbooks(spark, sf):
    """Row numbers go on from workbook to workbook."""
    cells = workbooks.workbook_cells(workbook_files(spark, sf))
    return workbooks.workbook_list(cells, columns=["o_orderkey", "o_orderstatus", "o_orderpriority"], sheet="orders")


@query(
    "list_sheets",
    """SELECT DISTINCT concat('orders-', cast(o_orderkey // 1000 AS string), '.xlsx') AS path, 0 AS sheet_pos, 'orders' AS sheet FROM orders
UNION ALL SELECT DISTINCT concat('orders-', cast(o_orderkey // 1000 AS string), '.xlsx'), 1, 'about' FROM orders""",
)
def list_sheets(spark, sf):
    return workbooks.workbook_sheets(workbook_files(spark, sf))


# Files as they come from different offices: other encodings, other column orders, ragged rows.

_OFFICES = "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'gbk' ELSE 'utf-8' END"
_OFFICE_ROWS = f"""WITH offices AS (
SELECT c_custkey, {_OFFICES} AS office, concat('客户', cast(c_custkey AS string)) AS name, cast(c_nationkey AS string) AS nation, c_mktsegment AS segment FROM customer)
"""


def _write_files(rows, folder):
    """One file per value of ``file``; ``content`` is text or bytes."""
    rows.select("file", F.col("content").cast("string").alias("content")).write.partitionBy("file").text(folder)


def office_files(spark, sf):
    """UTF-8 files (name, nation, segment) with ragged rows and GBK files (segment, name, nation)."""
    folder = shared_folder(spark, "offices")
    customers = table(spark, sf, "customer").select(
        "c_custkey",
        F.expr(_OFFICES).alias("office"),
        F.concat(F.lit("客户"), F.col("c_custkey").cast("string")).alias("name"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    line = (
        F.when(F.col("c_custkey") % 10 == 3, F.concat_ws(",", "name", "nation", "segment", F.lit("more")))
        .when(F.col("c_custkey") % 10 == 7, F.concat_ws(",", "name", "nation"))
        .otherwise(F.concat_ws(",", "name", "nation", "segment"))
    )
    plain = customers.filter("office = 'utf-8'").groupBy(F.floor(F.col("c_custkey") / 500).alias("file")).agg(
        F.concat_ws("\n", F.lit("name,nation,segment"), F.array_sort(F.collect_list(line))).alias("content")
    )
    _write_files(plain, f"{folder}/a")
    charset = layouts.charset_of(spark, "gbk")
    gbk = customers.filter("office = 'gbk'").select("segment", "name", "nation").repartition(4)
    gbk.write.option("header", True).option("encoding", charset).csv(f"{folder}/b")
    return folder


@query(
    "load_list_layouts",
    _OFFICE_ROWS + """SELECT name, nation, CASE WHEN office = 'utf-8' AND c_custkey % 10 = 7 THEN NULL ELSE segment END AS segment, 'partner' AS "_来源" FROM offices""",
)
def load_list_layouts(spark, sf):
    """Every file by its own encoding and column order."""
    folder = office_files(spark, sf)
    loaded, _ = lists.load_all(spark, {"primary": folder, "partner": folder, "vendor": None}, multi_line=False)
    return loaded["partner"].drop(L.row_num)


@query(
    "load_list_numbers",
    _OFFICE_ROWS + "SELECT count(*) AS n, count(*) AS n_numbers, 1 AS first_number, count(*) AS last_number FROM offices",
)
def load_list_numbers(spark, sf):
    """Numbers are dense over files of both layouts."""
    rows = lists.load_list(spark, office_files(spark, sf), multi_line=False).rows
    number = F.col(L.row_num)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(number).alias("n_numbers"), F.min(number).alias("first_number"), F.max(number).alias("last_number")
    )


@query(
    "load_findings",
    _OFFICE_ROWS + """SELECT name AS first_value, concat(name, ',', nation, CASE WHEN c_custkey % 10 = 3 THEN concat(',', segment, ',more') ELSE '' END) AS raw_value,
'RAGGED_ROW' AS problem FROM offices WHERE office = 'utf-8' AND c_custkey % 10 IN (3, 7)""",
)
def load_findings(spark, sf):
    found = lists.load_list(spark, office_files(spark, sf), multi_line=False).findings
    return found.select("first_value", "raw_value", "problem")


@query(
    "scan_file_heads",
    _OFFICE_ROWS + """SELECT 'utf-8' AS encoding, 'name|nation|segment' AS header, count(DISTINCT c_custkey // 500) AS files FROM offices WHERE office = 'utf-8'
UNION ALL SELECT 'gbk', 'segment|name|nation', least(count(*), 4) FROM offices WHERE office = 'gbk'""",
)
def scan_file_heads(spark, sf):
    """Encodings and headers, told from the written files."""
    heads = layouts.csv_heads(spark, office_files(spark, sf))
    return heads.groupBy("encoding", F.array_join("header", "|").alias("header")).agg(F.count(F.lit(1)).alias("files"))


def _office_book(batch: pd.DataFrame) -> pd.DataFrame:
    """A workbook with codes below its header; every second one has its columns in another order."""
    batch = batch.sort_values("o_orderkey")
    number = int(batch["o_orderkey"].iloc[0]) // 1000
    names = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    names = names if number % 2 else names[::-1]
    body = batch[names].astype(str).values.tolist()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _BOOK.items():
            book.writestr(name, text)
        book.writestr("xl/worksheets/sheet1.xml", _sheet_xml([names, [f"c_{n}" for n in names], *body]))
        book.writestr("xl/worksheets/sheet2.xml", _sheet_xml([["rows"]]))
    return pd.DataFrame({"file": [batch["file"].iloc[0]], "content": [buffer.getvalue()]})


@query(
    "scan_workbook_fleet",
    """WITH files AS (SELECT concat('orders-', cast(o_orderkey // 1000 AS string)) AS file, count(*) AS n FROM orders GROUP BY 1),
starts AS (SELECT file, coalesce(sum(n) OVER (ORDER BY file || '/' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM files)
SELECT cast(before + o_orderkey % 1000 + 1 AS bigint) AS _row_num, cast(o_orderkey AS string) AS o_orderkey, o_orderstatus, o_orderpriority,
'c_o_orderkey|c_o_orderstatus|c_o_orderpriority' AS codes
FROM orders JOIN starts ON file = concat('orders-', cast(o_orderkey // 1000 AS string))""",
)
def scan_workbook_fleet(spark, sf):
    """Written workbooks with two header rows; each is placed by its own header, and all are parsed once."""
    folder = shared_folder(spark, "fleet")
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("orders-"), F.floor(F.col("o_orderkey") / 1000).cast("string")).alias("file"), "o_orderkey", "o_orderstatus", "o_orderpriority"
    )
    _write_files(orders.groupBy("file").applyInPandas(_office_book, "file string, content binary"), folder)
    rows = lists.load_list(spark, folder, sheet="orders", code_row=True).rows
    names = ("o_orderkey", "o_orderstatus", "o_orderpriority")
    codes = lists.header_codes(rows)
    return rows.select(L.row_num, *names, F.lit("|".join(codes[n] for n in names)).alias("codes"))
