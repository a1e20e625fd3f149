"""Queries of dictionaries, encoding and the dictionary check."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.labels import DEFAULT_LABELS as L
from rollcall.operators import dictionary as d
from rollcall.operators import encode

from .registry import query
from .rule_queries import DICT_FIELDS, marked_cte, marked_primary
from .views import table, view, with_views

CATALOGUE = with_views("catalogue", "coded_list") + """,
clean AS (SELECT dict_id, trim(code) AS code, coalesce(trim(label), '') AS label, ord FROM catalogue WHERE trim(code) <> ''),
fwd AS (SELECT dict_id, code, arg_max(label, ord) AS label FROM clean GROUP BY dict_id, code),
rev AS (SELECT dict_id, lower(label) AS label_key, arg_max(code, ord) AS code FROM clean WHERE label <> '' GROUP BY dict_id, lower(label))
"""


def catalogue(spark, sf):
    return d.dictionary_table(view(spark, sf, "catalogue"))


def entries(spark, sf):
    return d.dictionary_table(view(spark, sf, "entries"))


def grid_cells(spark, sf):
    """Dictionary grids, one per brand: three header rows, then two dictionaries side by side.

    Brands whose name starts with ``Brand#1`` use the layout with the ids in row 2.
    """
    part = table(spark, sf, "part")
    path = F.concat(F.lit("dict/"), F.col("p_brand"), F.lit(".xlsx"))
    ids = F.array(F.concat(F.lit("示例："), "p_brand"), F.lit(None), F.concat(F.lit("types of "), "p_brand"), F.lit(None))
    is_template = F.col("p_brand").startswith("Brand#1")
    texts = F.array(F.lit("字典类型标识"), F.lit(None), F.lit("示例：A1"), F.lit(None))
    titles = F.array(F.lit("Code"), F.lit("Details"), F.lit("编码"), F.lit("说明"))
    header = part.select("p_brand").distinct().select(
        path.alias("path"),
        F.posexplode(
            F.array(F.when(is_template, texts).otherwise(ids), F.when(is_template, ids).otherwise(texts), titles)
        ).alias("pos", "cells"),
    )
    body = part.select(
        path.alias("path"),
        (F.col("p_partkey") + 4).alias("row_idx"),
        F.array(
            F.concat(F.lit(" "), F.col("p_partkey").cast("string")),
            F.when(F.col("p_size") < 40, F.col("p_name")),
            F.when(F.col("p_size") > 10, F.col("p_size").cast("string")),
            F.col("p_type"),
        ).alias("cells"),
    )
    header = header.select("path", (F.col("pos") + 1).cast("long").alias("row_idx"), "cells")
    return header.unionByName(body).withColumn("sheet", F.lit("Sheet1")).withColumn("sheet_pos", F.lit(0))


@query(
    "dict_unpivot",
    """SELECT concat('dict/', p_brand, '.xlsx') AS path, p_brand AS dict_id, cast(p_partkey AS string) AS code,
CASE WHEN p_size < 40 THEN p_name ELSE '' END AS label, p_partkey + 4 AS ord FROM part
UNION ALL SELECT concat('dict/', p_brand, '.xlsx'), concat('types of ', p_brand), cast(p_size AS string), p_type, p_partkey + 4
FROM part WHERE p_size > 10""",
)
def dict_unpivot(spark, sf):
    return d.unpivot_dictionaries(grid_cells(spark, sf)).drop("sheet")


@query(
    "dict_group_count",
    """SELECT DISTINCT concat('dict/', p_brand, '.xlsx') AS path, 2 AS dictionaries, true AS valid,
'格式校验通过，共 2 个字典组' AS message FROM part""",
)
def dict_group_count(spark, sf):
    return d.dictionary_format(grid_cells(spark, sf)).drop("sheet")


def workbook_grids(spark, sf):
    """Three files with a sheet for each brand, in the order of the brands' numbers.

    Every sheet holds the dictionary ``sizes`` and one of its own brand.
    """
    number = F.expr("cast(substring(p_brand, 7) AS int)")
    part = table(spark, sf, "part").withColumns({
        "path": F.concat(F.lit("dict/"), (number % 3).cast("string"), F.lit(".xlsx")), "sheet_pos": number
    })
    texts = lambda *values: F.array(*[F.lit(v) if isinstance(v, str) or v is None else v for v in values])
    rows = F.array(
        texts("示例：sizes", None, F.col("p_brand"), None), texts(None, None, None, None), texts("Code", "Details", "编码", "说明")
    )
    grid = ["path", "p_brand", "sheet_pos"]
    header = part.select(*grid).distinct().select(*grid, F.posexplode(rows).alias("pos", "cells"))
    body = part.select(
        *grid, (F.col("p_partkey") + 4).alias("row_idx"),
        texts(F.col("p_size").cast("string"), F.col("p_name"), F.col("p_partkey").cast("string"), F.col("p_type")).alias("cells"),
    )
    cells = header.select(*grid, (F.col("pos") + 1).cast("long").alias("row_idx"), "cells").unionByName(body)
    return cells.withColumnRenamed("p_brand", "sheet")


@query(
    "dict_file_catalogue",
    """WITH grids AS (SELECT concat('dict/', cast(substr(p_brand, 7) AS int) % 3, '.xlsx') AS path, cast(substr(p_brand, 7) AS int) AS sheet_pos, * FROM part),
last AS (SELECT path, max(sheet_pos) AS sheet_pos FROM grids GROUP BY path),
entries AS (
  SELECT g.path, 'sizes' AS dict_id, cast(p_size AS string) AS code, p_name AS label, p_partkey AS ord
  FROM grids g JOIN last l ON g.path = l.path AND g.sheet_pos = l.sheet_pos
  UNION ALL SELECT path, p_brand, cast(p_partkey AS string), p_type, p_partkey FROM grids)
SELECT path, dict_id, code, trim(arg_max(label, ord)) AS label FROM entries GROUP BY path, dict_id, code""",
)
def dict_file_catalogue(spark, sf):
    entries = d.dictionary_table(d.file_catalogue(workbook_grids(spark, sf)), within=["path"])
    return d.forward_map(entries, within=["path"])


@query(
    "dict_last_wins",
    CATALOGUE + "SELECT 'forward' AS direction, dict_id, code AS k, label AS v FROM fwd UNION ALL SELECT 'reverse', dict_id, label_key, code FROM rev",
)
def dict_last_wins(spark, sf):
    entries_ = catalogue(spark, sf)
    forward = d.forward_map(entries_).select(F.lit("forward").alias("direction"), "dict_id", F.col("code").alias("k"), F.col("label").alias("v"))
    reverse = d.reverse_map(entries_).select(F.lit("reverse").alias("direction"), "dict_id", F.col("label_key").alias("k"), F.col("code").alias("v"))
    return forward.unionByName(reverse)


HIT = "FROM coded_list c LEFT JOIN fwd ON c.dict_id = fwd.dict_id AND c.code = fwd.code"
ROW = "c.l_orderkey, c.l_partkey, c.dict_id, c.code"


@query("dict_lookup", CATALOGUE + f"SELECT {ROW}, fwd.label {HIT}")
def dict_lookup(spark, sf):
    return d.lookup_labels(view(spark, sf, "coded_list"), catalogue(spark, sf), "code", F.col("dict_id"))


@query("dict_code_valid", CATALOGUE + f"SELECT {ROW}, fwd.code IS NOT NULL AS code_valid {HIT}")
def dict_code_valid(spark, sf):
    return d.code_validity(view(spark, sf, "coded_list"), catalogue(spark, sf), "code", F.col("dict_id"))


@query("dict_filter_valid", CATALOGUE + f"SELECT {ROW} {HIT} WHERE c.code = '' OR fwd.code IS NOT NULL")
def dict_filter_valid(spark, sf):
    return d.keep_valid_codes(view(spark, sf, "coded_list"), catalogue(spark, sf), "code", F.col("dict_id"))


@query(
    "dict_error_column",
    CATALOGUE + f"SELECT {ROW}, CASE WHEN c.code <> '' AND fwd.code IS NULL THEN concat('代码值 ''', c.code, ''' 不在字典 ', c.dict_id, ' 中') END AS code_error {HIT}",
)
def dict_error_column(spark, sf):
    return d.code_errors(view(spark, sf, "coded_list"), catalogue(spark, sf), "code", F.col("dict_id"))


@query("dict_codes", CATALOGUE + "SELECT DISTINCT dict_id, code FROM clean")
def dict_codes(spark, sf):
    return d.all_codes(catalogue(spark, sf))


@query(
    "dict_sizes",
    CATALOGUE + """SELECT f.dict_id, f.codes, coalesce(r.labels, 0) AS labels FROM (SELECT dict_id, count(*) AS codes FROM fwd GROUP BY dict_id) f
LEFT JOIN (SELECT dict_id, count(*) AS labels FROM rev GROUP BY dict_id) r ON f.dict_id = r.dict_id""",
)
def dict_sizes(spark, sf):
    return d.dictionary_sizes(catalogue(spark, sf))


@query(
    "dict_fingerprint",
    CATALOGUE + """, h AS (SELECT dict_id, md5(concat('{"code":"', code, '","label":"', label, '"}')) AS e FROM clean)
SELECT dict_id, entries, md5(concat_ws('-', cast(entries AS string), cast(s0 AS string), cast(s1 AS string), cast(s2 AS string), cast(s3 AS string))) AS md5_hash
FROM (SELECT dict_id, count(*) AS entries, sum(cast(concat('0x', substr(e, 1, 7)) AS bigint)) AS s0, sum(cast(concat('0x', substr(e, 8, 7)) AS bigint)) AS s1,
sum(cast(concat('0x', substr(e, 15, 7)) AS bigint)) AS s2, sum(cast(concat('0x', substr(e, 22, 7)) AS bigint)) AS s3 FROM h GROUP BY dict_id) x""",
)
def dict_fingerprint(spark, sf):
    return d.fingerprint_tables(catalogue(spark, sf))


@query("file_fingerprint", "SELECT page_id, md5(html) AS md5_hash FROM pages")
def file_fingerprint(spark, sf):
    """Page texts stand in for files: same columns as the binary file source."""
    files = table(spark, sf, "pages").select(
        F.col("page_id").alias("path"), F.encode("html", "UTF-8").alias("content")
    )
    return d.fingerprint_files(files).withColumnRenamed("path", "page_id")


@query(
    "dict_version_changes",
    with_views("version_log", "current_versions") + """, last AS (SELECT dict_file, arg_max(md5_hash, recorded_at) AS last_md5 FROM version_log GROUP BY dict_file)
SELECT c.dict_file, left(c.md5_hash, 8) AS current_short, left(l.last_md5, 8) AS last_short,
(c.md5_hash IS NULL OR c.md5_hash IS DISTINCT FROM l.last_md5) AS changed FROM current_versions c LEFT JOIN last l ON c.dict_file = l.dict_file""",
)
def dict_version_changes(spark, sf):
    return d.changed_versions(view(spark, sf, "current_versions"), view(spark, sf, "version_log"))


ENCODED = with_views("primary_list", "entries") + ", " + marked_cte() + """,
lab AS (SELECT dict_id, lower(trim(label)) AS k, arg_max(code, ord) AS code FROM entries GROUP BY dict_id, lower(trim(label))),
enc AS (SELECT m.*, coalesce(s.code, '未匹配') AS status_code, coalesce(p.code, '未匹配') AS priority_code, coalesce(n.code, '未匹配') AS nation_code
FROM marked m LEFT JOIN lab s ON s.dict_id = 'status' AND s.k = lower(trim(m.status_label))
LEFT JOIN lab p ON p.dict_id = 'priority' AND p.k = lower(trim(m.priority_label))
LEFT JOIN lab n ON n.dict_id = 'nation' AND n.k = lower(trim(m.nation_label)))
"""
CODE_SQL = ('status_label, status_code AS "status_label_Code", priority_label, priority_code AS "priority_label_Code", '
            'nation_label, nation_code AS "nation_label_Code"')
CODE_COLUMNS = tuple(c for name in DICT_FIELDS for c in (name, name + L.code_suffix))


def encoded(spark, sf, **options):
    return encode.encode_labels(marked_primary(spark, sf), DICT_FIELDS, entries(spark, sf), **options)


@query("encode_labels", ENCODED + f"SELECT _row_num, {CODE_SQL} FROM enc")
def encode_labels(spark, sf):
    return encoded(spark, sf).select("_row_num", *CODE_COLUMNS)


@query("encode_labels_join", ENCODED + f"SELECT _row_num, {CODE_SQL} FROM enc")
def encode_labels_join(spark, sf):
    """The shuffled form, as used for dictionaries too large for a broadcast."""
    return encoded(spark, sf, broadcast_bytes=0).select("_row_num", *CODE_COLUMNS)


@query(
    "encode_large_dictionary",
    with_views("primary_list") + """SELECT p._row_num, lower(p.name) AS owner,
coalesce(c.code, '未匹配') AS "owner_Code" FROM primary_list p
LEFT JOIN (SELECT lower(concat('Customer ', cast(c_custkey AS string))) AS k, c_name AS code FROM customer) c
ON c.k = lower(trim(p.name))""",
)
def encode_large_dictionary(spark, sf):
    """Every customer is one dictionary entry."""
    customers = table(spark, sf, "customer").select(
        F.lit("owner").alias("dict_id"),
        F.col("c_name").alias("code"),
        F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("label"),
        F.col("c_custkey").alias("ord"),
    )
    rows = view(spark, sf, "primary_list").select("_row_num", F.lower("name").alias("owner"))
    return encode.encode_labels(rows, {"owner": "owner"}, d.dictionary_table(customers))


@query("encode_missing_dict", with_views("primary_list") + "SELECT _row_num, email, '未匹配' AS \"email_Code\" FROM primary_list")
def encode_missing_dict(spark, sf):
    rows = view(spark, sf, "primary_list").select("_row_num", "email")
    return encode.encode_labels(rows, {"email": "no such dictionary"}, entries(spark, sf))


@query(
    "encode_stats",
    ENCODED + "\nUNION ALL ".join(
        f"""SELECT '{c}_label' AS field, '{c}' AS dict_id, count(*) FILTER (WHERE {c}_code <> '未匹配') AS matched,
count(*) FILTER (WHERE {c}_code = '未匹配') AS unmatched, printf('%.1f%%', count(*) FILTER (WHERE {c}_code <> '未匹配') / count(*) * 100) AS match_rate,
'success' AS status FROM enc"""
        for c in ("status", "priority", "nation")
    )
    + """
UNION ALL SELECT 'remark', 'no such dictionary', 0, count(*), '0.0%', 'dict_not_found' FROM enc""",
)
def encode_stats(spark, sf):
    """One of the fields names a dictionary that is not there."""
    fields = DICT_FIELDS | {"remark": "no such dictionary"}
    codes = encode.encode_labels(marked_primary(spark, sf), fields, entries(spark, sf))
    return encode.encode_stats(codes, fields, entries(spark, sf))


@query(
    "decode_codes",
    with_views("entries") + """SELECT o_orderkey, o_orderstatus, e.label AS status_label, n.label AS nation_label FROM orders
LEFT JOIN entries e ON e.dict_id = 'status' AND e.code = o_orderstatus
LEFT JOIN entries n ON n.dict_id = 'nation' AND n.code = cast(o_custkey AS string)""",
)
def decode_codes(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return encode.decode_codes(
        orders,
        {"o_orderstatus": "status", "o_custkey": "nation"},
        entries(spark, sf),
        {"o_orderstatus": "status_label", "o_custkey": "nation_label"},
    ).drop("o_custkey")


_CHECKED = "\nUNION ALL ".join(
    f"SELECT '{c}_label' AS field, _row_num AS row_num, {c}_label AS raw_value, 'DICT_NOT_FOUND' AS problem, "
    f"concat('值 ''', coalesce({c}_label, 'None'), ''' 在数据字典中不存在') AS detail FROM enc WHERE status = '通过' AND {c}_code = '未匹配'"
    for c in ("status", "priority", "nation")
)


@query("dict_check_errors", ENCODED + _CHECKED)
def dict_check_errors(spark, sf):
    return encode.dict_check_errors(encoded(spark, sf))


UNMATCHED = ("cast(CASE WHEN status = '通过' THEN (CASE WHEN status_code = '未匹配' THEN 1 ELSE 0 END) + (CASE WHEN priority_code = '未匹配' THEN 1 ELSE 0 END)"
             " + (CASE WHEN nation_code = '未匹配' THEN 1 ELSE 0 END) ELSE 0 END AS int)")
CHECKED = ENCODED + f", chk AS (SELECT *, {UNMATCHED} AS dict_errors FROM enc)"


@query(
    "dict_check_markers",
    CHECKED + "SELECT _row_num, CASE WHEN dict_errors = 0 THEN '通过' ELSE '不通过' END AS \"字典校验_状态\", dict_errors AS \"字典校验_错误数\" FROM chk",
)
def dict_check_markers(spark, sf):
    return encode.mark_dictionary(encoded(spark, sf)).select("_row_num", L.dict_status, L.dict_count)


@query(
    "dict_check_summary",
    CHECKED + """SELECT valid_rows, problems, fail_rows, valid_rows - problems AS success FROM (
SELECT count(*) FILTER (WHERE status = '通过') AS valid_rows, cast(sum(dict_errors) AS bigint) AS problems, count(*) FILTER (WHERE dict_errors > 0) AS fail_rows FROM chk) x""",
)
def dict_check_summary(spark, sf):
    return encode.dict_check_summary(encode.mark_dictionary(encoded(spark, sf)))
