"""Customer lists: scanning, tagging, row numbers, header rows, counts."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptyInputError, InputError
from ..functions.text import col
from ..labels import DEFAULT_LABELS, PRIMARY, Labels
from ..schemas import FINDING_SCHEMA
from .encoding import read_binary
from .layouts import RAGGED, RAW, charset_of, csv_layouts, scan_layouts
from .numbers import BLOCK, FILE, POSITION, placed_rows, split_offsets, with_numbers
from .workbooks import workbook_cells, workbook_list


def read_csv_list(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "utf-8",
    multi_line: bool = True,
) -> DataFrame:
    """CSV files with a header row; every column stays text.

    ``multi_line`` accepts line breaks inside quotes. A file that may have some is read in one task, so UTF-8 files are
    looked through first, in splits: where every line is whole, files are split. Pass False for files known to have none.
    """
    charset = charset_of(spark, encoding)

    def reader(across_lines: bool):
        return (
            spark.read.option("header", True)
            .option("encoding", charset)
            .option("multiLine", across_lines)
            .option("quote", '"')
            .option("escape", '"')
            .option("inferSchema", False)
            # Nothing between two separators is null, a quoted empty text is a blank value.
            .option("nullValue", "\u0001")
        )

    try:
        rows = reader(multi_line).csv(path)
    except AnalysisException as e:
        raise InputError(f"文件不存在: {path}", code="NOT_FOUND") from e
    if multi_line and charset.upper() == "UTF-8" and _whole_lines(spark, path):
        rows = reader(False).schema(rows.schema).csv(path)
    if rows.isEmpty():
        raise EmptyInputError(f"文件为空: {path}")
    first = rows.columns[0]
    return rows.withColumnRenamed(first, first.lstrip("\ufeff"))


def _whole_lines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether every line of CSV files is certainly a record by itself, read alike with and without its neighbours.

    Quotes must enclose a value from its first character to its last; what stands between a quote and the next one becomes
    a mark, and marks may only touch separators, ends and each other. Carriage returns, blank lines and bytes
    that are no UTF-8 text do not count as certain.
    """
    line = F.col("value")
    marked = F.regexp_replace(line, '"[^"]*"', "\u0001")
    whole = (
        ~line.rlike("[\\r\\x00\\x01\\uFFFD]") & ~line.rlike("^[\\x00-\\x20]*$") & ~marked.rlike('"')
        & ~marked.rlike("[^,\\x01]\\x01|\\x01[^,\\x01]")
    )
    lines = spark.read.option("lineSep", "\n").text(path)
    return bool(lines.agg(F.min(whole).alias("whole")).first()["whole"])


def read_csv_folder(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All CSV files of a folder, each by its own encoding and header."""
    return scan_layouts(spark, csv_layouts(spark, path), multi_line).drop(FILE, BLOCK, POSITION)


def spread(rows: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """A list scanned in fewer splits than the session has cores, dealt out to all cores.

    One workbook, one multi-line CSV or one small file arrives in a single task, and all row checks
    would run there. A list with enough splits is returned as it is, without a shuffle. ``scan`` is
    the plain file scan below ``rows``, if ``rows`` is more than that.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    splits = (rows if scan is None else scan).rdd.getNumPartitions()
    return rows.repartition(cores) if splits < cores else rows


def tag_source(rows: DataFrame, list_key: str, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Adds the name of the list to every row."""
    return rows.withColumn(labels.source, F.lit(list_key))


def number_rows(
    rows: DataFrame, start: int = 1, labels: Labels = DEFAULT_LABELS, row_index: bool = False
) -> DataFrame:
    """Adds dense row numbers in file order; ``rows`` must come straight from a file source.

    Rows are counted per file split, the counts are summed up over the splits (one small row per
    split), and every row adds its position inside its split; see ``with_numbers``.
    ``row_index=True`` uses the position that the Parquet source knows itself.
    """
    placed = placed_rows(rows, row_index)
    return with_numbers(placed, split_offsets(placed), start, labels).drop(FILE, BLOCK, POSITION)


def split_header_row(rows: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Turns row 1 into column metadata (``code``) and drops it; later rows move up by one."""
    row_num = col(labels.row_num)
    names = [name for name in rows.columns if name not in (labels.row_num, labels.source)]
    header = rows.filter(row_num == 1).select(*[col(name) for name in names]).first()
    body = rows.filter(row_num > 1)
    if header is None or body.isEmpty():
        raise EmptyInputError("文件只有表头无数据")
    body = body.withColumn(labels.row_num, row_num - 1)
    for name, code in zip(names, header):
        body = body.withMetadata(name, {"code": code or ""})
    return body


def header_codes(rows: DataFrame) -> dict[str, str]:
    """Column → code kept from a two-row header."""
    return {f.name: f.metadata["code"] for f in rows.schema.fields if "code" in f.metadata}


class LoadedList(NamedTuple):
    """A numbered list and what was odd about its rows."""

    rows: DataFrame
    findings: DataFrame


def load_list(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    labels: Labels = DEFAULT_LABELS,
    multi_line: bool = True,
    sheet: str | None = None,
    code_row: bool = False,
) -> LoadedList:
    """One list from a file or folder: workbooks if their name or ``sheet`` says so, else CSV.

    Every CSV file is read by its own encoding (``encoding`` overrides what its head tells) and header, every
    workbook by its own header. ``code_row``: the first row below each header holds codes. It is no row
    of the list; the first file's codes become column metadata. Findings are CSV rows with more or
    fewer cells than their header: file, row number, first value, raw text, problem.
    """
    if sheet is not None or path.lower().endswith(".xlsx"):
        files = read_binary(spark, path)
        if files.select("path").isEmpty():
            raise EmptyInputError(f"文件为空: {path}")
        numbered = workbook_list(workbook_cells(files), None, sheet, labels, 2 if code_row else 1).withColumnRenamed("path", FILE)
        checked = None
    else:
        found = csv_layouts(spark, path, encoding)
        placed = scan_layouts(spark, found, multi_line)
        offsets = split_offsets(placed, code_row)
        numbered = with_numbers(placed, offsets, labels=labels).drop(BLOCK, POSITION)
        checked = with_numbers(scan_layouts(spark, found, multi_line, raw=True), offsets, labels=labels)
    body = numbered.filter(col(labels.row_num) > 0) if code_row else numbered
    if body.isEmpty():
        raise EmptyInputError("文件只有表头无数据" if code_row else f"文件为空: {path}")
    names = [n for n in numbered.columns if n not in (FILE, labels.row_num)]
    rows = body.select(*[col(n) for n in names], col(labels.row_num))
    if code_row:
        codes = numbered.filter(col(labels.row_num) == 0).orderBy(FILE).select(*[col(n) for n in names]).first()
        for name, code in zip(names, codes or ()):
            rows = rows.withMetadata(name, {"code": code or ""})
    if checked is None:
        return LoadedList(rows, spark.createDataFrame([], FINDING_SCHEMA))
    ragged = checked.filter(F.col(RAW).isNotNull() & (col(labels.row_num) > 0))
    return LoadedList(
        rows,
        ragged.select(
            F.col(FILE).alias("path"), col(labels.row_num).alias("row_num"), col(names[0]).alias("first_value"),
            F.col(RAW).alias("raw_value"), F.lit(RAGGED).alias("problem"),
        ),
    )


def load_all(
    spark: SparkSession,
    paths: Mapping[str, str | None],
    encodings: Mapping[str, str] | None = None,
    labels: Labels = DEFAULT_LABELS,
    multi_line: bool = True,
    sheets: Mapping[str, str] | None = None,
    code_rows: Collection[str] = (),
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Lazy tables per list, tagged and numbered, and the findings of all lists; blank paths are left out.

    ``sheets`` chooses a workbook sheet per list, ``code_rows`` names lists with a second header row.
    """
    if not paths.get(PRIMARY):
        raise InputError("the primary list is mandatory", code="PRIMARY_MISSING")
    encodings, sheets = encodings or {}, sheets or {}
    lists: dict[str, DataFrame] = {}
    findings = None
    for key, path in paths.items():
        if path:
            loaded = load_list(spark, path, encodings.get(key), labels, multi_line, sheets.get(key), key in code_rows)
            lists[key] = tag_source(spread(loaded.rows), key, labels)
            found = loaded.findings.select(F.lit(key).alias("list"), "*")
            findings = found if findings is None else findings.unionByName(found)
    return lists, findings


def load_lists(
    spark: SparkSession,
    paths: Mapping[str, str | None],
    encodings: Mapping[str, str] | None = None,
    labels: Labels = DEFAULT_LABELS,
    multi_line: bool = True,
) -> dict[str, DataFrame]:
    """The tables of ``load_all``."""
    return load_all(spark, paths, encodings, labels, multi_line)[0]


def list_counts(lists: Mapping[str, DataFrame], labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Rows per list in one job."""
    parts = [tag_source(rows.select(), key, labels).select(labels.source) for key, rows in lists.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.groupBy(labels.source).agg(F.count(F.lit(1)).alias("n"))


def list_profile(
    lists: Mapping[str, DataFrame],
    header_rows: Mapping[str, int] | None = None,
    labels: Labels = DEFAULT_LABELS,
) -> DataFrame:
    """Rows (less extra header rows still inside the data) and input columns per list."""
    header_rows = header_rows or {}
    widths = {k: len([c for c in rows.columns if not labels.is_generated(c)]) for k, rows in lists.items()}
    source = col(labels.source)
    width, extra = F.lit(None).cast("int"), F.lit(0)
    for key, n in widths.items():
        width = F.when(source == key, F.lit(n)).otherwise(width)
        extra = F.when(source == key, F.lit(header_rows.get(key, 0))).otherwise(extra)
    return list_counts(lists, labels).select(
        source.alias("list"),
        F.greatest(F.col("n") - extra, F.lit(0)).cast("long").alias("n_rows"),
        width.alias("n_columns"),
    )
