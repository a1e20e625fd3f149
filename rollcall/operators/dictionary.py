"""Data dictionaries as long tables ``dict_id, code, label, label_key, ord``.

Operators work on a catalogue of dictionaries (any number of ids in one table); a run that needs
one dictionary filters its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, pair_key, utrim
from ..labels import DEFAULT_LABELS, Labels
from .lookup import lookup_join
from .match import _row_id

# Words of the three header rows and prefixes of dictionary id cells.
TEMPLATE_MARK = "字典类型标识"
CODE_HEADINGS = ("code", "编码")
LABEL_HEADINGS = ("details", "说明", "标签")
ID_PREFIX = "^(示例：|示例:|Dict:|Dict：)"
HEADER_ROWS = 3


def _mentions(cell: Column, words: tuple[str, ...]) -> Column:
    lowered = F.lower(cell)
    hit = F.contains(lowered, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(lowered, F.lit(word))
    return F.coalesce(hit, F.lit(False))


def dictionary_headers(cells: DataFrame) -> DataFrame:
    """Per grid (path, sheet) the dictionaries it holds: ``groups array<struct<dict_id, pos>>``.

    ``cells`` has the workbook cell layout: path, sheet, row_idx (1-based) and an array of cells.
    A dictionary is a code column followed by a label column in header row 3. Its id stands in row
    1, or in row 2 if row 1 carries the template mark; without an id it is ``Dict_<column>``. An id
    that occurs again replaces the earlier dictionary.
    """
    headers = (
        cells.filter(F.col("row_idx") <= HEADER_ROWS)
        .groupBy("path", "sheet")
        .agg(*[F.max(F.when(F.col("row_idx") == i, F.col("cells"))).alias(f"h{i}") for i in (1, 2, 3)])
    )
    is_template = F.exists("h1", lambda c: F.coalesce(F.contains(c, F.lit(TEMPLATE_MARK)), F.lit(False)))
    id_row = F.when(is_template, F.col("h2")).otherwise(F.col("h1"))
    titles = F.col("h3")

    def cell(row: Column, pos: Column) -> Column:
        return F.get(row, pos)

    positions = F.when(
        F.size("h3") >= 2, F.sequence(F.lit(0), F.size("h3") - 2)
    ).otherwise(F.array().cast("array<int>"))
    code_positions = F.filter(
        positions,
        lambda i: _mentions(cell(titles, i), CODE_HEADINGS) & _mentions(cell(titles, i + 1), LABEL_HEADINGS),
    )
    groups = F.transform(
        code_positions,
        lambda i: F.struct(
            F.coalesce(
                F.nullif(utrim(F.regexp_replace(utrim(cell(F.col("id_row"), i)), ID_PREFIX, "")), F.lit("")),
                F.concat(F.lit("Dict_"), i.cast("string")),
            ).alias("dict_id"),
            i.alias("pos"),
        ),
    )
    last_of_id = F.filter(
        F.col("found"),
        lambda g: ~F.exists(F.col("found"), lambda o: (o["dict_id"] == g["dict_id"]) & (o["pos"] > g["pos"])),
    )
    return (
        headers.withColumn("id_row", id_row)
        .withColumn("found", groups)
        .select("path", "sheet", last_of_id.alias("groups"))
    )


def dictionary_format(cells: DataFrame) -> DataFrame:
    """Format check by header rows only: number of dictionaries, verdict and message per grid."""
    n = F.size("groups")
    return dictionary_headers(cells).select(
        "path",
        "sheet",
        n.alias("dictionaries"),
        (n > 0).alias("valid"),
        F.when(n > 0, F.concat(F.lit("格式校验通过，共 "), n.cast("string"), F.lit(" 个字典组")))
        .otherwise(F.lit("[DICT_HEADER] 字典文件格式无法解析。请确认文件格式符合规范。"))
        .alias("message"),
    )


def unpivot_dictionaries(cells: DataFrame) -> DataFrame:
    """Wide dictionary grids to long rows ``path, sheet, dict_id, code, label, ord``.

    Headers are one row per grid. They are joined to the body by grid, so the number of body rows
    per task does not depend on how many dictionaries stand side by side. Rows with a blank code
    are dropped, cells are trimmed, a blank label stays as an empty text.
    """
    body = cells.filter(F.col("row_idx") > HEADER_ROWS)
    grid = pair_key(F.col("path"), F.col("sheet"))
    headers = dictionary_headers(cells).select(grid.alias("grid"), F.col("groups").alias("__groups"))
    joined = lookup_join(body, headers, grid, "grid", F.col("row_idx"))
    return (
        joined.select("path", "sheet", "row_idx", "cells", F.explode("__groups").alias("g"))
        .select(
            "path",
            "sheet",
            F.col("g.dict_id").alias("dict_id"),
            F.coalesce(utrim(F.get("cells", F.col("g.pos"))), F.lit("")).alias("code"),
            F.coalesce(utrim(F.get("cells", F.col("g.pos") + 1)), F.lit("")).alias("label"),
            F.col("row_idx").alias("ord"),
        )
        .filter("code <> ''")
    )


def file_catalogue(cells: DataFrame) -> DataFrame:
    """``unpivot_dictionaries`` with the dictionaries that a file really offers.

    Sheets are read in order (``sheet_pos``), and a sheet that holds an id again replaces the whole earlier
    dictionary of that id, also if it has headers only. Files never replace each other's dictionaries: keep
    ``path`` in ``dictionary_table`` and in the maps. Sheet names are unique in a file.
    """
    placed = dictionary_headers(cells.withColumn("sheet", F.struct("sheet_pos", "sheet")))
    pair = pair_key(F.col("path"), F.col("dict_id"))
    valid = placed.select("path", "sheet", F.explode("groups").alias("g")).select("path", "sheet", "g.dict_id")
    last = valid.groupBy("path", "dict_id").agg(F.max("sheet").alias("last")).select(
        pair.alias("pair"), F.col("last.sheet").alias("__last_sheet")
    )
    entries = unpivot_dictionaries(cells)
    joined = lookup_join(entries, last, pair, "pair", F.xxhash64("ord", "code"))
    return joined.filter(F.col("sheet") == F.col("__last_sheet")).drop("__last_sheet")


def dictionary_table(entries: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Long entries (dict_id, code, label, ord) cleaned to the dictionary schema.

    Columns ``within`` stay, such as the ``path`` of a catalogue in which files share ids.
    """
    label = F.coalesce(utrim("label"), F.lit(""))
    return entries.select(
        *within,
        "dict_id",
        utrim("code").alias("code"),
        label.alias("label"),
        F.lower(label).alias("label_key"),
        F.col("ord").cast("long").alias("ord"),
    ).filter("code <> ''")


def forward_map(dictionary: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """One label per (dict_id, code): the last row wins, of equal ``ord`` the later text.

    With ``within=["path"]`` every file has its own dictionaries.
    """
    last = F.max_by("label", F.struct("ord", "label"))
    return dictionary.groupBy(*within, "dict_id", "code").agg(last.alias("label"))


def reverse_map(dictionary: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """One code per (dict_id, lower-cased label): the last row wins; blank labels have no entry."""
    return (
        dictionary.filter("label_key <> ''")
        .groupBy(*within, "dict_id", "label_key")
        .agg(F.max_by("code", F.struct("ord", "code")).alias("code"))
    )


def _by_code(rows: DataFrame, dictionary: DataFrame, dict_id: Column, code: str, labels: Labels) -> DataFrame:
    """``rows`` with the label of (dict_id, code) as ``__label``; a hit always has a non-null label."""
    table = forward_map(dictionary).select(
        pair_key(F.col("dict_id"), F.col("code")).alias("pair"), F.col("label").alias("__label")
    )
    return lookup_join(rows, table, pair_key(dict_id, col(code)), "pair", _row_id(rows, labels))


def lookup_labels(
    rows: DataFrame,
    dictionary: DataFrame,
    code: str,
    dict_id: str | Column,
    target: str = "label",
    labels: Labels = DEFAULT_LABELS,
) -> DataFrame:
    """Adds the label of each code; null for an unknown code or dictionary.

    ``dict_id`` is a column, or the id of one dictionary for all rows.
    """
    found = _by_code(rows, dictionary, _id_column(dict_id), code, labels)
    return found.withColumnRenamed("__label", target)


def code_validity(
    rows: DataFrame,
    dictionary: DataFrame,
    code: str,
    dict_id: str | Column,
    target: str = "code_valid",
    labels: Labels = DEFAULT_LABELS,
) -> DataFrame:
    """Adds a boolean: is the code in the dictionary? False for null."""
    found = _by_code(rows, dictionary, _id_column(dict_id), code, labels)
    return found.withColumn(target, F.col("__label").isNotNull()).drop("__label")


def keep_valid_codes(
    rows: DataFrame,
    dictionary: DataFrame,
    code: str,
    dict_id: str | Column,
    labels: Labels = DEFAULT_LABELS,
) -> DataFrame:
    """Rows whose code is in the dictionary; a blank code is kept, a null code is dropped."""
    found = _by_code(rows, dictionary, _id_column(dict_id), code, labels)
    return found.filter((col(code) == "") | F.col("__label").isNotNull()).drop("__label")


def code_errors(
    rows: DataFrame,
    dictionary: DataFrame,
    code: str,
    dict_id: str | Column,
    target: str = "code_error",
    labels: Labels = DEFAULT_LABELS,
) -> DataFrame:
    """All rows plus an error text; null for a valid, blank or null code."""
    id_column = _id_column(dict_id)
    found = _by_code(rows, dictionary, id_column, code, labels)
    bad = (col(code) != "") & F.col("__label").isNull()
    text = F.concat(
        F.lit("代码值 '"), col(code).cast("string"), F.lit("' 不在字典 "), id_column, F.lit(" 中")
    )
    return found.withColumn(target, F.when(bad, text)).drop("__label")


def _id_column(dict_id: str | Column) -> Column:
    return F.lit(dict_id) if isinstance(dict_id, str) else dict_id


def all_codes(dictionary: DataFrame) -> DataFrame:
    """Every (dict_id, code), once: the codes of a dictionary, one row each."""
    return dictionary.select("dict_id", "code").distinct()


def dictionary_sizes(dictionary: DataFrame) -> DataFrame:
    """Dictionary names with their number of distinct codes and labels.

    Codes and labels are first reduced to distinct pairs, so one large dictionary does not end up
    in one task.
    """
    codes = all_codes(dictionary).groupBy("dict_id").agg(F.count(F.lit(1)).alias("codes"))
    keys = (
        dictionary.filter("label_key <> ''")
        .select("dict_id", "label_key")
        .distinct()
        .groupBy("dict_id")
        .agg(F.count(F.lit(1)).alias("labels"))
    )
    return codes.join(keys, "dict_id", "left").select(
        "dict_id", "codes", F.coalesce("labels", F.lit(0)).alias("labels")
    )


def fingerprint_files(files: DataFrame) -> DataFrame:
    """MD5 per file; takes the columns of the ``binaryFile`` source (path, content)."""
    return files.select("path", F.md5("content").alias("md5_hash"))


def fingerprint_tables(dictionary: DataFrame) -> DataFrame:
    """Order-independent fingerprint per dictionary id.

    Entries are digested one by one and combined by two sums over 28-bit parts of the digest and a
    count, all of which aggregate map-side; nothing collects a whole dictionary.
    """
    entry = F.md5(F.to_json(F.struct("code", "label")).cast("binary"))

    def part(start: int) -> Column:
        return F.conv(F.substring(F.col("__entry"), start, 7), 16, 10).cast("long")

    return (
        dictionary.withColumn("__entry", entry)
        .groupBy("dict_id")
        .agg(F.count(F.lit(1)).alias("entries"), *[F.sum(part(1 + 7 * i)).alias(f"s{i}") for i in range(4)])
        .select("dict_id", "entries", F.md5(F.concat_ws("-", "entries", "s0", "s1", "s2", "s3").cast("binary")).alias("md5_hash"))
    )


def changed_versions(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Current fingerprints against the last recorded ones.

    ``current``: dict_file, md5_hash (null for a file that is gone). ``recorded``: the version
    table. The last record per file is a partial aggregate, so a file with very many records
    does not load one task. Adds ``changed`` and the 8-character short forms.
    """
    last = recorded.groupBy("dict_file").agg(F.max_by("md5_hash", "recorded_at").alias("last_md5"))
    joined = current.join(last, "dict_file", "left")
    return joined.select(
        "dict_file",
        F.left("md5_hash", F.lit(8)).alias("current_short"),
        F.left("last_md5", F.lit(8)).alias("last_short"),
        (F.col("md5_hash").isNull() | ~F.col("md5_hash").eqNullSafe(F.col("last_md5"))).alias("changed"),
    )
