"""CSV folders whose files differ in encoding and header.

The head of every file is looked at once: its encoding and its header record. Files with the same
encoding and the same header are scanned together with an explicit schema, and the scans are united by
column name, so a file may order its columns as it likes. Rows that have more or fewer cells than
their header stay in the list (extra cells are cut, missing ones are null) and are reported in
a table of findings with their raw text.
"""

from __future__ import annotations

import csv
import io
import logging
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EmptyInputError, InputError
from ..functions.text import col
from .encoding import CHARSETS, LONGEST_CHARACTER, SAMPLE_BYTES, SPARK_CHARSETS, encoding_of
from .numbers import BLOCK, FILE, POSITION, placed_rows

log = logging.getLogger(__name__)

RAGGED = "RAGGED_ROW"
RAW = "__raw"
_HEADS = "path string, encoding string, header array<string>, spans boolean"


class Layout(NamedTuple):
    """Files of one encoding and header; ``spans``: the header record goes over several lines."""

    encoding: str
    header: tuple[str, ...]
    spans: bool
    paths: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        """Column names: repeated names get a suffix, blank ones their position."""
        seen: dict[str, int] = {}
        out = []
        for i, name in enumerate(self.header):
            name = name or f"column_{i + 1}"
            out.append(f"{name}_duplicated_{seen[name] - 1}" if name in seen else name)
            seen[name] = seen.get(name, 0) + 1
        return out


def _first_record(text: str) -> tuple[list[str], int] | None:
    """Cells and lines of the first record that is not blank; None if its last quote is open."""
    reader = csv.reader(io.StringIO(text, newline=""))
    before = 0
    for cells in reader:
        if cells:
            taken = "".join(text.splitlines(keepends=True)[before : reader.line_num])
            return None if taken.count('"') % 2 else (cells, reader.line_num - before)
        before = reader.line_num
    return [], 0


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file whose first split is read here; lines of a split come in order."""
    path, lines, size, done = None, [], 0, True

    def head() -> pa.RecordBatch | None:
        data = b"\n".join(lines)
        encoding = encoding_of(data)
        first = _first_record(data.decode(encoding, errors="replace").lstrip("\ufeff"))
        if first is None or not first[0]:
            return None
        columns = [[path], [encoding], [first[0]], [first[1] > 1]]
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "encoding", "header", "spans"])

    for batch in batches:
        for at, line in zip(batch.column("path").to_pylist(), batch.column("line")):
            if at != path:
                if not done and (found := head()) is not None:
                    yield found
                path, lines, size, done = at, [], 0, False
            if done:
                continue
            lines.append(line.as_buffer().to_pybytes())
            size += len(lines[-1]) + 1
            if size >= SAMPLE_BYTES + LONGEST_CHARACTER and (found := head()) is not None:
                yield found
                lines, done = [], True
    if not done and (found := head()) is not None:
        yield found


def csv_heads(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Path, encoding and header of every file that has a line; files may be of any size.

    Lines keep their bytes, and only those of a file's first split are looked at. The line reader drops a
    UTF-8 mark at the start of a file, so such files count as plain UTF-8, as which they are read.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        lines = reader.text(path)
    except AnalysisException as e:
        raise InputError(f"文件不存在: {path}", code="NOT_FOUND") from e
    first = lines.filter(F.col("_metadata.file_block_start") == 0)
    return first.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line")).mapInArrow(_heads, _HEADS)


def csv_layouts(spark: SparkSession, path: str | list[str], encoding: str | None = None, glob: str | None = None) -> list[Layout]:
    """The layouts of a folder, by their first path. The driver gets a short row per file, as from a listing."""
    groups: dict[tuple, list[str]] = {}
    for r in csv_heads(spark, path, glob).orderBy("path").collect():
        groups.setdefault((encoding or r["encoding"], tuple(r["header"]), r["spans"]), []).append(r["path"])
    if not groups:
        raise EmptyInputError(f"文件为空: {path}")
    return [Layout(*key, tuple(paths)) for key, paths in groups.items()]


def charset_of(spark: SparkSession, encoding: str) -> str:
    """The JVM's name of an encoding. Those beyond the few that Spark reads at once need a session option."""
    charset = CHARSETS.get(encoding.lower(), encoding)
    if charset.upper() not in SPARK_CHARSETS:
        log.info("enabling JVM charsets for %s", charset)
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return charset


def _plain(path: str) -> str:
    """A path from file metadata, which is encoded like a URL, as readers take it: nothing in it is a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path))


def _scan(spark: SparkSession, layout: Layout, multi_line: bool, raw: bool) -> DataFrame:
    names = [*layout.names, RAW] if raw else layout.names
    reader = (
        spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        .option("header", True)
        .option("encoding", charset_of(spark, layout.encoding))
        .option("multiLine", multi_line or layout.spans)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        # Nothing between two separators is null, a quoted empty text is a blank value.
        .option("nullValue", "\u0001")
    )
    if raw:
        # Only a reader that parses all cells can tell that there are too many or too few.
        reader = reader.option("columnNameOfCorruptRecord", RAW).option("columnPruning", False)
    placed = placed_rows(reader.csv([_plain(p) for p in layout.paths]))
    if not raw:
        return placed
    # Spark refuses to look at the raw text alone; always true, it makes the first column part of it.
    looked_at = F.coalesce(F.char_length(col(layout.names[0])), F.lit(0)) >= 0
    return placed.withColumn(RAW, F.when(looked_at, F.col(RAW)))


def scan_layouts(spark: SparkSession, layouts: list[Layout], multi_line: bool = True, raw: bool = False) -> DataFrame:
    """All rows of all layouts, placed (file, split, position); ``raw``: with the raw text of ragged rows.

    Columns come in the order of their first occurrence; a column that a file has not is null.
    """
    names = list(dict.fromkeys(name for layout in layouts for name in layout.names))
    parts = [_scan(spark, layout, multi_line, raw) for layout in layouts]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result.select(*[col(n) for n in names], FILE, BLOCK, POSITION, *([RAW] if raw else []))
