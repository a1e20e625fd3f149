"""Text encoding of many files in one job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tried in this order on the first 4096 bytes; the first that decodes is taken.
CANDIDATES = ("utf-8", "gbk", "gb2312", "cp1252", "latin-1")
SAMPLE_BYTES = 4096
LONGEST_CHARACTER = 4
UTF8_MARK = b"\xef\xbb\xbf"
CHARSETS = {
    "utf-8": "UTF-8",
    "utf-8-sig": "UTF-8",
    "gbk": "GBK",
    "gb2312": "GB2312",
    "cp1252": "windows-1252",
    "latin-1": "ISO-8859-1",
}
SPARK_CHARSETS = {"UTF-8", "ISO-8859-1"}


def _decodes(head: bytes, encoding: str) -> bool:
    """Do all characters that start inside the sample decode? The head is a bit longer than that."""
    try:
        head.decode(encoding)
    except UnicodeDecodeError as e:
        return e.start >= SAMPLE_BYTES
    return True


def encoding_of(head: bytes) -> str:
    """The encoding of a text by its first bytes; more than the sample may be given."""
    head = head[: SAMPLE_BYTES + LONGEST_CHARACTER]
    if head.startswith(UTF8_MARK):
        return "utf-8-sig"
    return next((c for c in CANDIDATES if _decodes(head, c)), CANDIDATES[0])


@F.pandas_udf(T.StringType())
def _detect(heads: pd.Series) -> pd.Series:
    return heads.map(encoding_of)


def detect_encodings(files: DataFrame) -> DataFrame:
    """Encoding per file; takes ``path`` and ``content`` of the ``binaryFile`` source.

    Only the head of each file crosses into Python. The source itself reads whole files and
    refuses those above 2 GB; ``layouts.csv_heads`` has no such limit.
    """
    head = F.substring("content", 1, SAMPLE_BYTES + LONGEST_CHARACTER)
    return files.select("path", _detect(head).alias("encoding"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` as (path, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
