"""Scalar text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col(name: str) -> Column:
    """Column by its exact name, also when the name holds dots, brackets or backticks."""
    return F.col(sql_name(name))


def sql_name(name: str) -> str:
    """Column name as it is written in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """String literal as it is written in SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_utrim(name: str) -> str:
    """``utrim`` of a column as SQL text."""
    return f"trim(both {sql_text(WHITE_SPACE)} from cast({sql_name(name)} as string))"


def as_column(value: Column | str) -> Column:
    return col(value) if isinstance(value, str) else value


def utrim(value: Column | str) -> Column:
    """Text with all Unicode white space removed at both ends (``trim`` alone drops blanks only)."""
    if isinstance(value, str):
        return F.expr(sql_utrim(value))
    return F.trim(value.cast("string"), F.lit(WHITE_SPACE))


def match_key(value: Column | str) -> Column:
    """Comparison key: trimmed, lower-cased text; null for null and blank values."""
    return F.nullif(F.lower(utrim(value)), F.lit(""))


def pair_key(first: Column, second: Column) -> Column:
    """One text for a pair of texts, different for different pairs; null if a part is null."""
    a, b = first.cast("string"), second.cast("string")
    return F.concat(F.char_length(a).cast("string"), F.lit(":"), a, b)


def fixed(value: Column, digits: int) -> Column:
    """Plain decimal text with ``digits`` places, rounded half-even on the exact value."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits if digits else "0"))


def duration_text(seconds: Column | str) -> Column:
    """``x.x秒`` below a minute, else ``m分s秒``; null when the duration is unknown."""
    s = as_column(seconds).cast("double")
    short = F.concat(fixed(s, 1), F.lit("秒"))
    long = F.concat(fixed(F.floor(s / 60).cast("double"), 0), F.lit("分"), fixed(s % 60, 0), F.lit("秒"))
    return F.when(s < 60, short).when(s >= 60, long)


def percent_text(part: Column | str, whole: Column | str) -> Column:
    """``part / whole`` as ``x.x%``; ``0%`` for an empty whole."""
    p, w = as_column(part).cast("double"), as_column(whole).cast("double")
    return F.when(w > 0, F.concat(fixed(p / w * 100, 1), F.lit("%"))).otherwise(F.lit("0%"))


def base_name(path: Column | str) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(as_column(path), "/"), -1)


def file_stem(path: Column | str) -> Column:
    """Base name without its last extension (a leading dot is not an extension)."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def short_path(path: Column | str, limit: int = 30, keep: int = 27) -> Column:
    """Paths longer than ``limit`` shown as ``...`` plus their last ``keep`` characters; ``-`` for none."""
    p = as_column(path)
    shown = F.when(F.char_length(p) > limit, F.concat(F.lit("..."), F.right(p, F.lit(keep)))).otherwise(p)
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit("-"))
