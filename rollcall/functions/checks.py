"""Text format checks as native boolean expressions.

All of them expect text that is already trimmed and say nothing about blanks: callers
decide what a blank value means.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Named format patterns.
_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
_ID_CARD = r"^[1-9]\d{5}(18|19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[\dXx]$"
_PHONE = r"^1[3-9]\d{9}$"
NAMED_PATTERNS = {
    "email": _EMAIL,
    "邮箱": _EMAIL,
    "id_card": _ID_CARD,
    "phone": _PHONE,
    "mobile": _PHONE,
    "手机号": _PHONE,
    "手机": _PHONE,
}

_INTEGER = r"^-?\d+$"
_DIGITS = r"\d+(_\d+)*"
_DECIMAL = rf"^[+-]?({_DIGITS}\.({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"

_DAYS_31 = r"(?:3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])"
_DAYS_30 = r"(?:30|[12][0-9]|0[1-9]|[1-9]| [1-9])"
_DAYS_28 = r"(?:2[0-8]|1[0-9]|0[1-9]|[1-9]| [1-9])"
_MONTHS_31, _MONTHS_30, _FEBRUARY = r"(?:1[02]|0[13578]|[13578])", r"(?:11|0[469]|[469])", r"(?:02|2)"
_YEAR = r"(?!0000)[0-9]{4}"
_LEAP_YEAR = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)(?<!0000)"


def _calendar(layout: str, separator: str) -> str:
    """All real days in one layout of the letters Y, M and D."""

    def days(year: str, month: str, day: str) -> str:
        return separator.join({"Y": year, "M": month, "D": day}[letter] for letter in layout)

    return "|".join(
        (
            days(_YEAR, _MONTHS_31, _DAYS_31),
            days(_YEAR, _MONTHS_30, _DAYS_30),
            days(_YEAR, _FEBRUARY, _DAYS_28),
            days(_LEAP_YEAR, _FEBRUARY, "29"),
        )
    )


# Six accepted layouts; the day is checked by the pattern itself, leap years included.
_DATE = "^(?:" + "|".join(
    _calendar(layout, separator)
    for layout, separator in (("YMD", "-"), ("YMD", "/"), ("YMD", r"\."), ("YMD", ""), ("DMY", "/"), ("MDY", "/"))
) + r")\z"


# Categories that rule patterns and the JVM name alike; other names are scripts.
_CATEGORIES = re.compile(r"C[cfnos]?|L[lmotu]?|M[cen]?|N[dlo]?|P[cdefios]?|S[ckmo]?|Z[lps]?|Is\w+|In\w+|Alpha|Digit|Alnum|Upper|Lower|Punct|Space")
_COUNT = re.compile(r"\{\d+(,\d*)?\}")
_PROPERTY = re.compile(r"([pP])\{(\^?)(\w+)\}")


def search_pattern(pattern: str) -> str:
    """A rule pattern in the regex dialect of ``rlike``.

    Rule patterns treat ``\\d``/``\\w``/``\\s`` as Unicode classes and ``$`` as the very end of the text;
    the JVM needs ``(?U)`` and ``\\z`` for that. Scripts are named ``\\p{Han}`` and groups ``(?P<n>...)``.
    A brace that is no count, ``[`` within a class and ``&&`` within a class mean themselves.
    """
    out, at, in_class, class_start = [], 0, False, 0
    while at < len(pattern):
        ch, rest = pattern[at], pattern[at:]
        step, piece = 1, ch
        if ch == "\\":
            step, piece = 2, rest[:2]
            named = _PROPERTY.match(rest[1:])
            if named:
                kind, negated, name = named.groups()
                kind = {"p": "P", "P": "p"}[kind] if negated else kind
                step = 1 + named.end()
                piece = f"\\{kind}{{{name if _CATEGORIES.fullmatch(name) else 'Is' + name}}}"
        elif in_class:
            if ch == "]" and at > class_start:
                in_class = False
            elif ch == "[" and rest.startswith("[:") and ":]" in rest:
                step = rest.index(":]") + 2
                piece = f"\\p{{{rest[2 : step - 2].capitalize()}}}"
            elif ch == "[" or ch == "]":
                piece = "\\" + ch
            elif rest.startswith("&&"):
                step, piece = 2, r"\&\&"
        elif ch == "[":
            in_class = True
            if rest.startswith("[^"):
                step, piece = 2, "[^"
            class_start = at + step
        elif ch == "$":
            piece = r"\z"
        elif ch == "{" and not (out and _COUNT.match(rest)):
            piece = r"\{"
        elif ch == "{":
            step = _COUNT.match(rest).end()
            piece = rest[:step]
        elif ch == "}":
            piece = r"\}"
        elif rest.startswith("(?P<"):
            step, piece = 4, "(?<"
        elif rest.startswith("(?P="):
            end = rest.find(")")
            step, piece = end + 1, f"\\k<{rest[4:end]}>"
        out.append(piece)
        at += step
    return "(?U)" + "".join(out)


def is_usable_pattern(pattern: str) -> bool:
    """False for a pattern that the engine which would run it does not accept.

    The translated pattern is tried on one constant row, once per process; such a rule is skipped with a
    warning. Without a session, where nothing can run, every pattern counts as usable.
    """
    spark = SparkSession.getActiveSession()
    return spark is None or _runs(search_pattern(pattern))


@cache
def _runs(pattern: str) -> bool:
    try:
        SparkSession.active().range(1).select(F.lit("").rlike(pattern)).collect()
    except PySparkException:
        return False
    return True


INTEGER_PATTERN = search_pattern(_INTEGER)
DECIMAL_PATTERN = search_pattern(_DECIMAL)
DATE_PATTERN = _DATE


def integer_text(value: Column) -> Column:
    return value.rlike(INTEGER_PATTERN)


def decimal_text(value: Column) -> Column:
    """A float literal that has a decimal point (``12`` and ``1e5`` are not decimals)."""
    return value.rlike(DECIMAL_PATTERN)


def date_text(value: Column) -> Column:
    """A real calendar day in one of the six accepted layouts."""
    return value.rlike(DATE_PATTERN)
