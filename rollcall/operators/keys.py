"""Choice of the comparison column by name; works on column names only."""

from __future__ import annotations

from collections.abc import Sequence

# Name fragments that point to a usable key, best first.
ENGINE_WORDS = ("email", "邮箱", "mail", "e-mail", "e_mail")
INTERACTIVE_WORDS = ("email", "mail", "phone", "mobile", "tel", "idcard", "身份证", "id", "uid")


def _first_containing(columns: Sequence[str], words: Sequence[str]) -> str | None:
    return next((name for word in words for name in columns if word in name.lower()), None)


def resolve_key(
    columns: Sequence[str], configured: Sequence[str] = (), policy: str = "engine"
) -> str | None:
    """Name of the key column.

    ``engine``: a configured name that exists, else the first name holding a mail word, else None.
    ``interactive``: the first name holding a contact or id word, else the first column.
    """
    if policy == "engine":
        chosen = next((name for name in configured if name in columns), None)
        return chosen or _first_containing(columns, ENGINE_WORDS)
    if policy == "interactive":
        return _first_containing(columns, INTERACTIVE_WORDS) or next(iter(columns), None)
    raise ValueError(f"unknown policy: {policy}")
