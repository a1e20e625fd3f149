from .checks import NAMED_PATTERNS, date_text, decimal_text, integer_text, search_pattern
from .text import base_name, col, duration_text, file_stem, match_key, percent_text, short_path, utrim

__all__ = [
    "NAMED_PATTERNS",
    "base_name",
    "col",
    "date_text",
    "decimal_text",
    "duration_text",
    "file_stem",
    "integer_text",
    "match_key",
    "percent_text",
    "search_pattern",
    "short_path",
    "utrim",
]
