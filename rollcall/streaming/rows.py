"""The row-local stages on an arriving list.

Field rules, encoding and the dictionary check look at one row at a time and keep no state, so the
batch operators apply to a streaming DataFrame as they are. Dictionaries are static: every batch of
the stream is joined with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..labels import DEFAULT_LABELS, Labels
from ..operators.encode import encode_labels, encoded_fields, mark_dictionary
from ..operators.rules import FieldSpec, mark_rules


def mark_stream(
    rows: DataFrame,
    spec: FieldSpec,
    dictionary: DataFrame | None = None,
    labels: Labels = DEFAULT_LABELS,
) -> DataFrame:
    """Rule markers and, with a (static) dictionary, codes and dictionary markers."""
    marked = mark_rules(rows, spec, labels)
    fields = encoded_fields(spec, rows.columns)
    if dictionary is None or not fields:
        return marked
    return mark_dictionary(encode_labels(marked, fields, dictionary, labels), labels)
