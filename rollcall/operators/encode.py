"""Dictionary encoding of label columns, decoding, and the check of unmatched codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, match_key, pair_key, percent_text, sql_name, sql_text
from ..labels import DEFAULT_LABELS, Labels
from ..scratch import measured, settled
from .dictionary import forward_map, reverse_map
from .lookup import SMALL_BYTES, lookup_join, table_bytes
from .match import _row_id
from .rules import FieldSpec, is_valid

#: All fields' dictionaries together may take so many bytes in broadcasts.
ALL_BROADCASTS = 4 * SMALL_BYTES

DICT_NOT_FOUND = "DICT_NOT_FOUND"


def encoded_fields(spec: FieldSpec, columns: list[str]) -> dict[str, str]:
    """Fields to encode: those with a dictionary id that exist in the list."""
    return {f.name: f.dict_id for f in spec.fields if f.dict_id and f.name in columns}


_COMBINED = "__keys"


def _combined(keys: list[Column]) -> Column:
    """One text for the keys of a row: different for different keys, null if none is there."""
    parts = [F.coalesce(F.concat(F.char_length(k).cast("string"), F.lit(":"), k), F.lit("-")) for k in keys]
    return F.when(F.coalesce(*keys).isNotNull(), F.concat(*parts))


def _join_together(
    rows: DataFrame, hits: Mapping[str, str], normal: Mapping[str, Column], fields: Mapping[str, str],
    entries: DataFrame, row_id: Column, broadcast_bytes: int,
) -> DataFrame:
    """Adds the hit column of every field whose dictionary is too large for a broadcast.

    The list is scanned once for the different combinations of keys that occur, which are counted with
    map-side combine. Combinations are melted to one row per field and key, joined with all
    dictionaries at once and put together again; then one lookup brings them back to the list.
    Both joins salt by exact counts. However many fields there are, the list is scanned twice and
    shuffled once at most, and not at all if the combinations fit into ``broadcast_bytes``.
    """
    names = list(hits)
    keys = [F.col(f"__key_{i}") for i in range(len(names))]
    keyed = rows.select(*[normal[name].alias(f"__key_{i}") for i, name in enumerate(names)])
    combos = (
        keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        .select(_combined(keys).alias(_COMBINED), *keys, "n").filter(F.col(_COMBINED).isNotNull())
    )
    combos = settled(combos)
    melted = combos.select(
        _COMBINED,
        F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(fields[name]).alias("dict_id"), keys[i].alias("key")) for i, name in enumerate(names)])),
    ).filter(F.col("key").isNotNull())
    table = entries.filter(F.col("dict_id").isin(sorted({fields[n] for n in names})))
    table = table.select(pair_key(F.col("dict_id"), F.col("key")).alias("entry"), "value")
    found = lookup_join(melted, table, pair_key(F.col("dict_id"), F.col("key")), "entry", F.xxhash64(_COMBINED), small_bytes=broadcast_bytes)
    values = [F.max(F.when(F.col("pos") == i, F.col("value"))).alias(hits[name]) for i, name in enumerate(names)]
    translated = found.groupBy(_COMBINED).agg(*values)
    counted = translated.join(combos.select(_COMBINED, F.col("n").alias("__n")), _COMBINED)
    key = _combined([normal[name] for name in names])
    return lookup_join(rows, counted, key, _COMBINED, row_id, key_rows="__n", small_bytes=broadcast_bytes).drop("__n")


def _translate(
    rows: DataFrame,
    fields: Mapping[str, str],
    table: DataFrame,
    key: str,
    value: str,
    normal: Mapping[str, Column],
    targets: Mapping[str, str],
    default: Column,
    labels: Labels,
    broadcast_bytes: int,
) -> DataFrame:
    """Adds one translated column per field, each right after its source column.

    The wanted dictionaries are written and measured in one job. Fields whose dictionaries fit into
    ``broadcast_bytes`` together are broadcast joins; all others are joined at once. On a stream, where
    nothing can be counted, each of those is a join of its own.
    """
    ids = sorted(set(fields.values()))
    wanted = table.filter(F.col("dict_id").isin(ids)).select("dict_id", F.col(key).alias("key"), F.col(value).alias("value"))
    sizes_of = {f"bytes_{i}": table_bytes(wanted, F.col("dict_id") == d) for i, d in enumerate(ids)}
    wanted, seen = measured(wanted, **sizes_of) if ids else (wanted, {})
    sizes = {d: seen[f"bytes_{i}"] for i, d in enumerate(ids) if seen[f"bytes_{i}"]}
    translated: dict[str, Column] = {}
    alone: dict[str, DataFrame] = {}
    together: dict[str, str] = {}
    for pos, (name, dict_id) in enumerate(fields.items()):
        hit = f"__hit_{pos}"
        translated[name] = F.coalesce(F.col(hit), default) if dict_id in sizes else default
        if dict_id in sizes and (sizes[dict_id] <= broadcast_bytes or rows.isStreaming):
            broadcast_bytes -= sizes[dict_id]
            entries = wanted.filter(F.col("dict_id") == dict_id)
            alone[name] = entries.select(F.col("key").alias(f"__entry_{pos}"), F.col("value").alias(hit))
        elif dict_id in sizes:
            together[name] = hit
    left = max(broadcast_bytes, 0)
    row_id = _row_id(rows, labels)
    joined = _join_together(rows, together, normal, fields, wanted, row_id, left) if together else rows
    for name, entries in alone.items():
        entry = entries.columns[0]
        fits = sizes[fields[name]] <= ALL_BROADCASTS
        joined = joined.join(F.broadcast(entries) if fits else entries, normal[name] == F.col(entry), "left").drop(entry)
    out = []
    for name in rows.columns:
        out.append(col(name))
        if name in translated:
            out.append(translated[name].alias(targets[name]))
    return joined.select(*out)


def encode_labels(
    rows: DataFrame,
    fields: Mapping[str, str],
    dictionary: DataFrame,
    labels: Labels = DEFAULT_LABELS,
    broadcast_bytes: int = ALL_BROADCASTS,
) -> DataFrame:
    """Adds ``<field>_Code`` per field by label (trimmed, lower-cased); unmatched text otherwise.

    ``fields`` maps a column to its dictionary id. Null, blank and unknown labels and fields of an
    unknown dictionary get the unmatched marker.
    """
    return _translate(
        rows,
        fields,
        reverse_map(dictionary),
        "label_key",
        "code",
        {name: match_key(name) for name in fields},
        {name: name + labels.code_suffix for name in fields},
        F.lit(labels.unmatched),
        labels,
        broadcast_bytes,
    )


def decode_codes(
    rows: DataFrame,
    fields: Mapping[str, str],
    dictionary: DataFrame,
    targets: Mapping[str, str],
    labels: Labels = DEFAULT_LABELS,
    broadcast_bytes: int = ALL_BROADCASTS,
) -> DataFrame:
    """Adds the label of each code column (null where the code is unknown)."""
    return _translate(
        rows,
        fields,
        forward_map(dictionary),
        "code",
        "label",
        {name: col(name).cast("string") for name in fields},
        targets,
        F.lit(None).cast("string"),
        labels,
        broadcast_bytes,
    )


def encode_stats(
    encoded: DataFrame,
    fields: Mapping[str, str],
    dictionary: DataFrame,
    labels: Labels = DEFAULT_LABELS,
) -> DataFrame:
    """Matched and unmatched rows and match rate per encoded field; one pass over the list.

    The status says whether ``dictionary`` has any entry of the field's dictionary.
    """
    names = list(fields)
    counts = encoded.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count_if(col(name + labels.code_suffix) != labels.unmatched).alias(f"m{pos}")
            for pos, name in enumerate(names)
        ],
    )
    wanted = dictionary.filter(F.col("dict_id").isin(sorted(set(fields.values()))))
    known = {r["dict_id"] for r in wanted.select("dict_id").distinct().collect()}  # one row per field at most
    per_field = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.lit(fields[name]).alias("dict_id"),
                F.col(f"m{pos}").alias("matched"),
                (F.col("n") - F.col(f"m{pos}")).alias("unmatched"),
                percent_text(F.col(f"m{pos}"), F.col("n")).alias("match_rate"),
                F.lit("success" if fields[name] in known else "dict_not_found").alias("status"),
            )
            for pos, name in enumerate(names)
        ]
    )
    return counts.select(F.inline(per_field))


def _code_columns(columns: list[str], labels: Labels) -> list[str]:
    return [name for name in columns if name.endswith(labels.code_suffix)]


def dict_check_errors(encoded: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Error table of unmatched codes on valid rows; one pass over all code columns."""
    failures = []
    for code_col in _code_columns(encoded.columns, labels):
        source = code_col[: -len(labels.code_suffix)]
        raw = col(source).cast("string") if source in encoded.columns else F.lit("")
        failures.append(
            F.when(
                col(code_col) == labels.unmatched,
                F.struct(
                    F.lit(source).alias("field"),
                    raw.alias("raw_value"),
                    F.lit(DICT_NOT_FOUND).alias("problem"),
                    F.concat(
                        F.lit("值 '"), F.coalesce(raw, F.lit("None")), F.lit("' 在数据字典中不存在")
                    ).alias("detail"),
                ),
            )
        )
    valid = encoded.filter(is_valid([c for c in encoded.columns if c == labels.rule_status], labels))
    if not failures:
        return valid.limit(0).selectExpr(
            "'' as field", "0L as row_num", "'' as raw_value", "'' as problem", "'' as detail"
        )
    return (
        valid.select(
            col(labels.row_num).cast("long").alias("row_num"), F.explode(F.array(*failures)).alias("e")
        )
        .filter("e is not null")
        .select("e.field", "row_num", "e.raw_value", "e.problem", "e.detail")
    )


def mark_dictionary(encoded: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Adds status and number of unmatched codes; rows that failed the field rules count 0.

    Columns that are already there are left as they are.
    """
    if labels.dict_status in encoded.columns:
        return encoded
    unmatched = sql_text(labels.unmatched)
    terms = [
        f"case when {sql_name(c)} = {unmatched} then 1 else 0 end"
        for c in _code_columns(encoded.columns, labels)
    ]
    total = " + ".join(terms) or "0"
    if labels.rule_status in encoded.columns:
        status = sql_name(labels.rule_status)
        total = f"case when {status} = {sql_text(labels.passed)} then {total} else 0 end"
    counted = encoded.selectExpr("*", f"{total} as {sql_name(labels.dict_count)}")
    count = col(labels.dict_count)
    return counted.select(
        *[col(c) for c in encoded.columns],
        F.when(count == 0, labels.passed).otherwise(labels.failed).alias(labels.dict_status),
        count,
    )


def dict_check_summary(checked: DataFrame, labels: Labels = DEFAULT_LABELS) -> DataFrame:
    """Valid rows, unmatched codes, ``success`` = rows - codes (may be negative), failing rows."""
    valid = is_valid([c for c in checked.columns if c == labels.rule_status], labels)
    count = col(labels.dict_count).cast("long")
    return checked.agg(
        F.count_if(valid).alias("valid_rows"),
        F.coalesce(F.sum(count), F.lit(0)).alias("problems"),
        F.count_if(count > 0).alias("fail_rows"),
    ).withColumn("success", F.col("valid_rows") - F.col("problems"))


