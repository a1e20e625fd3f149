"""Fingerprints of documents by locally consistent parsing.

A text is a row of symbols, its UTF-8 bytes at first. On every level

1. a run of equal symbols becomes one symbol, so that neighbours differ;
2. deterministic coin tossing labels the symbols: the lowest bit in which a symbol differs from its left
   neighbour, and that bit's value. Labels of neighbours differ again, and four rounds bring any
   alphabet down to six labels;
3. a symbol whose label is larger than those of both neighbours begins a phrase, so phrases hold at most ten
   symbols;
4. a phrase's name, a hash of its symbols, is a symbol of the next level.

Levels go on until one symbol is left, the name of the whole text. Where phrases begin depends on a few
symbols nearby and never on the offset, so equal passages are cut alike except at their ends and have the
same names inside, on every level whose phrases they hold.

A fingerprint has the whole text's name and a sketch of the set of names from ``LOWEST`` up: a name counts by
the usual length of a phrase of its level and competes for one of ``SLOTS`` slots, where the name with the
smallest weighted rank leaves eight bits. So long texts are told by long phrases, which texts do not share by
chance, and short ones by what they have.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import BYTE_VALUES, SLICE_BYTES, mixed

SLOTS = 128
LOWEST = 1
#: How much more a name of the next level counts.
GROWTH = 2.5
#: Bytes of text that one task of ``edit_fingerprints`` reads.
TASK_BYTES = 16 << 20
#: Beyond so many tasks they grow, up to sixteen times as large.
MOST_SMALL_TASKS = 4_096
_U = np.uint64
_RUN = _U(0x9E3779B97F4A7C15)
_LEVEL = _U(0xD1B54A32D192ED03)
_STEP = 0xD6E8FEB86659FD93
_PLACES = np.array([pow(_STEP, i + 1, 1 << 64) for i in range(32)], dtype=_U)
#: Label of a pair of small symbols (left neighbour, symbol); any value for equal ones.
_SMALL = np.arange(256, dtype=np.int64)
_DIFFER = _SMALL[:, None] ^ _SMALL[None, :]
_LOW = np.maximum(_DIFFER & -_DIFFER, 1)
_TOSS = (2 * np.log2(_LOW).astype(np.int64) + ((_SMALL[None, :] & _LOW) != 0)).astype(np.uint8).reshape(-1)


def _left_of(symbols: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Left neighbours; the first symbol of a text gets one that differs in the lowest bit."""
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[edge] = symbols[edge] ^ symbols.dtype.type(1)
    return left


def _toss_small(symbols: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """One round on symbols of a byte."""
    return _TOSS[(_left_of(symbols, edge).astype(np.uint16) << np.uint16(8)) | symbols]


def _toss(symbols: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """One round on 64-bit symbols: labels below 128."""
    differ = symbols ^ _left_of(symbols, edge)
    low = differ & (~differ + _U(1))
    place = (low.astype(np.float64).view(np.int64) >> 52) - 1023
    return (2 * place + ((symbols & low) != 0)).astype(np.uint8)


def _phrase_starts(symbols: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where phrases begin; ``edge`` are the first symbols of the texts. Neighbours must differ."""
    labels = _toss_small(symbols, edge) if symbols.dtype == np.uint8 else _toss(symbols, edge)
    for _ in range(2 if symbols.dtype == np.uint8 else 3):
        labels = _toss_small(labels, edge)
    up = np.empty(len(labels) + 1, dtype=bool)
    up[1:-1] = labels[1:] > labels[:-1]
    up[0] = up[-1] = True
    begins = up[:-1] & ~up[1:]
    begins[edge[1:] - 1] = False  # the last symbol of a text begins nothing of its own
    begins[-1] = False
    begins[edge] = True
    return np.flatnonzero(begins)


def _phrase_names(values: np.ndarray, starts: np.ndarray, level: int) -> np.ndarray:
    """Hashes of the symbols from each start to the next."""
    size = np.diff(np.append(starts, len(values)))
    total = values[starts] * _PLACES[0]
    longer, k = np.arange(len(starts)), 1
    while True:
        longer = longer[size[longer] > k]
        if not len(longer):
            return mixed(total + _U(level * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        total[longer] += values[starts[longer] + k] * _PLACES[k]
        k += 1


def levels(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parses texts (bytes and their offsets) and yields level by level (level, text of each phrase, name of
    each phrase, finished texts, their names). Empty texts never appear.
    """
    size = np.diff(offsets)
    begin = offsets[:-1][size > 0]
    owner = np.flatnonzero(size > 0).astype(np.int32)
    symbols, level = data, 0
    while len(symbols):
        # Runs of equal symbols become one; ``begin`` are the first symbols of the texts ``owner``.
        fresh = np.ones(len(symbols), dtype=bool)
        np.not_equal(symbols[1:], symbols[:-1], out=fresh[1:])
        fresh[begin] = True
        starts = np.flatnonzero(fresh)
        begin = np.searchsorted(starts, begin)
        run = np.diff(np.append(starts, len(symbols)))
        symbols = symbols[starts]
        values = BYTE_VALUES[symbols] if symbols.dtype == np.uint8 else symbols
        many = np.flatnonzero(run > 1)
        if len(many):
            values = values.copy() if values is symbols else values
            values[many] = mixed(values[many] + run[many].astype(_U) * _RUN)
        alone = np.diff(np.append(begin, len(symbols))) == 1
        done, names = owner[alone], mixed(values[begin[alone]] ^ _LEVEL)
        if len(done):
            stays = np.ones(len(symbols), dtype=bool)
            stays[begin[alone]] = False
            symbols, values = symbols[stays], values[stays]
            begin = begin[~alone] - np.cumsum(alone)[~alone]
            owner = owner[~alone]
        level += 1
        if len(symbols):
            starts = _phrase_starts(symbols, begin)
            symbols = _phrase_names(values, starts, level)
            begin = np.searchsorted(starts, begin)
        yield level, np.repeat(owner, np.diff(np.append(begin, len(symbols)))), symbols, done, names


def _sketch_names(n: int, parts: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Slots of ``n`` texts from (text, name, weight) of their phrases; 0 is an empty slot."""
    sketch = np.zeros((n, SLOTS), dtype=np.uint8)
    keys = []
    for text, names, weight in parts:
        again = mixed(names + _RUN)
        # Exponential variables by weight: the smallest of a set falls on a name in proportion to its weight.
        rank = -np.log((again >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight
        bits = rank.astype(np.float32).view(np.uint32).astype(_U)
        value = np.maximum(names & _U(255), _U(1))
        slot = (names >> _U(8)) % _U(SLOTS)
        keys.append(((text.astype(_U) * _U(SLOTS) + slot) << _U(40)) | (bits << _U(8)) | value)
    if keys:
        found = np.sort(np.concatenate(keys))
        place = found >> _U(40)
        first = found[np.flatnonzero(np.append(True, place[1:] != place[:-1]))] if len(found) else found
        sketch.reshape(-1)[(first >> _U(40)).astype(np.int64)] = (first & _U(255)).astype(np.uint8)
    return sketch


def sketches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names (0 for an empty text) and slots of the given texts."""
    n = len(offsets) - 1
    names = np.zeros(n, dtype=_U)
    parts = []
    for level, text, phrases, done, whole in levels(data, offsets):
        names[done] = whole
        weight = GROWTH ** min(level, 30)
        if level >= LOWEST:
            parts.append((text, phrases, weight))
        if len(done):
            parts.append((done, whole, weight))
    return names, _sketch_names(n, parts)


def likeness_of(names: np.ndarray, slots: np.ndarray, other_names: np.ndarray, other_slots: np.ndarray) -> np.ndarray:
    """Share of slots on which two fingerprints agree, among those that either fills; 1 for equal names."""
    used = ((slots > 0) | (other_slots > 0)).sum(axis=1)
    same = ((slots == other_slots) & (slots > 0)).sum(axis=1)
    return np.where(names == other_names, 1.0, same / np.maximum(used, 1))


def likeness(fingerprint: Column | str, other: Column | str) -> Column:
    """``likeness_of`` for fingerprint texts, as a column."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (fingerprint, other))
    places = F.sequence(F.lit(17), F.lit(15 + 2 * SLOTS), F.lit(2))
    pairs = F.transform(places, lambda p: F.struct(F.substring(a, p, F.lit(2)).alias("a"), F.substring(b, p, F.lit(2)).alias("b")))
    used = F.size(F.filter(pairs, lambda p: (p["a"] != "00") | (p["b"] != "00")))
    same = F.size(F.filter(pairs, lambda p: (p["a"] != "00") & (p["a"] == p["b"])))
    whole = F.substring(a, 1, 16) == F.substring(b, 1, 16)
    return F.when(whole, F.lit(1.0)).otherwise(same / F.greatest(used, F.lit(1)))


def fingerprint_texts(names: np.ndarray, slots: np.ndarray) -> list[str]:
    return [f"{int(name):016x}{row.tobytes().hex()}" for name, row in zip(names, slots)]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE_BYTES``; a longer text is a range of its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and (size + len(text) > SLICE_BYTES or i - first >= 1 << 16):
            yield first, i
            first, size = i, 0
        size += len(text)
    if texts:
        yield first, len(texts)


def fingerprints(docs: DataFrame, text_column: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every whole text in the column ``into`` (replaced if there is one).

    Null counts as empty. Equal texts have equal fingerprints. No rows are exchanged.
    """
    kept = [c for c in docs.columns if c != into]
    shaped = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("__whole"))
    schema = shaped.drop("__whole").schema.add(into, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() for x in batch.column(batch.num_columns - 1)]
            out = []
            for i, j in _pieces(texts):
                out += fingerprint_texts(*sketches(*_joined(texts[i:j])))
            columns = [*batch.columns[:-1], pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, into])

    return shaped.mapInArrow(run, schema)


def _code_point_cut(text: bytes, keep: int) -> int:
    """Bytes of the first ``keep`` code points."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    return int(starts[keep]) if keep < len(starts) else len(text)


def _count(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))


def edited_text(text: bytes, other: bytes) -> tuple[bytes, int]:
    """``text`` with its last third of code points replaced by the first as many of ``other``, and its length."""
    n = _count(text)
    cut = n // 3
    return text[: _code_point_cut(text, n - cut)] + other[: _code_point_cut(other, cut)], n


_RESULT = (
    "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


class _Sketched(NamedTuple):
    """Rows with their texts, names and slots."""

    ids: list
    texts: list[bytes]
    names: np.ndarray
    slots: np.ndarray

    def slice(self, first: int | None, last: int | None) -> _Sketched:
        return _Sketched(self.ids[first:last], self.texts[first:last], self.names[first:last], self.slots[first:last])

    def then(self, other: _Sketched) -> _Sketched:
        return _Sketched(
            self.ids + other.ids, self.texts + other.texts,
            np.concatenate([self.names, other.names]), np.concatenate([self.slots, other.slots]),
        )


def _sketched(ids: list, texts: list[bytes]) -> _Sketched:
    return _Sketched(ids, texts, *sketches(*_joined(texts)))


def _judged(rows: _Sketched, following: _Sketched) -> pa.RecordBatch:
    edited = [edited_text(a, b) for a, b in zip(rows.texts, following.texts)]
    changed = [_sketched([], [e for e, _ in edited[i:j]]) for i, j in _pieces([e for e, _ in edited])]
    names, slots = np.concatenate([c.names for c in changed]), np.concatenate([c.slots for c in changed])
    columns = [
        pa.array(rows.ids, pa.int64()),
        pa.array([n for _, n in edited], pa.int64()),
        pa.array([sha256(e).hexdigest() for e, _ in edited], pa.string()),
        pa.array(fingerprint_texts(rows.names, rows.slots), pa.string()),
        pa.array(fingerprint_texts(names, slots), pa.string()),
        pa.array(likeness_of(rows.names, rows.slots, names, slots), pa.float64()),
        pa.array(likeness_of(rows.names, rows.slots, following.names, following.slots), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RESULT.split(", ")])


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[_Sketched]:
    """Rows of a part in portions of about ``SLICE_BYTES``, up to its first follower."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for late, id_, text in zip(batch.column("late").to_pylist(), batch.column("id").to_pylist(), batch.column("whole")):
            ids.append(id_)
            texts.append(text.as_buffer().to_pybytes())
            size += len(texts[-1])
            if late or size > SLICE_BYTES or len(ids) >= 1 << 16:
                yield _sketched(ids, texts)
                ids, texts, size = [], [], 0
            if late:
                return
    if ids:
        yield _sketched(ids, texts)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges the rows of one part, which come sorted and end with the row that follows the part."""
    waiting = None
    for rows in _portions(batches):
        rows = rows if waiting is None else waiting.then(rows)
        if len(rows.texts) > 1:
            yield _judged(rows.slice(None, -1), rows.slice(1, None))
        waiting = rows.slice(-1, None)


def _unplaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges rows without an id: nothing follows them."""
    for batch in batches:
        texts = [x.as_buffer().to_pybytes() for x in batch.column("whole")]
        for i, j in _pieces(texts):
            nothing = _sketched([None] * (j - i), [b""] * (j - i))
            yield _judged(_sketched(nothing.ids, texts[i:j]), nothing)


def _part_of(id_: Column, cuts: list[int]) -> Column:
    """How many cuts are below an id, by two short searches."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda b: b < id_
    array = lambda numbers: F.array(*[F.lit(n).cast("bigint") for n in numbers])
    coarse = F.size(F.filter(array([g[-1] for g in groups]), below))
    fine = F.size(F.filter(F.get(F.array(*map(array, groups)), coarse), below))
    return F.when(coarse == len(groups), F.lit(len(cuts))).otherwise(coarse * step + fine)


def edit_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """How fingerprints of whole texts bear an edit, and how they differ between neighbours.

    Per row: the id, ``n_chars`` (code points), ``edited_sha256`` of the edited text, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``, the likeness (0 to 1) of the text to its edited text and to
    the next document. The edited text has its last third of code points replaced by the first as many of
    the next document (all of it, if that is shorter). Documents follow each other by falling id, and the
    first follows the last. Null texts are empty. Rows with the same id follow each other by text. A row
    without an id has no place in that order: it is nobody's next, and nothing follows it. An
    empty table gives an empty result; other columns are left out.

    Rows are dealt to parts by ranges of ids and sorted there, so texts are exchanged once. Every part also
    gets the first row of the part that follows; which that is, is known from the ids alone. The
    driver sees one id per part. Ids are expected to tell rows apart: rows of one id share a task.
    """
    id_ = F.col(f"`{id_column}`").cast("bigint")
    rows = docs.select(id_.alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("whole"))
    placed, alone = rows.filter("id IS NOT NULL"), rows.filter("id IS NULL")
    judged = alone.mapInArrow(_unplaced, _RESULT)
    size = placed.agg(F.count(F.lit(1)), F.sum(F.octet_length("whole"))).first()
    if size[0]:
        wanted = max(min(size[1] // TASK_BYTES, MOST_SMALL_TASKS), size[1] // (16 * TASK_BYTES), 1)
        ids = placed.select("id")
        cuts = ids.agg(F.percentile_approx("id", [i / wanted for i in range(1, wanted)] or [0.5], max(10_000, 20 * wanted))).first()[0]
        part = _part_of(F.col("id"), sorted(set(cuts)))
        tops = sorted(tuple(r) for r in ids.groupBy(part.alias("part")).agg(F.max("id").alias("top")).collect())
        followers = docs.sparkSession.createDataFrame(
            [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)], "id bigint, target int"
        )
        own, extra = F.struct(part.alias("part"), F.lit(False).alias("late")), F.struct(F.col("target").alias("part"), F.lit(True).alias("late"))
        dealt = (
            placed.join(F.broadcast(followers), "id", "left")
            .select("id", "whole", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, extra))).alias("at"))
            .select("id", "whole", "at.part", "at.late")
            .repartitionById(tops[-1][0] + 1, "part")
            .sortWithinPartitions("late", F.desc("id"), "whole")
        )
        judged = judged.unionByName(dealt.mapInArrow(_in_order, _RESULT))
    return judged.withColumnRenamed("id", id_column)
