"""Spelling variants by dynamic programming along a sorted word list.

The words are sorted, and neighbours know the length of their common prefix. A query's edit matrix needs
one row per character of a word. Words with a common prefix have the same first rows, so a row is
computed once for the whole range of words that share the prefix and is used by all of them; only the
three columns around the diagonal can be within one edit. When the smallest entry of a row exceeds one
edit, the whole range is skipped.

Two words of at least ``2 s + 1`` characters that are one edit apart share their first or their last ``s``
characters. The list therefore holds every word twice, as it is (``>``) and reversed (``<``), and queries
look only at words with the same mark and the same first ``s`` characters. The reversed pass
leaves out what the first pass has found.

On Spark the list is range-partitioned into stretches of some thousand words, and each stretch is searched
in one task. A query goes to its own stretch, and to further ones only if words behind its own first ``s``
characters lie there and the stretch's common prefix is still within one edit; that is decided by the same
search, over the prefixes of the stretches. So a prefix that a third of all words share is cut like any
other. Tasks return one row per query, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.operators.lookup import lookup_join
from rollcall.scratch import settled

MIN_CHARS = 7
MIN_COUNT = 2
FACTOR = 10
SLIP = 31
#: Words of one stretch of the sorted list, each counted in both directions.
STRETCH_WORDS = 4_096
#: Queries searched at a time: bounds the memory of a search.
QUERIES_AT_A_TIME = 1_024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FORWARD, _BACKWARD = ">", "<"
_FAR = np.uint8(9)


def word_counts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, slip: int | None = SLIP
) -> DataFrame:
    """``word`` and its number of occurrences ``n`` over whole texts.

    Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of at least ``min_chars`` code
    points, A-Z lower-cased. ``slip`` plants slips of the pen: where it divides the CRC-32 ``h`` of
    ``<id>:<run>``, code point ``h % length`` is deleted; None plants none. Null texts have no words; a null id
    counts as an empty one. Counts are combined before they are exchanged, so a word that is a
    third of all words costs one row per map task.
    """
    low = F.translate(F.col(text_column), _UPPER, _LOWER)
    runs = F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{min_chars},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if slip is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "run"))
        at = F.when(h % slip == 0, (h % F.length("run")).cast("int"))
        cut = F.concat(F.expr("left(run, at)"), F.expr("substr(run, at + 2)"))
        found = found.withColumn("at", at).select(F.when(F.col("at").isNull(), F.col("run")).otherwise(cut).alias("run"))
    return found.filter(F.length("run") >= min_chars).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))


class SortedList(NamedTuple):
    """Distinct texts in order: their code points end to end, where each begins, its length, and the
    length of the prefix it has in common with the text before (-1 for the first)."""

    codes: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    lcp: np.ndarray


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with three zeros behind every text, begins and lengths."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(t + "\0\0\0" for t in texts).encode("utf-32-le"), dtype=np.uint32)
    return codes, np.cumsum(size + 3) - size - 3, size


def sorted_list(texts: list[str]) -> SortedList:
    """``texts`` must be distinct and in code point order."""
    codes, begin, size = _code_points(texts)
    lcp = np.zeros(len(texts), dtype=np.int64)
    if len(texts):
        lcp[0] = -1
    open_, depth = np.arange(1, len(texts)), 0
    while len(open_):
        open_ = open_[(size[open_] > depth) & (size[open_ - 1] > depth)]
        open_ = open_[codes[begin[open_] + depth] == codes[begin[open_ - 1] + depth]]
        depth += 1
        lcp[open_] = depth
    return SortedList(codes, begin, size, lcp)


def search(
    words: SortedList, queries: tuple[np.ndarray, np.ndarray, np.ndarray], first: np.ndarray, last: np.ndarray, shared: int, whole: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) within the word ranges ``first`` to ``last``, which share ``shared`` characters with
    their query: words exactly one edit away (``whole``), or words that are a prefix of something
    at most one edit away.
    """
    q_codes, q_begin, q_size = queries
    ask = np.flatnonzero(last > first)
    lo, hi, depth = first[ask], last[ask], shared
    # Columns depth - 1, depth and depth + 1 of the row behind ``depth`` equal characters.
    a = np.full(len(ask), 1 if depth else _FAR, dtype=np.uint8)
    b = np.zeros(len(ask), dtype=np.uint8)
    c = np.where(q_size[ask] > depth, np.uint8(1), _FAR)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    while len(ask):
        ends = words.size[lo] == depth
        if whole:
            gap = q_size[ask] - depth
            edits = np.where(gap == 0, b, np.where(gap == 1, c, np.where(gap == -1, a, _FAR)))
            ends &= edits == 1
        if ends.any():
            hits.append((ask[ends], lo[ends]))
        # Where the words go on: one range per next character.
        starts = np.flatnonzero((words.lcp <= depth) & (words.size > depth))
        stops = np.append(starts[1:], len(words.size))
        from_, to = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        n = to - from_
        if not n.any():
            break
        row = np.repeat(np.arange(len(ask)), n)
        child = np.arange(len(row)) - np.repeat(np.cumsum(n) - n - from_, n)
        ask, lo, hi = ask[row], starts[child], np.minimum(stops[child], hi[row])
        char, at, left = words.codes[words.begin[lo] + depth], q_begin[ask] + depth, q_size[ask] - depth
        a, b, c = a[row], b[row], c[row]
        new_a = np.minimum(b + 1, a + (char != q_codes[at - 1]))
        new_b = np.minimum(np.minimum(c + 1, new_a + 1), b + (char != q_codes[at]))
        new_c = np.minimum(new_b + 1, c + (char != q_codes[at + 1]))
        a = np.where(left >= 0, new_a, _FAR).astype(np.uint8)
        b = np.where(left >= 1, new_b, _FAR).astype(np.uint8)
        c = np.where(left >= 2, new_c, _FAR).astype(np.uint8)
        near = np.flatnonzero(np.minimum(np.minimum(a, b), c) <= 1)
        ask, lo, hi, a, b, c = ask[near], lo[near], hi[near], a[near], b[near], c[near]
        depth += 1
    if not hits:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def _prefix_range(heads: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.searchsorted(heads, wanted, side="left"), np.searchsorted(heads, wanted, side="right")


class Stretches:
    """Where the sorted list was cut: number, first and last text of every stretch, in order."""

    def __init__(self, rows: list[tuple[int, str, str]], shared: int):
        rows = sorted(rows, key=lambda r: r[1])
        self.shared = shared
        self.number = np.array([r[0] for r in rows], dtype=np.int64)
        self.first_head = np.array([r[1][:shared] for r in rows], dtype=object)
        self.last_head = np.array([r[2][:shared] for r in rows], dtype=object)
        prefixes = []
        for _, first, last in rows:
            same = next((i for i, (x, y) in enumerate(zip(first, last)) if x != y), min(len(first), len(last)))
            prefixes.append(first[:same])
        #: Stretches whose words have no more in common than all partners of a query have.
        self.shallow = np.array([len(p) <= shared for p in prefixes], dtype=bool)
        self.prefixes = sorted({p for p, shallow in zip(prefixes, self.shallow) if not shallow})
        self.listed = sorted_list(self.prefixes)
        self.heads = np.array([p[:shared] for p in self.prefixes], dtype=object)
        order = {p: i for i, p in enumerate(self.prefixes)}
        of = np.array([order.get(p, -1) for p in prefixes], dtype=np.int64)
        #: Stretches by their prefix: a prefix of some words can be that of several stretches.
        self.by_prefix = np.argsort(of, kind="stable")
        self.prefix_sorted = of[self.by_prefix]

    def reached(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place of a stretch) for all stretches with possible partners of the queries."""
        heads = np.array([t[: self.shared] for t in texts], dtype=object)
        first, last = np.searchsorted(self.last_head, heads, side="left"), np.searchsorted(self.first_head, heads, side="right")
        n = np.maximum(last - first, 0)
        query = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(query)) - np.repeat(np.cumsum(n) - n - first, n)
        plain = self.shallow[place]
        query, place = query[plain], place[plain]
        if not self.prefixes:
            return query, place
        found, prefix = search(self.listed, _code_points(texts), *_prefix_range(self.heads, heads), self.shared, whole=False)
        begin, end = _prefix_range(self.prefix_sorted, prefix)
        n = end - begin
        more = self.by_prefix[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)]
        return np.concatenate([query, np.repeat(found, n)]), np.concatenate([place, more])


def _routed(listed: DataFrame, stretches: Stretches) -> DataFrame:
    """Every text in its own stretch (``own``), and as a query in the other stretches it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("part").to_numpy()
            for i in range(0, batch.num_rows, QUERIES_AT_A_TIME):
                piece = batch.slice(i, QUERIES_AT_A_TIME)
                query, place = stretches.reached(piece.column("text").to_pylist())
                part = stretches.number[place]
                other = part != own[i : i + QUERIES_AT_A_TIME][query]
                took = piece.take(pa.array(np.concatenate([np.arange(piece.num_rows), query[other]])))
                parts = np.concatenate([own[i : i + QUERIES_AT_A_TIME], part[other]])
                yield pa.RecordBatch.from_arrays(
                    [took.column("text"), took.column("n"), pa.array(parts.astype(np.int32)), pa.array(np.arange(len(parts)) < piece.num_rows)],
                    names=["text", "n", "part", "own"],
                )

    return listed.mapInArrow(run, "text string, n bigint, part int, own boolean")


def _turned(text: str) -> str:
    """The word behind a marked text."""
    return text[1:] if text[0] == _FORWARD else text[:0:-1]


class _Stretch:
    """One task's stretch of the list and the search for queries in it."""

    def __init__(self, texts: list[str], n: np.ndarray, shared: int):
        self.shared, self.n = shared, n
        self.listed = sorted_list(texts)
        self.heads = np.array([t[:shared] for t in texts], dtype=object)
        self.words = [_turned(t) for t in texts]
        self.backward = np.array([t[0] == _BACKWARD for t in texts], dtype=bool)
        self.rank = np.empty(len(texts), dtype=np.int64)
        self.rank[sorted(range(len(texts)), key=self.words.__getitem__)] = np.arange(len(texts))

    def near(self, texts: list[str]) -> pa.RecordBatch:
        """Per query with near words: how many, and the most frequent of them with its count."""
        heads = np.array([t[: self.shared] for t in texts], dtype=object)
        codes, begin, size = queries = _code_points(texts)
        query, word = search(self.listed, queries, *_prefix_range(self.heads, heads), self.shared, whole=True)
        # Reversed words that also share their first characters belong to the first pass.
        again = self.backward[word]
        for k in range(1, self.shared):
            mine, other = codes[begin[query] + size[query] - k], self.listed.codes[self.listed.begin[word] + self.listed.size[word] - k]
            again &= mine == other
        query, word = query[~again], word[~again]
        order = np.lexsort((self.rank[word], -self.n[word], query))
        query, word = query[order], word[order]
        asked, at, count = np.unique(query, return_index=True, return_counts=True)
        best = word[at]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([_turned(texts[i]) for i in asked], pa.string()),
                pa.array(count.astype(np.int64)),
                pa.array(self.n[best]),
                pa.array([self.words[i] for i in best], pa.string()),
            ],
            names=["word", "n_near", "best_n", "best"],
        )


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, stretch_words: int = STRETCH_WORDS) -> DataFrame:
    """``word``, ``n_near``, ``best``, ``best_n`` for the words that have words one edit away.

    ``words`` holds distinct words of at least ``min_chars`` code points and their counts ``n``. ``best`` is the
    near word of largest count, then smallest in code point order. The driver sees one row per
    stretch of ``stretch_words`` words.
    """
    shared = 1 + (min_chars - 1) // 2
    ways = F.array(F.concat(F.lit(_FORWARD), "word"), F.concat(F.lit(_BACKWARD), F.reverse("word")))
    parts = max(1, -(-2 * words.count() // stretch_words))
    marked = words.select(F.explode(ways).alias("text"), "n")
    listed = settled(marked.repartitionByRange(parts, "text").withColumn("part", F.spark_partition_id()))
    cuts = listed.groupBy("part").agg(F.min("text"), F.max("text")).collect()
    stretches = Stretches([tuple(r) for r in cuts], shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, counts, stretch = [], [], None
        for batch in batches:
            own = batch.column("own").to_numpy(zero_copy_only=False)
            mine, others = batch.filter(pa.array(own)), batch.filter(pa.array(~own))
            texts.extend(mine.column("text").to_pylist())
            counts.append(mine.column("n").to_numpy())
            if others.num_rows:
                if stretch is None:
                    stretch = _Stretch(texts, np.concatenate(counts), shared)
                yield from asked(stretch, others.column("text").to_pylist())
        if texts:
            yield from asked(stretch or _Stretch(texts, np.concatenate(counts), shared), texts)

    def asked(stretch: _Stretch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(texts), QUERIES_AT_A_TIME):
            yield stretch.near(texts[i : i + QUERIES_AT_A_TIME])

    placed = _routed(listed, stretches).repartitionById(max(parts, *(r["part"] + 1 for r in cuts), 1), "part")
    found = placed.sortWithinPartitions(F.desc("own"), "text").mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return (
        found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
        .select("word", "n_near", F.col("first.word").alias("best"), (-F.col("first.n")).alias("best_n"))
    )


def _roots(formed: DataFrame) -> DataFrame:
    """``word`` and the last word reached from it by following forms.

    A form is more frequent than its word by a factor, so chains are as long as counts have digits.
    """
    forms = settled(formed.select("word", "form"))
    at = forms.select("word", F.col("form").alias("root"))
    done = None
    while True:
        step = settled(lookup_join(at, forms.withColumnRenamed("form", "next"), F.col("root"), "word", F.col("word")))
        ended = step.filter("next IS NULL").select("word", "root")
        done = ended if done is None else done.unionByName(ended)
        at = step.filter("next IS NOT NULL").select("word", F.col("next").alias("root"))
        if at.isEmpty():
            return done


def spelling_variants(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """Groups words with their more frequent spelling: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``words`` has distinct ``word`` and ``n``; words below ``min_count`` or ``min_chars`` are no words, nor are null
    ones. ``form`` is the near word of largest count (ties: smallest in code point order) if it is at least
    ``factor`` (over 1) times as frequent, else null; ``root`` is where following forms ends, the word itself if
    it has none; ``n_near`` counts words exactly one edit away. Words may be of any length. An empty
    table gives an empty result; further columns of ``words`` are left out.
    """
    if factor <= 1:
        raise ValueError("factor must be over 1, or forms could run in circles")
    chosen = (F.col("n") >= min_count) & (F.length("word") >= min_chars)
    kept = settled(words.select("word", F.col("n").cast("bigint").alias("n")).filter(chosen))
    near = near_words(kept, min_chars)
    fits = F.col("best_n") >= F.lit(factor) * F.col("n")
    judged = settled(
        kept.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"),
        )
    )
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
