"""Scoring texts by a recurrent language model, and by a unigram base.

1. *Counts.* Tasks count distinct words of their training texts and hand packed arrays to parts by word;
   a part sums them. Totals are exact and cover all training texts.
2. *Head.* The most frequent words (a fixed number) with their counts are broadcast. The first of them are the
   vocabulary of the recurrent model.
3. *Training.* All training texts are read, in rounds: a hash deals every text to one round and, in it, to one
   of the trainers, whose size is bounded. Every trainer of a round goes on from the same parameters; the results are
   averaged by a tree of aggregates with the trainers' token numbers as weights and start the next round.
4. *Scoring.* One scan runs the model over every whole text. A word outside the model's vocabulary has the
   probability of the other-word mark times its share among such words by smoothed counts. Words
   outside the head go, packed, to their part, where all their occurrences meet and are counted; the part returns one
   sum per text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.scratch import settled

from . import gru
from .words import LOWER, VISIBLE, find_words, hash_runs, mixed, slices

HEAD_WORDS = 1 << 16
HEAD_SHARE = 1 << 20
MODEL_WORDS = 1600
#: Step size of every round; together the rounds read each training text once.
RATES = (0.01, 0.005)
TRAINER_BYTES = 16 << 20
FAN_IN = 64
WORDS_A_PART = 2_000_000
SMOOTH = 0.1

_U = np.uint64
#: Stands for the end of a text; word hashes are finalised values, so any constant does.
END = _U(0x5DEECE66D)


def _word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and word hashes, with the end after the last word."""
    for part in slices(column):
        data = LOWER[part.data]
        words = find_words(data, part.offsets, VISIBLE)
        hashes = hash_runs(data, words.begin, words.end)
        for r in range(part.last - part.first):
            yield part.first + r, np.append(hashes[words.rows[r] : words.rows[r + 1]], END)


def _pack(parts: int, keys: np.ndarray, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    part = (mixed(keys.view(_U)) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    filled = np.flatnonzero(np.diff(edges))
    columns = [pa.array([a[order][edges[p] : edges[p + 1]].tobytes() for p in filled], pa.binary()) for a in arrays.values()]
    return pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), *columns], names=["part", *arrays])


def _joined(values, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=kind) for x in values])


def word_counts(docs: DataFrame, parts: int) -> DataFrame:
    """``(keys, counts, tokens, distinct)``, packed, one row per part; ``docs(text)``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _pack(parts, keys, {"keys": keys, "counts": counts.astype(np.int64)})

        for batch in batches:
            for _, words in _word_hashes(batch.column(0)):
                held.append(words)
                size += len(words)
                if size > 4_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _joined(frame["keys"], _U), _joined(frame["counts"], np.int64)
        kinds, where = np.unique(keys, return_inverse=True)
        totals = np.bincount(where, weights=counts).astype(np.int64)
        return pd.DataFrame({"keys": [kinds.tobytes()], "counts": [totals.tobytes()], "tokens": [totals.sum()], "kinds": [len(kinds)]})

    packed = docs.mapInArrow(counted, "part bigint, keys binary, counts binary")
    return packed.repartition(parts, "part").groupBy("part").applyInPandas(summed, "keys binary, counts binary, tokens bigint, kinds bigint")


def _head(counts: DataFrame, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, by falling count; only words with a share above 1 / HEAD_SHARE count."""

    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            keys, n = _joined(frame["keys"], np.int64), _joined(frame["counts"], np.int64)
            often = n * HEAD_SHARE > tokens
            yield pd.DataFrame({"key": keys[often], "n": n[often]})

    rows = counts.select("keys", "counts").mapInPandas(frequent, "key bigint, n bigint")
    top = rows.orderBy(F.desc("n"), "key").limit(HEAD_WORDS).toPandas()
    return top["key"].to_numpy(dtype=np.int64).view(_U), top["n"].to_numpy(dtype=np.int64)


class _Numbers:
    """Places of word hashes in a list of words by falling frequency; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(words), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return np.where(self.keys[at] == words, self.order[at], -1)


def _averaged(models: DataFrame, trainers: int) -> np.ndarray | None:
    """Mean of the trainers' parameters, at most ``FAN_IN`` at a time in one task."""

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        weights = frame["weight"].to_numpy(dtype=float)
        total = sum(np.frombuffer(v, dtype=np.float64) * w for v, w in zip(frame["values"], weights, strict=True))
        return pd.DataFrame({"k": [int(frame["k"].iloc[0])], "weight": [weights.sum()], "values": [(total / weights.sum()).tobytes()]})

    while True:
        models = models.withColumn("k", F.floor(F.col("k") / F.lit(FAN_IN))).groupBy("k").applyInPandas(
            mean, "k bigint, weight double, values binary"
        )
        trainers = -(-trainers // FAN_IN)
        if trainers == 1:
            break
    rows = models.collect()
    return np.frombuffer(rows[0]["values"], dtype=np.float64) if rows else None


def _trainer(shared, words: int, start: int, rate: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        model, keys = shared.value
        numbers, texts, tokens = _Numbers(keys), [], 0
        for _, hashes in _word_hashes(pa.array(frame.sort_values(["id", "text"])["text"], pa.large_string())):
            at = numbers(hashes)
            texts.append(np.where((at < 0) | (at >= words), words, at).astype(np.int32))
            tokens += len(hashes)
        values = gru.flat(gru.train(model, texts, start, rate=rate)).tobytes()
        return pd.DataFrame({"k": [int(frame["k"].iloc[0])], "weight": [float(tokens)], "values": [values]})

    return run


def _fitted(docs: DataFrame, model: gru.Parameters, keys: np.ndarray, words: int, start: int) -> gru.Parameters:
    """``docs(id, text)``, all of them, train the model, one part of them a round."""
    context = docs.sparkSession.sparkContext
    turn = F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(len(RATES)))
    sizes = {r["turn"]: r["n"] for r in docs.groupBy(turn.alias("turn")).agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    for number, rate in enumerate(RATES):
        if number not in sizes:
            continue
        shared = context.broadcast((model, keys))
        trainers = max(1, -(-sizes[number] // TRAINER_BYTES))
        dealt = docs.filter(turn == number).withColumn("k", F.pmod(F.xxhash64("id", "text", F.lit(12)), F.lit(trainers)).cast("int"))
        models = dealt.repartitionById(trainers, "k").groupBy("k").applyInPandas(
            _trainer(shared, words, start, rate), "k bigint, weight double, values binary"
        )
        values = _averaged(models, trainers)
        if values is not None:
            model = gru.shaped(values, model)
    return model


def score_texts(docs: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``training`` tells which rows the counts and the model are learned from (null: not). Words are what
    white space (space, tab to carriage return) separates, with A-Z lower-cased; a text's tokens are its words
    and one end. Scores are base-10 logarithms of the probability of the whole text. Null and empty
    texts have the end only. Without training rows the base gives every token the same probability.
    Repeated rows stay repeated, and each counts in training. A text is one row of a task, however long.
    Other columns of ``docs`` are not read, so their names cannot clash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * WORDS_A_PART)))
    learned = docs.select(F.col(id_column).alias("id"), text.alias("text"), training.alias("t")).filter("t").select("id", "text")

    counts = settled(word_counts(learned.select("text"), parts))
    totals = counts.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    tokens, kinds = int(totals["tokens"] or 0), int(totals["kinds"] or 0)
    keys, times = _head(counts, tokens)
    words = min(MODEL_WORDS, len(keys))
    numbers = _Numbers(keys)
    end_at = int(numbers(np.array([END], dtype=_U))[0])
    # The end is as frequent as texts are; should rare long texts push it out, it counts as another word.
    start = end_at if 0 <= end_at < words else words
    rest = tokens - int(times[:words].sum()) + SMOOTH * (kinds - words + 1)
    model = gru.initial(times[:words].astype(float), rest)
    if tokens:
        model = _fitted(learned, model, keys, words, start)

    shared = spark.sparkContext.broadcast((model, keys, np.log10(times + SMOOTH)))
    id_type = docs.schema[id_column].dataType.simpleString()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, logs = shared.value
        numbers = _Numbers(keys)
        named = ["row", "id", "learned", "n_tokens", "n_head", "n_other", "head_sum", "other_sum", "model_sum", "part", "keys", "rows", "times"]
        texts, facts, tail, held, waiting = [], [], [], 0, 0

        def scored():
            n = len(texts)
            sums = gru.log_probabilities(model, texts, start) / math.log(10)
            columns = list(zip(*facts, strict=True))
            kinds = [pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            arrays = [pa.array(list(c), k) if k is not None else pa.concat_arrays([x for x in c]) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(sums), pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.binary())] * 3], names=named)

        def sent(kind):
            key, row, count, train = (np.concatenate([t[i] for t in tail]) for i in range(4))
            batch = _pack(parts, key, {"keys": key, "rows": row * 2 + train, "times": count.astype(np.int32)})
            n = batch.num_rows
            blank = [pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.bool_()), *[pa.nulls(n, pa.int64())] * 3, *[pa.nulls(n, pa.float64())] * 3]
            return pa.RecordBatch.from_arrays([*blank, *batch.columns], names=named)

        kind = None
        for batch in batches:
            ids, rows, train = batch.column("id"), batch.column("row").to_numpy(), batch.column("learned").to_pylist()
            kind = ids.type
            for r, hashes in _word_hashes(batch.column("text")):
                at = numbers(hashes)
                inside = at >= 0
                other = inside & (at >= words)
                known = logs[at[inside]]
                texts.append(np.where(inside & ~other, at, words).astype(np.int32))
                facts.append(
                    (int(rows[r]), ids.slice(r, 1), bool(train[r]), len(hashes), int(inside.sum()), int(len(hashes) - (inside & ~other).sum()),
                     float(known.sum()), float(logs[at[other]].sum()))
                )
                own, n = np.unique(hashes[~inside], return_counts=True)
                tail.append((own, np.full(len(own), rows[r], dtype=np.int64), n, np.full(len(own), int(bool(train[r])), dtype=np.int64)))
                held += len(hashes)
                waiting += len(own)
                if held > 2_000_000:
                    yield scored()
                    texts, facts, held = [], [], 0
                if waiting > 1_000_000:
                    yield sent(kind)
                    tail, waiting = [], 0
        if texts:
            yield scored()
        if waiting:
            yield sent(kind)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.coalesce(training, F.lit(False)).alias("learned"), text.alias("text")
    )
    schema = (
        f"row bigint, id {id_type}, learned boolean, n_tokens bigint, n_head bigint, n_other bigint, head_sum double, other_sum double, "
        "model_sum double, part bigint, keys binary, rows binary, times binary"
    )
    scan = settled(rows.mapInArrow(scanned, schema))

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        """All occurrences of a part's words: counts over training rows, then sums per row."""
        key, row, count = _joined(frame["keys"], _U), _joined(frame["rows"], np.int64), _joined(frame["times"], np.int32)
        _, which = np.unique(key, return_inverse=True)
        seen = np.bincount(which, weights=count * (row & 1))
        values = count * np.log10(seen + SMOOTH)[which]
        rows, at = np.unique(row >> 1, return_inverse=True)
        sums, known = np.bincount(at, weights=values[: len(at)]), np.bincount(at, weights=count * (seen[which] > 0))
        out = _pack(parts, rows, {"rows": rows, "sums": sums, "known": known.astype(np.int64)})
        return out.to_pandas()

    def gathered(frame: pd.DataFrame) -> pd.DataFrame:
        row, value, known = _joined(frame["rows"], np.int64), _joined(frame["sums"], np.float64), _joined(frame["known"], np.int64)
        rows, at = np.unique(row, return_inverse=True)
        return pd.DataFrame({"row": rows, "tail_sum": np.bincount(at, weights=value), "tail_known": np.bincount(at, weights=known).astype(np.int64)})

    tail = (
        scan.filter("part IS NOT NULL").select("part", "keys", "rows", "times").repartition(parts, "part")
        .groupBy("part").applyInPandas(met, "part bigint, rows binary, sums binary, known binary")
        .repartition(parts, "part").groupBy("part").applyInPandas(gathered, "row bigint, tail_sum double, tail_known bigint")
    )
    tail_sum = F.coalesce("tail_sum", F.lit(0.0))
    base_log = math.log10(tokens + SMOOTH * (kinds + 1))
    return scan.filter("part IS NULL").join(tail, "row", "left").select(
        F.col("id").alias(id_column),
        "n_tokens",
        (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("head_sum") + tail_sum - F.col("n_tokens") * F.lit(base_log)).alias("base_score"),
        (F.col("model_sum") + F.col("other_sum") + tail_sum - F.col("n_other") * F.lit(math.log10(rest))).alias("score"),
    )
