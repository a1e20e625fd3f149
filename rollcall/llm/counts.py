"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes, plus one mark for the end of a word. Greedy longest-match-first
splitting of a word would restart in the trie after every piece. Instead every node knows where to go
on when no edge fits (its failure link) and how many pieces are finished by going there (popped
pieces), both worked out once, level by level. A word is then read left to right, every byte once, and
only a counter is kept: no piece is ever built. The automaton is sent to the tasks as a broadcast; its
size is the vocabulary's, whatever the number of documents.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

END = 256
_CACHED_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves,
    the others follow from code point 256 on in the order of their bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str, end: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces of a vocabulary file as bytes, with ``END`` after pieces that close a word."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    letters, pieces = byte_letters(), []
    for piece in vocabulary:
        body = piece.removesuffix(end)
        if all(c in letters for c in body):
            pieces.append(tuple(letters[c] for c in body) + ((END,) if body != piece else ()))
    return pieces


class Automaton:
    """Trie of pieces with failure links and popped-piece counts."""

    def __init__(self, edges: dict[int, int], fail: list[int], popped: list[int]):
        self.edges, self.fail, self.popped = edges, fail, popped

    @classmethod
    def of(cls, pieces: list[tuple[int, ...]]) -> Automaton:
        edges: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[]]
        whole = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                key = node << 9 | symbol
                if key not in edges:
                    edges[key] = len(children)
                    children[node].append((symbol, len(children)))
                    children.append([])
                    whole.append(False)
                node = edges[key]
            if node:
                whole[node] = True
        fail, popped = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for symbol, node in children[parent]:
                queue.append(node)
                if whole[node]:
                    fail[node], popped[node] = 0, 1
                    continue
                at, count = fail[parent], popped[parent]
                while at >= 0 and (at << 9 | symbol) not in edges:
                    count += popped[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], popped[node] = edges[at << 9 | symbol], count
        return cls(edges, fail, popped)

    def count(self, word: bytes) -> int:
        """Number of pieces of the word, or 0 if its greedy splitting gets stuck."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for symbol in (*word, END):
            while (step := edges.get(node << 9 | symbol)) is None:
                if fail[node] < 0:
                    return 0
                total += popped[node]
                node = fail[node]
            node = step
        while node:
            if fail[node] < 0:
                return 0
            total += popped[node]
            node = fail[node]
        return total


class _Lengths(dict):
    """Piece counts of words seen lately; holds a bounded number of them."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = value
        return value


def token_counts(
    docs: DataFrame,
    vocabulary_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_tokens`` and ``n_unknown``.

    Words are what white space (space, tab to carriage return) separates, with A-Z lower-cased. A word
    that the vocabulary cannot split counts as one token and one unknown word. Null and empty texts
    have no words. ``vocabulary_path`` is read on the driver. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    built = Automaton.of(read_vocabulary(vocabulary_path))
    shared = context.broadcast((built.edges, built.fail, built.popped))
    id_type = docs.schema[id_column].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _Lengths(Automaton(*shared.value))
        for batch in batches:
            texts = batch.column(1)
            out = np.zeros((3, batch.num_rows), dtype=np.int64)
            for i in range(batch.num_rows):
                if texts[i].is_valid:
                    # ASCII white space in bytes is exactly the separators; bytes.lower touches A-Z only.
                    words = texts[i].as_buffer().to_pybytes().lower().split()
                    pieces = [lengths[w] for w in words]
                    unknown = pieces.count(0)
                    out[:, i] = len(words), sum(pieces) + unknown, unknown
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x) for x in out)], names=["id", "n_words", "n_tokens", "n_unknown"]
            )

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    counts = rows.mapInArrow(counted, f"id {id_type}, n_words bigint, n_tokens bigint, n_unknown bigint")
    return counts.withColumnRenamed("id", id_column)
