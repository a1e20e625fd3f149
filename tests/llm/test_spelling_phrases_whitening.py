"""Spelling variants, phrase fingerprints, whitening: brute force and odd input."""

import math
import random
import zlib
from collections import Counter
from decimal import localcontext
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import phrases, queries, spelling, whitening

LONG = "wörd of length " * 20_000
ODD = [
    (1, None), (2, ""), (3, "same text here"), (4, "same text here"), (4, "same text here"), (5, "aaaaaaaaaaaaaaaa"),
    (None, "nobody's next one"), (7, LONG), (8, "näïve ÇA 数据 text"), (9, "x"),
]
CLASH = ("id", "whole", "part", "late", "target", "at", "word", "run", "n", "x", "component", "text_", "fingerprint")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string").withColumns({c: F.lit(7) for c in CLASH})


# spelling -----------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, factor=10):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda x: (-counts[x], x))
            if counts[best] >= factor * counts[w]:
                form[w] = best
    rows = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return rows


def test_variants_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH_WORDS", 64)
    monkeypatch.setattr(spelling, "QUERIES_AT_A_TIME", 50)
    rng = random.Random(5)
    # Dense: many neighbours; one prefix for a third of the words; letters beyond ASCII; a very long word.
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(300)}
    words |= {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(150)}
    words |= {"z" * 3_000, "z" * 3_001, "z" * 1_500 + "y" + "z" * 1_500}
    counts = {w: rng.choice([2, 3, 25, 300, 4_000]) for w in sorted(words)}
    table = spark.createDataFrame([*counts.items(), ("toorare", 1), ("short", 90), (None, 9)], "word string, n bigint")
    got = spelling.spelling_variants(table.withColumns({"text": F.lit(1), "part": F.lit(2), "own": F.lit(3), "form": F.lit(4)}))
    rows = [tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(counts) and set(rows) == brute_variants(counts)


def test_words_of_whole_texts(odd):
    want = Counter()
    for doc, text in ODD:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
            run = ""
    want = {w: n for w, n in want.items() if len(w) >= 4}
    assert {r["word"]: r["n"] for r in spelling.word_counts(odd, min_chars=4).collect()} == want


def test_no_words(spark, odd):
    empty = spelling.spelling_variants(spelling.word_counts(odd.limit(0)))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    with pytest.raises(ValueError):
        spelling.spelling_variants(empty, factor=1)


# fingerprints -------------------------------------------------------------------------------------


def plain_parse(text):
    """The same parsing, symbol by symbol: names of all phrases by level, and the name of the text."""
    m = (1 << 64) - 1

    def mix(x):
        return int(phrases.mixed(np.array([x & m], dtype=np.uint64))[0])

    def toss(symbols):
        out, left = [], symbols[0] ^ 1
        for s in symbols:
            low = (s ^ left) & -(s ^ left)
            out.append(2 * (low.bit_length() - 1) + (s & low != 0))
            left = s
        return out

    found, symbols, level = [], list(text), 0
    while symbols:
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        symbols = [s for s, _ in runs]
        values = [int(phrases.BYTE_VALUES[s]) if level == 0 else s for s in symbols]
        values = [v if r == 1 else mix(v + r * int(phrases._RUN)) for v, (_, r) in zip(values, runs)]
        if len(symbols) == 1:
            return found, mix(values[0] ^ int(phrases._LEVEL))
        labels = symbols
        for _ in range(3 if level == 0 else 4):
            labels = toss(labels)
        assert max(labels) < 6 and all(a != b for a, b in zip(labels, labels[1:]))
        starts = [0] + [i for i in range(1, len(labels) - 1) if labels[i - 1] < labels[i] > labels[i + 1]]
        level += 1
        ends = [*starts[1:], len(labels)]
        symbols = [
            mix(sum(values[i + k] * int(phrases._PLACES[k]) for k in range(j - i)) + level * int(phrases._LEVEL)) for i, j in zip(starts, ends)
        ]
        found.append(symbols)
    return found, 0


def test_parsing_is_that_of_single_steps():
    rng = random.Random(3)
    texts = [b"", b"a", b"aaaa", b"ab", b"abab" * 40, bytes(rng.randrange(256) for _ in range(900))]
    texts += ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 400))).encode() for _ in range(30)]
    got = [[] for _ in texts]
    names = [0] * len(texts)
    for _, owner, found, done, whole in phrases.levels(*phrases._joined(texts)):
        for i in range(len(texts)):
            if (owner == i).any():
                got[i].append([int(x) for x in found[owner == i]])
        for i, name in zip(done, whole):
            names[i] = int(name)
    for i, text in enumerate(texts):
        assert (got[i], names[i]) == plain_parse(text)


def test_equal_passages_share_names_at_any_offset():
    rng = random.Random(4)
    passage = bytes(rng.randrange(97, 123) for _ in range(3_000))
    for before in (b"", b"x", b"some other words " * 9):
        found, _ = plain_parse(before + passage + b" and an end")
        plain, _ = plain_parse(passage)
        for level in range(3):
            inside = plain[level][8:-8]
            at = [i for i, name in enumerate(found[level]) if name == inside[0]]
            assert any(found[level][i : i + len(inside)] == inside for i in at)


def expected_edits(rows):
    placed = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1]))
    out = []
    for (doc, text), (_, follower) in zip(placed, placed[1:] + placed[:1]):
        cut = len(text) // 3
        out.append((doc, len(text), sha256((text[: len(text) - cut] + follower[:cut]).encode()).hexdigest()))
    out += [(None, len(t), sha256(t[: len(t) - len(t) // 3].encode()).hexdigest()) for d, t in rows if d is None]
    return sorted(out, key=repr)


def test_fingerprints_of_odd_input(odd):
    rows = phrases.edit_fingerprints(odd).collect()
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=repr)
    assert got == expected_edits([(d, t or "") for d, t in ODD])
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by_id[3] == by_id[4] and by_id[1] == by_id[2] and len(by_id[3]) == 1
    assert phrases.edit_fingerprints(odd.limit(0)).collect() == []


def test_fingerprints_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TASK_BYTES", 20_000)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op12_phrase_fingerprints(spark, sf).collect()
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=repr)
    assert got == expected_edits([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.98
    assert np.mean([r["near_edited"] for r in rows]) > 0.4 and np.mean([r["near_next"] for r in rows]) < 0.1
    # The column form of the likeness agrees, and so does the plain operator.
    frame = spark.createDataFrame(rows).withColumn("again", phrases.likeness("fingerprint", "edited_fingerprint"))
    assert all(math.isclose(r["again"], r["near_edited"]) for r in frame.collect())
    plain = {r["doc_id"]: r["fingerprint"] for r in phrases.fingerprints(docs).collect()}
    assert plain == {r["doc_id"]: r["fingerprint"] for r in rows}


# whitening ----------------------------------------------------------------------------------------


def exact_polynomial(matrix):
    """Faddeev-LeVerrier in fractions, constant first."""
    n = len(matrix)
    a = [[Fraction(v) for v in row] for row in matrix]
    m, out = [[Fraction(0)] * n for _ in range(n)], [Fraction(1)]
    for k in range(1, n + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(n)) + (out[-1] if i == j else 0) for j in range(n)] for i in range(n)]
        am = [[sum(a[i][t] * m[t][j] for t in range(n)) for j in range(n)] for i in range(n)]
        out.append(-sum(am[i][i] for i in range(n)) / k)
    return [int(c) for c in reversed(out)]


def scatter_of(x):
    n, s = len(x), [int(v) for v in x.sum(axis=0)]
    x = x.astype(object)
    return [[int(n * (x[:, i] * x[:, j]).sum() - s[i] * s[j]) for j in range(x.shape[1])] for i in range(x.shape[1])]


def test_polynomial_is_exact(spark):
    x = np.random.default_rng(1).integers(-999, 999, (40, 7))
    x[:, 5] = 3 * x[:, 2] - x[:, 0]
    matrix = scatter_of(x)
    assert whitening.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)
    assert exact_polynomial(matrix)[0] == 0


def test_roots_and_components_with_multiplicity():
    matrix = np.diag([9, 4, 4, 4, 1, 0]).tolist()
    roots = whitening.largest_roots(exact_polynomial(matrix), 3)
    assert [(round(float(r.value()), 12), r.count) for r in roots] == [(9.0, 1), (4.0, 3)]
    with localcontext() as context:
        context.prec = 200
        vectors = np.array([[float(c) for c in v] for v in whitening.null_space(matrix, roots[1])])
    assert np.allclose(vectors @ vectors.T, np.eye(3)) and np.allclose(vectors[:, [0, 4, 5]], 0)


def check_whitened(rows, x, ids):
    fit = np.array(sorted({tuple(int(e) for e in v) for v in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    covariance = np.array([[float(Fraction(int(v), n * n)) for v in row] for row in scatter_of(fit)])
    e = np.linalg.eigvalsh(covariance)[::-1]
    by = {}
    for r in rows:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], r)
    k = max(by)
    for c in by:
        assert len(by[c]) == len(set(ids))
        r = next(iter(by[c].values()))
        assert r["n"] == n and math.isclose(r["explained"], e[c - 1] / e.sum(), rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
    for i, v in zip(ids, x):
        assert int(by[1][i]["deviation"]) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))
    first = {tuple(int(e) for e in v): [by[c][i]["whitened"] for c in range(1, k + 1)] for i, v in zip(ids, x)}
    w = np.array([first[tuple(v)] for v in fit])
    assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-9)
    # Sign changes are free; the directions are not.
    vectors = np.linalg.eigh(covariance)[1][:, ::-1][:, :k]
    centred = np.array([[float(Fraction(int(a)) - Fraction(int(b), n)) for a, b in zip(v, s)] for v in fit])
    plain = centred @ vectors / np.sqrt(e[:k])
    assert np.allclose(np.abs((plain * w).sum(axis=0) / n), 1, atol=1e-9)


def test_whitening_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = [[math.floor(256 * c) for c in r["embedding"]] for r in table]
    rows = queries.op13_polynomial_whitening(spark, sf).collect()
    assert len(rows) == 4 * len(table)
    check_whitened(rows, np.array(x), [r["vec_id"] for r in table])


@pytest.mark.parametrize("shift", [0.0, 2.0**40])
def test_whitening_with_copies_far_from_zero(spark, shift):
    rng = np.random.default_rng(2)
    vectors = [[float(v) + shift for v in row] for row in rng.integers(-50, 50, (60, 5)) / 8]
    vectors += [vectors[0]] * 40
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [float("nan")] * 5), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("inf")] * 5), (904, [1.0]), (905, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "x", "n", "i", "width")})
    got = whitening.whiten(frame).collect()
    assert {r["vec_id"] for r in got} == set(range(100))
    check_whitened(got, np.array([[math.floor(256 * c) for c in v] for v in vectors]), list(range(100)))


def test_whitening_of_extreme_entries(spark):
    rows = [(i, [s * 3e38, float(i)]) for i, s in enumerate((1, -1, 1, -1))]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1, 2} and all(math.isfinite(r["whitened"]) for r in got)
    assert got[0]["identity_error"] < 1e-4


def test_fewer_components_than_dimensions(spark):
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)]
    frame = spark.createDataFrame(flat, "vec_id bigint, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(frame).collect()} == {1}
    assert whitening.whiten(frame.filter("vec_id = 1")).collect() == []
    assert whitening.whiten(frame.limit(0)).collect() == []
