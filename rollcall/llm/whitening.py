"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Vectors are brought to integers, so their scatter matrix is one of integers and can be computed without any
rounding. From there on:

* The matrix is reduced modulo many primes. Modulo a prime it is brought to Hessenberg form by similarity, whose
  characteristic polynomial follows from a short recurrence. Primes are independent, so they are tasks.
* Chinese remaindering joins the residues to the integer coefficients. How many primes it takes follows from a bound
  on the coefficients.
* All roots are real, so by Descartes' rule the number of roots beyond ``a`` is exactly the number of sign changes
  in the coefficients of the polynomial shifted by ``a``, multiplicities included. Halving intervals isolates the
  largest roots, with integer arithmetic throughout. Roots that are still together when the interval is 2**-128
  of their size are one root of that multiplicity.
* A component spans the null space of the matrix less its root: inverse iteration with many digits, a block
  of as many vectors as the root has multiplicity.

Spark computes whatever grows with the rows: the distinct integer vectors, their sums and scatter (partial
matrices per task, added up by entry) and the projection. The driver gets matrices of the dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, getcontext, localcontext
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.scratch import settled

SCALE = 256
COMPONENTS = 4
#: Bits of an integer that one exact floating product handles.
LIMB = 16
#: Rows of one exact product: these and twice ``LIMB`` bits stay below the 53 of a double.
_PIECE_ROWS = 4_096
_HALF = 1 << 32
#: Roots closer than this are one root; single ones are known to twice as many bits.
CLUSTER_BITS = 128
#: Digits of the inverse iteration beyond those of the matrix and of the roots.
SPARE_DIGITS = 40


# Integers --------------------------------------------------------------------------------------------


def integer_vector(vector: Column, scale: int = SCALE) -> Column:
    """Entries as ``floor(scale * entry)``, held to the range of a long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def is_finite(vector: Column) -> Column:
    """Neither null nor with null, infinite or undefined entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrices(batch: pa.RecordBatch, column: str, width: int) -> Iterator[np.ndarray]:
    values = batch.column(column)
    for i in range(0, len(values), _PIECE_ROWS):
        yield values.slice(i, _PIECE_ROWS).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Floating matrices of at most ``LIMB`` bits with ``x = sum of limb * 2**(LIMB * i)``."""
    out = []
    while True:
        if np.abs(x).max(initial=0) < 1 << (LIMB - 1):
            return [*out, x.astype(np.float64)]
        low = x & ((1 << LIMB) - 1)
        out.append(low.astype(np.float64))
        x = (x - low) >> LIMB


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum per dimension; sums travel as high and low halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        for batch in batches:
            for x in _matrices(batch, "x", width):
                n += len(x)
                high += (x >> 32).sum(axis=0)
                low += (x & (_HALF - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(width), "n": np.full(width, n), "high": high, "low": low})

    parts = fit.select("x").mapInArrow(run, "i bigint, n bigint, high bigint, low bigint")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()
    return (rows[0]["n"] if rows else 0), [r["high"] * _HALF + r["low"] for r in rows]


def _scatter(fit: DataFrame, width: int, n: int, sums: list[int]) -> list[list[int]]:
    """``n * sum of z z' - (sum of z) (sum of z)'`` for ``z`` = vector less the rounded mean: ``n`` squared times the
    covariance, exactly."""
    middle = [s // n for s in sums]
    shift = np.array([max(min(m, (1 << 62) - 1), -(1 << 62)) for m in middle], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in _matrices(batch, "x", width):
                limbs = [_limbs(x - shift)] if _fits(x) else None
                if limbs is None:  # entries near the ends of a long: shifted as Python integers
                    z = x.astype(object) - shift.astype(object)
                    high = np.array(z >> 31, dtype=np.int64).reshape(z.shape)
                    low = np.array(z & ((1 << 31) - 1), dtype=np.int64).reshape(z.shape)
                    limbs = [_limbs(low), _limbs(high)]
                flat = [(31 * j + LIMB * i, part) for j, group in enumerate(limbs) for i, part in enumerate(group)]
                for p, a in flat:
                    for q, b in flat:
                        total = totals.setdefault(p + q, np.zeros((2, width, width), dtype=np.int64))
                        product = (a.T @ b).astype(np.int64)
                        total[0] += product >> 32
                        total[1] += product & (_HALF - 1)
        for bits, total in totals.items():
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_pydict(
                {"bits": np.full(len(i), bits), "i": i, "j": j, "high": total[0][i, j], "low": total[1][i, j]}
            )

    parts = fit.select("x").mapInArrow(run, "bits bigint, i bigint, j bigint, high bigint, low bigint")
    added = parts.groupBy("bits", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    rest = [s - n * int(m) for s, m in zip(sums, shift)]
    matrix = [[0] * width for _ in range(width)]
    for r in added:
        matrix[r["i"]][r["j"]] += (r["high"] * _HALF + r["low"]) << r["bits"]
    for i in range(width):
        for j in range(i, width):
            matrix[i][j] = matrix[j][i] = n * matrix[i][j] - rest[i] * rest[j]
    return matrix


def _fits(x: np.ndarray) -> bool:
    return bool(np.abs(x).max(initial=0) < 1 << 61) and bool(x.min(initial=0) > -(1 << 61))


# Polynomial ------------------------------------------------------------------------------------------


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (at most 2**31), largest first."""
    found: list[int] = []
    small = [p for p in range(3, isqrt(top) + 1, 2) if all(p % q for q in range(3, isqrt(p) + 1, 2))]
    stop = top
    while len(found) < count:
        begin = max(stop - (1 << 20), 3) | 1
        alive = np.ones((stop - begin + 1) // 2, dtype=bool)  # odd numbers from ``begin``
        for p in small:
            first = -(-begin // p) * p
            first += p if first % 2 == 0 else 0
            first = max(first, p * p)
            alive[(first - begin) // 2 :: p] = False
        found += [begin + 2 * int(i) for i in np.flatnonzero(alive)[::-1]]
        stop = begin - 1
    return found[:count]


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of the characteristic polynomial of ``matrix`` modulo a prime below 2**31."""
    h, n = matrix % p, len(matrix)
    for m in range(1, n - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        if factors.any():
            h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m][None, :] % p) % p
            # The similar column step adds up many products: reduced before they are summed.
            h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors[None, :] % p).sum(axis=1)) % p
    rows = np.zeros((n + 1, n + 1), dtype=np.int64)
    rows[0, 0] = 1
    for k in range(1, n + 1):
        rows[k, 1:] = rows[k - 1, :-1]
        rows[k] = (rows[k] - int(h[k - 1, k - 1]) * rows[k - 1]) % p
        path = 1
        for i in range(1, k):
            path = path * int(h[k - i, k - i - 1]) % p
            if not path:
                break
            rows[k] = (rows[k] - path * int(h[k - i - 1, k - 1]) % p * rows[k - i - 1]) % p
    return rows[n]


def coefficient_bound(matrix: list[list[int]]) -> int:
    """Larger than any coefficient: elementary symmetric functions of non-negative roots with a known sum."""
    n, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    return max((comb(n, k) * trace**k // k**k for k in range(1, n + 1)), default=0) + 1


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of a positive semidefinite integer matrix, exactly."""
    width = len(matrix)
    limit = 2 * coefficient_bound(matrix) + 1
    primes = primes_below(1 << 31, limit.bit_length() // 30 + 1)
    entries = np.array(matrix, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [polynomial_modulo((entries % p).astype(np.int64), p) for p in batch["p"].tolist()]
            if found:
                yield pd.DataFrame({"p": batch["p"], "residues": [f.tolist() for f in found]})

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    listed = spark.createDataFrame(pd.DataFrame({"p": primes})).repartition(tasks)
    modulus, joined = 1, [0] * (width + 1)
    for p, residues in listed.mapInPandas(run, "p bigint, residues array<bigint>").collect():
        inverse = pow(modulus, -1, p)
        joined = [c + modulus * ((r - c) * inverse % p) for c, r in zip(joined, residues)]
        modulus *= p
    return [c - modulus if c > modulus // 2 else c for c in joined]


# Roots -----------------------------------------------------------------------------------------------


def roots_beyond(polynomial: list[int], numerator: int, bits: int) -> int:
    """How many of the real roots are larger than ``numerator / 2**bits``, with multiplicity."""
    n = len(polynomial) - 1
    # Roots times 2**bits, so that the shift is an integer.
    shifted = [c << (bits * (n - i)) for i, c in enumerate(polynomial)]
    for i in range(n):
        for j in range(n - 1, i - 1, -1):
            shifted[j] += numerator * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


class Root:
    """An interval ``(low, high] / 2**bits`` with ``count`` roots, of which ``above`` are larger than all of it."""

    def __init__(self, low: int, high: int, bits: int, above: int, count: int):
        self.low, self.high, self.bits, self.above, self.count = low, high, bits, above, count

    def halves(self, polynomial: list[int]) -> list[Root]:
        low, high, bits = self.low, self.high, self.bits
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        upper = roots_beyond(polynomial, middle, bits) - self.above
        parts = [Root(middle, high, bits, self.above, upper), Root(low, middle, bits, self.above + upper, self.count - upper)]
        return [p for p in parts if p.count]

    def narrow(self) -> bool:
        """Whether the interval is ``2**-CLUSTER_BITS`` of its upper end."""
        return (self.high - self.low) << CLUSTER_BITS <= self.high

    def value(self) -> Decimal:
        return (Decimal(self.low) + Decimal(self.high)) / 2 / Decimal(2) ** self.bits


def largest_roots(polynomial: list[int], wanted: int) -> list[Root]:
    """Isolated positive roots from the largest, until ``wanted`` (with multiplicity) and the next one are told apart."""
    zeros = next(i for i, c in enumerate(polynomial) if c)
    positive = polynomial[zeros:]
    if len(positive) == 1:
        return []
    top = 1 - positive[-2]  # no root is larger than the sum of all
    found: list[Root] = []
    waiting = [Root(0, 1 << top.bit_length(), 0, 0, len(positive) - 1)]
    while waiting and sum(r.count for r in found) <= wanted:
        root = waiting.pop()
        if root.narrow() or (root.count == 1 and root.low > 0 and (root.high - root.low) << 8 <= root.high):
            found.append(root)
        else:
            waiting += reversed(root.halves(positive))
    # A single root is one sign change: halving goes on by signs alone, far below the distance to its neighbours.
    return [_refined(positive, r) if r.count == 1 else r for r in found]


def _sign(polynomial: list[int], numerator: int, bits: int) -> int:
    total = 0
    for k, c in enumerate(reversed(polynomial)):
        total = total * numerator + (c << (bits * k))
    return (total > 0) - (total < 0)


def _refined(polynomial: list[int], root: Root, more_bits: int = 2 * CLUSTER_BITS) -> Root:
    low, high, bits = root.low, root.high, root.bits
    at_high = _sign(polynomial, high, bits)
    while at_high and (high - low) << more_bits > high:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        sign = _sign(polynomial, middle, bits)
        if sign == 0:
            return Root(middle, middle, bits, root.above, 1)
        low, high = (low, middle) if sign == at_high else (middle, high)
    return Root(low if at_high else high, high, bits, root.above, 1)


# Components ------------------------------------------------------------------------------------------


def null_space(matrix: list[list[int]], root: Root) -> list[list[Decimal]]:
    """Orthonormal vectors that the matrix stretches by ``root``: as many as its multiplicity."""
    width = len(matrix)
    a = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object)
    a[np.diag_indices(width)] -= root.value()
    tiny = max(abs(v) for row in matrix for v in row) * Decimal(10) ** -getcontext().prec
    order = np.arange(width)
    for k in range(width):  # elimination with row exchanges, factors kept below the diagonal
        pivot = k + max(range(width - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        if k + 1 < width:
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= a[k + 1 :, k][:, None] * a[k, k + 1 :][None, :]
    start = np.random.default_rng(width).integers(1, 1 << 30, size=(root.count, width))
    vectors = [np.array([Decimal(int(v)) for v in row], dtype=object) for row in start]
    for _ in range(4):
        solved = []
        for v in vectors:
            y = v[order].copy()
            for k in range(width):
                y[k] -= (a[k, :k] * y[:k]).sum() if k else 0
            for k in range(width - 1, -1, -1):
                y[k] = (y[k] - ((a[k, k + 1 :] * y[k + 1 :]).sum() if k + 1 < width else 0)) / a[k, k]
            for other in solved * 2:
                y = y - (y * other).sum() * other
            solved.append(y / (y * y).sum().sqrt())
        vectors = solved
    return [list(v) for v in vectors]


class Whitening:
    """What the projection needs: sums, components as doubles, scales and shares."""

    def __init__(self, n: int, sums: list[int], vectors: list[list[float]], values: list[float], explained: list[float]):
        self.n, self.sums, self.vectors, self.values, self.explained = n, sums, vectors, values, explained

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``x`` (integers) centred, projected and scaled."""
        centred = self.centred(x)
        return np.stack([centred @ np.array(v) / np.sqrt(e) for v, e in zip(self.vectors, self.values)], axis=1)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n``: the whole part of the mean goes first, exactly."""
        middle = [s // self.n for s in self.sums]
        rest = np.array([(s - m * self.n) / self.n for s, m in zip(self.sums, middle)])
        if _fits(x) and all(abs(m) < 1 << 61 for m in middle):
            return (x - np.array(middle, dtype=np.int64)).astype(np.float64) - rest
        return (x.astype(object) - np.array(middle, dtype=object)).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of ``(n x - sums)`` squared, exactly."""
        bound = self.n * int(np.abs(x).max(initial=0) if _fits(x) else 1 << 63) + max(map(abs, self.sums), default=0)
        if bound * bound * x.shape[1] < 1 << 62:
            y = x * self.n - np.array(self.sums, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        y = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return (y * y).sum(axis=1).tolist()


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Fits on the integer vectors ``x`` (all of length ``width``) of ``fit``; None if nothing varies."""
    n, sums = _sums(fit, width)
    matrix = _scatter(fit, width, n, sums)
    trace = sum(matrix[i][i] for i in range(width))
    if not trace:
        return None
    polynomial = characteristic_polynomial(fit.sparkSession, matrix)
    with localcontext() as context:
        roots = largest_roots(polynomial, components)
        context.prec = len(str(trace)) + CLUSTER_BITS + SPARE_DIGITS
        vectors: list[list[float]] = []
        values, explained = [], []
        for root in roots:
            if len(vectors) >= components:
                break
            value = root.value()
            for v in null_space(matrix, root)[: components - len(vectors)]:
                largest = max(v, key=abs)
                vectors.append([float(c if largest > 0 else -c) for c in v])
                values.append(float(value / (Decimal(n) * n)))
                explained.append(float(value / trace))
    return Whitening(n, sums, vectors, values, explained)


def identity_error(fit: DataFrame, width: int, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit vectors less the identity."""
    k = len(model.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in _matrices(batch, "x", width):
                w = model.whitened(x)
                first += w.sum(axis=0)
                second += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "first": first[i], "second": second.reshape(-1)})

    parts = fit.select("x").mapInArrow(run, "i bigint, j bigint, first double, second double")
    rows = parts.groupBy("i", "j").agg(F.sum("first").alias("first"), F.sum("second").alias("second")).collect()
    mean = {r["i"]: r["first"] / model.n for r in rows}
    # The vectors were centred before, so the means are rounding errors only.
    return max(abs(r["second"] / model.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in rows)


def whiten(
    table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """One row per row and component: id, ``component`` (from 1), ``n``, ``deviation`` (decimal, exact), ``whitened``,
    ``explained``, ``identity_error``.

    Vectors are fitted on their distinct integer forms, so copies, however many, count once; their rows are
    combined before they are exchanged. Rows whose vector is null or holds null or non-finite entries are
    left out, and so are rows whose vector is not of the commonest length (among distinct vectors; ties: the
    longer). Entries beyond the range of a long are held to it. A row with a null id is a row like others.
    There are as many components as there are positive eigenvalues, up to ``components``: a table
    without rows, with one distinct vector or with empty vectors gives an empty result. Other columns are left out.
    """
    schema = (
        f"id {table.schema[id_column].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), "
        "whitened double, explained double, identity_error double"
    )
    vector = F.col(f"`{vector_column}`")
    rows = table.filter(is_finite(vector)).select(F.col(f"`{id_column}`").alias("id"), integer_vector(vector, scale).alias("x"))
    fit = settled(rows.select("x").distinct())
    common = fit.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width = common["width"] if common else 0
    fit = fit.filter(F.size("x") == width)
    model = fit_whitening(fit, width, components) if width else None
    if model is None:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    error = identity_error(fit, width, model)
    k, most = len(model.vectors), 10**38 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _matrices(batch, "x", width):
                ids = batch.column("id").slice(at, len(x)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                at += len(x)
                deviation = [Decimal(d) if d <= most else None for d in model.deviations(x)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, model.n)),
                        pa.array(np.repeat(np.array(deviation, dtype=object), k), pa.decimal128(38, 0)),
                        pa.array(model.whitened(x).reshape(-1)),
                        pa.array(np.tile(model.explained, len(x))),
                        pa.array(np.full(len(x) * k, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.filter(F.size("x") == width).mapInArrow(run, schema).withColumnRenamed("id", id_column)
