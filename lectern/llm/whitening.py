"""Embedding whitening from an exact characteristic polynomial.

Entries become integers x = floor(256 c).  The fit list holds each distinct
integer vector once; with n vectors and sums S the matrix

    M = n * (sum of x x') - S S'

is n^2 times their covariance, in integers.  Its second moments are added up in
Spark without rounding (tasks hand on 32-bit limbs, Spark sums limbs).  Then

1. the characteristic polynomial of M is computed modulo enough 31-bit primes,
   each by Hessenberg reduction, the primes dealt over Spark tasks, and put
   together by Chinese remaindering;
2. its largest roots are isolated and refined to about `ROOT_BITS` bits.  All
   roots are real, so the sign variations of the polynomial shifted by a count
   the roots above a exactly, repeated ones included (Descartes);
3. inverse iteration with 100-digit decimals on M - root gives the unit
   eigenvectors, orthogonal to those before (which matters for repeated roots);
4. rows are projected: (x - S / n) . v / sqrt(e), e = root / n^2.

What is on the driver is bounded by the vectors' dimension d: M, d + 1
coefficients a prime, and d^2 log(M) / 31 primes' worth of them; nothing grows with the rows.

Defined results: rows whose vector is null or holds null or non-finite entries
are dropped; 256 c beyond a 64-bit integer saturates; vectors shorter than the
longest count as zero in the entries they lack; repeated rows and rows with
equal or null vec_id give rows of their own, and enter the fit once by vector;
components whose eigenvalue is zero (fewer than four directions vary) cannot be
whitened and are not returned, so one single distinct vector gives no rows, like
an empty table; deviation is null where it does not fit a 64-bit integer; only
vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import prepare, stored

GRID = 256
COMPONENTS = 4
ROOT_BITS = 200   # of a root
DIGITS = 100      # of the decimals in inverse iteration
LIMB = 32
EXACT = 1 << 53   # whole numbers up to here are exact as doubles


def grid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole; x: longs, all of one length."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = table.where(F.forall("embedding", fine))
    rows = rows.select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * GRID)).alias("x"))
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    lacking = F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))
    return rows.select("vec_id", F.when(F.size("x") == d, F.col("x")).otherwise(F.concat("x", lacking)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x in whole numbers of any size (dtype object)."""
    top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if top * top >= EXACT:
        wide = x.astype(object)
        return wide.T.dot(wide)
    rows = max(1, (EXACT - 1) // max(1, top * top))
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), rows):
        part = x[at:at + rows].astype(np.float64)  # every sum stays below 2^53
        out += (part.T @ part).astype(np.int64)
    return out


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Limbs (i, j, k, limb) of a task's sums of x_i x_j, with a last entry 1 in every x."""
    total = None
    for batch in batches:
        x = _matrix(batch.column(0))
        if len(x):
            own = _products(np.column_stack((x, np.ones(len(x), np.int64))))
            total = own if total is None else total + own
    if total is not None:
        rows = []
        for i in range(len(total)):
            for j in range(i, len(total)):
                v, k = int(total[i, j]), 0
                while not -(1 << LIMB) < v < 1 << LIMB:
                    v, low = v >> LIMB, v & ((1 << LIMB) - 1)
                    rows.append((i, j, k, low))
                    k += 1
                rows.append((i, j, k, v))
        i, j, k, limb = (np.array(c, np.int64) for c in zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i, j, k, limb)], names=["i", "j", "k", "limb"])


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, S and M = n sum(x x') - S S' of the vectors x of `fit`, exactly."""
    limbs = fit.select("x").mapInArrow(_moments, "i long, j long, k long, limb long").groupBy("i", "j", "k").agg(F.sum("limb").alias("limb"))
    sums: dict[tuple[int, int], int] = {}
    for r in limbs.collect():  # d^2 / 2 sums
        sums[r.i, r.j] = sums.get((r.i, r.j), 0) + (r.limb << (LIMB * r.k))
    if not sums:
        return 0, [], []
    d = max(i for i, _ in sums)
    n, s = sums[d, d], [sums[i, d] for i in range(d)]
    return n, s, [[n * sums[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


# ---- characteristic polynomial ----

def _is_prime(n: int) -> bool:
    """For odd n below 2^31 (these bases decide up to 3.2e9)."""
    d, r = n - 1, 0
    while not d % 2:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes below 2^31 whose product passes 2 * bound."""
    out, product, at = [], 1, (1 << 31) - 1
    while product <= 2 * bound:
        if _is_prime(at):
            out.append(at)
            product *= at
        at -= 2
    return out


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (lowest first) of det(x - a) modulo the prime p < 2^31, by reduction to Hessenberg form."""
    h, d = a.copy() % p, len(a)
    for j in range(d - 2):
        below = np.flatnonzero(h[j + 1:, j])
        if not len(below):
            continue
        i = j + 1 + int(below[0])
        if i != j + 1:
            h[[i, j + 1]] = h[[j + 1, i]]
            h[:, [i, j + 1]] = h[:, [j + 1, i]]
        u = h[j + 2:, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2:] = (h[j + 2:] - u[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2:] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks
    polys[0, 0] = 1
    for k in range(d):
        w, run = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            run = run * int(h[i + 1, i]) % p
            w[i] = int(h[i, k]) * run % p
        new = np.roll(polys[k], 1) - polys[k] * h[k, k] % p - (w[:, None] * polys[:k] % p).sum(axis=0)
        polys[k + 1] = new % p
    return polys[d]


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients (lowest first) of det(x - m), m positive semidefinite in whole numbers."""
    d = len(m)
    mean = -(-sum(m[i][i] for i in range(d)) // d)
    primes = primes_for((1 + mean) ** d)  # no elementary symmetric function of the roots is above it (Maclaurin)

    def modular(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ps = [int(p) for p in batch["p"]]
            yield pd.DataFrame({"p": ps, "c": [polynomial_mod(np.array([[v % p for v in row] for row in m], np.int64), p).tolist() for p in ps]})

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    parts = dealt.mapInPandas(modular, "p long, c array<long>").collect()  # d + 1 numbers a prime
    whole = math.prod(primes)
    out = [0] * (d + 1)
    for r in parts:
        rest = whole // r.p
        w = rest * pow(rest, -1, r.p)
        out = [x + w * c for x, c in zip(out, r.c)]
    return [x - whole if (x := v % whole) > whole // 2 else x for v in out]


# ---- roots ----

def roots_above(c: list[int], a: int) -> int:
    """How many roots of the real-rooted polynomial c (lowest first) are above a, repeated ones counted."""
    c = list(c)
    for i in range(len(c) - 1):  # Taylor shift by a
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(c: list[int], want: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """Up to `want` largest positive roots of the monic real-rooted c, repeated ones repeated, falling, as (r, s): r / 2^s.

    Intervals are halved by exact counts until they hold one root, then by the sign there; a repeated root keeps to the counts.
    """
    d = len(c) - 1
    top = max(1, -c[d - 1])  # the trace
    shift = max(0, bits - top.bit_length())
    c = [v << (shift * (d - k)) for k, v in enumerate(c)]
    top = (top << shift) + 1
    known = {0: roots_above(c, 0), top: 0}

    def above(a: int) -> int:
        if a not in known:
            known[a] = roots_above(c, a)
        return known[a]

    def value(x: int) -> int:
        v = 0
        for k in reversed(c):
            v = v * x + k
        return v

    out: list[tuple[int, int]] = []
    for nth in range(1, min(want, known[0]) + 1):
        lo = max(a for a, n in known.items() if n >= nth)
        hi = min(a for a, n in known.items() if n < nth)
        floor_width = lambda: hi - lo <= max(1, hi >> bits)
        while not floor_width() and above(lo) - above(hi) > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if above(mid) >= nth else (lo, mid)
        if above(lo) - above(hi) == 1:
            rising = value(hi) > 0 or (value(hi) == 0 and above(hi) % 2 == 0)
            while not floor_width():
                mid = (lo + hi) // 2
                v = value(mid)
                lo, hi = (lo, mid) if v == 0 or (v > 0) == rising else (mid, hi)
        out.append((hi, shift))
    return out


# ---- components ----

def _solver(m: list[list[Decimal]], root: Decimal):
    """Solves (m - root) x = b by elimination with row pivots; a vanishing pivot counts as tiny."""
    d = len(m)
    lu = [[v - root if i == j else v for j, v in enumerate(row)] for i, row in enumerate(m)]
    tiny = max(max(abs(v) for v in row) for row in m) * Decimal(10) ** (-DIGITS)
    order = list(range(d))
    for j in range(d):
        best = max(range(j, d), key=lambda i: abs(lu[i][j]))
        lu[j], lu[best], order[j], order[best] = lu[best], lu[j], order[best], order[j]
        if abs(lu[j][j]) < tiny:
            lu[j][j] = tiny
        pivot, row = lu[j][j], lu[j]
        for i in range(j + 1, d):
            own = lu[i]
            if own[j]:
                f = own[j] = own[j] / pivot
                for k in range(j + 1, d):
                    own[k] -= f * row[k]

    def solve(b: list[Decimal]) -> list[Decimal]:
        x = [b[i] for i in order]
        for i in range(d):
            x[i] -= sum((lu[i][k] * x[k] for k in range(i)), Decimal(0))
        for i in range(d - 1, -1, -1):
            x[i] = (x[i] - sum((lu[i][k] * x[k] for k in range(i + 1, d)), Decimal(0))) / lu[i][i]
        return x

    return solve


def eigenvectors(m: list[list[int]], roots: list[tuple[int, int]]) -> tuple[list[list[float]], list[Decimal]]:
    """Unit eigenvectors of m for `roots` (falling), the entry of largest size positive, and the roots as decimals."""
    d = len(m)
    with localcontext() as ctx:
        ctx.prec = DIGITS
        wide = [[Decimal(v) for v in row] for row in m]
        dot = lambda a, b: sum((x * y for x, y in zip(a, b)), Decimal(0))
        vectors: list[list[Decimal]] = []
        values = [Decimal(r) / Decimal(1 << s) for r, s in roots]
        solve, solved = None, None

        def orthonormal(x: list[Decimal]) -> list[Decimal]:
            for _ in range(2):
                for v in vectors:
                    f = dot(x, v)
                    x = [a - f * b for a, b in zip(x, v)]
            size = dot(x, x).sqrt()
            return [a / size for a in x]

        for nth, root in enumerate(values):
            if root != solved:
                solve, solved = _solver(wide, root), root
            x = [Decimal((i * i * 7 + i * (nth * 31 + 11) + nth) % 101 + 1) for i in range(d)]
            for _ in range(3):
                x = orthonormal(solve(orthonormal(x)))
            big = max(range(d), key=lambda i: (abs(x[i]).quantize(Decimal("1e-15")), -i))
            vectors.append([-a for a in x] if x[big] < 0 else x)
        return [[float(a) for a in v] for v in vectors], values


class Whitening:
    """The fitted transformation: n, sums, components (unit vectors), variances e, explained shares."""

    def __init__(self, spark: SparkSession, fit: DataFrame, components: int = COMPONENTS):
        self.n, self.sums, m = scatter(fit)
        self.vectors, self.variances, self.explained = [], [], []
        trace = sum(m[i][i] for i in range(len(m)))
        if trace:
            roots = largest_roots(characteristic(spark, m), components)
            self.vectors, values = eigenvectors(m, roots)
            self.variances = [float(r / Decimal(self.n) ** 2) for r in values]
            self.explained = [float(r / Decimal(trace)) for r in values]

    def axes(self) -> np.ndarray:
        """d x components: component over sqrt(e)."""
        return np.array(self.vectors).T / np.sqrt(self.variances)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S in whole numbers."""
        top = (int(np.abs(x).max()) if x.size and x.min() > -(1 << 63) else 1 << 63) * self.n + max(map(abs, self.sums))
        if top < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.axes()


def _deviation(centred: np.ndarray) -> list[int | None]:
    """Sums of squares; null beyond 64 bits."""
    top = int(np.abs(centred).max()) if centred.size else 0
    if centred.dtype != object and centred.shape[1] * top * top < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    return [s if (s := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in centred]


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                w = model.whitened(model.centred(x))
                g = w.T @ w
                i, j = np.indices(g.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(g.reshape(-1))], names=["i", "j", "s"])

    sums = fit.select("x").mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max(abs(r.s / model.n - (r.i == r.j)) for r in sums)  # whitened values are centred


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each whole row and component."""
    spark = table.sparkSession
    prepare(spark)
    rows = grid_vectors(table)
    fit = stored(rows.select("x").distinct(), "fit")
    model = Whitening(spark, fit, components)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not model.vectors:
        return spark.createDataFrame([], schema)
    error = identity_error(fit, model)
    k = len(model.vectors)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.num_rows
            if not b:
                continue
            centred = model.centred(_matrix(batch.column(1)))
            again = np.repeat(np.arange(b), k)
            cols = [batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b)), pa.array(np.full(b * k, model.n, np.int64)),
                    pa.array(_deviation(centred), pa.int64()).take(pa.array(again)), pa.array(model.whitened(centred).reshape(-1)),
                    pa.array(np.tile(np.array(model.explained), b)), pa.array(np.full(b * k, error))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def op12_whitening(table: DataFrame) -> DataFrame:
    """The query's columns."""
    return whiten(table)
