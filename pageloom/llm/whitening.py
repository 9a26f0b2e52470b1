"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

Components c become integers x = floor(256 * c). Over the distinct vectors (the fit list) the sums S and products of x are added
exactly, in limbs that cannot overflow, and give the scatter matrix A = n * sum(x x') - S S', which is n * n times
the covariance. Its characteristic polynomial is found modulo as many 31-bit primes as its coefficients can need, each by a reduction to
Hessenberg form in a task of its own, and put together by Chinese remainders. All its roots are real, so the sign changes of
the exactly shifted polynomial count the roots above a point (Budan and Fourier), and bisection isolates the largest ones to
``BITS`` bits. Components come from inverse iteration with the null space of A - root in ``DIGITS`` decimal digits,
orthogonal to those found before, so repeated roots get a basis. The driver holds matrices of the dimension only.

Rows whose vector is null, empty or holds null or non-finite entries are left out, as are vectors of another length than the
most frequent one (ties: the longer). Entries beyond 64 bits are held at the limits. Repeated vectors count once in the fit and are all
returned. Components of variance 0 are none: one distinct vector, or an empty table, gives no rows. ``deviation`` is null where the
exact value exceeds a long. A null vec_id is a row like any other; other columns are not read.
"""

from __future__ import annotations

import decimal
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import arrow_map, stored, table

SCALE, KEPT, BITS, DIGITS, LIMB = 256, 4, 200, 120, 40


def scaled(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` (array<bigint>) of the usable rows."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    good = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    sizes = good.groupBy(F.size("embedding").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    return good.where(F.size("embedding") == (sizes.s if sizes else 0)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("bigint")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """``n``, the sums and the products of the distinct vectors ``x``, all exact."""

    def run(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            if not x.size:
                continue
            one = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
            most = max(int(x.max()), -int(x.min()), 1)
            if most * most * len(x) < 1 << 52:  # products and sums are exact in doubles
                part = (one.T.astype(np.float64) @ one.astype(np.float64)).astype(np.int64).astype(object)
            else:
                part = one.astype(object).T @ one.astype(object)
            total = part if total is None else total + part
        if total is not None:
            rows: list[tuple[int, int, int, int]] = []
            for i, line in enumerate(total):
                for j, value in enumerate(line[i:], i):
                    limb, value = 0, int(value)
                    while value:
                        rows.append((i, j, limb, (1 if value > 0 else -1) * (abs(value) & ((1 << LIMB) - 1))))
                        value = (1 if value > 0 else -1) * (abs(value) >> LIMB)
                        limb += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=["i", "j", "limb", "v"])

    parts = fit.select("x").mapInArrow(run, "i bigint, j bigint, limb bigint, v bigint").groupBy("i", "j", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    sums: dict[tuple[int, int], int] = {}
    for r in parts.collect():  # at most (dimension + 1) squared entries
        sums[r.i, r.j] = sums.get((r.i, r.j), 0) + (int(r.v) << (LIMB * r.limb))
    size = max((j for _, j in sums), default=0)
    if not sums:
        return 0, [], []
    width = fit.select(F.size("x")).first()[0]
    get = lambda i, j: sums.get((min(i, j), max(i, j)), 0)
    assert size <= width
    return get(0, 0), [get(0, j) for j in range(1, width + 1)], [[get(i, j) for j in range(1, width + 1)] for i in range(1, width + 1)]


def centred(n: int, sums: list[int], products: list[list[int]]) -> list[list[int]]:
    return [[n * v - sums[i] * sums[j] for j, v in enumerate(line)] for i, line in enumerate(products)]


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top``."""
    found, reach, span = [], top, 1 << 16
    small = np.ones(int(math.isqrt(top)) + 1, dtype=bool)
    small[:2] = False
    for i in range(2, math.isqrt(len(small)) + 1):
        if small[i]:
            small[i * i :: i] = False
    factors = np.flatnonzero(small).tolist()
    while len(found) < count:
        lo = reach - span
        flags = np.ones(span, dtype=bool)
        for f in factors:
            flags[-lo % f :: f] = False
        found += [lo + i for i in np.flatnonzero(flags)[::-1].tolist()]
        reach = lo
    return found[:count]


def charpoly_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients, constant first, of det(x - a) modulo the prime ``p`` below 2**31."""
    h, d = a % p, len(a)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        at = k + int(below[0])
        if at != k:
            h[[k, at]] = h[[at, k]]
            h[:, [k, at]] = h[:, [at, k]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k][None, :] % p) % p
        # The inverse step on the columns: column k gains the others' multiples.
        gain = np.zeros(d, dtype=np.int64)
        for j, f in enumerate(u.tolist(), k + 1):
            if f:
                gain = (gain + f * h[:, j]) % p
        h[:, k] = (h[:, k] + gain) % p
    polys = [np.array([1], dtype=np.int64)]
    for m in range(1, d + 1):
        out = np.zeros(m + 1, dtype=np.int64)
        out[1:] = polys[m - 1]
        out[:-1] = (out[:-1] - int(h[m - 1, m - 1]) * polys[m - 1]) % p
        t = 1
        for i in range(1, m):
            t = t * int(h[m - i, m - i - 1]) % p
            if not t:
                break
            c = int(h[m - i - 1, m - 1]) * t % p
            if c:
                out[: m - i] = (out[: m - i] - c * polys[m - i - 1]) % p
        polys.append(out % p)
    return polys[d].tolist()


def characteristic(spark, a: list[list[int]]) -> list[int]:
    """Exact coefficients, constant first, of det(x - a) for a positive semidefinite integer matrix."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    # The k-th symmetric function of roots that are not negative is at most C(d, k) (trace / d)^k.
    bound = max(math.comb(d, k) * trace**k // d**k for k in range(d + 1)) + 1
    primes, product = primes_below(1 << 31, 1 + (2 * bound).bit_length() // 30), 1
    flat = spark.sparkContext.broadcast([[str(v) for v in line] for line in a])
    held: list[list[list[int]]] = []

    def run(batch):
        if not held:
            held.append([[int(v) for v in line] for line in flat.value])
        ps = batch.column(0).to_pylist()
        yield {"p": ps, "c": [charpoly_mod(np.array([[v % p for v in line] for line in held[0]], dtype=np.int64), p) for p in ps]}

    todo = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(min(len(primes), 64), "p")
    found = {r.p: r.c for r in arrow_map(todo, run, "p bigint, c array<bigint>").collect()}
    out = [0] * (d + 1)
    for p in primes:
        back = pow(product, -1, p)
        out = [x + product * ((r - x) * back % p) for x, r in zip(out, found[p])]
        product *= p
    return [x - product if 2 * x > product else x for x in out]


def above(poly: list[int], at: int) -> int:
    """Number of roots (all of them real) greater than ``at``: sign changes of the shifted polynomial."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int, trace: int, bits: int = BITS) -> list[Fraction]:
    """The ``count`` largest positive roots, each to about ``bits`` bits, with multiplicity."""
    d = len(poly) - 1
    total = above(poly, 0)
    out: list[Fraction] = []
    for k in range(1, min(count, total) + 1):
        # First between powers of two, then in units of 2 ** -shift: y = x * 2 ** shift has integer coefficients.
        high = trace + 1
        low = 0
        if above(poly, 1) >= k:
            low = 1
            while above(poly, 2 * low) >= k:
                low *= 2
            high = 2 * low
            shift = max(0, bits - low.bit_length())
        else:
            high, shift = 1, bits
            while above([c << (shift * (d - i)) for i, c in enumerate(poly)], 1 << bits // 2) < k:
                shift += bits
        fine = [c << (shift * (d - i)) for i, c in enumerate(poly)]
        lo, hi = low << shift, high << shift
        while hi - lo > max(1, hi >> bits):
            mid = (lo + hi) // 2
            if above(fine, mid) >= k:
                lo = mid
            else:
                hi = mid
        out.append(Fraction(lo + hi, 2 << shift))
    return out


def null_vectors(a: list[list[int]], roots: list[Fraction], digits: int = DIGITS) -> list[list[decimal.Decimal]]:
    """Unit vectors of the null spaces of ``a`` minus each root, orthogonal to each other."""
    with decimal.localcontext(decimal.Context(prec=digits, Emin=-(10**8), Emax=10**8)):
        d, found = len(a), []
        for root in roots:
            shift = decimal.Decimal(root.numerator) / decimal.Decimal(root.denominator)
            tiny = max(abs(shift), decimal.Decimal(1)) * decimal.Decimal(10) ** (-digits + 10)
            m = [[decimal.Decimal(v) - (shift if i == j else 0) for j, v in enumerate(line)] for i, line in enumerate(a)]
            order, factors = list(range(d)), []
            for k in range(d):
                at = max(range(k, d), key=lambda i: abs(m[i][k]))
                m[k], m[at], order[k], order[at] = m[at], m[k], order[at], order[k]
                if abs(m[k][k]) < tiny:
                    m[k][k] = tiny
                column = []
                for i in range(k + 1, d):
                    f = m[i][k] / m[k][k]
                    column.append(f)
                    if f:
                        row, pivot = m[i], m[k]
                        row[k] = f
                        for j in range(k + 1, d):
                            row[j] -= f * pivot[j]
            v = [decimal.Decimal(1 + (7 * i + 3 * len(found)) % 11) for i in range(d)]
            for _ in range(4):
                b = [v[i] for i in order]
                for i in range(d):
                    b[i] -= sum((m[i][j] * b[j] for j in range(i)), decimal.Decimal(0))
                for i in reversed(range(d)):
                    b[i] = (b[i] - sum((m[i][j] * b[j] for j in range(i + 1, d)), decimal.Decimal(0))) / m[i][i]
                for _ in range(2):
                    big = max(abs(x) for x in b)
                    b = [x / big for x in b]
                    for u in found:
                        dot = sum((x * y for x, y in zip(u, b)), decimal.Decimal(0))
                        b = [x - dot * y for x, y in zip(b, u)]
                size = sum((x * x for x in b), decimal.Decimal(0)).sqrt()
                v = [x / size for x in b]
            sign = 1 if max(v, key=abs) > 0 else -1
            found.append([sign * x for x in v])
        return found


class Fit:
    """What whitening needs: ``n``, sums, the roots, the projections and the shares of the trace."""

    def __init__(self, n: int, sums: list[int], a: list[list[int]], roots: list[Fraction]) -> None:
        self.n, self.sums, self.roots = n, sums, roots
        trace = sum(a[i][i] for i in range(len(a)))
        self.explained = [float(r / trace) for r in roots]
        # whitened = (x - S/n) v / sqrt(root / n^2) = (n x - S) v / sqrt(root)
        with decimal.localcontext(decimal.Context(prec=DIGITS)):
            self.directions = np.array([
                [float(x * n / (decimal.Decimal(r.numerator) / decimal.Decimal(r.denominator)).sqrt()) for x in v]
                for v, r in zip(null_vectors(a, roots), roots)]).reshape(len(roots), len(a))
        self.middle = [Fraction(s, n) for s in sums]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of components; x less the whole part of the mean is exact, the rest is a fraction below one."""
        whole = np.array([m.numerator // m.denominator for m in self.middle], dtype=np.int64)
        rest = np.array([float(m - m.numerator // m.denominator) for m in self.middle])
        return ((x - whole).astype(np.float64) - rest) @ self.directions.T


def fitted(vectors: DataFrame, fit: DataFrame, kept: int = KEPT) -> Fit | None:
    """``fit``: the distinct ``x``. None if there are no components."""
    n, sums, products = scatter(fit)
    if not n:
        return None
    a = centred(n, sums, products)
    trace = sum(a[i][i] for i in range(len(a)))
    roots = largest_roots(characteristic(vectors.sparkSession, a), kept, trace) if trace else []
    return Fit(n, sums, a, roots) if roots else None


def identity_error(fit: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the fit list's whitened covariance minus the identity."""

    def run(batch):
        w = model.whitened(_matrix(batch.column(0)))
        one = np.concatenate([np.ones((len(w), 1)), w], axis=1)
        both = one.T @ one
        i, j = np.triu_indices(len(both))
        yield {"i": i.astype(np.int64), "j": j.astype(np.int64), "v": both[i, j]}

    k = len(model.roots)
    sums = np.zeros((k + 1, k + 1))
    for r in arrow_map(fit.select("x"), run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r.i, r.j] = sums[r.j, r.i] = r.v
    mean = sums[0, 1:] / model.n
    return float(np.abs(sums[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, kept: int = KEPT) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component."""
    rows = scaled(vectors)
    fit = stored(rows.select("x").distinct())
    model = fitted(vectors, fit, kept)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(fit, model), len(model.roots)

    def run(batch):
        x = _matrix(batch.column(1))
        w, most = model.whitened(x), max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
        if (2 * model.n * most) ** 2 * x.shape[1] < 1 << 62:
            far = model.n * x - np.array(model.sums, dtype=np.int64)
            deviation = (far * far).sum(axis=1).tolist()
        else:
            far = model.n * x.astype(object) - np.array(model.sums, dtype=object)
            deviation = [v if v < 1 << 63 else None for v in map(int, (far * far).sum(axis=1))]
        size = len(x)
        yield {"vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(size), k))), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), size),
               "n": np.full(size * k, model.n), "deviation": [v for v in deviation for _ in range(k)], "whitened": w.ravel(),
               "explained": np.tile(model.explained, size), "identity_error": np.full(size * k, error)}

    return arrow_map(rows, run, schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
