"""Whitening of embeddings by spectrum slicing.

Spark plan: the entries become whole numbers; equal vectors are one row of the fit list
(a grouping that Spark combines before the shuffle, so a vector held by a third of the rows
costs one row per task); each task sums the products of its part of the fit list exactly
and Spark adds the partial sums as decimals. The driver gets a dimension x dimension matrix
of whole numbers, whatever the number of rows, and finds the leading eigenpairs: LDLᵀ
inertia counts of the shifted (tridiagonalised) covariance isolate each eigenvalue,
Rayleigh quotient iteration converges on it, and the counts certify its number. Every row
is then projected by Spark expressions on broadcast literals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: x = floor(SCALE * c) + BASE.
SCALE = 64
BASE = 1_000_000
# Entries whose products a task sums in 64 bits; larger ones are summed as Python integers.
SMALL = 1 << 20


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a symmetric matrix similar to `matrix` (Householder reflections)."""
    a = np.array(matrix, float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        v = x
        v[0] += np.copysign(norm, x[0])
        v /= np.linalg.norm(v)
        a[k + 1:, :] -= 2 * np.outer(v, v @ a[k + 1:, :])
        a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.array([a[i + 1, i] for i in range(n - 1)])


def above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed `shift`: the positive pivots of the LDLᵀ factors of T - shift I."""
    tiny = np.finfo(float).tiny
    scale = max(1.0, float(np.abs(diagonal).max(initial=0)), float(np.abs(off).max(initial=0)))
    pivot, positive = 0.0, 0
    for i, value in enumerate(diagonal):
        pivot = value - shift - (off[i - 1] ** 2 / pivot if i else 0.0)
        if pivot == 0:
            pivot = -tiny * scale
        positive += pivot > 0
    return positive


@dataclass(frozen=True)
class Spectrum:
    values: np.ndarray  # falling
    vectors: np.ndarray  # columns, unit length


def leading(matrix: np.ndarray, count: int, tolerance: float = 1e-13) -> Spectrum:
    """The `count` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors.

    Eigenvalue j is isolated by bisection on the inertia count, down to an interval of
    `tolerance` times the matrix's norm (a repeated value stays with its copies), then
    inverse iteration at the interval's middle and Rayleigh quotient iteration converge; a result that leaves the interval is
    replaced by inverse iteration at the interval's middle, so the number is certified.
    Vectors of a repeated value are kept orthogonal to those found before.
    """
    n = len(matrix)
    count = min(count, n)
    if not count:
        return Spectrum(np.zeros(0), np.zeros((n, 0)))
    diagonal, off = tridiagonal(matrix)
    radius = float(np.abs(matrix).sum(axis=1).max()) or 1.0
    width = tolerance * radius
    rng = np.random.default_rng(7)
    values, vectors = [], []
    for j in range(1, count + 1):
        low, high = -radius - 1, radius + 1  # above(low) = n >= j > above(high) = 0
        # Bisection keeps above(low) >= j > above(high); it goes on after the value is isolated
        # (above(low) = j, above(high) = j - 1) until the interval is narrow, so that its
        # middle is nearer to eigenvalue j than to any other.
        while high - low > width:
            middle = (low + high) / 2
            if above(diagonal, off, middle) >= j:
                low = middle
            else:
                high = middle
        shift = (low + high) / 2
        previous = np.array(vectors).T if vectors else np.zeros((n, 0))

        def cleaned(v):
            v = v - previous @ (previous.T @ v)
            return v / np.linalg.norm(v)

        def solve(at, v):
            """(matrix - at I)^-1 v, or None where that is singular: `at` is then an eigenvalue."""
            try:
                return np.linalg.solve(matrix - at * np.eye(n), v)
            except np.linalg.LinAlgError:
                return None

        v = cleaned(rng.standard_normal(n))
        for _ in range(3):  # inverse iteration at the middle: near the eigenvalue's direction
            w = solve(shift, v)
            if w is None:
                break
            v = cleaned(w)
        rho = float(v @ matrix @ v)
        for _ in range(30):  # Rayleigh quotient iteration
            w = solve(rho, v)
            if w is None or not np.all(np.isfinite(w)) or not np.any(w):
                break
            v = cleaned(w)
            new = float(v @ matrix @ v)
            if abs(new - rho) <= tolerance * radius:
                rho = new
                break
            rho = new
        if not low - width <= rho <= high + width:  # left its interval: stay at the certified place
            v = cleaned(rng.standard_normal(n))
            for _ in range(50):
                w = solve(shift, v)
                if w is None:
                    break
                v = cleaned(w)
            rho = float(v @ matrix @ v)
        largest = int(np.argmax(np.abs(v)))
        values.append(rho)
        vectors.append(v if v[largest] > 0 else -v)
    return Spectrum(np.array(values), np.array(vectors).T)


def _moments(dim: int):
    """Per task: rows, sums and products of x - BASE, as (kind, place, value) rows; exact."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_numpy()).reshape(len(frame), dim) - BASE
            rows += len(frame)
            if np.abs(x).max(initial=0) < SMALL:
                for start in range(0, len(x), 1 << 20):
                    part = x[start:start + (1 << 20)].astype(np.int64)
                    sums += part.sum(axis=0).astype(object)
                    products += (part.T @ part).astype(object)
            else:
                part = x.astype(object)
                sums += part.sum(axis=0)
                products += part.T @ part
        if rows:
            places = [("n", 0, rows)] + [("s", i, int(v)) for i, v in enumerate(sums)]
            places += [("m", i, int(v)) for i, v in enumerate(products.ravel())]
            yield pd.DataFrame({"kind": [p[0] for p in places], "place": [p[1] for p in places],
                                "value": [str(p[2]) for p in places]})
    return run


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def whiten(frame: DataFrame, components: int = 16, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """Per remaining row and component up to `components`: vec_id, component, n, deviation,
    whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry are dropped; every other
    entry c becomes x = floor(64 c) + 1,000,000 (as a long; entries beyond 2^62/64 fail the
    cast). The fit list is each distinct x vector once (n of them, sums S per dimension);
    covariances are over it, divisor n, centred first. All vectors must have one length:
    rows of another length than the most frequent one (the smaller on ties) are dropped
    too. Components are unit eigenvectors of the covariance, numbered from 1 by falling
    eigenvalue e, the sign making the largest entry positive. `deviation` is the exact sum
    over dimensions of (n x - S)^2 (NULL if it exceeds a long); `whitened` is (x - S/n)
    projected on the component over sqrt(e) (NULL where e is not above 1e-12 of the
    trace); `explained` is e over the trace (NULL for a zero trace); `identity_error` is the
    largest entry of |covariance of whitened - I| over the components with e above that
    bound, from the exact moments. Repeated rows and ids each get their rows. An empty
    table gives no rows; other columns are not carried.
    """
    spark = frame.sparkSession
    rows = frame.select(F.col(id_column).alias("vid"), F.col(vector_column).cast("array<double>").alias("c"))
    rows = rows.filter(finite(F.col("c"))).select(
        "vid", F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + BASE).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None or not lengths["dim"]:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    dim = int(lengths["dim"])
    rows = rows.filter(F.size("x") == dim)
    fit = rows.groupBy("x").agg(F.lit(1).alias("one")).select("x")
    parts = fit.mapInPandas(_moments(dim), "kind string, place int, value string")
    totals = parts.groupBy("kind", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    moment = {(r["kind"], r["place"]): int(r["value"]) for r in totals}
    n = moment[("n", 0)]
    sums = [moment[("s", i)] for i in range(dim)]
    # n^2 V = n M - S S^T, exact integers (the shift by BASE does not change V).
    scaled = [[n * moment[("m", i * dim + j)] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    covariance = np.array([[float(Fraction(v, n * n)) for v in row] for row in scaled])
    trace = float(Fraction(sum(scaled[i][i] for i in range(dim)), n * n))
    spectrum = leading(covariance, components)
    kept = spectrum.values > 1e-12 * trace if trace > 0 else np.zeros(len(spectrum.values), bool)
    u = spectrum.vectors[:, kept] / np.sqrt(spectrum.values[kept])
    error = float(np.abs(u.T @ covariance @ u - np.eye(int(kept.sum()))).max(initial=0.0))

    # sums are of x - BASE, so n (x - BASE) - sum is n x - S.
    centred = F.zip_with("x", F.array(*[F.lit(s) for s in sums]),
                         lambda x, s: (x - BASE).cast("decimal(38,0)") * n - s)
    deviation = F.aggregate(centred, F.lit(0).cast("decimal(38,0)"), lambda acc, d: acc + d * d)
    table = [(j + 1, [float(c) for c in spectrum.vectors[:, j]], float(spectrum.values[j]), bool(kept[j]))
             for j in range(len(spectrum.values))]
    chosen = F.array(*[F.struct(F.lit(j).alias("component"), F.array(*map(F.lit, vec)).alias("u"),
                                F.lit(e).alias("e"), F.lit(ok).alias("ok")) for j, vec, e, ok in table])
    projected = F.aggregate(F.zip_with("mean_free", "part.u", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    out = rows.select("vid", F.transform(centred, lambda d: d.cast("double") / n).alias("mean_free"),
                      deviation.alias("deviation"), F.explode(chosen).alias("part"))
    return out.select(
        F.col("vid").alias(id_column), F.col("part.component").cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
        F.when(F.col("part.ok"), projected / F.sqrt("part.e")).alias("whitened"),
        (F.col("part.e") / F.lit(trace) if trace > 0 else F.lit(None).cast("double")).alias("explained"),
        F.lit(error).alias("identity_error"))
