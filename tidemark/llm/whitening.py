"""Whitening of embeddings on their leading principal components.

The covariance is summed up by Spark from integer, centred entries, so that its
sums are exact and independent of their order.  Its leading eigenvalues come from
spectrum slicing: the signs of the pivots of an LDL' factorisation of the shifted
matrix count the eigenvalues above the shift, bisection isolates each one,
Rayleigh quotient iteration converges to it cubically, and two more counts around
the result certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import fresh, written

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Entries of this size or more count as not finite: their integers would overflow.
LARGEST = float(1 << 31)
#: Components with a smaller share of the trace are rounding errors of the covariance.
LEAST_SHARE = 1e-11
EPSILON = float(np.finfo(float).eps)
LONG_LIMIT = 9.2e18


# --- eigenvalues of a symmetric matrix -------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of an orthogonally similar matrix, which has the same inertia at each shift."""
    a = matrix.astype(float).copy()
    d = len(a)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0 or size == abs(v[0]):
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = -np.copysign(size, a[k + 1, k])
    return np.diag(a).copy(), np.diag(a, -1) ** 2


class Slices:
    """Counts of eigenvalues above a shift, and the brackets that they prove."""

    def __init__(self, matrix: np.ndarray):
        self.diagonal, self.squares = tridiagonal(matrix)
        self.size = len(matrix)
        self.norm = float(np.abs(matrix).sum(axis=1).max())
        self.tolerance = 4 * self.size * EPSILON * self.norm
        # no eigenvalue is beyond the largest row sum
        self.known = [(-2 * self.norm, self.size), (2 * self.norm, 0)]

    def above(self, shift: float) -> int:
        """Positive pivots of the LDL' factorisation of the shifted matrix."""
        tiny = max(EPSILON * EPSILON * self.norm, 1e-300)
        pivot, positive = float(self.diagonal[0]) - shift, 0
        for i in range(self.size):
            if i:
                pivot = float(self.diagonal[i]) - shift - float(self.squares[i - 1]) / pivot
            if abs(pivot) < tiny:
                pivot = -tiny
            positive += pivot > 0
        self.known.append((shift, positive))
        return positive

    def bracket(self, number: int) -> tuple[float, float, int, int]:
        """Shifts around eigenvalue ``number`` (from 1, falling), and the counts above them."""
        low = max((s, c) for s, c in self.known if c >= number)
        high = min((s, c) for s, c in self.known if c < number)
        return low[0], high[0], low[1], high[1]

    def isolate(self, number: int, width: float = np.inf) -> tuple[float, float, bool]:
        """A bracket of at most ``width`` with this eigenvalue alone, or one as narrow as rounding allows with several."""
        while True:
            low, high, at_low, at_high = self.bracket(number)
            alone = at_low == number and at_high == number - 1
            if (alone and high - low <= width) or high - low <= self.tolerance:
                return low, high, alone
            self.above((low + high) / 2)


def _without(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in found:
            x = x - (other @ x) * other
    return x / np.linalg.norm(x)


def _solved(matrix: np.ndarray, shift: float, x: np.ndarray, step: float) -> np.ndarray:
    while True:
        try:
            found = np.linalg.solve(matrix - shift * np.eye(len(matrix)), x)
            if np.isfinite(found).all():
                return found
        except np.linalg.LinAlgError:
            pass
        shift += step  # an eigenvalue was met exactly


def _iterated(matrix: np.ndarray, slices: Slices, number: int, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """Eigenvalue ``number`` and its vector by Rayleigh quotient iteration from an isolating bracket.

    Where several eigenvalues are one within rounding, no bracket isolates them:
    inverse iteration then completes an orthonormal basis of their space.
    """
    width, step = np.inf, max(slices.tolerance / 8, 1e-300)
    start = np.random.default_rng(number).standard_normal(slices.size)
    while True:
        low, high, alone = slices.isolate(number, width)
        x, shift = _without(start, found), (low + high) / 2
        for _ in range(3):
            x = _without(_solved(matrix, shift, x, step), found)
        for _ in range(12 if alone else 0):
            value = float(x @ matrix @ x)
            if not low <= value <= high:
                break
            if np.linalg.norm(matrix @ x - value * x) <= slices.tolerance / 4:
                break
            x = _without(_solved(matrix, value, x, step), found)
        value = float(x @ matrix @ x)
        near = np.linalg.norm(matrix @ x - value * x) <= slices.tolerance
        if near and low - slices.tolerance <= value <= high + slices.tolerance:
            return value, x
        if high - low <= slices.tolerance:
            raise ArithmeticError(f"eigenvalue {number} did not converge")
        width = (high - low) / 8


def leading_eigenpairs(matrix: np.ndarray, most: int, least_share: float = LEAST_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` eigenvalues from the largest, and their unit vectors in columns.

    Those with less than ``least_share`` of the trace are left out.  Every number
    is certified by the counts just above and just below its eigenvalue.
    """
    values, vectors = [], []
    trace = float(np.trace(matrix)) if len(matrix) else 0.0
    if trace > 0:
        slices = Slices(matrix)
        for number in range(1, min(most, len(matrix)) + 1):
            value, vector = _iterated(matrix, slices, number, vectors)
            if value < least_share * trace:
                break
            margin = 2 * slices.tolerance
            if slices.above(value - margin) < number or slices.above(value + margin) >= number:
                raise ArithmeticError(f"counts do not certify eigenvalue {number}")
            values.append(value)
            vectors.append(vector)
    order = np.argsort([-v for v in values], kind="stable")  # equal ones may differ in the last bit
    columns = np.array(vectors).reshape(len(vectors), len(matrix)).T
    return np.array(values)[order] if values else np.zeros(0), columns[:, order]


# --- the covariance by Spark -------------------------------------------------------


def usable(vector: Column) -> Column:
    """Whether a vector has entries, and none that is null, not finite or ``LARGEST``."""
    entries = vector.cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return F.coalesce(fine & (F.size(entries) > 0), F.lit(False))


def integers(column: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, matrix of integer entries)`` of the vectors of each length, or of one."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths) if length is None else [length]:
        rows = np.flatnonzero(lengths == n)
        if len(rows):
            entries = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float)
            yield rows, np.floor(SCALE * entries.reshape(len(rows), int(n))).astype(np.int64) + OFFSET


def fitted_sums(vectors: DataFrame, vector: str) -> tuple[int, np.ndarray]:
    """Number of vectors of the commonest length (of equally common ones the greatest), and their sums by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for rows, x in integers(batch.column(0)):
                seen = totals.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
                seen[0] += len(rows)
                seen[1] += x.sum(axis=0)
        for length, (n, sums) in totals.items():
            place = np.arange(length)
            columns = [np.full(length, length), place, np.full(length, n), sums]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["length", "i", "n", "total"])

    parts = vectors.select(vector).mapInArrow(add, "length bigint, i bigint, n bigint, total bigint")
    sums = written(parts.groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "vector-sums")
    top = sums.where("i = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if top is None:
        return 0, np.zeros(0, np.int64)
    chosen = sums.where(F.col("length") == top["length"]).orderBy("i").toPandas()
    return int(top["n"]), chosen["total"].to_numpy()


def covariance(vectors: DataFrame, vector: str, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance with divisor ``n`` of the integer entries.

    Entries are centred on the whole number next to their mean before they are
    multiplied; products of whole numbers add up without rounding below 2 ** 53.
    What is left of the mean, half a unit at most, is taken off at the end.
    """
    d = len(sums)
    centre = np.rint(sums / n).astype(np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for _, x in integers(batch.column(0), d):
                y = (x - centre).astype(float)
                total += y.T @ y
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "total"])

    parts = vectors.select(vector).mapInArrow(multiply, "i bigint, j bigint, total double")
    summed = parts.groupBy("i", "j").agg(F.sum("total").alias("total")).toPandas()
    gram = np.zeros((d, d))
    gram[summed["i"], summed["j"]] = gram[summed["j"], summed["i"]] = summed["total"]
    rest = (sums - n * centre) / n
    return gram / n - np.outer(rest, rest)


@dataclass(frozen=True)
class Whitening:
    """What is fitted: rows, sums, and leading eigenvalues with their vectors in columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(v) / self.trace for v in self.values]


def fit_whitening(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Fitted on all usable vectors of the commonest length.

    The driver gets the covariance, whose size is the square of the dimension.
    """
    fit = vectors.where(usable(F.col(vector)))
    n, sums = fitted_sums(fit, vector)
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    matrix = covariance(fit, vector, n, sums)
    values, columns = leading_eigenpairs(matrix, components)
    return Whitening(n, sums, values, columns, float(np.trace(matrix)))


def with_whitened(df: DataFrame, fitted: Whitening, vector: str = "embedding") -> DataFrame:
    """Usable rows of the fitted length with ``deviation`` and ``whitened``, an entry for each component.

    ``deviation`` is the exact sum of squares of ``n * x - sums``, null beyond a
    long.  Columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(fitted)

    @F.arrow_udf("deviation bigint, whitened array<double>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fit = shared.value
        d, k = fit.vectors.shape
        centre = np.rint(fit.sums / fit.n).astype(np.int64)
        rest = (fit.sums - fit.n * centre) / fit.n
        scaled = fit.vectors / np.sqrt(fit.values)
        for batch in batches:
            deviation = np.zeros(len(batch), np.int64)
            beyond = np.zeros(len(batch), bool)
            white = np.zeros((len(batch), k))
            for rows, x in integers(batch, d):
                off = fit.n * x - fit.sums
                deviation[rows] = (off * off).sum(axis=1)
                beyond[rows] = (off.astype(float) ** 2).sum(axis=1) > LONG_LIMIT
                white[rows] = ((x - centre) - rest) @ scaled
            ends = pa.array(np.arange(len(batch) + 1) * k, pa.int32())
            yield pa.StructArray.from_arrays(
                [pa.array(deviation, mask=beyond), pa.ListArray.from_arrays(ends, pa.array(white.ravel()))],
                ["deviation", "whitened"],
            )

    rows = df.drop(*[c for c in ("deviation", "whitened") if c != vector])
    (result,) = fresh(rows, "projected")
    fits = usable(F.col(vector)) & (F.size(vector) == len(fitted.sums))
    kept = [c for c in rows.columns if c not in ("deviation", "whitened")]
    projected = rows.where(fits).withColumn(result, project(F.col(vector)))
    return projected.select(
        *kept, F.col(result)["deviation"].alias("deviation"), F.col(result)["whitened"].alias("whitened")
    )


def identity_error(whitened: DataFrame, components: int, n: int) -> float:
    """Largest absolute entry of the covariance of column ``whitened`` minus the identity."""
    if not components:
        return 0.0
    entry = [F.col("whitened")[i] for i in range(components)]
    means = whitened.agg(*[F.avg(e) for e in entry]).first()
    centred = [e - m for e, m in zip(entry, means)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    sums = whitened.agg(*[F.sum(centred[i] * centred[j]) for i, j in pairs]).first()
    return max(abs(total / n - (i == j)) for (i, j), total in zip(pairs, sums))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Each usable vector's whitened components; none where the vectors do not vary.

    Vectors of another than the commonest length are left out like those with
    null or non-finite entries; repeated rows count as often as they stand.
    """
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    fitted = fit_whitening(table)
    rows = written(with_whitened(table, fitted).drop("embedding"), "whitened")
    error = identity_error(rows, len(fitted.values), fitted.n)
    explained = F.array(*[F.lit(v) for v in fitted.explained]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
