"""Embedding whitening on the leading principal components, from an exactly centred covariance.

Entries become whole numbers x = floor(SCALE * c) + SHIFT. Sums S over the n
distinct vectors are exact, so n * x - S, n times the distance from the mean,
is a whole number and centring loses nothing, however far from zero the mean
is. Tasks multiply centred rows and send one matrix per task and slice; Spark
adds the matrices. The d x d covariance then meets the eigensolver:
Householder reflections make it tridiagonal, Sturm counts bisect for the
leading eigenvalues, inverse iteration finds their vectors, those of a cluster
of near-equal eigenvalues being made orthogonal to each other. The components,
d x 16 numbers, go to all tasks, which project the rows.

Defined results: null vectors and those with null or non-finite entries are
left out; repeated vectors count once in the fit and each row is projected;
shorter vectors are taken to end in zeros, to the length of the longest, before
scaling; components whose eigenvalue is under NOUGHT of the trace (constant
vectors, fewer distinct vectors than components) have no direction and are left
out, so a single distinct vector gives no rows; components of equal eigenvalues
are any orthonormal choice, the same for all rows; a deviation beyond a long is
null; rows without an id are projected like any other; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldline.llm.batches import map_batches
from fieldline.llm.vectors import LONG, matrix, whole_vectors
from fieldline.session import discard, materialise

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
NOUGHT = 1e-12
# Eigenvalues closer than this share of the norm form a cluster.
CLOSE = 1e-3
SLICE_ROWS = 1 << 14


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors (unit, or zero for no reflection) of a symmetric matrix."""
    a, n, vectors = np.array(a, dtype=float), len(a), []
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        size = np.linalg.norm(u)
        u[0] += math.copysign(size, u[0])
        length = np.linalg.norm(u)
        u = u / length if length else u
        vectors.append(u)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ u
        w = 2 * (p - (u @ p) * u)
        a[k + 1 :, k + 1 :] = rest - np.outer(u, w) - np.outer(w, u)
        a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy(), vectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: the negative pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    counts, pivot = np.zeros(len(at), dtype=int), np.ones(len(at))
    for k, d in enumerate(diagonal):
        pivot = d - at - (off[k - 1] ** 2 / pivot if k else 0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        counts += pivot < 0
    return counts


def bisected(diagonal: np.ndarray, off: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` largest eigenvalues, falling, halved down to neighbouring doubles."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    margin = np.finfo(float).eps * (np.abs(diagonal) + reach).max() * n
    wanted = n - 1 - np.arange(many)  # so many lie below
    low, high = np.full(many, (diagonal - reach).min() - margin), np.full(many, (diagonal + reach).max() + margin)
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        above = sturm_counts(diagonal, off, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """x of (T - shift) x = right, by elimination with row exchanges; pivots of nought count as ``tiny``."""
    n = len(diagonal)
    d, u, w = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    x, low = right.copy(), off
    for k in range(n - 1):
        if abs(low[k]) > abs(d[k]):
            f = d[k] / low[k]
            d[k], u[k], w[k], d[k + 1], u[k + 1] = low[k], d[k + 1], u[k + 1], u[k] - f * d[k + 1], -f * u[k + 1]
            x[k], x[k + 1] = x[k + 1], x[k] - f * x[k + 1]
        else:
            d[k] = d[k] or tiny
            f = low[k] / d[k]
            d[k + 1] -= f * u[k]
            x[k + 1] -= f * x[k]
    for k in range(n - 1, -1, -1):
        ahead = (u[k] * x[k + 1] if k + 1 < n else 0) + (w[k] * x[k + 2] if k + 2 < n else 0)
        x[k] = (x[k] - ahead) / (d[k] if abs(d[k]) > tiny else tiny)
    return x


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors (columns) of falling eigenvalues by inverse iteration, orthogonal within clusters."""
    n = len(diagonal)
    norm = float((np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off))).max()) or 1.0
    tiny, draw = np.finfo(float).eps * norm, np.random.default_rng(11)
    out, cluster = np.zeros((n, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * norm:
            cluster = j
        # Equal eigenvalues get shifts a few roundings apart, so that their systems differ.
        shift = value - tiny * (j - cluster)
        v = draw.standard_normal(n)
        for _ in range(6):
            v = _solved(diagonal, off, shift, v / np.linalg.norm(v), tiny)
            for _ in range(2):
                v -= out[:, cluster:j] @ (out[:, cluster:j].T @ v)
        out[:, j] = v / np.linalg.norm(v)
    return out


def leading(a: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``many`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    n, many = len(a), min(many, len(a))
    if not many:
        return np.zeros(0), np.zeros((n, 0))
    size = float(np.abs(a).max()) or 1.0
    diagonal, off, reflections = tridiagonal(a / size)
    values = bisected(diagonal, off, many)
    vectors = eigenvectors(diagonal, off, values)
    for k, u in reversed(list(enumerate(reflections))):
        vectors[k + 1 :] -= 2 * np.outer(u, u @ vectors[k + 1 :])
    return values * size, vectors


_CELL = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("value", T.DoubleType())])


def _summed(rows: DataFrame, columns: int, products) -> np.ndarray:
    """The sum over all rows of the matrix that ``products`` makes of a slice of x vectors; d x d numbers reach the driver."""

    def run(batches):
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = products(matrix(batch.column(0).slice(start, SLICE_ROWS), columns))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1))], names=_CELL.names)

    cells = map_batches(rows.select("x"), run, _CELL).groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((max((c.i for c in cells), default=-1) + 1, max((c.j for c in cells), default=-1) + 1))
    for c in cells:
        out[c.i, c.j] = c.value
    return out


class Whitening:
    """A fitted map: whole-number vectors to whitened components."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.base = np.array([s // n for s in sums] if n else [], dtype=np.int64)
        self.rest = np.array([float(Fraction(s % n, n)) for s in sums] if n else [], dtype=float)
        self.map = vectors / np.sqrt(values) if len(values) else vectors

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole part first, so that nothing of a large mean is rounded."""
        return (x - self.base).astype(float) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.map

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2, exact; None beyond a long."""
        away, rest = x - self.base, np.array([s % self.n for s in self.sums], dtype=object)
        reach = self.n * (max(-int(away.min(initial=0)), int(away.max(initial=0))) + 1)
        if reach * reach * max(1, len(rest)) <= LONG:
            return ((self.n * away - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * away.astype(object) - rest) ** 2).sum(axis=1)
        return [int(v) if v <= LONG else None for v in exact]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on a stored table of distinct x vectors."""
    totals = distinct.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    size = distinct.count()
    found = {r["at"]: int(r["total"]) for r in totals.collect()}
    sums = [found[k] for k in range(len(found))]
    centre = Whitening(size, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)

    def outer(x: np.ndarray) -> np.ndarray:
        z = centre.centred(x)
        return z.T @ z

    if not size or not sums:
        return centre
    covariance = _summed(distinct, len(sums), outer) / size
    trace = float(np.trace(covariance))
    values, vectors = leading(covariance, components)
    firm = values > NOUGHT * trace if trace > 0 else np.zeros(len(values), dtype=bool)
    return Whitening(size, sums, values[firm], vectors[:, firm], trace)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, minus the identity."""
    columns, many = len(model.sums), len(model.values)
    if not many:
        return 0.0
    mean = _summed(distinct, columns, lambda x: model.whitened(x).sum(axis=0, keepdims=True))[0] / model.n

    def outer(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x) - mean
        return w.T @ w

    return float(np.abs(_summed(distinct, columns, outer) / model.n - np.eye(many)).max())


_OUT = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ]
)


def _padded(rows: DataFrame) -> DataFrame:
    """Vectors of equal length: shorter ones end in the whole number that zero becomes."""
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    zeros = F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(longest or 0) - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < F.lit(longest or 0), F.concat("x", zeros)).otherwise(F.col("x")))


def whiten(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per remaining row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    stored = materialise(whole_vectors(rows, vector, vec_id, SCALE, SHIFT), "whitening-vectors")
    equal = _padded(stored)
    distinct = materialise(equal.select("x").distinct(), "whitening-distinct")
    model = fit(distinct, components)
    error = identity_error(distinct, model)
    discard(distinct)
    many, columns = len(model.values), len(model.sums)

    def run(batches):
        for batch in batches:
            if not many or not batch.num_rows:
                continue
            x, count = matrix(batch.column(1), columns), batch.num_rows
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(count), many)))
            deviation = pa.array([d for d in model.deviations(x) for _ in range(many)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * many, model.n, dtype=np.int64)),
                    deviation,
                    pa.array(model.whitened(x).reshape(-1)),
                    pa.array(np.tile(model.values / model.trace, count)),
                    pa.array(np.full(count * many, error)),
                ],
                names=_OUT.names,
            )

    return map_batches(equal, run, _OUT)
