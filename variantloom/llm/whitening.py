"""Embedding whitening by FEAST: contour integration over the covariance, Rayleigh-Ritz, inertia counts.

Spark does the passes over rows: the fit list (each distinct whole-number vector once), its sums, its
centred covariance, the whitened rows and the covariance of these. What is solved in one place is the
covariance itself, dimensions x dimensions, whose size is that of the schema and not of the table.

The eigenvalues wanted lie in an interval [low, high]. The spectral projector of that interval is the contour
integral of (zI - V)^-1 around it; Gauss-Legendre nodes on the upper half circle give it as a sum of complex
shifted solves. It is applied to a block of vectors, Rayleigh-Ritz takes eigenpairs from the block,
and both are repeated until the residuals are at rounding level. The inertia of V - low*I says how many eigenvalues
must have come out; fewer are an error, never a shorter answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.llm.common import read_table
from variantloom.session import materialize

SCALE = 256
COMPONENTS = 4
NODES = 16  # quadrature nodes on the half circle
SPARE = 4  # vectors of the block beyond the eigenvalues that the interval holds
SWEEPS = 60
ROWS = 4096  # rows of one matrix product
LONG = 2.0**63


# --- the eigenvalue problem


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of ``v``, by Householder steps."""
    a = v.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += norm if x[0] >= 0 else -norm
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, :]
        rest -= 2 * np.outer(x, x @ rest)
        rest = a[:, k + 1 :]
        rest -= 2 * np.outer(rest @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues lie above ``shift``: the positive pivots of the shifted matrix (Sylvester's inertia)."""
    diagonal, beside = form
    tiny = np.finfo(float).eps * (np.abs(diagonal).max() + np.abs(beside).max(initial=0.0)) or np.finfo(float).tiny
    above, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - shift - (beside[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        above += pivot > 0
    return above


def interval_of(form: tuple[np.ndarray, np.ndarray], wanted: int, top: float) -> tuple[float, float, int]:
    """An interval that holds the largest eigenvalues, ``wanted`` or more of them, and how many they are.

    Bisection on inertia counts brackets the largest and some from the ``wanted``-th on. The lower end lies in
    the widest gap at hand; where neighbours are equal it goes below all of them.
    """
    size = len(form[0])

    def bracket(k: int) -> tuple[float, float]:
        """Around the k-th largest eigenvalue."""
        low, high = -top * 1e-3, top
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if count_above(form, mid) >= k else (low, mid)
            if high - low < 1e-12 * top:
                break
        return low, high

    largest = bracket(1)[1]
    best, at = None, bracket(wanted)
    for k in range(wanted, size):
        after = bracket(k + 1)
        gap = at[0] - after[1]
        if best is None or gap > best[0]:
            best = (gap, (at[0] + after[1]) / 2, k)
        if k >= wanted + SPARE and best[0] > 1e-9 * top:
            break
        at = after
    low, inside = (-top * 1e-3, size) if best is None or best[0] <= 1e-9 * top else best[1:]
    return low, largest + 0.05 * (largest - low), inside


def feast(v: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``inside`` eigenpairs of the symmetric ``v`` between ``low`` and ``high``, by falling eigenvalue."""
    size = len(v)
    block = min(size, inside + max(SPARE, inside // 2))
    t, weights = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi * (1 - t) / 2
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(1j * angle)
    shifted = [np.linalg.inv((centre + radius * z) * np.eye(size) - v) for z in turn]
    parts = [0.5 * w * radius * z for w, z in zip(weights, turn, strict=True)]
    projector = sum((p * s).real for p, s in zip(parts, shifted, strict=True))
    y = np.random.default_rng(7).standard_normal((size, block))
    scale = max(abs(low), abs(high))
    last = np.inf
    for _ in range(SWEEPS):
        q, _ = np.linalg.qr(projector @ y)
        q, _ = np.linalg.qr(projector @ q)
        ritz, inner = np.linalg.eigh(q.T @ v @ q)
        y = q @ inner[:, ::-1]
        ritz = ritz[::-1]
        found = (ritz > low) & (ritz < high)
        wrong = np.linalg.norm(v @ y - y * ritz, axis=0)[found].max(initial=0.0) / scale
        if found.sum() == inside and (wrong < 1e-14 or (wrong < 1e-11 and wrong > last / 2)):
            return ritz[found], y[:, found]
        last = wrong
    raise ArithmeticError(f"{inside} eigenvalues lie above {low}, {int(found.sum())} were found, residual {wrong:.1e}")


def top_components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance and their unit vectors as columns."""
    wanted = min(wanted, len(v))
    trace = float(np.trace(v))
    if not wanted or trace <= 0:
        return np.zeros(wanted), np.eye(len(v))[:, :wanted]
    v = (v + v.T) / (2 * trace)  # all eigenvalues in [0, 1]
    form = tridiagonal(v)
    low, high, inside = interval_of(form, wanted, 1.0 + 1e-3)
    if count_above(form, low) - count_above(form, high) != inside:
        raise ArithmeticError("inertia counts disagree")
    values, vectors = feast(v, low, high, inside)
    return values[:wanted] * trace, vectors[:, :wanted]


# --- passes over rows


@dataclass(frozen=True)
class Whitening:
    """What was fitted: size and sums of the fit list, eigenvalues and unit vectors, trace of the covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the whole part is taken off in whole numbers, so large offsets cost no digits."""
        whole, rest = np.divmod(self.sums, self.n)
        return (x - whole).astype(float) - rest / self.n

    def usable(self) -> np.ndarray:
        """Components with a variance above rounding."""
        return self.values > len(self.sums) * np.finfo(float).eps * self.trace

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN in a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.usable(), self.centred(x) @ self.vectors / np.sqrt(self.values), np.nan)


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE * entry) as longs."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("bigint"))


def usable_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, x`` of the rows whose vector is not null and has no null, NaN or infinite entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~bad).select(F.col(key), whole_numbers(F.col(vector)).alias("x"))


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def summed(df: DataFrame, rows_of, width: int) -> np.ndarray:
    """The sum over all tasks of the (lines, width) matrices that ``rows_of(batches)`` returns.

    Each task sends its matrix line by line, and lines with one number are added up by Spark, so the driver gets
    one matrix however many tasks there are.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = rows_of(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["line", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, cells in zip(batch.column("line").to_pylist(), _matrix(batch, "cells"), strict=True):
                totals[line] = totals[line] + cells if line in totals else cells.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.list_(pa.float64()))], ["line", "cells"])

    schema = "line int, cells array<double>"
    rows = df.mapInArrow(lines, schema).repartition("line").mapInArrow(add, schema).collect()
    out = np.zeros((len(rows), width))
    for r in rows:
        out[r["line"]] = r["cells"]
    return out


def fit(fit_list: DataFrame, dimensions: int, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the stored ``fit_list`` (column x, distinct rows of ``dimensions`` longs); None without rows."""
    sums = fit_list.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("s"), F.count("c").alias("n")).collect()
    if not sums:
        return None
    s = np.zeros(dimensions, np.int64)
    for r in sums:
        s[r["at"]] = r["s"]
    base = Whitening(sums[0]["n"], s, np.zeros(0), np.zeros((dimensions, 0)), 0.0)

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for piece in _pieces(batches):
            d = base.centred(_matrix(piece))
            total = d.T @ d if total is None else total + d.T @ d
        return total

    covariance = summed(fit_list, products, dimensions) / base.n
    values, vectors = top_components(covariance, components)
    return Whitening(base.n, s, values, vectors, float(np.trace(covariance)))


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, over usable components."""
    used = np.flatnonzero(model.usable())
    k = len(used)

    def moments(products: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for piece in _pieces(batches):
                w = model.apply(_matrix(piece))[:, used]
                own = w.sum(axis=0)[None, :] if products is None else (w - products).T @ (w - products)
                total = own if total is None else total + own
            return total

        return run

    if not k:
        return 0.0
    mean = summed(fit_list, moments(None), k)[0] / model.n
    return float(np.abs(summed(fit_list, moments(mean), k) / model.n - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    Rows whose vector is null, or holds a null, NaN or infinite entry, are left out, and so are vectors of another length
    than most have (the longer one of equally common lengths). There are ``components`` components, or as many as there are
    dimensions; one without variance has a null ``whitened`` and counts in no identity_error. A
    deviation beyond a long is null. Keys may be null or repeated; their rows all stay. Copies of a vector
    count once in the fit, and are merged within each task before they move. Other columns are left out, whatever
    their names. An empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = usable_rows(df, key, vector).withColumnRenamed(key, "key")
    lengths = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not lengths:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths[0]["length"])
    fit_list = materialize(rows.select("x").distinct(), "fit-list")
    model = fit(fit_list, lengths[0]["length"], components)
    error = identity_error(fit_list, model)
    k, (whole, rest) = len(model.values), np.divmod(model.sums, model.n)
    explained = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            x = _matrix(piece)
            own = model.n * (x - whole) - rest  # n * x - sums
            fits = (own.astype(float) ** 2).sum(axis=1) < LONG * (1 - 1e-9)
            deviation = pa.array((own * own).sum(axis=1), mask=~fits)
            white = model.apply(x).reshape(-1)
            order = pa.array(np.repeat(np.arange(piece.num_rows), k))
            columns = [
                piece.column("key").take(order),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), piece.num_rows)),
                pa.array(np.full(len(order), model.n, np.int64)),
                deviation.take(order),
                pa.array(white, mask=np.isnan(white)),
                pa.array(np.tile(explained, piece.num_rows)),
                pa.array(np.full(len(order), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op11_feast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEAST whitening of the whole embeddings table; nulls, ties, repeats and empty tables as in ``whiten``."""
    return whiten(read_table(spark, sf_dir, "embeddings"))
