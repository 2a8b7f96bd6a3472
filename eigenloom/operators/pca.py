"""Principal components of a matrix kept by variant: exact, randomised, windowed and Lanczos.

Every method reads the rows in distributed passes that return sums (`sum_arrays`), and does small dense
algebra on the driver. Loadings stay distributed. Column `x` of the input holds the values to decompose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenloom.operators.matrix import batch_of, column_of, gathered, map_rows, rows_of, sum_arrays, turned

#: The smaller dimension up to which the exact method is chosen by "auto".
EXACT_UP_TO = 10_000


@dataclass
class PCAModel:
    """U (N by k), singular values, and loadings (variant_idx, v array<double>) of a decomposition.

    `scale` tells the domain of the decomposed values: "standardized", "centred" (dosage 0..1) or "raw".
    """

    spark: SparkSession
    u: np.ndarray
    s: np.ndarray
    packed_loadings: DataFrame
    n_samples: int
    n_variants: int
    scale: str
    history: list[float] = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.s)

    @property
    def eigenvalues(self) -> np.ndarray:
        return self.s**2 / self.n_variants

    def scores(self) -> DataFrame:
        n, k = self.u.shape
        return self.spark.createDataFrame(pa.table({"sample_idx": np.repeat(np.arange(n, dtype=np.int32), k), "pc": np.tile(np.arange(1, k + 1, dtype=np.int32), n), "u": self.u.ravel()}))

    def loadings(self) -> DataFrame:
        return self.packed_loadings.select("variant_idx", F.posexplode("v").alias("pc", "v")).select("variant_idx", (F.col("pc") + 1).cast("int").alias("pc"), "v")

    def spectrum(self) -> DataFrame:
        return self.spark.createDataFrame([(i + 1, float(s), float(s * s / self.n_variants)) for i, s in enumerate(self.s)], "pc int, sigval double, eigval double")


def flip_signs(u: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Make the entry of largest magnitude of each column of `u` positive; the others' columns follow."""
    sign = np.sign(u[np.argmax(np.abs(u), axis=0), np.arange(u.shape[1])])
    sign[sign == 0] = 1
    return [m * sign for m in (u, *others)]


def align_signs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Columns of y with the signs that agree with x."""
    sign = np.sign((x * y).sum(axis=0))
    sign[sign == 0] = 1
    return y * sign


def rmse(x: np.ndarray, y: np.ndarray) -> float:
    """Root mean squared difference, after aligning signs of columns."""
    return float(np.sqrt(np.mean((x - align_signs(x, y)) ** 2)))


def mev(x: np.ndarray, y: np.ndarray) -> float:
    """Mean explained variance: mean length of y's columns within the span of x."""
    return float(np.mean(np.sqrt(((x.T @ y) ** 2).sum(axis=0))))


def min_sse(x: np.ndarray, y: np.ndarray) -> float:
    """Least sum of squared differences when each column of y may change its sign."""
    return float(np.minimum(((x - y) ** 2).sum(axis=0), ((x + y) ** 2).sum(axis=0)).sum())


def mev_rmse_by_k(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """`mev` and `rmse` of the first 1, 2, .. columns."""
    ks = range(1, x.shape[1] + 1)
    return [mev(x[:, :k], y[:, :k]) for k in ks], [rmse(x[:, :k], y[:, :k]) for k in ks]


def dimensions(rows: DataFrame, column: str = "x") -> tuple[int, int]:
    """Samples and variants; every row must have all samples."""
    r = rows.agg(F.count("*").alias("m"), F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi")).first()
    if r.m and r.lo != r.hi:
        raise ValueError("rows have different numbers of samples")
    return (r.hi or 0), r.m


def sample_gram(rows: DataFrame, column: str = "x") -> np.ndarray:
    """Sum over variants of x x^T, samples by samples."""

    def partial(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = None
        for b in batches:
            if b.num_rows:
                x = rows_of(b, column)
                total = x.T @ x if total is None else total + x.T @ x
        return {} if total is None else {"gram": total}

    return sum_arrays(rows.select(column), partial).get("gram", np.zeros((0, 0)))


def feature_gram(rows: DataFrame, column: str = "x") -> tuple[np.ndarray, list[int]]:
    """Sum over samples of x x^T, variants by variants, and the variants' order: for fewer variants than samples."""
    order = sorted(r.variant_idx for r in rows.select("variant_idx").collect())
    return sample_gram(turned(rows, len(order), column)), order


def power_pass(rows: DataFrame, omega: np.ndarray, column: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """One reading of the rows: H = sum of x (x^T omega), and the Gram matrix of the products x^T omega."""
    shared = rows.sparkSession.sparkContext.broadcast(omega)

    def partial(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        om = shared.value
        h, g = np.zeros_like(om), np.zeros((om.shape[1], om.shape[1]))
        for b in batches:
            if b.num_rows:
                x = rows_of(b, column)
                y = x @ om
                h += x.T @ y
                g += y.T @ y
        return {"h": h, "g": g}

    out = sum_arrays(rows.select(column), partial)
    return out["h"], out["g"]


def loadings_of(rows: DataFrame, u: np.ndarray, s: np.ndarray, column: str = "x") -> DataFrame:
    """v = U^T x / s of each row: (variant_idx, v array<double>)."""
    shared = rows.sparkSession.sparkContext.broadcast(u / np.where(s > 0, s, 1.0))
    schema = "variant_idx long, v array<double>"
    return map_rows(rows.select("variant_idx", column), lambda b: batch_of(schema, column_of(b, "variant_idx"), rows_of(b, column) @ shared.value), schema)


def orthonormal(h: np.ndarray) -> np.ndarray:
    return np.linalg.qr(h)[0]


def factor(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left vectors and singular values from a pass's sums: with Gt = Q R and B = R^-T H^T, those of B.

    R comes from the products' Gram matrix, so that the tall factor never leaves the tasks; where it is close
    to singular its small eigenvalues are dropped.
    """
    lam, w = np.linalg.eigh(g)
    keep = lam > lam.max(initial=0) * 1e-13
    b = (w[:, keep] / np.sqrt(lam[keep])).T @ h.T
    _, s, vt = np.linalg.svd(b, full_matrices=False)
    return vt.T, s


#: Bytes of a band's values that one partition holds.
BAND_BYTES = 128 << 20


def random_start(n: int, width: int, seed: int, kind: str) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, width)) if kind == "gaussian" else rng.uniform(-1, 1, (n, width))


def exact(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors of the rows' Gram matrix, and the square roots of its eigenvalues."""
    lam, vec = np.linalg.eigh(sample_gram(rows))
    top = np.argsort(-lam)[:k]
    return vec[:, top], np.sqrt(np.maximum(lam[top], 0))


def by_sample(rows: DataFrame, k: int, n: int, m: int, method: str, options: dict) -> tuple[np.ndarray, np.ndarray, DataFrame, list[float]]:
    """Components of a matrix with more samples than variants, by iterations on vectors of its variants.

    The matrix is turned once and kept; passes over it return sums of the variants' number times a few components, and
    the scores, which are products of the rows, are sent to the driver once. Iterated vectors are rotated within their
    span to make the scores orthogonal.
    """
    turn, history = turned(rows, m).persist(), []
    try:
        if method == "full":
            v, s = exact(turn, k)
        else:
            v, _, history = METHODS[method](turn, k, m, **({"m": n} if method == "winsvd" else {}) | options)
            lam, p = np.linalg.eigh(power_pass(turn, v)[1])
            v, s = v @ p[:, ::-1], np.sqrt(np.maximum(lam[::-1], 0))
        u, v = flip_signs(gathered(loadings_of(turn, v, s), n, v.shape[1]), v)
    finally:
        turn.unpersist()
    order = np.sort(column_of(rows.select("variant_idx").toArrow(), "variant_idx"))
    schema = "variant_idx long, v array<double>"
    return u, s, rows.sparkSession.createDataFrame(pa.Table.from_batches([batch_of(schema, order, v)])), history


def randomized(rows: DataFrame, k: int, n: int, *, oversamples: int = 10, max_passes: int = 20, tol: float = 1e-4, seed: int = 112, rand: str = "gaussian") -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Power iterations on a random start until the components' span stays: one pass each."""
    omega, before, history = orthonormal(random_start(n, min(n, k + max(oversamples, k)), seed, rand)), None, []
    for _ in range(max_passes):
        h, g = power_pass(rows, omega)
        u, s = factor(h, g)
        u, s = u[:, :k], s[:k]
        omega = orthonormal(h)
        if before is not None:
            history.append(1 - mev(u, before))
            if history[-1] < tol:
                break
        before = u
    return u, s, history


def windowed(rows: DataFrame, k: int, n: int, *, m: int | None = None, bands: int = 64, oversamples: int = 10, max_passes: int = 20, tol: float = 1e-4, seed: int = 112, rand: str = "gaussian") -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Power iterations whose test matrix is renewed within a pass.

    Rows are dealt to bands in turn. Pass p slides a window of min(2^(p+1), bands) bands; each half window gives
    a sum, the two last ones are added and orthonormalised to the next test matrix. Half windows grow until one
    holds half of all bands, so early passes renew it often and log2(bands) + 1 passes do. All bands of a half
    window are read in one job. A band has as many partitions as its BAND_BYTES ask for, of equal numbers of rows;
    `m` is the number of rows, counted if not given.
    """
    if bands % 2 or bands < 4:
        raise ValueError("bands must be even and at least 4")
    each = max(1, -(-8 * n * (rows.count() if m is None else m) // (bands * BAND_BYTES)))
    band = F.pmod("variant_idx", F.lit(bands))
    place = (band * each + F.pmod(F.floor(F.col("variant_idx") / bands), F.lit(each))).cast("int")
    banded = rows.withColumn("band", band).repartitionById(bands * each, place).persist()
    omega, before, history = orthonormal(random_start(n, min(n, k + max(oversamples, k)), seed, rand)), None, []
    try:
        for p in range(max_passes):
            half = min(2**p, bands // 2)
            older, total_h, total_g = None, 0.0, 0.0
            for first in range(0, bands, half):
                part = banded.where((F.col("band") >= first) & (F.col("band") < first + half))
                h, g = power_pass(part, omega)
                both = h if older is None else older + h
                whole = 2 * half >= bands
                if whole:  # the test matrix stays while a factorisation's sums are taken over all rows
                    total_h, total_g = total_h + h, total_g + g
                else:
                    omega = align_to(omega, orthonormal(both))
                older = h
            if 2 * half < bands:
                continue
            u, s = factor(total_h, total_g)
            u, s = u[:, :k], s[:k]
            omega = orthonormal(total_h)
            if before is not None:
                history.append(1 - mev(u, before))
                if history[-1] < tol:
                    break
            before = u
    finally:
        banded.unpersist()
    return u, s, history


def align_to(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Columns of the new test matrix with the old one's signs."""
    return align_signs(old, new) if old.shape == new.shape else new


def lanczos(rows: DataFrame, k: int, n: int, *, ncv: int | None = None, max_restarts: int = 1000, tol: float = 1e-6, seed: int = 112, diagonal: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Thick-restart Lanczos on K = sum x x^T with a distributed product; max(20, 2k + 1) vectors between restarts.

    `diagonal`, if given, is added to that of K.
    """
    width = min(n, ncv or max(20, 2 * k + 1))
    basis, t = np.zeros((n, width + 1)), np.zeros((width, width))
    basis[:, 0] = orthonormal(random_start(n, 1, seed, "gaussian"))[:, 0]
    size, history = 0, []
    for _ in range(max_restarts):
        beta = 0.0
        for j in range(size, width):
            w = power_pass(rows, basis[:, j : j + 1])[0][:, 0]
            if diagonal is not None:
                w += diagonal * basis[:, j]
            t[: j + 1, j] = t[j, : j + 1] = basis[:, : j + 1].T @ w
            for _ in range(2):
                w -= basis[:, : j + 1] @ (basis[:, : j + 1].T @ w)
            beta = float(np.linalg.norm(w))
            if beta < 1e-12 * max(1.0, abs(t[0, 0])):
                width = j + 1
                break
            basis[:, j + 1] = w / beta
        lam, y = np.linalg.eigh(t[:width, :width])
        top = np.argsort(-lam)
        residual = np.abs(beta * y[width - 1, top[:k]])
        history.append(float(residual.max()))
        if history[-1] <= tol * max(lam[top[0]], 1e-300) or width == n or beta < 1e-12 * max(1.0, lam[top[0]]):
            break
        size = min(width - 1, k + (width - k) // 2)
        kept = basis[:, :width] @ y[:, top[:size]]
        basis[:, size] = basis[:, width]
        basis[:, :size] = kept
        t[:] = 0
        t[range(size), range(size)] = lam[top[:size]]
    u = basis[:, :width] @ y[:, top[:k]]
    return u, np.sqrt(np.maximum(lam[top[:k]], 0)), history


METHODS: dict[str, Callable] = {"rsvd": randomized, "winsvd": windowed, "lanczos": lanczos}


def decompose(rows: DataFrame, k: int, method: str = "auto", scale: str = "standardized", **options) -> PCAModel:
    """Top k components of the rows' column `x`.

    "full" takes the eigenvectors of the smaller Gram matrix; "rsvd", "winsvd" and "lanczos" iterate on vectors of the
    smaller dimension; "auto" is exact up to EXACT_UP_TO rows or columns, else winsvd. Signs make each score vector's largest entry positive.
    """
    n, m = dimensions(rows)
    k = min(k, n, m)
    if k < 1:
        raise ValueError("there are no values to decompose")
    if method == "auto":
        method = "full" if min(n, m) <= EXACT_UP_TO else "winsvd"
    if method not in ("full", *METHODS):
        raise ValueError(f"unknown method {method}")
    if n > m:
        u, s, packed, history = by_sample(rows, k, n, m, method, options)
        return PCAModel(rows.sparkSession, u, s, packed, n, m, scale, history)
    if method == "full":
        (u, s), history = exact(rows, k), []
    else:
        u, s, history = METHODS[method](rows, k, n, **({"m": m} if method == "winsvd" else {}) | options)
    (u,) = flip_signs(u)
    return PCAModel(rows.sparkSession, u, s, loadings_of(rows, u, s), n, m, scale, history)


def residuals(rows: DataFrame, u: np.ndarray, column: str = "x") -> DataFrame:
    """x - U (U^T x), then centred over samples: (variant_idx, r array<double>)."""
    shared = rows.sparkSession.sparkContext.broadcast(u)
    keep = [c for c in rows.columns if c == "variant_idx"]
    schema = "variant_idx long, r array<double>"

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        x = rows_of(b, column)
        r = x - (x @ shared.value) @ shared.value.T
        return batch_of(schema, column_of(b, "variant_idx"), r - r.mean(axis=1, keepdims=True))

    return map_rows(rows.select(*keep, column), fn, schema)


def residuals_of_model(rows: DataFrame, u: np.ndarray, s: np.ndarray, loadings: DataFrame, column: str = "x") -> DataFrame:
    """x - U S v of each variant, with the model's own loadings (variant_idx, v array<double>): (variant_idx, r)."""
    shared = rows.sparkSession.sparkContext.broadcast(u * s)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of("variant_idx long, r array<double>", column_of(b, "variant_idx"), rows_of(b, column) - rows_of(b, "v") @ shared.value.T)

    return map_rows(rows.select("variant_idx", column).join(loadings.select("variant_idx", "v"), "variant_idx"), fn, "variant_idx long, r array<double>")
