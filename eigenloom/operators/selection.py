"""Selection scans on components: a test for each component, and one on all together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.functions.stats import mad, pchisq, qchisq
from eigenloom.operators.matrix import batch_of, column_of, map_rows, rows_of, sum_arrays

#: Variants up to which z-scores are gathered for the medians; beyond, the same medians are found in passes over all.
DRIVER_ROWS = 2_000_000
#: Bits of a number that one pass of a distributed median settles.
DIGIT = 11


def _products(rows: DataFrame, u: np.ndarray, eigenvalues: np.ndarray, m: int) -> DataFrame:
    """v = U^T x / sqrt(E m) and |x|^2 of each variant."""
    shared = rows.sparkSession.sparkContext.broadcast((u, np.sqrt(eigenvalues * m)))
    schema = "variant_idx long, v array<double>, norm2 double"

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        x = rows_of(b, "x")
        return batch_of(schema, column_of(b, "variant_idx"), x @ shared.value[0] / shared.value[1], (x * x).sum(axis=1))

    return map_rows(rows.select("variant_idx", "x"), fn, schema)


def galinsky(rows: DataFrame, u: np.ndarray, eigenvalues: np.ndarray) -> DataFrame:
    """m v^2 of each variant and component, chi-square with one degree of freedom: (variant_idx, pc, stat, p).

    `rows` are the standardised variants of the scan, whose number is m.
    """
    m = rows.count()
    schema = "variant_idx long, stat array<double>, p array<double>"

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        stat = m * rows_of(b, "v") ** 2
        return batch_of(schema, column_of(b, "variant_idx"), stat, pchisq(stat, 1, lower=False))

    packed = map_rows(_products(rows, u, eigenvalues, m), fn, schema)
    return packed.select("variant_idx", F.posexplode(F.arrays_zip("stat", "p")).alias("pc", "e")).select("variant_idx", (F.col("pc") + 1).cast("int").alias("pc"), "e.stat", "e.p")


def z_scores(rows: DataFrame, u: np.ndarray, eigenvalues: np.ndarray, residual: str = "reference") -> DataFrame:
    """Each variant's loadings over its residual deviation: (variant_idx, z array<double>).

    The residual sum of squares is |x|^2 less |v|^2, with v divided by the singular values as in the reference
    way, or with the plain products, as in a regression on U.
    """
    n, k = u.shape
    if n <= k:
        raise ValueError("more samples than components are needed")
    m = rows.count()
    root = np.sqrt(eigenvalues * m)
    schema = "variant_idx long, z array<double>"

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        v = rows_of(b, "v")
        fitted = v if residual == "reference" else v * root
        rss = np.maximum(column_of(b, "norm2") - (fitted**2).sum(axis=1), 0)
        sd = np.sqrt(rss / (n - k))[:, None]
        return batch_of(schema, column_of(b, "variant_idx"), np.where(sd > 1e-9, v / np.where(sd > 1e-9, sd, 1), 0.0))

    return map_rows(_products(rows, u, eigenvalues, m), fn, schema)


def robust_moments(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column medians, and a covariance whose entries come from the robust scale of sums and differences.

    Eigenvalues are at least 1e-8 of the largest, or of 1.
    """
    centre = np.median(z, axis=0)
    c = z - centre
    k = z.shape[1]
    cov = np.array([[mad(c[:, i]) ** 2 if i == j else 0.25 * (mad(c[:, i] + c[:, j]) ** 2 - mad(c[:, i] - c[:, j]) ** 2) for j in range(k)] for i in range(k)])
    lam, vec = np.linalg.eigh(cov)
    lam = np.maximum(lam, 1e-8 * max(1.0, lam.max()))
    return centre, (vec * lam) @ vec.T


def _ordered(x: np.ndarray) -> np.ndarray:
    """Numbers as unsigned integers of the same order."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def exact_medians(z: DataFrame, n: int, columns, width: int) -> np.ndarray:
    """Medians of the `width` columns that `columns` makes of a batch's z-scores, over all n rows.

    Each pass counts the next digit of the numbers that begin as the middle ones do, so what reaches the driver
    depends on the columns alone.
    """
    ranks = np.array([[(n - 1) // 2] * width, [n // 2] * width])
    found = np.zeros((2, width), np.uint64)
    settled = 0
    while settled < 64:
        digit = min(DIGIT, 64 - settled)
        shift, size = 64 - settled - digit, 1 << digit
        begun = found.copy()

        def partial(batches, begun=begun, shift=shift, size=size, digit=digit) -> dict[str, np.ndarray]:
            out = np.zeros((2, width, size))
            for b in batches:
                if not b.num_rows:
                    continue
                key = _ordered(columns(rows_of(b, "z"))) >> np.uint64(shift)
                for side in range(2):
                    same = key >> np.uint64(digit) == begun[side]
                    at = (key & np.uint64(size - 1)).astype(np.int64) + np.arange(width) * size
                    out[side] += np.bincount(at[same], minlength=width * size).reshape(width, size)
            return {"counts": out}

        below = np.cumsum(sum_arrays(z.select("z"), partial)["counts"], axis=2)
        at = (below <= ranks[:, :, None]).sum(axis=2)
        ranks = ranks - np.where(at > 0, np.take_along_axis(below, np.maximum(at - 1, 0)[:, :, None], axis=2)[:, :, 0], 0).astype(np.int64)
        found = found << np.uint64(digit) | at.astype(np.uint64)
        settled += digit
    bits = np.where(found >> np.uint64(63), found & np.uint64((1 << 63) - 1), ~found)
    return bits.view(np.float64).mean(axis=0)


def all_moments(z: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """`robust_moments` of a table of z-scores too large to gather."""
    centre = exact_medians(z, n, lambda x: x, k)
    i, j = np.triu_indices(k, 1)

    def spread(x: np.ndarray) -> np.ndarray:
        c = x - centre
        return np.hstack((c, c[:, i] + c[:, j], c[:, i] - c[:, j]))

    width = k + 2 * len(i)
    middle = exact_medians(z, n, spread, width)
    scale = 1.4826 * exact_medians(z, n, lambda x: np.abs(spread(x) - middle), width)
    if (scale == 0).any():  # as `mad` does: the deviation, and if that is 0, 1
        sums = lambda f: sum_arrays(z.select("z"), lambda batches: {"s": sum((f(spread(rows_of(b, "z"))).sum(axis=0) for b in batches if b.num_rows), np.zeros(width))})["s"]
        mean = sums(lambda x: x) / n
        sd = np.sqrt(sums(lambda x: (x - mean) ** 2) / max(1, n - 1))
        scale = np.where(scale > 0, scale, np.where(sd > 0, sd, 1.0))
    cov = np.diag(scale[:k] ** 2)
    cov[i, j] = cov[j, i] = 0.25 * (scale[k : k + len(i)] ** 2 - scale[k + len(i) :] ** 2)
    lam, vec = np.linalg.eigh(cov)
    lam = np.maximum(lam, 1e-8 * max(1.0, lam.max()))
    return centre, (vec * lam) @ vec.T


def inflation(median: float, df: int) -> float:
    """Median of the statistics over the chi-square's; 1 if that is not a positive number."""
    factor = median / qchisq(0.5, df)
    return factor if np.isfinite(factor) and factor > 0 else 1.0


def pcadapt(rows: DataFrame, u: np.ndarray, eigenvalues: np.ndarray, residual: str = "reference") -> tuple[DataFrame, float]:
    """Robust squared distance of each variant's z-scores: (variant_idx, z, stat, chi2, p), and the inflation factor."""
    z = z_scores(rows, u, eigenvalues, residual)
    k = u.shape[1]
    n = z.count()
    few = n <= DRIVER_ROWS
    data = np.array([r.z for r in z.select("z").collect()]).reshape(-1, k) if few else None
    centre, cov = robust_moments(data) if few else all_moments(z, n, k)
    inverse = np.linalg.inv(cov)
    stat = lambda x: np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
    gif = inflation(float(np.median(stat(data)) if few else exact_medians(z, n, lambda x: stat(x)[:, None], 1)[0]), k)
    schema = "variant_idx long, z array<double>, stat double, chi2 double, p double"

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        x = rows_of(b, "z")
        s = stat(x)
        return batch_of(schema, column_of(b, "variant_idx"), x, s, s / gif, pchisq(s / gif, k, lower=False))

    return map_rows(z, fn, schema), gif
