"""Inbreeding and Hardy-Weinberg tests given individual allele frequencies, by variant or by sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eigenloom.functions.stats import chisq1
from eigenloom.operators.matrix import batch_of, column_of, map_rows, rows_of, sum_arrays

FLOOR = 1e-4
#: Fixed value: the weight of each class of a missing genotype.
MISSING = 0.333333


def class_weights(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likelihood of 0, 1 and 2 copies in each cell, from likelihoods p0, p1 or from genotypes g."""
    if "p0" in b.schema.names:
        p0, p1 = rows_of(b, "p0"), rows_of(b, "p1")
        return p0, p1, 1 - p0 - p1
    g = rows_of(b, "g")
    none = np.isnan(g)
    return tuple(np.where(none, MISSING, g == x) for x in (0.0, 0.5, 1.0))


def masses(pi: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each class with inbreeding f, floored and made to sum to one."""
    a = pi * (1 - pi)
    parts = [np.maximum(FLOOR, m) for m in ((1 - pi) ** 2 + a * f, 2 * a * (1 - f), pi**2 + a * f)]
    total = parts[0] + parts[1] + parts[2]
    return tuple(p / total for p in parts)


def heterozygosity(weights: tuple, pi: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Posterior probability of the heterozygote in each cell."""
    post = [w * m for w, m in zip(weights, masses(pi, f), strict=True)]
    return post[1] / (post[0] + post[1] + post[2])


def em_site(weights: tuple, pi: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Next coefficient of each row: 1 - observed / expected heterozygosity, within [-1, 1]."""
    seen = heterozygosity(weights, pi, f[:, None]).sum(axis=1)
    return np.clip(1 - seen / (2 * pi * (1 - pi)).sum(axis=1), -1, 1)


def replay(weights: tuple, pi: np.ndarray, alphas: list[float]) -> np.ndarray:
    """Coefficients after the accelerated iterations whose step lengths are given, from zero."""
    f = np.zeros(len(pi))
    for alpha in alphas:
        one = em_site(weights, pi, f)
        two = em_site(weights, pi, one)
        first, change = one - f, (two - one) - (one - f)
        f = em_site(weights, pi, np.clip(f + 2 * alpha * first + alpha * alpha * change, -1, 1))
    return f


def log_likelihood_ratio(weights: tuple, pi: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Twice the gain in log likelihood of each row over no inbreeding, whose masses are taken as they are."""
    alt = sum(w * m for w, m in zip(weights, masses(pi, f[:, None]), strict=True))
    null = sum(w * m for w, m in zip(weights, ((1 - pi) ** 2, 2 * pi * (1 - pi), pi**2), strict=True))
    return 2 * (np.log(alt) - np.log(null)).sum(axis=1)


def hwe(rows: DataFrame, max_iter: int = 100, tol: float = 1e-5, iterations: int | None = None) -> DataFrame:
    """Inbreeding coefficient, likelihood ratio and p-value of each variant.

    `rows` has variant_idx, pi, and g or p0 and p1. Iterations are extrapolated with one step length for all
    variants, so each takes a pass that returns three sums; a pass replays the earlier ones from their step
    lengths, hence no state is kept. Stops at a root mean squared change below `tol`, or after `iterations`.
    A ratio that is not positive or not a number has p = 1.
    """
    columns = ["variant_idx", "pi", *(["p0", "p1"] if "p0" in rows.columns else ["g"])]
    alphas: list[float] = []
    for _ in range(iterations if iterations is not None else max_iter):

        def partial(batches: Iterator[pa.RecordBatch], done: tuple[float, ...] = tuple(alphas)) -> dict[str, np.ndarray]:
            out = np.zeros(4)
            for b in batches:
                if not b.num_rows:
                    continue
                w, pi = class_weights(b), rows_of(b, "pi")
                f = replay(w, pi, list(done))
                one = em_site(w, pi, f)
                two = em_site(w, pi, one)
                before = replay(w, pi, list(done[:-1]))
                out += [((one - f) ** 2).sum(), (((two - one) - (one - f)) ** 2).sum(), ((f - before) ** 2).sum(), len(f)]
            return {"sums": out}

        r2, v2, moved, n = sum_arrays(rows.select(*columns), partial).get("sums", np.zeros(4))
        if not n or (alphas and iterations is None and np.sqrt(moved / n) < tol) or v2 == 0:
            break
        alphas.append(float(min(max(1.0, np.sqrt(r2 / v2)), 256.0)))
    schema = "variant_idx long, hwe_p double, lrt double, inbreeding double"

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        w, pi = class_weights(b), rows_of(b, "pi")
        f = replay(w, pi, alphas)
        lrt = log_likelihood_ratio(w, pi, f)
        return batch_of(schema, column_of(b, "variant_idx"), chisq1(lrt), lrt, f)

    return map_rows(rows.select(*columns), fn, schema)


def inbreeding_by_sample(rows: DataFrame, max_iter: int = 100, tol: float = 1e-5, iterations: int | None = None) -> DataFrame:
    """Inbreeding coefficient of each sample over all variants: plain steps from zero, one pass each."""
    columns = ["pi", *(["p0", "p1"] if "p0" in rows.columns else ["g"])]
    f: np.ndarray | None = None
    for _ in range(iterations if iterations is not None else max_iter):
        shared = rows.sparkSession.sparkContext.broadcast(f)

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> dict[str, np.ndarray]:
            total = None
            for b in batches:
                if b.num_rows:
                    pi = rows_of(b, "pi")
                    now = np.zeros(pi.shape[1]) if shared.value is None else shared.value
                    part = np.stack((heterozygosity(class_weights(b), pi, now[None, :]).sum(axis=0), (2 * pi * (1 - pi)).sum(axis=0)))
                    total = part if total is None else total + part
            return {} if total is None else {"sums": total}

        sums = sum_arrays(rows.select(*columns), partial).get("sums")
        if sums is None:
            break
        before, f = f, np.clip(1 - sums[0] / sums[1], -1, 1)
        if iterations is None and before is not None and np.sqrt(np.mean((f - before) ** 2)) < tol:
            break
    return rows.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(f if f is not None else [])], "sample_idx int, inbreeding double")
