"""Expectation-maximisation: allele frequencies from likelihoods, PCA with missing or uncertain genotypes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from eigenloom.operators.matrix import batch_of, column_of, gathered, gram_cells, map_rows, rows_of, sum_arrays, turned
from eigenloom.operators.normalize import centred
from eigenloom.operators.variants import with_each
from eigenloom.operators.pca import PCAModel, decompose, dimensions, flip_signs, lanczos, mev, sample_gram

#: Individual frequencies are kept this far from 0 and 1.
EDGE = 1e-4


def em_step(p0: np.ndarray, p1: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Next frequency of each row: half the mean expected dosage under Hardy-Weinberg priors."""
    f = f[:, None]
    w0, w1, w2 = p0 * (1 - f) ** 2, p1 * 2 * f * (1 - f), (1 - p0 - p1) * f * f
    return ((w1 + 2 * w2) / (w0 + w1 + w2)).sum(axis=1) / (2 * p0.shape[1])


def em_frequency(gl: DataFrame, max_iter: int = 100, tol: float = 1e-6, iterations: int | None = None) -> DataFrame:
    """Allele frequency of each variant from genotype likelihoods (variant_idx, p0, p1): adds `af`.

    All variants iterate in step from 0.25, until the root mean squared change over all of them is below `tol`.
    One pass finds that iteration (each task returns its summed changes), one applies it; a given number of
    `iterations` needs only the last.
    """
    if iterations is None:

        def partial(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
            change = np.zeros(max_iter + 1)
            for b in batches:
                if b.num_rows:
                    p0, p1 = rows_of(b, "p0"), rows_of(b, "p1")
                    f = np.full(len(p0), 0.25)
                    for t in range(max_iter):
                        new = em_step(p0, p1, f)
                        change[t] += ((new - f) ** 2).sum()
                        f = new
                    change[-1] += len(p0)
            return {"change": change}

        change = sum_arrays(gl.select("p0", "p1"), partial)["change"]
        small = np.flatnonzero(np.sqrt(change[:-1] / max(1, change[-1])) < tol)
        iterations = int(small[0]) + 1 if len(small) else max_iter
    schema = "variant_idx long, p0 array<double>, p1 array<double>, af double"

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        p0, p1 = rows_of(b, "p0"), rows_of(b, "p1")
        f = np.full(len(p0), 0.25)
        for _ in range(iterations):
            f = em_step(p0, p1, f)
        return batch_of(schema, column_of(b, "variant_idx"), p0, p1, f)

    return map_rows(gl.select("variant_idx", "p0", "p1"), fn, schema)


def posterior_dosage(p0: np.ndarray, p1: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Expected copies (0..2) given likelihoods and frequencies; NaN where the likelihoods leave no mass."""
    w0, w1, w2 = p0 * (1 - pi) ** 2, p1 * 2 * pi * (1 - pi), (1 - p0 - p1) * pi * pi
    total = w0 + w1 + w2
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.isfinite(total) & (total > 0), (w1 + 2 * w2) / total, np.nan)


def individual_frequency(rows: DataFrame, model: PCAModel, dosage_scale: float = 2.0) -> DataFrame:
    """pi = clip((U S v + dosage_scale * af) / dosage_scale) of each row: adds `pi`. `rows` has af.

    `dosage_scale` is 2 for components of 0..2 dosages and 1 for those of half-dosages. Components of
    standardised values are refused, as they are on another scale.
    """
    if model.scale == "standardized":
        raise ValueError("individual frequencies need components of values that are only centred")
    us = rows.sparkSession.sparkContext.broadcast(model.u * model.s)
    joined = rows.join(model.packed_loadings, "variant_idx").select(*rows.columns, "v")
    schema = StructType([*rows.schema.fields, StructField("pi", ArrayType(DoubleType()))])

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        pi = np.clip(rows_of(b, "v") @ us.value.T / dosage_scale + column_of(b, "af")[:, None], EDGE, 1 - EDGE)
        made = batch_of("pi array<double>", pi).column(0)
        return pa.RecordBatch.from_arrays([*b.columns[:-1], made], [*b.schema.names[:-1], "pi"])

    return map_rows(joined, fn, schema)


def likelihood_rows(gl: DataFrame) -> DataFrame:
    """Dosages `x` (0..2, less 2 af) expected under the variant's own frequency."""
    schema = "variant_idx long, p0 array<double>, p1 array<double>, af double, x array<double>"

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        p0, p1, f = rows_of(b, "p0"), rows_of(b, "p1"), column_of(b, "af")
        x = posterior_dosage(p0, p1, np.repeat(f[:, None], p0.shape[1], 1)) - 2 * f[:, None]
        return batch_of(schema, column_of(b, "variant_idx"), p0, p1, f, np.nan_to_num(x))

    return map_rows(gl.select("variant_idx", "p0", "p1", "af"), fn, schema)


def impute(rows: DataFrame, model: PCAModel) -> DataFrame:
    """Replace `x` where g is missing by U S v, kept within [-af, 1 - af]."""
    us = rows.sparkSession.sparkContext.broadcast(model.u * model.s)
    schema = "variant_idx long, g array<double>, af double, x array<double>"

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        g, f = rows_of(b, "g"), column_of(b, "af")[:, None]
        x = np.where(np.isnan(g), np.clip(rows_of(b, "v") @ us.value.T, -f, 1 - f), g - f)
        masked = pa.ListArray.from_arrays(np.arange(0, g.size + 1, g.shape[1], dtype=np.int32), pa.array(g.ravel(), mask=np.isnan(g).ravel()))
        return pa.RecordBatch.from_arrays([b.column(0), masked, b.column(b.schema.get_field_index("af")), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))], ["variant_idx", "g", "af", "x"])

    return map_rows(rows.select("variant_idx", "g", "af").join(model.packed_loadings, "variant_idx"), fn, schema)


def scale_rows(rows: DataFrame, ploidy: int = 2) -> DataFrame:
    """Divide `x` by the binomial deviation of af."""
    sd = F.sqrt(F.col("af") * (1 - F.col("af")))
    return rows.withColumn("x", with_each(F.col("x"), F.when(sd > 1e-9, F.sqrt(F.lit(float(ploidy))) / sd).otherwise(1.0), lambda v, s: v * s))


def emu(geno: DataFrame, k: int, method: str = "auto", max_iter: int = 100, tol: float = 1e-5, **options) -> PCAModel:
    """PCA of genotypes with missing values: decompose, put U S v into the missing cells, and again.

    Stops when the span of U changes by less than `tol`, then imputes, standardises and decomposes once more.
    Every round starts from the input, so lineage does not grow.
    """
    base = centred(geno).select("variant_idx", "g", "af", "x").persist()
    try:
        model, history = decompose(base, k, method, "centred", **options), []
        for _ in range(max_iter):
            again = decompose(impute(base, model), k, method, "centred", **options)
            history.append(1 - mev(again.u, model.u))
            model = again
            if history[-1] < tol:
                break
        last = decompose(scale_rows(impute(base, model)), k, method, "standardized", **options)
        last.history = history
        return last
    finally:
        base.unpersist()


def pcangsd(gl: DataFrame, k: int, method: str = "auto", max_iter: int = 100, tol: float = 1e-5, components: int | None = None, **options) -> tuple[PCAModel, np.ndarray | None]:
    """PCA of genotype likelihoods (variant_idx, p0, p1): individual frequencies and dosages in turn.

    Rows that have `af` keep it; else it is found by EM.
    Returns the components of the final covariance of samples, whose diagonal is corrected for the genotypes'
    uncertainty. Given the number of `components`, this covariance is never formed, and None is returned for it; else
    all its components are returned and the covariance itself, which must have room on the driver.
    """
    rows = (gl if "af" in gl.columns else em_frequency(gl)).persist()
    try:
        base = likelihood_rows(rows)
        model, history = decompose(base, k, method, "dosage", **options), []
        for _ in range(max_iter):
            again = decompose(update_dosage(individual_frequency(rows, model)), k, method, "dosage", **options)
            history.append(1 - mev(again.u, model.u))
            model = again
            if history[-1] < tol:
                break
        if components is not None:
            n, m = dimensions(rows, "p0")
            u, s = covariance_components(covariance_rows(individual_frequency(rows, model)), min(components, n), n, m)
            return PCAModel(gl.sparkSession, u, s, model.packed_loadings, n, m, "standardized", history), None
        cov = gl_covariance(individual_frequency(rows, model))
        lam, vec = np.linalg.eigh(cov)
        top = np.argsort(-lam)
        (u,) = flip_signs(vec[:, top])
        n, m = dimensions(base)
        return PCAModel(gl.sparkSession, u, np.sqrt(np.maximum(lam[top], 0) * m), model.packed_loadings, n, m, "standardized", history), cov
    finally:
        rows.unpersist()


def update_dosage(rows: DataFrame) -> DataFrame:
    """Dosages `x` (0..2, less 2 af) expected under the individual frequencies `pi`."""
    schema = "variant_idx long, af double, x array<double>"

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        f = column_of(b, "af")
        x = posterior_dosage(rows_of(b, "p0"), rows_of(b, "p1"), rows_of(b, "pi")) - 2 * f[:, None]
        return batch_of(schema, column_of(b, "variant_idx"), f, np.nan_to_num(x))

    return map_rows(rows.select("variant_idx", "p0", "p1", "af", "pi"), fn, schema)


def covariance_rows(rows: DataFrame) -> DataFrame:
    """Factors of the samples' covariance from likelihoods and `pi`: (variant_idx, x, e).

    Covariances are the means of products of x, the standardised expected dosages. Variances are the mean squared
    deviations of the genotypes, E[(g - 2f)^2] / (2 f (1 - f)), which exceed x^2 by e.
    """
    schema = "variant_idx long, x array<double>, e array<double>"

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        p0, p1, pi, f = rows_of(b, "p0"), rows_of(b, "p1"), rows_of(b, "pi"), column_of(b, "af")[:, None]
        w0, w1, w2 = p0 * (1 - pi) ** 2, p1 * 2 * pi * (1 - pi), (1 - p0 - p1) * pi * pi
        total, norm = w0 + w1 + w2, np.sqrt(2 * f * (1 - f))
        norm = np.where(norm > 1e-9, norm, 1.0)
        x = ((w1 + 2 * w2) / total - 2 * f) / norm
        square = (w0 * (2 * f) ** 2 + w1 * (1 - 2 * f) ** 2 + w2 * (2 - 2 * f) ** 2) / total / norm**2
        return batch_of(schema, column_of(b, "variant_idx"), x, square - x * x)

    return map_rows(rows.select("variant_idx", "p0", "p1", "pi", "af"), fn, schema)


def covariance_cells(rows: DataFrame, n: int, m: int, decimals: int) -> DataFrame:
    """Covariance of `n` samples over `m` variants from likelihoods and `pi`, rounded: i, j (i <= j), k. In blocks."""
    return gram_cells(covariance_rows(rows), n, lambda k: np.round(k / m, decimals) + 0.0, diagonal="e")


def gl_covariance(rows: DataFrame) -> np.ndarray:
    """The same covariance as one matrix on the driver: for as many samples as have room there."""

    def partial(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x = rows_of(b, "x")
                for name, value in (("gram", x.T @ x), ("excess", rows_of(b, "e").sum(axis=0)), ("m", np.array([len(x)]))):
                    out[name] = out[name] + value if name in out else value
        return out

    sums = sum_arrays(covariance_rows(rows), partial)
    return (sums["gram"] + np.diag(sums["excess"])) / sums["m"][0]


def covariance_components(rows: DataFrame, k: int, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """First k eigenvectors of K = sum x x^T + diag(sum e) over rows (variant_idx, x, e), and roots of its eigenvalues.

    With more samples than variants, K is a matrix of the variants' rank and a diagonal D. An eigenvalue above all of D
    is that t at which S(t) = X (t - D)^-1 X^T, variants by variants, has the eigenvalue 1, and (t - D)^-1 X^T w its
    vector, w being that of S. S is a sum over samples, and falls as t grows. Otherwise, and where eigenvalues lie among
    D, products of K with a vector are summed over the rows.
    """
    if n > m:
        turn = turned(rows, m, "x", "e").persist()
        try:
            found = _above_diagonal(turn, k, n)
        finally:
            turn.unpersist()
        if found is not None:
            return found

    def partial(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = None
        for b in batches:
            part = rows_of(b, "e").sum(axis=0)
            total = part if total is None else total + part
        return {} if total is None else {"e": total}

    held = rows.persist()
    try:
        u, s, _ = lanczos(held, k, n, tol=1e-10, diagonal=sum_arrays(held.select("e"), partial)["e"])
    finally:
        held.unpersist()
    (u,) = flip_signs(u)
    return u, s


def _above_diagonal(turn: DataFrame, k: int, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The components if all k eigenvalues surely lie above the diagonal (variant_idx, x, e), else None."""
    r = turn.agg(F.min("e").alias("low"), F.max("e").alias("high")).first()

    plain = np.linalg.eigvalsh(sample_gram(turn))[::-1][:k]
    if k > len(plain) or (plain + r.low <= max(r.high, 0.0)).any():
        return None

    def spectra(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """1 / mu - 1 of the j-th eigenvalue mu of S at the j-th place, and its vector."""

        def partial(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
            out: dict[str, np.ndarray] = {}
            for b in batches:
                x, e = rows_of(b, "x"), column_of(b, "e")
                for j, t in enumerate(at):
                    part = (x / (t - e)[:, None]).T @ x
                    out[str(j)] = out[str(j)] + part if str(j) in out else part
            return out

        sums = sum_arrays(turn.select("x", "e"), partial)
        lam, vec = zip(*(np.linalg.eigh(sums[str(j)]) for j in range(k)), strict=True)
        return 1 / np.array([lam[j][-1 - j] for j in range(k)]) - 1, np.stack([vec[j][:, -1 - j] for j in range(k)], axis=1)

    low, high = plain + r.low, plain + r.high  # an eigenvalue lies between these
    f_low, f_high = spectra(low)[0], spectra(high)[0]  # close to linear, and rising
    for _ in range(100):
        spread = f_high - f_low
        at = np.clip(np.where(spread > 0, low - f_low * (high - low) / np.where(spread > 0, spread, 1.0), high), low, high)
        f, w = spectra(at)
        if (np.abs(f) < 1e-12).all() or (high - low <= 1e-14 * high).all():
            break
        above = f > 0
        # an end that stays counts half, so that both ends move
        f_low, f_high = np.where(above, f_low / 2, f), np.where(above, f, f_high / 2)
        low, high = np.where(above, low, at), np.where(above, at, high)
    schema, shared = "variant_idx long, v array<double>", turn.sparkSession.sparkContext.broadcast((w, at))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        w, at = shared.value
        return batch_of(schema, column_of(b, "variant_idx"), rows_of(b, "x") @ w / (at - column_of(b, "e")[:, None]))

    u = gathered(map_rows(turn, fn, schema), n, k)
    (u,) = flip_signs(u / np.linalg.norm(u, axis=0))
    return u, np.sqrt(np.maximum(at, 0))


def predict_missing(geno: DataFrame, u: np.ndarray) -> DataFrame:
    """Fill each variant's missing cells by its regression on U over the samples that have a value: adds `x`."""
    shared = geno.sparkSession.sparkContext.broadcast(u)
    schema = "variant_idx long, af double, x array<double>"

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        g, f = rows_of(b, "g"), column_of(b, "af")
        x = np.nan_to_num(g - f[:, None])
        for j in range(len(g)):
            seen = ~np.isnan(g[j])
            if seen.any() and not seen.all():
                beta = np.linalg.lstsq(shared.value[seen], x[j, seen], rcond=None)[0]
                x[j, ~seen] = np.clip(shared.value[~seen] @ beta, -f[j], 1 - f[j])
        return batch_of(schema, column_of(b, "variant_idx"), f, x)

    from eigenloom.operators.variants import with_frequency

    rows = geno if "af" in geno.columns else with_frequency(geno)
    return map_rows(rows.select("variant_idx", "g", "af"), fn, schema)


def expected_dosage(p0: Column, p1: Column, pi: Column) -> Column:
    """Expected copies (0..2) of one genotype; null where the likelihoods leave no mass."""
    w0, w1, w2 = p0 * (1 - pi) * (1 - pi), p1 * 2 * pi * (1 - pi), (1 - p0 - p1) * pi * pi
    return F.when((w0 + w1 + w2) > 0, (w1 + 2 * w2) / (w0 + w1 + w2))
