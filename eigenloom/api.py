"""One call for each analysis, with the checks of its options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from eigenloom.operators import em, hwe, ld, normalize, project, selection, variants
from eigenloom.operators.pca import PCAModel, decompose, residuals


@dataclass(frozen=True)
class Defaults:
    """Option values where none is given."""

    components: int = 10
    bands: int = 64
    seed: int = 112
    oversamples: int = 10
    max_passes: int = 20
    tol_rsvd: float = 1e-4
    tol_em: float = 1e-5
    tol_maf: float = 1e-6
    max_iter: int = 100
    ld_bp: int = 1_000_000
    clump_p1: float = 1e-4
    clump_p2: float = 1e-2
    clump_r2: float = 0.5
    clump_bp: int = 250_000


DEFAULTS = Defaults()


def pca(geno: DataFrame, k: int = DEFAULTS.components, method: str = "auto", standardize: bool = True, haploid: bool = False, maf: float = 0.0, emu: bool = False, **options) -> PCAModel:
    """Components of genotypes (variant_idx, g). `maf` keeps variants above it; `emu` imputes missing values by EM."""
    rows = variants.filter_maf(geno, maf) if maf else geno
    if emu:
        return em.emu(rows.select("variant_idx", "g"), k, method, DEFAULTS.max_iter, DEFAULTS.tol_em, **options)
    made = normalize.standardized(rows, 1 if haploid else 2) if standardize else normalize.centred(rows)
    return decompose(made, k, method, "standardized" if standardize else "centred", **options)


def pca_likelihoods(gl: DataFrame, k: int = DEFAULTS.components, method: str = "auto", **options) -> PCAModel:
    """Components of genotype likelihoods (variant_idx, p0, p1)."""
    return em.pcangsd(gl, k, method, DEFAULTS.max_iter, DEFAULTS.tol_em, components=k, **options)[0]


def pca_counts(counts: DataFrame, k: int = DEFAULTS.components, scale: int = 2, scale_factor: float = 1.0, method: str = "auto", **options) -> tuple[PCAModel, list[str]]:
    """Components of a count matrix (feature, sample, n), and the samples' names in order."""
    rows, names = normalize.pack_counts(normalize.normalize_counts(counts, scale, scale_factor))
    return decompose(rows.withColumnRenamed("g", "x"), k, method, "raw", **options), names


def project_samples(geno: DataFrame, markers: DataFrame, reference_markers: DataFrame, reference: DataFrame, singular_values, mode: int = 2, standardize: bool = True):
    """Scores of new samples on a reference: 1 mean imputation, 2 least squares, 3 genotype likelihoods."""
    if mode not in (1, 2, 3):
        raise ValueError("projection has modes 1, 2 and 3")
    if (mode == 3) != ("p0" in geno.columns):
        raise ValueError("mode 3 needs genotype likelihoods, the others genotypes")
    matches = variants.match_markers(markers, reference_markers)
    rows = project.matched_rows(geno, matches, reference, standardize and mode != 3).persist()
    try:
        run = {1: project.project_mean, 2: project.project_least_squares, 3: project.project_likelihoods}[mode]
        return run(rows, singular_values)
    finally:
        rows.unpersist()


def selection_scan(geno: DataFrame, model: PCAModel, kind: int = 1) -> DataFrame:
    """1: a test of each component; 2: one test of all components together."""
    if kind not in (1, 2):
        raise ValueError("selection scans are 1 and 2")
    rows = normalize.standardized(geno)
    return selection.galinsky(rows, model.u, model.eigenvalues) if kind == 1 else selection.pcadapt(rows, model.u, model.eigenvalues)[0]


def hardy_weinberg(data: DataFrame, model: PCAModel, dosage_scale: float = 1.0, by_sample: bool = False) -> DataFrame:
    """Inbreeding and Hardy-Weinberg tests given the model's structure; `data` has af, and g or p0 and p1."""
    rows = em.individual_frequency(data, model, dosage_scale).persist()
    return hwe.inbreeding_by_sample(rows) if by_sample else hwe.hwe(rows, DEFAULTS.max_iter, DEFAULTS.tol_em)


def ld_rows(geno: DataFrame, model: PCAModel | None = None) -> DataFrame:
    """Rows (variant_idx, af, r) for LD: centred genotypes, without the model's components if one is given."""
    rows = normalize.centred(geno)
    if model is None:
        return rows.select("variant_idx", "af", rows["x"].alias("r"))
    return residuals(rows, model.u).join(rows.select("variant_idx", "af"), "variant_idx")


def ld_report(rows: DataFrame, markers: DataFrame, window_bp: int = DEFAULTS.ld_bp) -> DataFrame:
    return ld.r2_pairs(rows, markers, window_bp)


def ld_prune(rows: DataFrame, markers: DataFrame, r2: float, window_bp: int = DEFAULTS.ld_bp) -> DataFrame:
    """Markers with `keep`; of linked ones that of lower frequency goes if `markers` has af."""
    if not 0 < r2 <= 1:
        raise ValueError("r2 must lie between 0 and 1")
    return ld.prune(ld.r2_pairs(rows, markers, window_bp), markers, r2)


def ld_clump(rows: DataFrame, markers: DataFrame, associations: list[DataFrame], p1: float = DEFAULTS.clump_p1, p2: float = DEFAULTS.clump_p2, r2: float = DEFAULTS.clump_r2, window_bp: int = DEFAULTS.clump_bp) -> list[DataFrame]:
    """Clumps of each association table."""
    pairs = ld.r2_pairs(rows, markers, window_bp).persist()
    return [ld.clump(pairs, markers, a, p1, p2, r2, window_bp) for a in associations]


def ld_study(geno: DataFrame, markers: DataFrame, k: int = DEFAULTS.components, maf: float = 0.05, window_bp: int = DEFAULTS.ld_bp, bins: int = 500) -> dict[str, DataFrame]:
    """Decay of LD with distance, plain and without the structure of k components, and the background between
    chromosomes, over all of them.
    """
    kept = variants.filter_maf(geno, maf).select("variant_idx", "g").persist()
    n = kept.selectExpr("size(g) AS n").first().n
    out: dict[str, DataFrame] = {}
    several = markers.select("chr").distinct().limit(2).count() > 1
    for name, model in (("standard", None), ("adjusted", pca(kept, k))):
        rows = ld_rows(kept, model)
        decay = ld.decay_bins(ld.r2_pairs(rows, markers, window_bp), window_bp, bins)
        out[f"{name}_by_chromosome"], out[name] = decay, ld.weighted_decay(decay, n)
        if several:
            out[f"{name}_background"] = ld.background_mean(rows, markers)
    return out
