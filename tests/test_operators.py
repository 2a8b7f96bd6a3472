"""Operators against numpy, and properties that hold for any data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenloom.functions import stats
from eigenloom.operators import em, hwe, ld, normalize, pca, project, selection, variants
from eigenloom.operators import matrix as mx

RNG = np.random.default_rng(7)
N, M = 30, 60


@pytest.fixture(scope="module")
def g():
    base = RNG.random(M)[:, None] * 0.8 + 0.1 + np.where(np.arange(N) < 12, 0.15, -0.05)[None, :] * RNG.choice([-1, 1], M)[:, None]
    x = RNG.binomial(2, np.clip(base, 0.02, 0.98)) / 2
    x[RNG.random((M, N)) < 0.05] = np.nan
    x[5] = 0.5
    return x


@pytest.fixture(scope="module")
def geno(spark, g):
    return spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(g)], "variant_idx long, g array<double>").repartition(3).persist()


@pytest.fixture(scope="module")
def markers(spark):
    return spark.createDataFrame([(i, str(i // 30 + 1), f"m{i}", 0.0, (i % 30) * 100 + 1, "A", "G") for i in range(M)], "variant_idx long, chr string, id string, cm double, bp long, a1 string, a2 string")


def matrix(df, column):
    return np.array([getattr(r, column) for r in df.orderBy("variant_idx").collect()], float)


def expected_standard(g):
    f = np.nanmean(g, axis=1)[:, None]
    sd = np.sqrt(f * (1 - f))
    return np.nan_to_num(g - f) * np.where(sd > 1e-9, np.sqrt(2) / np.where(sd > 0, sd, 1), 1)


def test_standardizing(geno, g):
    assert np.allclose(matrix(normalize.standardized(geno), "x"), expected_standard(g))


@pytest.mark.parametrize("method,options", [("full", {}), ("rsvd", {"tol": 1e-9, "max_passes": 60}), ("winsvd", {"bands": 4, "tol": 1e-7, "max_passes": 12}), ("lanczos", {})])
def test_decompositions(geno, g, method, options):
    rows = normalize.standardized(geno).persist()
    model = pca.decompose(rows, 3, method, **options)
    _, s, vt = np.linalg.svd(expected_standard(g))
    assert np.allclose(model.s, s[:3], rtol=1e-3) and pca.mev(vt[:2].T, model.u[:, :2]) > 0.999
    assert np.allclose(model.u.T @ model.u, np.eye(3), atol=1e-6)
    assert (model.u[np.abs(model.u).argmax(axis=0), range(3)] > 0).all()
    assert model.loadings().count() == 3 * M


def test_exact_on_the_longer_side(geno, g):
    rows = normalize.standardized(geno).where("variant_idx < 20").persist()
    model = pca.decompose(rows, 20, "full")
    x = expected_standard(g)[:20]
    assert np.allclose(model.eigenvalues.sum(), (x**2).sum() / 20)
    v = matrix(model.packed_loadings, "v")
    assert np.allclose(v * model.s @ model.u.T, x, atol=1e-6)


def test_sums_do_not_depend_on_partitions(geno):
    rows = normalize.standardized(geno)
    assert np.allclose(pca.sample_gram(rows.repartition(1)), pca.sample_gram(rows.repartition(17)))


@pytest.mark.parametrize("block,arrays", [(1 << 19, 16), (7, 5)])
def test_sums_of_many_partitions(spark, monkeypatch, block, arrays):
    monkeypatch.setattr(mx, "BLOCK", block)
    kept = []
    real = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: kept.append(real(self)) or kept[-1])

    def partial(batches):
        total = sum(float(b.column(0).to_numpy().sum()) for b in batches)
        return {"a": np.full((5, 6), total), "n": np.array(1.0)}

    out = mx.sum_arrays(spark.range(0, 3000, 1, 300), partial)
    assert (out["a"] == 3000 * 2999 / 2).all() and out["a"].shape == (5, 6) and out["n"] == 300
    assert sum(r.name == "a" for r in kept[-1]) <= max(16, arrays)
    assert mx.sum_arrays(spark.range(0), lambda batches: {}) == {}


def test_bands_of_many_partitions(geno, g, monkeypatch):
    monkeypatch.setattr(pca, "BAND_BYTES", 1000)  # several partitions for each band
    model = pca.decompose(normalize.standardized(geno), 2, "winsvd", bands=4, tol=1e-7, max_passes=12)
    assert np.allclose(model.s, np.linalg.svd(expected_standard(g))[1][:2], rtol=1e-3)


def test_projecting_the_training_samples_returns_their_scores(geno, markers):
    rows = normalize.standardized(geno).persist()
    model = pca.decompose(rows, 2, "full")
    reference = rows.select("variant_idx", "af").join(model.packed_loadings, "variant_idx")
    matches = variants.match_markers(markers, markers)
    matched = project.matched_rows(geno, matches, reference)
    assert np.allclose(project.project_mean(matched, model.s), model.u, atol=1e-8)
    swapped = markers.withColumn("a1", F.lit("G")).withColumn("a2", F.lit("A"))
    flipped = geno.withColumn("g", F.transform("g", lambda x: 1 - x))
    again = project.matched_rows(flipped, variants.match_markers(swapped, markers), reference)
    assert np.allclose(project.project_mean(again, model.s), model.u, atol=1e-8)
    full = project.project_least_squares(matched, model.s)
    drawn = project.with_draws(matched, 4).persist()
    weights = np.array([r.w for r in drawn.collect()])
    assert (weights.sum(axis=0) == M).all()
    reps = project.bootstrap(drawn, model.s, full, 4)
    assert reps.count() == 4 * 2 * N
    assert project.bootstrap_summary(reps, project.scores_table(geno, full)).where("rmsd is null").count() == 0


def test_duplicate_reference_marker_is_an_error(markers):
    with pytest.raises(ValueError):
        variants.match_markers(markers, markers.unionByName(markers.limit(1)))


def test_ld_and_pruning(geno, g, markers):
    rows = normalize.centred(geno).select("variant_idx", "af", F.col("x").alias("r"))
    pairs = ld.r2_pairs(rows, markers, 500).persist()
    x = np.nan_to_num(g - np.nanmean(g, axis=1)[:, None])
    got = {(r.i, r.k): r.r2 for r in pairs.collect()}
    want = {(i, k) for i in range(M) for k in range(i + 1, M) if i // 30 == k // 30 and k - i <= 5}
    assert set(got) == want
    for (i, k), r2 in got.items():
        if 5 in (i, k):
            assert r2 is None or r2 >= 0  # variant 5 has no spread but for its missing cells
        else:
            assert abs(r2 - np.corrcoef(x[i], x[k])[0, 1] ** 2) < 1e-9
    kept = {r.variant_idx for r in ld.prune(pairs, markers, 0.1).where("keep").collect()}
    assert all(not (i in kept and k in kept and (r2 or 0) > 0.1) for (i, k), r2 in got.items())
    small = ld.r2_pairs(rows, markers, 500, n_samples=ld.SAMPLE_BLOCK + 1)  # in two blocks of samples
    assert all(abs((r.r2 or 0) - (got[r.i, r.k] or 0)) < 1e-9 for r in small.collect())


def test_background_over_all_chromosomes(geno, g, markers):
    rows = normalize.centred(geno).select("variant_idx", F.col("x").alias("r"))
    three = markers.withColumn("chr", F.floor(F.col("variant_idx") / 23).cast("string"))
    x = np.nan_to_num(g - np.nanmean(g, axis=1)[:, None])
    x = x - x.mean(axis=1, keepdims=True)
    use = [i for i in range(M) if np.sqrt((x[i] ** 2).sum()) > 1e-12]
    r2 = [np.corrcoef(x[i], x[k])[0, 1] ** 2 for i in use for k in use if i // 23 < k // 23]
    got = ld.background_mean(rows.where(F.col("variant_idx").isin(use)), three).first()
    assert got.n_pairs == len(r2) and got.mean_r2 == pytest.approx(np.mean(r2), rel=1e-9)
    two = ld.cross_chromosome_mean(rows.where(F.col("variant_idx").isin(use)), markers, "1", "2").first()
    assert tuple(ld.background_mean(rows.where(F.col("variant_idx").isin(use)), markers).first()) == (two.n_pairs, pytest.approx(two.mean_r2))
    assert ld.background_mean(rows.where("variant_idx < 20"), markers).first().n_pairs == 0


def test_dense_variants_meet_in_tiles(geno, markers, monkeypatch):
    rows = normalize.centred(geno).select("variant_idx", F.col("x").alias("r"))
    want = {(r.i, r.k): r.r2 for r in ld.r2_pairs(rows, markers, 1500).collect()}
    monkeypatch.setattr(ld, "TILE", 4)
    for window in (1500, 5000):  # the second holds a chromosome in one stretch
        got = ld.r2_pairs(rows, markers, window).collect()
        assert len(got) == len({(r.i, r.k) for r in got})
        near = {(r.i, r.k): r.r2 for r in got if r.bp_k - r.bp_i <= 1500}
        assert set(near) == set(want) and all(v is None or abs(v - want[k]) < 1e-12 for k, v in near.items())
        assert window == 1500 or len(got) == 2 * 30 * 29 // 2
    assert ld.r2_pairs(rows.where("variant_idx in (3, 9, 40)"), markers, 1500).count() == 1  # tiles without rows


@pytest.mark.parametrize("frequencies", [False, True])
def test_pruning_and_clumping_by_pieces(spark, geno, g, markers, monkeypatch, frequencies):
    monkeypatch.setattr(ld, "PIECE", 1)
    rows = normalize.centred(geno).select("variant_idx", "af", F.col("x").alias("r"))
    pairs = ld.r2_pairs(rows, markers, 1000).persist()
    f = np.nanmean(g, axis=1)
    maf = np.minimum(f, 1 - f) if frequencies else np.zeros(M)
    table = markers.join(rows.select("variant_idx", "af"), "variant_idx") if frequencies else markers
    links = {}
    for r in pairs.where("r2 > 0.08").orderBy("i", "k").collect():
        links.setdefault(r.i, []).append(r.k)
    kept = [True] * M
    for i in range(M):
        for k in links.get(i, []) if kept[i] else []:
            if kept[k]:
                kept[i if maf[k] > maf[i] else k] = False
    assert 0 < sum(kept) < M
    assert {r.variant_idx: r.keep for r in ld.prune(pairs, table, 0.08).collect()} == dict(enumerate(kept))
    assoc = spark.createDataFrame([(str(i // 30 + 1), (i % 30) * 100 + 1, 10.0 ** -(2 + i * 7 % 11)) for i in range(M)], "chr string, bp long, p double")
    want = {tuple(r) for r in _clumps(pairs, M)}
    assert {(r.chr, r.bp, r.sp2) for r in ld.clump(pairs, markers, assoc, r2=0.08, window_bp=600).collect()} == want


def _clumps(pairs, m):
    near = {frozenset((r.i, r.k)) for r in pairs.where("r2 >= 0.08 and bp_k - bp_i <= 600").collect()}
    p, free = {i: 10.0 ** -(2 + i * 7 % 11) for i in range(m)}, set(range(m))
    for i in sorted(range(m), key=lambda i: (i // 30, p[i], i)):
        if p[i] <= 1e-4 and i in free:
            taken = sorted((v for v in free if frozenset((i, v)) in near), key=lambda v: (p[v], v))
            free -= set(taken)
            yield str(i // 30 + 1), (i % 30) * 100 + 1, ",".join(str((v % 30) * 100 + 1) for v in taken) or "NONE"


def test_em_frequency_stops_together(spark, g):
    p0 = np.where(np.isnan(g), 1 / 3, np.where(g == 0, 0.9, 0.05))
    p1 = np.where(np.isnan(g), 1 / 3, np.where(g == 0.5, 0.9, 0.05))
    gl = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(p0, p1, strict=True))], "variant_idx long, p0 array<double>, p1 array<double>").repartition(3)
    f = np.full(M, 0.25)
    for _ in range(100):
        new = em.em_step(p0, p1, f)
        stop = np.sqrt(np.mean((new - f) ** 2)) < 1e-6
        f = new
        if stop:
            break
    assert np.allclose(matrix(em.em_frequency(gl), "af"), f, atol=1e-12)
    model, cov = em.pcangsd(gl, 1, "full", max_iter=2)
    assert cov.shape == (N, N) and np.allclose(cov, cov.T) and model.k == N


def test_emu_fills_missing_cells(geno, g):
    model = em.emu(geno, 1, "full", max_iter=3)
    assert model.u.shape == (N, 1) and len(model.history) <= 3


def top(x, k):
    """First k components of the rows of x over their columns, and the rank-k part of x."""
    w, s, ut = np.linalg.svd(x, full_matrices=False)
    return ut[:k].T, s[:k], (w[:, :k] * s[:k]) @ ut[:k]


def same(a, b):
    return np.allclose(a * np.sign((a * b).sum(axis=0)), b, atol=1e-7)


def test_emu_is_that_of_numpy(geno, g):
    f, rounds = np.nanmean(g, axis=1)[:, None], 4
    fill = lambda part: np.where(np.isnan(g), np.clip(part, -f, 1 - f), g - f)
    part = top(np.nan_to_num(g - f), 2)[2]
    for _ in range(rounds):
        part = top(fill(part), 2)[2]
    sd = np.sqrt(f * (1 - f))
    u, s, _ = top(fill(part) * np.sqrt(2) / np.where(sd > 1e-9, sd, np.sqrt(2)), 2)
    model = em.emu(geno, 2, "full", max_iter=rounds, tol=-1)
    assert np.allclose(model.s, s) and same(model.u, u) and len(model.history) == rounds


def test_pcangsd_is_that_of_numpy(spark, g):
    p0 = np.where(np.isnan(g), 1 / 3, np.where(g == 0, 0.8, 0.1))
    p1 = np.where(np.isnan(g), 1 / 3, np.where(g == 0.5, 0.8, 0.1))
    p2, rounds = 1 - p0 - p1, 3
    f = np.full(M, 0.25)
    for _ in range(12):
        f = em.em_step(p0, p1, f)
    gl = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(p0, p1, strict=True))], "variant_idx long, p0 array<double>, p1 array<double>").repartition(3)
    model, cov = em.pcangsd(em.em_frequency(gl, iterations=12), 2, "full", max_iter=rounds, tol=-1)
    f = f[:, None]

    def weights(pi):
        w = np.stack([p0 * (1 - pi) ** 2, 2 * p1 * pi * (1 - pi), p2 * pi**2])
        return w / w.sum(axis=0)

    def dosage(pi):
        return np.tensordot([0, 1, 2], weights(pi), 1)

    part = top(dosage(np.broadcast_to(f, p0.shape)) - 2 * f, 2)[2]
    for _ in range(rounds):
        pi = np.clip(part / 2 + f, 1e-4, 1 - 1e-4)
        part = top(dosage(pi) - 2 * f, 2)[2]
    pi = np.clip(part / 2 + f, 1e-4, 1 - 1e-4)
    variance = 2 * f * (1 - f)
    x = (dosage(pi) - 2 * f) / np.sqrt(variance)
    want = x.T @ x / M
    np.fill_diagonal(want, (sum(w * (copies - 2 * f) ** 2 for copies, w in enumerate(weights(pi))) / variance).mean(axis=0))
    assert np.allclose(cov, want, atol=1e-9)
    lam, vec = np.linalg.eigh(want)
    assert same(model.u[:, :3], vec[:, ::-1][:, :3]) and np.allclose(model.s[:3] ** 2 / M, lam[::-1][:3])


def test_hardy_weinberg(spark, geno, g):
    f = np.nanmean(g, axis=1)
    pi = geno.join(spark.createDataFrame([(i, [float(np.clip(f[i], 0.01, 0.99))] * N) for i in range(M)], "variant_idx long, pi array<double>"), "variant_idx")
    rows = hwe.hwe(pi).orderBy("variant_idx").collect()
    assert all(-1 <= r.inbreeding <= 1 and 0 <= r.hwe_p <= 1 for r in rows)
    assert hwe.inbreeding_by_sample(pi).count() == N
    weights = tuple(np.where(np.isnan(g), hwe.MISSING, g == x) for x in (0.0, 0.5, 1.0))
    even = np.full((M, N), 0.5)
    assert np.allclose(hwe.log_likelihood_ratio(weights, even, np.zeros(M)), 0, atol=1e-9)


def test_selection_scan(geno, g):
    rows = normalize.standardized(geno).persist()
    model = pca.decompose(rows, 2, "full")
    out = selection.galinsky(rows, model.u, model.eigenvalues)
    v = expected_standard(g) @ model.u / model.s
    assert np.allclose(sorted(r.stat for r in out.collect()), sorted((M * v**2).ravel()))
    for residual in ("reference", "regression"):
        scan, gif = selection.pcadapt(rows, model.u, model.eigenvalues, residual)
        stat = np.array([r.stat for r in scan.collect()])
        assert gif == pytest.approx(np.median(stat) / stats.qchisq(0.5, 2)) and scan.where("p < 0 or p > 1").count() == 0


def test_selection_scan_of_many_variants_is_exact(geno, monkeypatch):
    rows = normalize.standardized(geno).persist()
    model = pca.decompose(rows, 2, "full")
    scan, gif = selection.pcadapt(rows, model.u, model.eigenvalues)
    want = {r.variant_idx: (r.stat, r.chi2, r.p) for r in scan.collect()}
    monkeypatch.setattr(selection, "DRIVER_ROWS", M // 2)
    scan, again = selection.pcadapt(rows, model.u, model.eigenvalues)
    assert again == pytest.approx(gif, rel=1e-12)
    assert all(np.allclose((r.stat, r.chi2, r.p), want[r.variant_idx], rtol=1e-9) for r in scan.collect())


def test_statistics():
    assert float(stats.pchisq(3.841458820694124, 1, False)) == pytest.approx(0.05, rel=1e-9)
    assert stats.qchisq(0.95, 3) == pytest.approx(7.814727903251179, rel=1e-9)
    for df in (1, 2, 5, 40):
        x = np.array([1e-8, 0.3, 1.0, df, 3.0 * df, 200.0])
        assert np.allclose(stats.pchisq(x, df) + stats.pchisq(x, df, False), 1)
    assert np.allclose(stats.pchisq(np.array([0.5, 4.0, 90.0]), 1, False), [math.erfc(math.sqrt(x / 2)) for x in (0.5, 4.0, 90.0)], rtol=1e-12)
    assert np.isnan(stats.pchisq(1.0, 0)) and np.isnan(stats.pchisq(np.nan, 1)) and stats.pchisq(np.inf, 2) == 1 and stats.pchisq(-1.0, 2, False) == 1
    assert stats.chisq1(np.nan) == 1 and stats.chisq1(-2.0) == 1
    assert stats.beta_i(2, 3, 0.4) == pytest.approx(0.5248, rel=1e-9)
    assert stats.fisher_exact(3, 1, 1, 3)[3] == pytest.approx(0.4857142857, rel=1e-9)
    assert stats.mad(np.ones(4)) == 1.0


def test_options_are_checked(geno, spark):
    with pytest.raises(ValueError):
        variants.filter_maf(geno, 0.5)
    with pytest.raises(ValueError):
        normalize.normalize_counts(spark.createDataFrame([("a", "b", 1.0)], "feature string, sample string, n double"), -9)
    with pytest.raises(ValueError):
        pca.windowed(normalize.centred(geno), 1, N, bands=5)
