import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenloom.operators import em, ld, normalize, pca
from eigenloom.plans import fixtures as fx
from eigenloom.plans.formats import fixture_matrix
from eigenloom.sources import sinks

SF = "/root/testdata/sf0.001"


def test_torn_chromosomes_are_an_error(spark):
    rows = [(0, "1"), (1, "2"), (2, "1")]
    with pytest.raises(ValueError):
        ld.chromosome_runs(spark.createDataFrame(rows, "variant_idx long, chr string"))


def test_residuals_of_a_model(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(7, 5))
    u, s, v = rng.normal(size=(5, 2)), np.array([3.0, 2.0]), rng.normal(size=(7, 2))
    rows = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "variant_idx long, x array<double>")
    loadings = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(v)], "variant_idx long, v array<double>")
    got = {r.variant_idx: r.r for r in pca.residuals_of_model(rows, u, s, loadings).collect()}
    assert np.allclose(np.array([got[i] for i in range(7)]), x - v @ np.diag(s) @ u.T)


def test_rows_are_numbered_by_rank_of_their_names(spark):
    cells = spark.createDataFrame([(f"f{i:05d}", s, float(i)) for i in range(1200) for s in "ab"], "feature string, sample string, x double")
    rows, samples = normalize.pack_counts(cells)
    assert samples == ["a", "b"] and all(r.id == f"f{r.variant_idx:05d}" for r in rows.select("variant_idx", "id").collect())


def test_log_and_square(spark, tmp_path):
    sinks.write_log(spark, str(tmp_path / "log"), [("2020-01-01", "begun"), ("2020-01-02", "done")])
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["[2020-01-01] begun", "[2020-01-02] done"]
    rows = spark.createDataFrame([(1, [2.0, 1.0]), (0, [1.0, 0.5])], "i long, row array<double>")
    sinks.write_square(rows, str(tmp_path / "cov"), "i", "row")
    assert sorted(r.value.split("\t")[1] for r in spark.read.text(str(tmp_path / "cov")).collect()) == ["0.500000", "1.00000"]


def numpy_emu(g, k, rounds, tol):
    """Rounds of imputing missing cells from the truncated decomposition of the centred matrix."""
    miss = np.isnan(g)
    f = np.nanmean(g, axis=1, keepdims=True)
    x = np.where(miss, 0, g - f)
    before = None
    for _ in range(rounds):
        u, s, vt = np.linalg.svd(x.T, full_matrices=False)
        u = u[:, :k]
        if before is not None and np.sqrt(np.mean((np.abs(u) - np.abs(before)) ** 2)) < tol:
            break
        before = u
        low = (u * s[:k] @ vt[:k]).T
        x = np.where(miss, np.clip(low + f, 1e-4, 1 - 1e-4) - f, x)
    return f, x


def test_emu_imputes_as_numpy_does(spark):
    """The scores of a run to convergence span the same line as those of the same rounds in numpy."""
    g = fixture_matrix(spark, SF)
    model = em.emu(fx.genotypes(spark, SF), 2, "full", max_iter=50, tol=1e-7)
    f, x = numpy_emu(g, 2, 50, 1e-9)
    scaled = x * np.where(f * (1 - f) > 1e-18, np.sqrt(2) / np.sqrt(f * (1 - f)), 1)
    want = np.linalg.svd(scaled.T, full_matrices=False)[0][:, :1]
    got = np.array([r.u for r in model.scores().where(F.col("pc") == 1).orderBy("sample_idx").collect()])
    assert abs(float(want[:, 0] @ got)) > 0.999
