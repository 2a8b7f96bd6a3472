"""Steps that must not hold samples by samples, or all samples of many rows, in one place."""

import numpy as np
import pytest

from eigenloom.operators import em, ld, pca, project
from eigenloom.operators import matrix as mx
from eigenloom.plans import fixtures as fx
from eigenloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return con


@pytest.fixture
def sent(monkeypatch):
    """Sizes of the arrays that reach the driver as sums."""
    sizes, real = [], mx.sum_arrays

    def watched(*args):
        out = real(*args)
        sizes.extend(v.size for v in out.values())
        return out

    for module in (mx, em, pca, project):
        monkeypatch.setattr(module, "sum_arrays", watched)
    return sizes


def cells(df):
    return {(r.i, r.j): r.k for r in df.collect()}


@pytest.mark.parametrize("name", ["gl_covariance", "grm_samples"])
def test_samples_by_samples_in_blocks(spark, duck, sent, monkeypatch, name):
    monkeypatch.setattr(mx, "SIDE", 150)  # four blocks, the last one narrower
    monkeypatch.setattr(mx, "PIECE", 10)  # several pieces of variants
    got = cells(QUERIES[name](spark, SF))
    want = {(i, j): k for i, j, k in duck.execute(f"SELECT i, j, k FROM ({ORACLES[name]})").fetchall()}
    assert len(got) == 500 * 501 // 2 and set(got) == set(want)
    assert np.abs(np.array([got[x] - want[x] for x in want])).max() < 1.5e-6
    assert max(sent, default=0) < 500 * 500


@pytest.mark.parametrize("m,n", [(45, 30), (30, 45)])
def test_background_by_blocks_of_either_side(spark, sent, monkeypatch, m, n):
    for module in (mx, ld):
        monkeypatch.setattr(module, "SIDE", 8)
    monkeypatch.setattr(mx, "PIECE", 7)
    x = np.random.default_rng(m).standard_normal((m, n))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "variant_idx long, r array<double>").repartition(3)
    markers = spark.createDataFrame([(i, str(i % 3)) for i in range(m)], "variant_idx long, chr string")
    r2 = [np.corrcoef(x[i], x[k])[0, 1] ** 2 for i in range(m) for k in range(i) if i % 3 != k % 3]
    got = ld.background_mean(rows, markers).first()
    assert got.n_pairs == len(r2) and got.mean_r2 == pytest.approx(np.mean(r2), rel=1e-9)
    r2 = [np.corrcoef(x[i], x[k])[0, 1] ** 2 for i in range(0, m, 3) for k in range(2, m, 3)]
    got = ld.cross_chromosome_mean(rows, markers, "0", "2").first()
    assert got.n_pairs == len(r2) and got.mean_r2 == pytest.approx(np.mean(r2), rel=1e-9)
    assert not sent


def test_background_of_many_samples_sends_variants_by_variants(spark, duck, sent):
    got = QUERIES["ld_cross_chr_mean"](spark, SF).first()
    assert tuple(got) == duck.execute(ORACLES["ld_cross_chr_mean"]).fetchone()
    assert sent and max(sent) <= 64 * 64


@pytest.mark.parametrize("name", ["rsvd_vs_exact", "winsvd_vs_exact", "pca_pc1_power", "lanczos_vs_exact"])
def test_iterations_send_vectors_of_the_smaller_side(spark, duck, sent, name):
    df = QUERIES[name](spark, SF)
    order = ", ".join(df.columns).replace("check", '"check"')
    want = duck.execute(f"SELECT {order} FROM ({ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    assert sent and max(sent) <= 64 * 64  # 64 variants, 500 samples


@pytest.mark.parametrize("m,n,high", [(12, 40, 1.0), (12, 40, 60.0), (40, 25, 1.0)])
def test_components_of_a_covariance_that_is_not_formed(spark, sent, m, n, high):
    rng = np.random.default_rng(5)
    x, e = rng.standard_normal((m, n)), rng.random((m, n)) * high / m
    x[:, : n // 2] += 2 * rng.choice([-1, 1], m)[:, None]
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, e, strict=True))], "variant_idx long, x array<double>, e array<double>").repartition(3)
    lam, vec = np.linalg.eigh(x.T @ x + np.diag(e.sum(axis=0)))
    u, s = em.covariance_components(rows, 2, n, m)
    assert np.allclose(s**2, lam[:-3:-1], rtol=1e-9)
    assert np.allclose(np.abs(u.T @ vec[:, :-3:-1]), np.eye(2), atol=1e-8)
    assert max(sent) < n * n


def test_first_component_of_likelihoods_without_their_covariance(spark, duck, sent):
    got = {r.sample_idx: r.u for r in QUERIES["pcangsd_first_component"](spark, SF).collect()}
    want = dict(duck.execute(f"SELECT sample_idx, u FROM ({ORACLES['pcangsd_first_component']})").fetchall())
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1.5e-6
    assert max(sent) < 500 * 500


def test_two_components_of_likelihoods(spark, sent):
    rows = QUERIES["pcangsd_pca"](spark, SF).collect()
    assert max(sent) < 500 * 500
    got = np.full((500, 2), np.nan)
    for r in rows:
        got[r.sample_idx, r.pc - 1] = r.u
    gl = fx.likelihoods(spark, SF).persist()
    whole, cov = em.pcangsd(gl, 1, "full")  # the operator's own end
    gl.unpersist()
    assert cov.shape == (500, 500) and np.abs(got - whole.u[:, :2]).max() < 1e-5


def test_rows_come_in_slices(spark, duck, sent):
    rows = spark.range(0, 40, 1, 1).selectExpr("id", "array_repeat(double(id), 100000) AS x")  # 32 MB

    def height(b):
        return mx.batch_of("id long, n long", mx.column_of(b, "id"), [b.num_rows] * b.num_rows)

    seen = mx.map_rows(rows, height, "id long, n long").collect()
    assert sorted(r.id for r in seen) == list(range(40)) and max(r.n for r in seen) <= 11
    got = {r.variant_idx: r.v for r in QUERIES["pca_loadings"](spark, SF).collect()}
    want = dict(duck.execute(f"SELECT variant_idx, v FROM ({ORACLES['pca_loadings']})").fetchall())
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1.5e-6
    assert max(sent) <= 64 * 64  # no sum over samples


def test_bootstrap_by_blocks_of_samples(spark, sent, monkeypatch):
    monkeypatch.setattr(project, "VARIANTS_AT_ONCE", 5)
    m, n, replicates = 17, 23, 3
    rng = np.random.default_rng(3)
    x, v, w, s = rng.standard_normal((m, n)), rng.standard_normal((m, 2)), rng.integers(0, 3, (m, replicates)).astype(float), np.array([2.0, 1.0])
    x[rng.random((m, n)) < 0.2] = np.nan
    x[1:, 4] = np.nan  # too few values for two components
    data = [(i, [None if np.isnan(y) else float(y) for y in x[i]], v[i].tolist(), w[i].tolist()) for i in range(m)]
    rows = spark.createDataFrame(data, "variant_idx long, x array<double>, v array<double>, w array<double>").repartition(4)

    def fit(weight):
        out = np.full((n, 2), np.nan)
        for i in range(n):
            seen = ~np.isnan(x[:, i])
            if (weight * seen).sum() >= 2:
                root = np.sqrt(weight[seen])[:, None]
                out[i] = np.linalg.lstsq(root * v[seen] * s, root[:, 0] * x[seen, i], rcond=None)[0]
        return out

    base = project.project_least_squares(rows, s)
    assert np.allclose(base, fit(np.ones(m)), equal_nan=True)
    got = np.full((replicates, n, 2), np.nan)
    reps = project.bootstrap(rows, s, base, replicates, at_once=replicates * 7 * 4).collect()  # four samples at a time
    for r in reps:
        got[r.replicate, r.sample_idx, r.pc - 1] = np.nan if r.u is None else r.u
    want = np.stack([fit(w[:, r]) for r in range(replicates)])
    sign = np.sign(np.nansum(want * base, axis=1, keepdims=True))
    assert len(reps) == replicates * n * 2 and np.allclose(got, want * sign, equal_nan=True)
    assert max(sent) <= replicates * 2  # of all sums, the driver gets those of the signs
