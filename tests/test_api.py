import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenloom import api
from eigenloom.operators import normalize
from eigenloom.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def geno(spark):
    return fx.genotypes(spark, SF).withColumn("g", F.slice("g", 1, 80)).persist()


def test_analyses_run_on_one_model(spark, geno):
    markers = fx.variants(spark)
    model = api.pca(geno, 2)
    assert model.u.shape == (80, 2)
    reference = normalize.standardized(geno).select("variant_idx", "af").join(model.packed_loadings, "variant_idx")
    u = api.project_samples(geno, markers, markers, reference, model.s, mode=1)
    assert np.allclose(u, model.u, atol=1e-8)
    assert api.selection_scan(geno, model, 2).count() == 64
    rows = api.ld_rows(geno, model)
    assert api.ld_prune(rows, markers, 0.2, 4000).where("keep").count() > 0
    assert len(api.ld_clump(rows, markers, [fx.associations(spark)], 0.01, 0.02, 0.05, 4000)) == 1
    plain = api.pca(geno, 1, standardize=False)
    assert api.hardy_weinberg(normalize.centred(geno).select("variant_idx", "g", "af"), plain).count() == 64
    study = api.ld_study(geno, markers, 1, window_bp=4000, bins=4)
    assert study["adjusted"].count() == 4 and study["standard_background"].count() == 1


def test_counts(spark):
    model, names = api.pca_counts(fx.counts(spark, SF), 2)
    assert model.u.shape == (len(names), 2)


def test_options_are_checked(spark, geno):
    markers = fx.variants(spark)
    model = api.pca(geno, 1)
    for bad in (lambda: api.project_samples(geno, markers, markers, markers, model.s, mode=4), lambda: api.selection_scan(geno, model, 3), lambda: api.ld_prune(geno, markers, 0.0), lambda: api.hardy_weinberg(geno.withColumn("af", F.lit(0.5)), model)):
        with pytest.raises(ValueError):
            bad()
