"""Registered queries against their SQL, by DuckDB over the same tables."""

import duckdb
import pytest

import __spark_entry__
import eigenloom.plans.formats  # noqa: F401
from eigenloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "customer lineitem orders part supplier embeddings events".split()
CHOSEN = (
    "allele_freq missing_rate_by_sample genotype_class_counts maf_filter cpmed_normalized zero_filled_counts feature_gram pca_full_spectrum pca_loadings eigvecs_with_ids "
    "marker_match marker_match_identical band_permutation projection_pc1_lsq projection_gl_em projection_bootstrap_summary selection_galinsky selection_pcadapt em_allele_freq "
    "source_bed source_pgen source_beagle source_counts source_residuals source_vectors source_spectrum source_mbim source_pvar source_samples source_associations sink_pairs sink_scores_with_ids sink_statistics ld_cumulative_mean chromosome_runs "
    "hwe_inbreeding hwe_pvalue inbreeding_per_sample ld_r2_adjusted ld_prune_highmaf ld_clump ld_decay_bins ld_cross_chr_mean emu_pca pcangsd_first_component rsvd_vs_exact lanczos_vs_exact"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = duck.execute(ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    assert got == sorted(repr(tuple(r[at.index(c)] for c in columns)) for r in found.fetchall())
    spark.catalog.clearCache()


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(QUERIES) <= set(queries)
    assert __spark_entry__.entry(spark).count() == 500
