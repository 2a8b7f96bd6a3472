"""Registered queries of the matrix engine, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenloom.functions.stats import chi_square_tail
from eigenloom.operators import em, hwe, ld, normalize, pca, project, selection, variants
from eigenloom.operators.matrix import gram_cells
from eigenloom.plans import fixtures as fx
from eigenloom.plans import oracle as o

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LD_BP, LD_R2, EM_STEPS, HWE_STEPS, EMU_ROUNDS, GL_ROUNDS = 8000, 0.2, 10, 2, 6, 4


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def from_numpy(spark: SparkSession, **columns) -> DataFrame:
    return spark.createDataFrame(pa.table(columns))


def long_form(rows: DataFrame, column: str, name: str = "x") -> DataFrame:
    return rows.select("variant_idx", F.posexplode(column).alias("sample_idx", name)).select("variant_idx", F.col("sample_idx").cast("long").alias("sample_idx"), (r6(name) + F.lit(0.0)).alias(name))


GX, SELECT_V = o.BASE["gx"], "v::BIGINT AS variant_idx"

# -- frequencies, missing values, filters ---------------------------------------------------------------------


@register(o.query([*GX, *o.frequency()], f"SELECT {SELECT_V}, round(f, 6) AS af FROM af"))
def allele_freq(spark, sf_dir):
    return variants.with_frequency(fx.genotypes(spark, sf_dir)).select("variant_idx", r6("af").alias("af"))


@register(o.query(GX, f"SELECT {SELECT_V}, count(*) FILTER (g IS NULL)::BIGINT AS n_missing, round(count(*) FILTER (g IS NULL) / count(*)::DOUBLE, 6) AS rate FROM gx GROUP BY v"))
def missing_rate_by_variant(spark, sf_dir):
    return variants.missing_by_variant(fx.genotypes(spark, sf_dir)).withColumn("rate", r6("rate"))


@register(o.query(GX, "SELECT s::BIGINT AS sample_idx, count(*) FILTER (g IS NULL)::BIGINT AS n_missing, round(count(*) FILTER (g IS NULL) / count(*)::DOUBLE, 6) AS rate FROM gx GROUP BY s"))
def missing_rate_by_sample(spark, sf_dir):
    return variants.missing_by_sample(fx.genotypes(spark, sf_dir)).select(F.col("sample_idx").cast("long").alias("sample_idx"), "n_missing", r6("rate").alias("rate"))


@register(o.query(GX, "SELECT count(*) FILTER (g IS NULL)::BIGINT AS n_missing, round(count(*) FILTER (g IS NULL) / count(*)::DOUBLE, 6) AS rate FROM gx"))
def missing_rate_total(spark, sf_dir):
    return variants.missing_rate(fx.genotypes(spark, sf_dir)).select(F.col("n_missing").cast("long").alias("n_missing"), r6("rate").alias("rate"))


@register(o.query(GX, f"SELECT {SELECT_V}, count(*) FILTER (g = 0)::BIGINT AS n0, count(*) FILTER (g = 0.5)::BIGINT AS n1, count(*) FILTER (g = 1)::BIGINT AS n2, count(*) FILTER (g IS NULL)::BIGINT AS n_missing FROM gx GROUP BY v"))
def genotype_class_counts(spark, sf_dir):
    return variants.class_counts(fx.genotypes(spark, sf_dir))


@register(o.query([*GX, *o.frequency()], f"SELECT {SELECT_V}, round(f, 6) AS af FROM af WHERE least(f, 1 - f) > 0.4::DOUBLE"))
def maf_filter(spark, sf_dir):
    return variants.filter_maf(fx.genotypes(spark, sf_dir), 0.4).select("variant_idx", r6("af").alias("af"))


@register(o.query([*GX, *o.frequency()], "SELECT count(*)::BIGINT AS n_variants, count(*) FILTER (f IN (0, 1))::BIGINT AS n_fixed, count(*) FILTER (f = 0.5)::BIGINT AS n_half FROM af"))
def frequency_warnings(spark, sf_dir):
    return variants.quality_counts(fx.genotypes(spark, sf_dir))


# -- normalising ------------------------------------------------------------------------------------------------

CELLS = "SELECT v::BIGINT AS variant_idx, s::BIGINT AS sample_idx, round(x, 6) + 0.0::DOUBLE AS x FROM "


@register(o.query([*GX, *o.centred()], CELLS + "xc"))
def centered_genotypes(spark, sf_dir):
    return long_form(normalize.centred(fx.genotypes(spark, sf_dir)), "x")


@register(o.query([*GX, *o.standardized()], CELLS + "xs"))
def standardized_genotypes(spark, sf_dir):
    return long_form(normalize.standardized(fx.genotypes(spark, sf_dir)), "x")


@register(o.query([*GX, *o.standardized(ploidy=1)], CELLS + "xs"))
def haploid_standardized(spark, sf_dir):
    return long_form(normalize.standardized(fx.genotypes(spark, sf_dir), ploidy=1), "x")


CX = o.BASE["cx"]
LIB = "lib AS (SELECT sample, sum(n) AS l FROM cx GROUP BY sample)"
Z = "SELECT feature, sample, round((x - avg(x) OVER w) / (CASE WHEN stddev_samp(x) OVER w > 1e-10 THEN stddev_samp(x) OVER w ELSE 1 END), 6) AS x FROM t WINDOW w AS (PARTITION BY feature)"


@register(o.query([*CX, LIB], "SELECT sample, l AS library FROM lib"))
def library_size(spark, sf_dir):
    return normalize.library_size(fx.counts(spark, sf_dir))


@register(o.query([*CX, LIB], "SELECT floor(median(l))::DOUBLE AS median FROM lib"))
def median_library_size(spark, sf_dir):
    sizes = normalize.library_size(fx.counts(spark, sf_dir))
    return sizes.agg(normalize.median_library(sizes).alias("median"))


def _scaled(scale: int, factor: float = 1.0) -> Query:
    return lambda spark, sf_dir: normalize.normalize_counts(fx.counts(spark, sf_dir), scale, factor).select("feature", "sample", r6("x").alias("x"))


register(o.query([*CX, "t AS (SELECT feature, sample, n AS x FROM cx)"], Z), "zscore_features")(_scaled(1))
register(o.query([*CX, LIB, "t AS (SELECT feature, sample, log10(n * (SELECT floor(median(l)) FROM lib) / l + 1) AS x FROM cx JOIN lib USING (sample))"], Z), "cpmed_normalized")(_scaled(2))
register(o.query([*CX, LIB, "t AS (SELECT feature, sample, ln(1 + n / l * 10000) AS x FROM cx JOIN lib USING (sample))"], Z), "log1p_normalized")(_scaled(3, 10_000))
register(o.query([*CX, LIB, "t AS (SELECT feature, sample, n / l * 10000 AS x FROM cx JOIN lib USING (sample))"], Z), "relative_counts")(_scaled(4, 10_000))
register(o.query(CX, "SELECT feature, sample, n AS x FROM cx"), "raw_counts")(_scaled(0))


@register("""WITH c AS (SELECT p_brand || '/' || p_type AS feature, l_suppkey::VARCHAR AS sample, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT feature, sample, coalesce(n, 0)::DOUBLE AS n FROM (SELECT DISTINCT feature FROM c) CROSS JOIN (SELECT DISTINCT sample FROM c) LEFT JOIN c USING (feature, sample)""")
def zero_filled_counts(spark, sf_dir):
    items, part = fx.table(spark, sf_dir, "lineitem"), fx.table(spark, sf_dir, "part")
    counted = items.join(part, items["l_partkey"] == part["p_partkey"]).groupBy(F.concat_ws("/", "p_brand", "p_type").alias("feature"), F.col("l_suppkey").cast("string").alias("sample")).agg(F.count("*").cast("double").alias("n"))
    return normalize.zero_filled(counted)


# -- Gram matrices and components -----------------------------------------------------------------------------------


def upper(spark: SparkSession, k: np.ndarray) -> DataFrame:
    i, j = np.triu_indices(len(k))
    return from_numpy(spark, i=i.astype(np.int64), j=j.astype(np.int64), k=np.round(k[i, j], 6) + 0.0)


@register(o.query([*GX, *o.standardized()], "SELECT a.s::BIGINT AS i, b.s::BIGINT AS j, round(sum(a.x * b.x) / 64, 6) + 0.0::DOUBLE AS k FROM xs a JOIN xs b ON a.v = b.v AND a.s <= b.s GROUP BY ALL"))
def grm_samples(spark, sf_dir):
    geno = fx.genotypes(spark, sf_dir)
    return gram_cells(normalize.standardized(geno), pca.dimensions(geno, "g")[0], lambda k: np.round(k / fx.VARIANTS, 6) + 0.0)


@register(o.query([*GX, *o.standardized()], "SELECT a.v::BIGINT AS i, b.v::BIGINT AS j, round(sum(a.x * b.x) / 64, 6) + 0.0::DOUBLE AS k FROM xs a JOIN xs b ON a.s = b.s AND a.v <= b.v GROUP BY ALL"))
def feature_gram(spark, sf_dir):
    x = normalize.standardized(fx.genotypes(spark, sf_dir)).persist()
    gram, _ = pca.feature_gram(x)
    x.unpersist()
    return upper(spark, gram / fx.VARIANTS)


@register(o.query([*GX, *o.standardized()], "SELECT round(sum(x * x) / 64, 6) AS total FROM xs"))
def total_variance(spark, sf_dir):
    x = normalize.standardized(fx.genotypes(spark, sf_dir))
    return x.agg((F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)) / fx.VARIANTS).alias("t")).select(r6("t").alias("total"))


def components(spark: SparkSession, sf_dir: str, k: int = 1, scale: str = "standardized", method: str = "full", **options) -> tuple[DataFrame, pca.PCAModel]:
    rows = (normalize.standardized if scale == "standardized" else normalize.centred)(fx.genotypes(spark, sf_dir)).persist()
    return rows, pca.decompose(rows, k, method, scale, **options)


SAMPLES = "(SELECT count(*) FROM embeddings)"


@register(o.query([*GX, *o.standardized(), "k AS (SELECT a.v AS i, b.v AS j, sum(a.x * b.x) / 64 AS k FROM xs a JOIN xs b USING (s) GROUP BY ALL)"], "SELECT 64::BIGINT AS n_components, round(sum(k) FILTER (i = j), 5) AS sum_eig, round(sum(k * k), 4) AS sum_eig2 FROM k"))
def pca_full_spectrum(spark, sf_dir):
    _, model = components(spark, sf_dir, k=fx.VARIANTS)
    e = model.eigenvalues
    return from_numpy(spark, n_components=[len(e)], sum_eig=[round(float(e.sum()), 5)], sum_eig2=[round(float((e**2).sum()), 4)])


PC1 = [*GX, *o.standardized(), *o.component("xs")]


@register(o.query(PC1, "SELECT 1 AS pc, round(sig, 6) AS sigval, round(sig * sig / 64, 6) AS eigval FROM ps"))
def pca_pc1_spectrum(spark, sf_dir):
    return components(spark, sf_dir)[1].spectrum().select("pc", r6("sigval").alias("sigval"), r6("eigval").alias("eigval"))


@register(o.query(PC1, "SELECT s::INTEGER AS sample_idx, 1 AS pc, round(u, 6) AS u FROM pu"))
def pca_scores(spark, sf_dir):
    return components(spark, sf_dir)[1].scores().select("sample_idx", "pc", r6("u").alias("u"))


@register(o.query(PC1, f"SELECT {SELECT_V}, 1 AS pc, round(w, 6) AS v FROM pv"))
def pca_loadings(spark, sf_dir):
    return components(spark, sf_dir)[1].loadings().select("variant_idx", "pc", r6("v").alias("v"))


@register(o.query(PC1, "SELECT s::INTEGER AS sample_idx, 1 AS pc, round(u, 6) AS u FROM pu"))
def pca_pc1_power(spark, sf_dir):
    rows, model = components(spark, sf_dir, method="rsvd", max_passes=12, tol=0.0)
    return model.scores().select("sample_idx", "pc", r6("u").alias("u"))


@register(o.query([*PC1, *o.BASE["sm"]], "SELECT fid, iid, round(u, 6) AS pc1, round(sig * sig / 64, 6) AS eigval FROM pu JOIN sm ON sample_idx = s, ps"))
def eigvecs_with_ids(spark, sf_dir):
    _, model = components(spark, sf_dir)
    scores = model.scores().groupBy("sample_idx").pivot("pc", [1]).agg(F.first("u")).withColumnRenamed("1", "pc1")
    return fx.samples(spark, sf_dir).join(scores, "sample_idx").select("fid", "iid", r6("pc1").alias("pc1"), F.lit(round(float(model.eigenvalues[0]), 6)).alias("eigval"))


def _agrees(method: str, **options) -> Query:
    def run(spark, sf_dir):
        rows, exact = components(spark, sf_dir, k=3)
        other = pca.decompose(rows, 3, method, **options)
        same = [abs(other.s[0] / exact.s[0] - 1) < 1e-6, pca.rmse(exact.u[:, :1], other.u[:, :1]) < 1e-4, pca.mev(exact.u, other.u) > 0.99]
        return from_numpy(spark, check=["sigval", "scores", "span"], agrees=[bool(x) for x in same])

    return run


AGREES = "SELECT unnest(['sigval', 'scores', 'span']) AS \"check\", true AS agrees"
register(AGREES, "rsvd_vs_exact")(_agrees("rsvd", tol=1e-7))
register(AGREES, "winsvd_vs_exact")(_agrees("winsvd", bands=4, max_passes=8))
register(AGREES, "lanczos_vs_exact")(_agrees("lanczos"))


@register(o.query([*PC1, *o.BASE["vr"]], "SELECT v::BIGINT AS variant_idx, chr, round(max(abs(w)) OVER (PARTITION BY chr ORDER BY v ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS running_max FROM pv JOIN vr ON variant_idx = v"))
def loadings_running_max(spark, sf_dir):
    loads = components(spark, sf_dir)[1].loadings().join(fx.variants(spark).select("variant_idx", "chr"), "variant_idx")
    return variants.running_max(loads, 5).select("variant_idx", "chr", r6("running_max").alias("running_max"))


# -- markers and filesets --------------------------------------------------------------------------------------------

MATCH = """exact AS (SELECT t.variant_idx, r.variant_idx AS ref_idx, false AS flip FROM tb t JOIN vr r USING (chr, bp, a1, a2)),
both_ AS (SELECT * FROM exact UNION ALL SELECT t.variant_idx, r.variant_idx, true FROM tb t JOIN vr r ON t.chr = r.chr AND t.bp = r.bp AND t.a1 = r.a2 AND t.a2 = r.a1 WHERE t.variant_idx NOT IN (SELECT variant_idx FROM exact))"""


@register(o.query([*o.BASE["tb"], MATCH], "SELECT variant_idx, ref_idx, flip FROM both_"))
def marker_match(spark, sf_dir):
    return variants.match_markers(fx.target_markers(spark), fx.variants(spark))


@register(o.query([*o.BASE["tb"], MATCH], "SELECT flip, count(*)::BIGINT AS n FROM both_ GROUP BY flip"))
def marker_match_flips(spark, sf_dir):
    return marker_match(spark, sf_dir).groupBy("flip").agg(F.count("*").alias("n"))


@register(o.query([*o.BASE["tb"], MATCH], "SELECT 'target' AS list, false AS identical, (SELECT count(*) FROM tb)::BIGINT AS n_target, 64::BIGINT AS n_reference UNION ALL SELECT 'self', true, 64, 64"))
def marker_match_identical(spark, sf_dir):
    v = fx.variants(spark)
    lists = [("target", fx.target_markers(spark)), ("self", v)]
    out = [variants.markers_identical(t, v).withColumn("list", F.lit(n)) for n, t in lists]
    return out[0].unionByName(out[1]).select("list", "identical", "n_target", "n_reference")


@register(o.query(o.BASE["vr"], "SELECT variant_idx, chr || '_' || bp || '_' || a1 || '_' || a2 AS key, a1 AS allele FROM vr"))
def beagle_allele_decode(spark, sf_dir):
    code = lambda a: F.translate(a, "ACGT", "0123")
    coded = fx.variants(spark).select("variant_idx", "chr", "bp", code("a1").alias("c1"), code("a2").alias("c2"))
    a1, a2 = variants.decode_beagle_allele(F.col("c1")), variants.decode_beagle_allele(F.col("c2"))
    return coded.select("variant_idx", variants.marker_key(F.col("chr"), F.col("bp"), a1, a2).alias("key"), a1.alias("allele"))


@register(o.query(o.BASE["vr"], "SELECT (CASE WHEN variant_idx < 20 THEN variant_idx ELSE variant_idx END)::BIGINT AS variant_idx, id FROM vr"))
def merge_filesets(spark, sf_dir):
    v = fx.variants(spark).select("variant_idx", "id")
    return variants.merge_filesets([(v.where("variant_idx < 20"), 20), (v.where("variant_idx >= 20").withColumn("variant_idx", F.col("variant_idx") - 20), 44)])


STARTS = variants.band_starts(fx.VARIANTS, 6)


@register(o.query(o.BASE["vr"], f"SELECT variant_idx, (variant_idx % 6)::INTEGER AS band, (list_extract({STARTS}, (variant_idx % 6 + 1)::INTEGER) + variant_idx // 6)::BIGINT AS permuted_idx FROM vr"))
def band_permutation(spark, sf_dir):
    return variants.band_permutation(fx.variants(spark).select("variant_idx"), fx.VARIANTS, 6)


# -- projection ------------------------------------------------------------------------------------------------------

HALVES = ["ge AS MATERIALIZED (SELECT * FROM gx WHERE s % 2 = 0)", "godd AS MATERIALIZED (SELECT * FROM gx WHERE s % 2 = 1)"]
REF = [*GX, *HALVES, *o.standardized("ge", "e"), *o.component("exs")]
TARGET = "tg AS MATERIALIZED (SELECT v, (s - 1) // 2 AS s, (g - f) * sqrt(2::DOUBLE) / sqrt(f * (1 - f)) AS x, w FROM godd JOIN eaf USING (v) JOIN pv USING (v))"


def halves(spark: SparkSession, sf_dir: str, scale: str = "standardized") -> tuple[DataFrame, DataFrame, pca.PCAModel]:
    """Odd samples matched to a model of the even ones: (target rows, reference rows, model)."""
    geno = fx.genotypes(spark, sf_dir).persist()
    part = lambda k: geno.select("variant_idx", F.filter("g", lambda x, i: i % 2 == k).alias("g"))
    ref = (normalize.standardized if scale == "standardized" else normalize.centred)(part(0)).persist()
    model = pca.decompose(ref, 1, "full", scale)
    reference = ref.select("variant_idx", "af").join(model.packed_loadings, "variant_idx")
    matches = variants.match_markers(fx.variants(spark), fx.variants(spark))
    return project.matched_rows(part(1), matches, reference, scale == "standardized"), reference, model


def scores(spark: SparkSession, u: np.ndarray) -> DataFrame:
    return from_numpy(spark, sample_idx=np.repeat(np.arange(len(u)), u.shape[1]), pc=np.tile(np.arange(1, u.shape[1] + 1), len(u)).astype(np.int32), u=np.round(u.ravel(), 6))


@register(o.query([*REF, TARGET], "SELECT s::BIGINT AS sample_idx, 1 AS pc, round(sum(coalesce(x, 0) * w) / any_value(sig), 6) AS u FROM tg, ps GROUP BY s"))
def projection_pc1_meanimpute(spark, sf_dir):
    rows, _, model = halves(spark, sf_dir)
    return scores(spark, project.project_mean(rows, model.s))


@register(o.query([*REF, TARGET], "SELECT s::BIGINT AS sample_idx, 1 AS pc, round(sum(x * w * sig) FILTER (x IS NOT NULL) / sum(w * w * sig * sig) FILTER (x IS NOT NULL), 6) AS u FROM tg, ps GROUP BY s"))
def projection_pc1_lsq(spark, sf_dir):
    rows, _, model = halves(spark, sf_dir)
    return scores(spark, project.project_least_squares(rows, model.s))


GL_STEPS = 3
REFC = [*GX, *HALVES, *o.centred("ge", "e"), *o.component("exc")]


def _gl_projection() -> str:
    like = "lo AS MATERIALIZED (SELECT v, (s - 1) // 2 AS s, p0, p1, 1 - p0 - p1 AS p2, f, w * sig AS d FROM lx JOIN eaf USING (v) JOIN pv USING (v), ps WHERE s % 2 = 1)"
    out, post = [like], "(p1 * 2 * pi * (1 - pi) + 2 * p2 * pi * pi) / (p0 * (1 - pi) * (1 - pi) + p1 * 2 * pi * (1 - pi) + p2 * pi * pi) / 2 - f"
    for t in range(GL_STEPS + 1):
        pi = "f" if not t else f"greatest(1e-4, least(1 - 1e-4, u * d / 2 + f))"
        src = "lo" if not t else f"lo JOIN z{t - 1} USING (s)"
        out.append(f"z{t} AS MATERIALIZED (SELECT s, sum(d * ({post})) / sum(d * d) AS u FROM (SELECT *, {pi} AS pi FROM {src}) GROUP BY s)")
    return o.query([*REFC, *o.BASE["lx"], *out], f"SELECT s::BIGINT AS sample_idx, 1 AS pc, round(u, 6) AS u FROM z{GL_STEPS}")


@register(_gl_projection())
def projection_gl_em(spark, sf_dir):
    _, reference, model = halves(spark, sf_dir, "centred")
    odd = lambda c: F.filter(c, lambda x, i: i % 2 == 1).alias(c)
    gl = fx.likelihoods(spark, sf_dir).select("variant_idx", odd("p0"), odd("p1"))
    rows = project.matched_rows(gl, variants.match_markers(fx.variants(spark), fx.variants(spark)), reference, False).persist()
    return scores(spark, project.project_likelihoods(rows, model.s, iterations=GL_STEPS))


REPLICATES = 8
DRAWS = f"dr AS (SELECT v, r, (v * 31 + r * 17 + (v * r) % 7) % 3 AS w FROM (SELECT unnest(range(64)) AS v) CROSS JOIN (SELECT unnest(range({REPLICATES})) AS r))"
BOOT = [
    *REF,
    TARGET.replace("w FROM", "w AS load FROM"),
    DRAWS,
    "b0 AS MATERIALIZED (SELECT s, sum(x * load * sig) FILTER (x IS NOT NULL) / sum(load * load * sig * sig) FILTER (x IS NOT NULL) AS u FROM tg, ps GROUP BY s)",
    "b1 AS MATERIALIZED (SELECT s, r, sum(dr.w * x * load * sig) FILTER (x IS NOT NULL) / sum(dr.w * load * load * sig * sig) FILTER (x IS NOT NULL) AS u FROM tg JOIN dr USING (v), ps GROUP BY s, r)",
    "sg AS MATERIALIZED (SELECT r, sign(sum(b1.u * b0.u)) AS g FROM b1 JOIN b0 USING (s) GROUP BY r)",
    "bt AS MATERIALIZED (SELECT s, r, b1.u * g AS u, b0.u AS base FROM b1 JOIN b0 USING (s) JOIN sg USING (r))",
]


def bootstrapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, _, model = halves(spark, sf_dir)
    v = F.col("variant_idx")
    w = F.array(*(((v * 31 + r * 17 + (v * r) % 7) % 3).cast("double") for r in range(REPLICATES)))
    rows = rows.withColumn("w", w).persist()
    base = project.project_least_squares(rows, model.s)
    return project.bootstrap(rows, model.s, base, REPLICATES), project.scores_table(rows, base)


@register(o.query(BOOT, "SELECT s::INTEGER AS sample_idx, 1 AS pc, round(any_value(base), 6) AS baseline, round(avg(u), 6) AS mean, round(stddev_samp(u), 6) AS se, round(min(u), 6) AS \"min\", round(max(u), 6) AS \"max\", round(sqrt(avg((u - base) * (u - base))), 6) AS rmsd FROM bt GROUP BY s"))
def projection_bootstrap_summary(spark, sf_dir):
    reps, base = bootstrapped(spark, sf_dir)
    out = project.bootstrap_summary(reps, base)
    return out.select("sample_idx", "pc", *(r6(c).alias(c) for c in ("baseline", "mean", "se", "min", "max", "rmsd")))


@register(o.query(BOOT, "SELECT s::INTEGER AS sample_idx, 1 AS pc_a, 1 AS pc_b, round(var_samp(u), 6) AS var_a, round(var_samp(u), 6) AS var_b, round(var_samp(u), 6) AS cov, 1.0::DOUBLE AS corr FROM bt GROUP BY s"))
def projection_bootstrap_cov(spark, sf_dir):
    out = project.bootstrap_covariance(bootstrapped(spark, sf_dir)[0])
    return out.select("sample_idx", "pc_a", "pc_b", *(r6(c).alias(c) for c in ("var_a", "var_b", "cov", "corr")))


# -- selection -------------------------------------------------------------------------------------------------------

SCAN = [*PC1, "sv AS MATERIALIZED (SELECT v, sum(x * u) / any_value(sig) AS v1, sum(x * x) AS n2 FROM xs JOIN pu USING (s), ps GROUP BY v)"]
ZSCORE = [
    *SCAN,
    f"zs AS MATERIALIZED (SELECT v, v1 / sqrt(greatest(n2 - v1 * v1, 0) / ({SAMPLES} - 1)) AS z FROM sv)",
    "mc AS MATERIALIZED (SELECT median(z) AS c, 1.4826::DOUBLE * mad(z) AS m FROM zs)",
    "st AS MATERIALIZED (SELECT v, z, (z - c) * (z - c) / greatest(m * m, 1e-8 * greatest(1, m * m)) AS stat FROM zs, mc)",
    "gf AS MATERIALIZED (SELECT median(stat) / 0.45493642311957283::DOUBLE AS gif FROM st)",
]


@register(o.query(SCAN, f"SELECT {SELECT_V}, 1 AS pc, round(64 * v1 * v1, 6) AS stat, round({o.upper_tail('64 * v1 * v1')}, 6) AS p FROM sv"))
def selection_galinsky(spark, sf_dir):
    rows, model = components(spark, sf_dir)
    return selection.galinsky(rows, model.u, model.eigenvalues).select("variant_idx", "pc", r6("stat").alias("stat"), r6("p").alias("p"))


@register(o.query(ZSCORE, f"SELECT {SELECT_V}, round(z, 6) AS z, round(stat, 6) AS stat, round(stat / gif, 6) AS chi2, round({o.upper_tail('stat / gif')}, 6) AS p FROM st, gf"))
def selection_pcadapt(spark, sf_dir):
    rows, model = components(spark, sf_dir)
    out, _ = selection.pcadapt(rows, model.u, model.eigenvalues)
    return out.select("variant_idx", r6(F.col("z")[0]).alias("z"), r6("stat").alias("stat"), r6("chi2").alias("chi2"), r6("p").alias("p"))


@register(o.query(ZSCORE, "SELECT round(gif, 6) AS gif FROM gf"))
def genomic_inflation(spark, sf_dir):
    rows, model = components(spark, sf_dir)
    return from_numpy(spark, gif=[round(selection.pcadapt(rows, model.u, model.eigenvalues)[1], 6)])


# -- likelihoods, missing values, Hardy-Weinberg -------------------------------------------------------------------------

EMF = [*o.BASE["lx"], *o.likelihood_steps(EM_STEPS)]
POST = "(p1 * 2 * f * (1 - f) + 2 * (1 - p0 - p1) * f * f) / (p0 * (1 - f) * (1 - f) + p1 * 2 * f * (1 - f) + (1 - p0 - p1) * f * f)"


@register(o.query(EMF, f"SELECT {SELECT_V}, round(f, 6) AS af FROM f{EM_STEPS}"))
def em_allele_freq(spark, sf_dir):
    return em.em_frequency(fx.likelihoods(spark, sf_dir), iterations=EM_STEPS).select("variant_idx", r6("af").alias("af"))


@register(o.query(EMF, f"SELECT v::BIGINT AS variant_idx, s::BIGINT AS sample_idx, round({POST} - 2 * f, 6) + 0.0::DOUBLE AS x FROM lx JOIN f{EM_STEPS} USING (v)"))
def gl_posterior_dosage(spark, sf_dir):
    return long_form(em.likelihood_rows(em.em_frequency(fx.likelihoods(spark, sf_dir), iterations=EM_STEPS)), "x")


def _gl_cov() -> str:
    w0, w1, w2 = "p0 * (1 - f) * (1 - f)", "p1 * 2 * f * (1 - f)", "(1 - p0 - p1) * f * f"
    cell = f"gc AS MATERIALIZED (SELECT v, s, ({POST} - 2 * f) / sqrt(2 * f * (1 - f)) AS x, ({w0} * 4 * f * f + {w1} * (1 - 2 * f) * (1 - 2 * f) + {w2} * (2 - 2 * f) * (2 - 2 * f)) / ({w0} + {w1} + {w2}) / (2 * f * (1 - f)) AS d FROM lx JOIN f{EM_STEPS} USING (v))"
    return o.query([*EMF, cell], "SELECT a.s::BIGINT AS i, b.s::BIGINT AS j, round(CASE WHEN a.s = b.s THEN sum(a.d) ELSE sum(a.x * b.x) END / 64, 6) + 0.0::DOUBLE AS k FROM gc a JOIN gc b ON a.v = b.v AND a.s <= b.s GROUP BY a.s, b.s")


@register(_gl_cov())
def gl_covariance(spark, sf_dir):
    likelihoods = fx.likelihoods(spark, sf_dir)
    rows = em.em_frequency(likelihoods, iterations=EM_STEPS)
    rows = rows.withColumn("pi", F.array_repeat(F.col("af"), F.size("p0")))
    return em.covariance_cells(rows, *pca.dimensions(likelihoods, "p0"), 6)


PCC = [*GX, *o.centred(), *o.component("xc")]


@register(o.query(PCC, "SELECT v::BIGINT AS variant_idx, s::BIGINT AS sample_idx, round(greatest(-f, least(1 - f, u * sig * w)), 6) + 0.0::DOUBLE AS x FROM gx JOIN af USING (v) JOIN pu USING (s) JOIN pv USING (v), ps WHERE g IS NULL"))
def emu_impute_one_step(spark, sf_dir):
    rows, model = components(spark, sf_dir, scale="centred")
    filled = em.impute(rows, model).select("variant_idx", F.posexplode(F.arrays_zip("g", "x")).alias("sample_idx", "e"))
    return filled.where("e.g is null").select("variant_idx", F.col("sample_idx").cast("long").alias("sample_idx"), (r6("e.x") + F.lit(0.0)).alias("x"))


@register(o.query([*PCC, "xr AS (SELECT v, s, g - f AS y, u FROM gx JOIN af USING (v) JOIN pu USING (s))", "be AS (SELECT v, sum(u * y) / sum(u * u) FILTER (y IS NOT NULL) AS b FROM xr GROUP BY v)"], "SELECT v::BIGINT AS variant_idx, s::BIGINT AS sample_idx, round(greatest(-f, least(1 - f, u * b)), 6) + 0.0::DOUBLE AS x FROM xr JOIN be USING (v) JOIN af USING (v) WHERE y IS NULL"))
def predict_missing(spark, sf_dir):
    rows, model = components(spark, sf_dir, scale="centred")
    filled = em.predict_missing(rows.select("variant_idx", "g", "af"), model.u).join(rows.select("variant_idx", "g"), "variant_idx")
    cells = filled.select("variant_idx", F.posexplode(F.arrays_zip("g", "x")).alias("sample_idx", "e")).where("e.g is null")
    return cells.select("variant_idx", F.col("sample_idx").cast("long").alias("sample_idx"), (r6("e.x") + F.lit(0.0)).alias("x"))


HWE = [*PCC, *o.cells(), *o.squarem(HWE_STEPS), o.lrt(f"q{HWE_STEPS}")]


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = components(spark, sf_dir, scale="centred")
    return em.individual_frequency(rows.select("variant_idx", "g", "af"), model, 1.0).persist()


@register(o.query(HWE, f"SELECT {SELECT_V}, round(f, 6) AS inbreeding FROM lr"))
def hwe_inbreeding(spark, sf_dir):
    return hwe.hwe(frequencies(spark, sf_dir), iterations=HWE_STEPS).select("variant_idx", r6("inbreeding").alias("inbreeding"))


@register(o.query(HWE, f"SELECT {SELECT_V}, round(lrt, 6) AS lrt FROM lr"))
def hwe_lrt(spark, sf_dir):
    return hwe.hwe(frequencies(spark, sf_dir), iterations=HWE_STEPS).select("variant_idx", r6("lrt").alias("lrt"))


@register(o.query([*HWE, *o.BASE["vr"]], f"SELECT id, round({o.upper_tail('lrt')}, 6) AS hwe_p FROM lr JOIN vr ON v = variant_idx"))
def hwe_pvalue(spark, sf_dir):
    found = hwe.hwe(frequencies(spark, sf_dir), iterations=HWE_STEPS)
    return found.join(fx.variants(spark), "variant_idx").select("id", r6("hwe_p").alias("hwe_p"))


@register(o.query([*PCC, *o.cells(), "i0 AS (SELECT DISTINCT s, 0::DOUBLE AS f FROM cell)", *(o.inbreeding_step(f"i{t}", f"i{t - 1}", "s") for t in range(1, 4))], "SELECT s::INTEGER AS sample_idx, round(f, 6) AS inbreeding FROM i3"))
def inbreeding_per_sample(spark, sf_dir):
    return hwe.inbreeding_by_sample(frequencies(spark, sf_dir), iterations=3).select("sample_idx", r6("inbreeding").alias("inbreeding"))


@register(f"WITH x AS (SELECT unnest([0.5, 1, 3.84, 6.63, 10.83, 30]::DOUBLE[]) AS x) SELECT x, round({o.upper_tail('x')}, 9) AS p FROM x")
def chi_square_tails(spark, sf_dir):
    x = spark.createDataFrame([(v,) for v in (0.5, 1.0, 3.84, 6.63, 10.83, 30.0)], "x double")
    return x.select("x", F.round(chi_square_tail(F.col("x")), 9).alias("p"))


# -- linkage disequilibrium ----------------------------------------------------------------------------------------------

STD = [*GX, *o.centred(), *o.unit("xc", "d"), *o.pairs("d", LD_BP)]
ADJ = [*PC1, "pr AS MATERIALIZED (SELECT v, sum(x * u) AS b FROM xc JOIN pu USING (s) GROUP BY v)", "xa AS MATERIALIZED (SELECT v, s, x - u * b AS x FROM xc JOIN pu USING (s) JOIN pr USING (v))", *o.unit("xa", "a"), *o.pairs("a", LD_BP)]
PAIR = "SELECT chr, i::BIGINT AS i, k::BIGINT AS k, bp_i, bp_k, round(r2, 6) AS r2 FROM "


def standard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.centred(fx.genotypes(spark, sf_dir)).select("variant_idx", "af", F.col("x").alias("r"))


def standard_pairs(spark: SparkSession, sf_dir: str, window: int = LD_BP) -> DataFrame:
    return ld.r2_pairs(standard_rows(spark, sf_dir), fx.variants(spark), window)


def adjusted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = components(spark, sf_dir)
    return pca.residuals(normalize.centred(fx.genotypes(spark, sf_dir)), model.u)


@register(o.query(STD, PAIR + "dr"))
def ld_r2_standard(spark, sf_dir):
    return standard_pairs(spark, sf_dir).withColumn("r2", r6("r2"))


@register(o.query(ADJ, PAIR + "ar"))
def ld_r2_adjusted(spark, sf_dir):
    return ld.r2_pairs(adjusted_rows(spark, sf_dir), fx.variants(spark), LD_BP).withColumn("r2", r6("r2"))


@register(o.query(ADJ, "SELECT v::BIGINT AS variant_idx, s::BIGINT AS sample_idx, round(x, 6) + 0.0::DOUBLE AS x FROM am"))
def residual_matrix(spark, sf_dir):
    return long_form(adjusted_rows(spark, sf_dir), "r", "x")


def _prune(known: bool, kept: str) -> str:
    goes = "list_filter(later, lambda k: NOT list_contains(gone, k)" + (" AND list_extract(mafs, (k + 1)::INTEGER) <= list_extract(mafs, (n + 1)::INTEGER))" if known else ")")
    lead = "CASE WHEN len(list_filter(later, lambda k: NOT list_contains(gone, k) AND list_extract(mafs, (k + 1)::INTEGER) > list_extract(mafs, (n + 1)::INTEGER))) > 0 THEN [n] ELSE []::BIGINT[] END" if known else "[]::BIGINT[]"
    return o.query(
        [
            *STD,
            "nb AS MATERIALIZED (SELECT variant_idx AS i, coalesce(later, []::BIGINT[]) AS later FROM vr LEFT JOIN (SELECT i, list(k::BIGINT ORDER BY k) AS later FROM dr WHERE r2 > 0.2::DOUBLE GROUP BY i) ON i = variant_idx)",
            "mf AS MATERIALIZED (SELECT list(least(f, 1 - f) ORDER BY v) AS mafs FROM af)",
            f"go AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS gone UNION ALL SELECT n + 1, CASE WHEN list_contains(gone, n) THEN gone ELSE list_concat(gone, list_concat({goes}, {lead})) END FROM go JOIN nb ON nb.i = n, mf WHERE n < 64)",
        ],
        f"SELECT variant_idx, chr, id, bp, a1, a2 FROM vr, (SELECT gone FROM go WHERE n = 64) WHERE {kept} list_contains(gone, variant_idx)",
    )


def pruned(spark: SparkSession, sf_dir: str, known: bool) -> DataFrame:
    v = fx.variants(spark)
    if known:
        v = v.join(variants.with_frequency(fx.genotypes(spark, sf_dir)).select("variant_idx", "af"), "variant_idx")
    return ld.prune(standard_pairs(spark, sf_dir), v, LD_R2).select("variant_idx", "chr", "id", "bp", "a1", "a2", "keep")


@register(_prune(False, "NOT"))
def ld_prune_keep(spark, sf_dir):
    return pruned(spark, sf_dir, False).where("keep").drop("keep")


@register(_prune(False, ""))
def ld_prune_out(spark, sf_dir):
    return pruned(spark, sf_dir, False).where("not keep").drop("keep")


@register(_prune(True, "NOT"))
def ld_prune_highmaf(spark, sf_dir):
    return pruned(spark, sf_dir, True).where("keep").drop("keep")


CLUMP = {"p1": 0.002, "p2": 0.006, "r2": 0.1, "window_bp": 4000}


@register(
    o.query(
        [
            *GX,
            *o.centred(),
            *o.unit("xc", "d"),
            *o.pairs("d", CLUMP["window_bp"]),
            *o.BASE["ax"],
            "hit AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY p, bp) AS n FROM ax WHERE p <= 0.006::DOUBLE)",
            "near AS MATERIALIZED (SELECT i AS a, k AS b FROM dr WHERE r2 >= 0.1::DOUBLE UNION ALL SELECT k, i FROM dr WHERE r2 >= 0.1::DOUBLE)",
            "nn AS MATERIALIZED (SELECT h.n, h.variant_idx, h.p, coalesce((SELECT list(m.n ORDER BY m.n) FROM near JOIN hit m ON m.variant_idx = b WHERE a = h.variant_idx), []::BIGINT[]) AS linked FROM hit h)",
            "cl AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS gone, []::BIGINT[] AS mine, false AS led UNION ALL SELECT nn.n, CASE WHEN nn.p <= 0.002::DOUBLE AND NOT list_contains(gone, nn.n) THEN list_concat(gone, list_filter(linked, lambda m: NOT list_contains(gone, m))) ELSE gone END, list_filter(linked, lambda m: NOT list_contains(gone, m)), nn.p <= 0.002::DOUBLE AND NOT list_contains(gone, nn.n) FROM cl JOIN nn ON nn.n = cl.n + 1)",
        ],
        "SELECT h.chr, h.bp, h.p, coalesce((SELECT string_agg(m.bp::VARCHAR, ',' ORDER BY m.n) FROM hit m WHERE list_contains(mine, m.n)), 'NONE') AS sp2 FROM cl JOIN hit h USING (n) WHERE led",
    )
)
def ld_clump(spark, sf_dir):
    return ld.clump(standard_pairs(spark, sf_dir, CLUMP["window_bp"]), fx.variants(spark), fx.associations(spark), **CLUMP)


@register(o.query([*STD, "t AS (SELECT chr, r2, ntile(10) OVER (PARTITION BY chr ORDER BY bp_k - bp_i, i, k) AS bin FROM dr)"], "SELECT chr, (bin * 800)::DOUBLE AS distance, count(*)::BIGINT AS num, round(avg(r2), 6) AS avg_r2, round(stddev_samp(r2), 6) AS std FROM t GROUP BY chr, bin"))
def ld_decay_bins(spark, sf_dir):
    return ld.decay_bins(standard_pairs(spark, sf_dir), LD_BP, 10).select("chr", "distance", "num", r6("avg_r2").alias("avg_r2"), r6("std").alias("std"))


@register(o.query([*STD, "t AS (SELECT chr, r2, ntile(10) OVER (PARTITION BY chr ORDER BY bp_k - bp_i, i, k) AS bin FROM dr)", "b AS (SELECT chr, bin, count(*) AS num, avg(r2) AS a FROM t GROUP BY ALL)", "m AS (SELECT bin, sum(a * num) / sum(num) AS r2 FROM b GROUP BY bin)"], f"SELECT (bin * 800)::DOUBLE AS distance, round(r2 - (1 - r2) / ({SAMPLES} - 2), 6) AS r2 FROM m"))
def ld_bias_corrected(spark, sf_dir):
    rows = standard_rows(spark, sf_dir)
    n = rows.select(F.size("r")).first()[0]
    return ld.weighted_decay(ld.decay_bins(ld.r2_pairs(rows, fx.variants(spark), LD_BP), LD_BP, 10), n).select("distance", r6("r2").alias("r2"))


@register(o.query(STD, "SELECT chr, (bp_k - bp_i)::BIGINT AS distance, round(sum(r2), 6) AS r2_total, count(r2)::BIGINT AS num_pairs FROM dr GROUP BY ALL"))
def ld_distance_summary(spark, sf_dir):
    return ld.distance_summary(standard_pairs(spark, sf_dir)).select("chr", "distance", r6("r2_total").alias("r2_total"), "num_pairs")


@register(o.query(STD, "SELECT (CASE WHEN bp_k - bp_i <= 1000 THEN 1000 WHEN bp_k - bp_i <= 5000 THEN 5000 ELSE 10000 END)::INTEGER AS bin, count(r2)::BIGINT AS counts, round(sum(sqrt(r2)), 6) AS r_sum, round(sum(r2), 6) AS r2_sum FROM dr GROUP BY ALL"))
def ld_curve_bins(spark, sf_dir):
    return ld.curve_bins(standard_pairs(spark, sf_dir)).select("bin", "counts", r6("r_sum").alias("r_sum"), r6("r2_sum").alias("r2_sum"))


@register(o.query([*GX, *o.centred(), *o.unit("xc", "d"), "c AS (SELECT a.v, b.v AS k, sum(a.x * b.x) AS r FROM dn a JOIN dn b USING (s) WHERE a.v < 32 AND b.v >= 32 GROUP BY ALL)"], "SELECT '1' AS chr_a, '2' AS chr_b, count(*)::BIGINT AS n_pairs, round(avg(r * r), 6) AS mean_r2 FROM c"))
def ld_cross_chr_mean(spark, sf_dir):
    return ld.cross_chromosome_mean(standard_rows(spark, sf_dir), fx.variants(spark), "1", "2").withColumn("mean_r2", r6("mean_r2"))


# -- whole expectation-maximisation runs: SQL for fixed numbers of rounds; tests compare more components with numpy --------


@register(o.query([*GX, *o.emu(EMU_ROUNDS)], "SELECT s::INTEGER AS sample_idx, 1::INTEGER AS pc, round(u, 6) AS u FROM eu"))
def emu_pca(spark, sf_dir):
    model = em.emu(fx.genotypes(spark, sf_dir), 1, "full", max_iter=EMU_ROUNDS, tol=-1)  # no early end
    return model.scores().select("sample_idx", "pc", r6("u").alias("u"))


@register(o.query([*o.BASE["lx"], *o.pcangsd(GL_ROUNDS, EM_STEPS)], "SELECT s::INTEGER AS sample_idx, 1::INTEGER AS pc, round(u, 6) AS u FROM gu"))
def pcangsd_first_component(spark, sf_dir):
    rows = em.em_frequency(fx.likelihoods(spark, sf_dir), iterations=EM_STEPS)
    model, _ = em.pcangsd(rows, 1, "full", max_iter=GL_ROUNDS, tol=-1, components=1)  # no early end
    return model.scores().where("pc = 1").select("sample_idx", "pc", r6("u").alias("u"))


@register()
def pcangsd_pca(spark, sf_dir):
    model, _ = em.pcangsd(fx.likelihoods(spark, sf_dir), 1, "full", components=2)
    return model.scores().where("pc <= 2").select("sample_idx", "pc", r6("u").alias("u"))
