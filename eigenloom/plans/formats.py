"""Registered queries that write a format from the fixtures and read it back, with the fixtures' SQL as oracle."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenloom.operators import ld, normalize, variants
from eigenloom.plans import fixtures as fx
from eigenloom.plans import oracle as o
from eigenloom.plans.catalogue import CX, GX, SELECT_V, STD, r6, register, standard_pairs
from eigenloom.sources import binary, sinks, text

VARIANT_COLUMNS = "variant_idx::BIGINT AS variant_idx, chr, id, bp, a1, a2"


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the folder that all executors share, or in one of this machine's where a single one runs all; gone at exit."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="eigenloom-formats-")
    path = f"{top.rstrip('/')}/formats-{uuid.uuid4().hex}/{name}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def sweep() -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            at = jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(conf).delete(at, True)

    atexit.register(sweep)
    return path


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Write bytes, a fixture's size, to any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def fixture_matrix(spark: SparkSession, sf_dir: str) -> np.ndarray:
    rows = sorted(fx.genotypes(spark, sf_dir).collect(), key=lambda r: r.variant_idx)
    return np.array([[np.nan if x is None else x for x in r.g] for r in rows])


def two_bits(g: np.ndarray, values: tuple[float, ...]) -> bytes:
    """Rows of two-bit codes, lowest bits first, each row in whole bytes."""
    code = np.zeros(g.shape, np.uint8)
    for c, v in enumerate(values):
        code[np.isnan(g) if np.isnan(v) else g == v] = c
    wide = np.zeros((len(g), -(-g.shape[1] // 4) * 4), np.uint8)
    wide[:, : g.shape[1]] = code
    parts = wide.reshape(len(g), -1, 4)
    return (parts[:, :, 0] | parts[:, :, 1] << 2 | parts[:, :, 2] << 4 | parts[:, :, 3] << 6).astype(np.uint8).tobytes()


CLASSES = o.query(GX, f"SELECT {SELECT_V}, count(*) FILTER (g = 0)::BIGINT AS n0, count(*) FILTER (g = 0.5)::BIGINT AS n1, count(*) FILTER (g = 1)::BIGINT AS n2, count(*) FILTER (g IS NULL)::BIGINT AS n_missing FROM gx GROUP BY v")


@register(CLASSES)
def source_bed(spark, sf_dir):
    g = fixture_matrix(spark, sf_dir)
    path = put(spark, scratch(spark, "a.bed"), binary.BED_MAGIC + two_bits(g, binary.BED_VALUES))
    return variants.class_counts(binary.read_bed(spark, path, g.shape[1], len(g)))


@register(CLASSES)
def source_pgen(spark, sf_dir):
    g = fixture_matrix(spark, sf_dir)
    head = binary.PGEN_MAGIC + np.array([len(g), g.shape[1]], "<u4").tobytes() + b"\0"
    return variants.class_counts(binary.read_pgen(spark, put(spark, scratch(spark, "a.pgen"), head + two_bits(g, binary.PGEN_VALUES)), g.shape[1], len(g)))


@register(o.query([*o.BASE["lx"]], "SELECT v::BIGINT AS variant_idx, s::BIGINT AS sample_idx, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM lx"))
def source_beagle(spark, sf_dir):
    wide = fx.likelihoods(spark, sf_dir).join(fx.variants(spark), "variant_idx")
    cell = lambda p, q: F.concat_ws("\t", F.format_string("%.8f", p), F.format_string("%.8f", q), F.format_string("%.8f", 1 - p - q))
    line = F.concat_ws("\t", F.concat_ws("_", "chr", "bp"), "a1", "a2", F.array_join(F.zip_with("p0", "p1", cell), "\t"))
    n = fx.samples(spark, sf_dir).count()
    path = scratch(spark, "a.beagle.gz")
    sinks.write_lines(wide.select("variant_idx", line.alias("l")).coalesce(1), path, F.col("l"), ["variant_idx"], "\t".join(["marker", "allele1", "allele2", *(f"S{i}" for i in range(n) for _ in range(3))]), "gzip")
    found, _ = text.read_beagle(spark, path)
    both = found.select("variant_idx", F.posexplode(F.arrays_zip("p0", "p1")).alias("sample_idx", "x"))
    return both.select("variant_idx", F.col("sample_idx").cast("long").alias("sample_idx"), r6("x.p0").alias("p0"), r6("x.p1").alias("p1"))


@register(o.query(CX, "SELECT (dense_rank() OVER (ORDER BY feature) - 1)::VARCHAR AS feature, (dense_rank() OVER (ORDER BY sample) - 1)::VARCHAR AS sample, n FROM cx"))
def source_counts(spark, sf_dir):
    rows, _ = normalize.pack_counts(normalize.zero_filled(fx.counts(spark, sf_dir)), "n")
    path = scratch(spark, "counts.csv")
    sinks.write_lines(rows, path, F.array_join(F.transform("g", lambda x: F.format_string("%.0f", x)), ","), ["id"])
    return text.read_counts(spark, path)


@register(o.query([*GX, *o.centred(), "m AS (SELECT v, s, x - avg(x) OVER (PARTITION BY v) AS x FROM xc)"], "SELECT v::BIGINT AS variant_idx, round(sum(x * x), 2) AS squares, round(max(x), 4) AS highest FROM m GROUP BY v"))
def source_residuals(spark, sf_dir):
    rows = normalize.centred(fx.genotypes(spark, sf_dir)).withColumnRenamed("x", "r")
    n, m = rows.select(F.size("r")).first()[0], rows.count()
    path = scratch(spark, "a.residuals")
    sinks.write_residuals(rows, path, n, m)
    back = sinks.read_residual_parts(spark, path)
    return back.select("variant_idx", F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x * x), 2).alias("squares"), F.round(F.array_max("r"), 4).alias("highest"))


@register(o.query([*o.BASE["lx"]], "SELECT v::BIGINT AS idx, s::BIGINT AS at, round(p0, 4) AS x FROM lx WHERE s < 5"))
def source_vectors(spark, sf_dir):
    path = scratch(spark, "a.loadings")
    sinks.write_vectors(fx.likelihoods(spark, sf_dir), path, "variant_idx", "p0")
    found = text.read_vectors(spark, path, 5, fx.VARIANTS)
    return found.select("idx", F.posexplode("v").alias("at", "x")).select("idx", F.col("at").cast("long").alias("at"), F.round("x", 4).alias("x"))


@register(o.query([*GX, *o.frequency()], "SELECT v::BIGINT AS pc, round(f, 6) AS value, 64::BIGINT AS n, 7::BIGINT AS m FROM af"))
def source_spectrum(spark, sf_dir):
    af = [r.af for r in variants.with_frequency(fx.genotypes(spark, sf_dir)).select("variant_idx", "af").orderBy("variant_idx").collect()]
    path = scratch(spark, "a.sigvals")
    sinks.write_spectrum(fx.variants(spark), np.array(af), path, (64, 7))
    values, (n, m) = text.read_spectrum(spark, path)
    rows = spark.createDataFrame([(i, v, n, m) for i, v in enumerate(values)], "pc long, value double, n long, m long")
    return rows.withColumn("value", r6("value"))


@register(o.query([*GX, *o.frequency(), *o.BASE["vr"]], f"SELECT {VARIANT_COLUMNS}, round(f, 6) AS af FROM vr JOIN af ON v = variant_idx"))
def source_mbim(spark, sf_dir):
    path = scratch(spark, "a.mbim")
    sinks.write_variants(fx.variants(spark).join(variants.with_frequency(fx.genotypes(spark, sf_dir)).select("variant_idx", "af"), "variant_idx"), path)
    found = text.read_bim(spark, path).drop("cm", "af").join(text.read_frequencies(spark, path), "variant_idx")
    return found.select("variant_idx", "chr", "id", "bp", "a1", "a2", r6("af").alias("af"))


@register(o.query([*o.BASE["vr"]], f"SELECT {VARIANT_COLUMNS} FROM vr"))
def source_pvar(spark, sf_dir):
    path = scratch(spark, "a.pvar")
    line = F.concat_ws("\t", "chr", F.col("bp").cast("string"), "id", "a2", F.concat("a1", F.lit(",N")), F.lit("."))
    sinks.write_lines(fx.variants(spark), path, line, ["variant_idx"], "#CHROM\tPOS\tID\tREF\tALT\tFILTER")
    return text.read_pvar(spark, path).select("variant_idx", "chr", "id", "bp", "a1", "a2")


@register(o.query([o.BASE["sm"][0]], "SELECT sample_idx::INTEGER AS sample_idx, fid, iid, 'fam' AS kind FROM sm UNION ALL SELECT sample_idx::INTEGER, '0', iid, 'psam' FROM sm"))
def source_samples(spark, sf_dir):
    people, fam, psam = fx.samples(spark, sf_dir), scratch(spark, "a.fam"), scratch(spark, "a.psam")
    sinks.write_lines(people, fam, F.concat_ws(" ", "fid", "iid", F.lit("0"), F.lit("0"), F.lit("0"), F.lit("-9")), ["sample_idx"])
    sinks.write_lines(people, psam, F.col("iid"), ["sample_idx"], "#IID")
    return text.read_fam(spark, fam).withColumn("kind", F.lit("fam")).unionByName(text.read_psam(spark, psam).withColumn("kind", F.lit("psam")))


@register(o.query([*o.BASE["ax"]], "SELECT chr, bp, round(p, 8) AS p FROM ax WHERE p <= 0.005::DOUBLE"))
def source_associations(spark, sf_dir):
    path = scratch(spark, "a.assoc")
    sinks.write_lines(fx.associations(spark), path, F.concat_ws("\t", "chr", F.lit("x"), F.col("bp").cast("string"), F.format_string("%.12g", "p")), ["variant_idx"], "CHR\tNAME\tBP\tP")
    return text.read_associations(spark, path, p_max=0.005).select("chr", "bp", F.round("p", 8).alias("p"))


@register(o.query(STD, "SELECT 'rs' || i AS id_i, 'rs' || k AS id_k, bp_i::BIGINT AS bp_i, bp_k::BIGINT AS bp_k, round(r2, 6) AS r2 FROM dr"))
def sink_pairs(spark, sf_dir):
    path = scratch(spark, "a.ld.gz")
    sinks.write_pairs(standard_pairs(spark, sf_dir), fx.variants(spark), path)
    f = F.split("value", "\t")
    back = spark.read.text(path).where("not startswith(value, 'CHR_A')")
    return back.select(f[2].alias("id_i"), f[5].alias("id_k"), f[1].cast("long").alias("bp_i"), f[4].cast("long").alias("bp_k"), F.round(f[6].cast("double"), 6).alias("r2"))


@register(o.query([*o.BASE["sm"]], "SELECT fid, iid, sample_idx / 8.0::DOUBLE AS pc1, sample_idx / 4.0::DOUBLE AS pc2 FROM sm"))
def sink_scores_with_ids(spark, sf_dir):
    people, path = fx.samples(spark, sf_dir), scratch(spark, "a.eigvecs2")
    scores = people.select("sample_idx", F.explode(F.array(F.lit(1), F.lit(2))).alias("pc")).withColumn("u", F.col("sample_idx") / F.when(F.col("pc") == 1, 8.0).otherwise(4.0))
    sinks.write_scores_with_ids(scores, people, path, 2)
    f = F.split("value", "\t")
    back = spark.read.text(path).where("not startswith(value, '#')")
    return back.select(f[0].alias("fid"), f[1].alias("iid"), f[2].cast("double").alias("pc1"), f[3].cast("double").alias("pc2"))


@register(o.query([*o.BASE["vr"]], "SELECT id, round(variant_idx / 64.0::DOUBLE, 4) AS hwe_p, round(variant_idx / 3.0::DOUBLE, 4) AS lrt, 'hwe' AS kind FROM vr UNION ALL SELECT id, round(variant_idx / 64.0::DOUBLE, 4), round(variant_idx / 3.0::DOUBLE, 4), 'galinsky' FROM vr"))
def sink_statistics(spark, sf_dir):
    """.hwe and the selection scans' tables share one shape: a name and numbers of six digits."""
    rows = fx.variants(spark).select("variant_idx", (F.col("variant_idx") / 64.0).alias("hwe_p"), (F.col("variant_idx") / 3.0).alias("lrt"), F.lit(0.0).alias("inbreeding"))
    a, b = scratch(spark, "a.hwe"), scratch(spark, "a.galinsky")
    sinks.write_hwe(rows, fx.variants(spark), a)
    sinks.write_statistics(rows, fx.variants(spark), b, ["hwe_p", "lrt"])
    f, g = F.split("value", "\t"), lambda c: F.round(c.cast("double"), 4)
    back = [spark.read.text(p).where("not startswith(value, '#')").select(f[0].alias("id"), g(f[1]).alias("hwe_p"), g(f[2]).alias("lrt"), F.lit(kind).alias("kind")) for p, kind in ((a, "hwe"), (b, "galinsky"))]
    return back[0].unionByName(back[1])


@register(o.query(STD, "SELECT chr, (bp_k - bp_i)::BIGINT AS distance, round(sum(sum(r2)) OVER w / sum(count(r2)) OVER w, 6) AS mean_r2 FROM dr GROUP BY chr, bp_k - bp_i WINDOW w AS (PARTITION BY chr ORDER BY bp_k - bp_i)"))
def ld_cumulative_mean(spark, sf_dir):
    return ld.cumulative_mean(standard_pairs(spark, sf_dir)).select("chr", "distance", r6("mean_r2").alias("mean_r2"))


@register(o.query([*o.BASE["vr"]], "SELECT chr, min(variant_idx)::BIGINT AS first, max(variant_idx)::BIGINT AS last, count(*)::BIGINT AS n FROM vr GROUP BY chr"))
def chromosome_runs(spark, sf_dir):
    return ld.chromosome_runs(fx.variants(spark))


