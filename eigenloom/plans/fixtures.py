"""Inputs for the registered queries, derived from the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured genotypes from `embeddings`: (variant_idx, g), samples in the order of vec_id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    at = lambda v, k: F.get(F.col("x"), F.pmod(v + k, F.lit(VARIANTS)))

    def cell(v):
        z = at(v, 0) + at(v, 1) + at(v, 2) + F.lit(0.15) * F.when(F.col("label") < 5, 1.0).otherwise(-1.0) * F.when(v % 4 < 2, 1.0).otherwise(-1.0) + F.lit(0.04) * ((v % 8) - 3).cast("double")
        return F.when((F.col("vec_id") * 7 + (v + 1) * 13) % 29 != 0, F.when(z > 0.12, 1.0).when(z > -0.12, 0.5).otherwise(0.0))

    cells = e.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(VARIANTS - 1)), cell)).alias("v", "c"))
    packed = cells.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "c"))), lambda s: s["c"]).alias("g"))
    return packed.select(F.col("v").cast("long").alias("variant_idx"), "g")


def variants(spark: SparkSession) -> DataFrame:
    v = F.col("id")
    allele = lambda a, b, c: F.when(v % 3 == 0, a).when(v % 3 == 1, b).otherwise(c)
    return spark.range(VARIANTS).select(
        v.alias("variant_idx"),
        (F.floor(v / 32) + 1).cast("string").alias("chr"),
        F.concat(F.lit("rs"), v.cast("string")).alias("id"),
        F.lit(0.0).alias("cm"),
        ((v % 32 + 1) * 1000).alias("bp"),
        allele("A", "C", "A").alias("a1"),
        allele("G", "T", "C").alias("a2"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("sample_idx"), F.concat(F.lit("L"), "label").alias("fid"), F.concat(F.lit("S"), "vec_id").alias("iid"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of each supplier (sample) for each brand (feature)."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = items.join(part, items["l_partkey"] == part["p_partkey"])
    return joined.groupBy(F.col("p_brand").alias("feature"), F.col("l_suppkey").cast("string").alias("sample")).agg(F.count("*").cast("double").alias("n"))


def likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda a, b, c: lambda x: F.when(x.isNull(), 1 / 3).when(x == 0, a).when(x == 0.5, b).otherwise(c)
    return genotypes(spark, sf_dir).select("variant_idx", F.transform("g", pick(0.9, 0.1, 0.02)).alias("p0"), F.transform("g", pick(0.08, 0.8, 0.08)).alias("p1"))


def associations(spark: SparkSession) -> DataFrame:
    return variants(spark).select("variant_idx", "chr", "bp", (((F.col("variant_idx") * 37 + 11) % 64 + 1) / 6400).alias("p"))


def target_markers(spark: SparkSession) -> DataFrame:
    """A second marker list: some dropped, some with swapped alleles, some moved."""
    v = F.col("variant_idx")
    swap = v % 5 == 0
    return variants(spark).where(v % 10 != 9).select(
        v, "chr", "id", "cm", (F.col("bp") + (v % 17 == 0).cast("long")).alias("bp"), F.when(swap, F.col("a2")).otherwise(F.col("a1")).alias("a1"), F.when(swap, F.col("a1")).otherwise(F.col("a2")).alias("a2")
    )


#: Common table expressions for the oracle: gx (v, s, g), vr (variants), sm (samples), cx (counts), lx (likelihoods).
GX = """
gz AS (
  SELECT vec_id AS s, v, embedding[v + 1]::DOUBLE + embedding[(v + 1) % 64 + 1]::DOUBLE + embedding[(v + 2) % 64 + 1]::DOUBLE
    + 0.15::DOUBLE * (CASE WHEN label < 5 THEN 1 ELSE -1 END)::DOUBLE * (CASE WHEN v % 4 < 2 THEN 1 ELSE -1 END)::DOUBLE
    + 0.04::DOUBLE * (v % 8 - 3)::DOUBLE AS z
  FROM embeddings, (SELECT unnest(range(64)) AS v)
),
gx AS MATERIALIZED (
  SELECT v, s, CASE WHEN (s * 7 + (v + 1) * 13) % 29 = 0 THEN NULL WHEN z > 0.12::DOUBLE THEN 1.0::DOUBLE WHEN z > (-0.12)::DOUBLE THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS g FROM gz
)"""
VR = """
vr AS (
  SELECT v AS variant_idx, (v // 32 + 1)::VARCHAR AS chr, 'rs' || v AS id, ((v % 32 + 1) * 1000)::BIGINT AS bp,
    CASE v % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' ELSE 'A' END AS a1, CASE v % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'T' ELSE 'C' END AS a2
  FROM (SELECT unnest(range(64)) AS v)
)"""
SM = "sm AS (SELECT vec_id AS sample_idx, 'L' || label AS fid, 'S' || vec_id AS iid FROM embeddings)"
CX = "cx AS MATERIALIZED (SELECT p_brand AS feature, l_suppkey::VARCHAR AS sample, count(*)::DOUBLE AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
LX = """
lx AS MATERIALIZED (
  SELECT v, s, CASE WHEN g IS NULL THEN 1/3::DOUBLE WHEN g = 0 THEN 0.9::DOUBLE WHEN g = 0.5 THEN 0.1::DOUBLE ELSE 0.02::DOUBLE END AS p0,
    CASE WHEN g IS NULL THEN 1/3::DOUBLE WHEN g = 0 THEN 0.08::DOUBLE WHEN g = 0.5 THEN 0.8::DOUBLE ELSE 0.08::DOUBLE END AS p1 FROM gx
)"""
AX = "ax AS (SELECT variant_idx, chr, bp, ((variant_idx * 37 + 11) % 64 + 1) / 6400::DOUBLE AS p FROM vr)"
AF = "af AS MATERIALIZED (SELECT v, coalesce(avg(g), 0) AS f FROM gx GROUP BY v)"
XC = "xc AS MATERIALIZED (SELECT v, s, coalesce(g - f, 0) AS x FROM gx JOIN af USING (v))"
XS = "xs AS MATERIALIZED (SELECT v, s, x * (CASE WHEN sqrt(f * (1 - f)) > 1e-9 THEN sqrt(2::DOUBLE) / sqrt(f * (1 - f)) ELSE 1 END) AS x FROM xc JOIN af USING (v))"
TB = """
tb AS (
  SELECT variant_idx, chr, id, bp + (variant_idx % 17 = 0)::BIGINT AS bp, CASE WHEN variant_idx % 5 = 0 THEN a2 ELSE a1 END AS a1, CASE WHEN variant_idx % 5 = 0 THEN a1 ELSE a2 END AS a2
  FROM vr WHERE variant_idx % 10 <> 9
)"""
