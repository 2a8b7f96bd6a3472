"""Centring and scaling of matrix rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eigenloom.operators.variants import with_each, with_frequency

EPSILON_GENETIC, EPSILON_FEATURE = 1e-9, 1e-10


def centre(g: Column, af: Column) -> Column:
    """g - af, and 0 where g is missing."""
    return with_each(g, af, lambda x, a: F.coalesce(x - a, F.lit(0.0)))


def genetic_scale(af: Column, ploidy: int = 2) -> Column:
    """sqrt(ploidy) / sqrt(af (1 - af)); 1 where that deviation is 1e-9 or less."""
    sd = F.sqrt(af * (F.lit(1.0) - af))
    return F.when(sd > EPSILON_GENETIC, F.sqrt(F.lit(float(ploidy))) / sd).otherwise(F.lit(1.0))


def centred(geno: DataFrame) -> DataFrame:
    """Add `af` and `x`, the centred values with missing ones at the mean."""
    rows = geno if "af" in geno.columns else with_frequency(geno)
    return rows.withColumn("x", centre(F.col("g"), F.col("af")))


def standardized(geno: DataFrame, ploidy: int = 2) -> DataFrame:
    """Add `af` and `x`, centred and divided by the binomial deviation."""
    scale = genetic_scale(F.col("af"), ploidy)
    return centred(geno).withColumn("x", with_each(F.col("x"), scale, lambda v, s: v * s))


def library_size(counts: DataFrame) -> DataFrame:
    """Total count of each sample."""
    return counts.groupBy("sample").agg(F.sum("n").alias("library"))


def median_library(sizes: DataFrame) -> Column:
    """Exact median of the library sizes; of two middle ones the mean, without its fraction, as sizes are whole numbers."""
    return F.floor(F.median(F.col("library"))).cast("double")


def normalize_counts(counts: DataFrame, scale: int, scale_factor: float = 1.0) -> DataFrame:
    """Values `x` of each (feature, sample) cell by the scale's rule.

    0 leaves counts as they are; 1 centres features and divides by their deviation (N - 1); 2 first takes
    log10(n * median library / library + 1); 3 log(1 + n / library * scale_factor); 4 n / library *
    scale_factor. Sample totals are few numbers for each sample and are joined back by sample.
    """
    if scale not in range(5):
        raise ValueError("count data takes a scale from 0 to 4")
    if scale == 0:
        return counts.withColumn("x", F.col("n").cast("double"))
    x = F.col("n").cast("double")
    if scale > 1:
        sizes = library_size(counts)
        if scale == 2:
            sizes = sizes.crossJoin(sizes.agg(median_library(sizes).alias("middle")))  # one row
        counts = counts.join(sizes, "sample")
        part = x / F.col("library")
        x = {2: F.log10(x * F.col("middle") / F.col("library") + 1), 3: F.log1p(part * scale_factor), 4: part * scale_factor}[scale]
    return z_score(counts.withColumn("x", x).drop("library", "middle"))


def z_score(cells: DataFrame) -> DataFrame:
    """Centre `x` within each feature and divide by its deviation (N - 1) where that is above 1e-10."""
    moments = cells.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    out = cells.join(moments, "feature").withColumn("x", (F.col("x") - F.col("mean")) / F.when(F.col("sd") > EPSILON_FEATURE, F.col("sd")).otherwise(F.lit(1.0)))
    return out.drop("mean", "sd")


def zero_filled(counts: DataFrame) -> DataFrame:
    """Every (feature, sample) cell, 0 where there is no count. The result is the dense matrix by definition."""
    cells = counts.select("feature").distinct().crossJoin(counts.select("sample").distinct())
    return cells.join(counts, ["feature", "sample"], "left").select("feature", "sample", F.coalesce("n", F.lit(0.0)).alias("n"))


def pack_counts(cells: DataFrame, value: str = "x") -> tuple[DataFrame, list[str]]:
    """Rows by feature (variant_idx, id, g), samples in ascending order of their names; and these names."""
    samples = [r[0] for r in cells.select("sample").distinct().orderBy("sample").collect()]
    rows = cells.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", value))), lambda s: s[value]).alias("g"))
    lens = rows.where(F.size("g") != len(samples)).limit(1).collect()
    if lens:
        raise ValueError(f"feature {lens[0].feature} does not have a value for every sample")
    # a row's number is its name's rank, at every size; the window sorts names alone
    ranks = rows.select("feature").withColumn("variant_idx", F.row_number().over(Window.orderBy("feature")).cast("long") - 1)
    return rows.join(ranks, "feature").select("variant_idx", F.col("feature").alias("id"), "g"), samples
