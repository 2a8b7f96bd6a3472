"""Variant tables: allele frequencies, missing rates, filters, marker matching, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def observed(g: Column) -> Column:
    """How many samples have a value."""
    return F.size(F.filter(g, lambda x: x.isNotNull()))


def frequency(g: Column) -> Column:
    """Mean of the values there are; 0 if there are none."""
    total = F.aggregate(g, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when(observed(g) > 0, total / observed(g)).otherwise(F.lit(0.0))


def with_each(array: Column, scalar: Column, fn) -> Column:
    """fn(element, scalar) of each element. The scalar is computed once for a row, not in the lambda for each element."""
    return F.zip_with(array, F.array_repeat(scalar, F.size(array)), fn)


def maf(af: Column) -> Column:
    """Minor allele frequency."""
    return F.least(af, F.lit(1.0) - af)


def with_frequency(geno: DataFrame) -> DataFrame:
    """Add `af`, the mean half-dosage of the counted allele. Narrow: each row has all samples."""
    return geno.withColumn("af", frequency(F.col("g")))


def missing_by_variant(geno: DataFrame) -> DataFrame:
    return geno.select("variant_idx", (F.size("g") - observed(F.col("g"))).cast("long").alias("n_missing"), ((F.size("g") - observed(F.col("g"))) / F.size("g")).alias("rate"))


def missing_by_sample(geno: DataFrame) -> DataFrame:
    """Missing rate of each sample, by a partial sum in each task."""
    each = geno.select(F.posexplode("g").alias("sample_idx", "x"))
    lacking = F.col("x").isNull().cast("long")
    return each.groupBy("sample_idx").agg(F.sum(lacking).alias("n_missing"), F.avg(lacking.cast("double")).alias("rate"))


def missing_rate(geno: DataFrame) -> DataFrame:
    """Share of missing cells of the whole matrix: one row."""
    cells = geno.agg(F.sum(F.size("g") - observed(F.col("g"))).alias("n_missing"), F.sum(F.size("g")).alias("cells"))
    return cells.select("n_missing", (F.col("n_missing") / F.col("cells")).alias("rate"))


def class_counts(geno: DataFrame) -> DataFrame:
    """How many samples of each variant have each genotype: n0, n1, n2 copies of the counted allele, n_missing."""
    of = lambda v: F.size(F.filter("g", lambda x: x == v)).cast("long")
    return geno.select("variant_idx", of(0.0).alias("n0"), of(0.5).alias("n1"), of(1.0).alias("n2"), (F.size("g") - observed(F.col("g"))).cast("long").alias("n_missing"))


def filter_maf(geno: DataFrame, threshold: float) -> DataFrame:
    """Variants whose minor allele frequency is above the threshold, which must lie in (0, 0.5)."""
    if not 0 < threshold < 0.5:
        raise ValueError("maf must be between 0 and 0.5")
    return (geno if "af" in geno.columns else with_frequency(geno)).where(maf(F.col("af")) > threshold)


def quality_counts(geno: DataFrame) -> DataFrame:
    """Variants whose frequency is 0 or 1, and exactly one half: they have no variance, or no minor allele."""
    af = F.col("af")
    return with_frequency(geno).agg(F.count("*").alias("n_variants"), F.sum(((af == 0) | (af == 1)).cast("long")).alias("n_fixed"), F.sum((af == 0.5).cast("long")).alias("n_half"))


def marker_key(chr_: Column, bp: Column, a1: Column, a2: Column) -> Column:
    return F.concat_ws("_", chr_, bp.cast("string"), a1, a2)


def decode_beagle_allele(code: Column) -> Column:
    """0, 1, 2, 3 are A, C, G, T; other codes stay."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in zip("0123", "ACGT", strict=True) for x in p)), code), code)


def match_markers(target: DataFrame, reference: DataFrame, check: bool = True) -> DataFrame:
    """Markers of `target` found in `reference`, by chromosome, place and alleles, in either order.

    A target marker with the reference's alleles swapped has flip = true; the same order wins where both are
    found. Both sides shuffle once, on the sorted pair of alleles. Returns variant_idx, ref_idx, flip. A key
    that the reference repeats is an error.
    """
    if check:
        again = reference.groupBy("chr", "bp", "a1", "a2").count().where("count > 1").limit(1).collect()
        if again:
            raise ValueError(f"marker {again[0][:4]} is repeated in the reference")

    def keyed(df: DataFrame, idx: str) -> DataFrame:
        return df.select("chr", "bp", F.least("a1", "a2").alias("lo"), F.greatest("a1", "a2").alias("hi"), F.col("a1").alias(f"{idx}_a1"), F.col("variant_idx").alias(idx))

    both = keyed(target, "t").join(keyed(reference, "r"), ["chr", "bp", "lo", "hi"])
    found = both.select(F.col("t").alias("variant_idx"), F.col("r").alias("ref_idx"), (F.col("t_a1") != F.col("r_a1")).alias("flip"))
    best = found.groupBy("variant_idx").agg(F.min(F.struct("flip", "ref_idx")).alias("m"))
    return best.select("variant_idx", "m.ref_idx", "m.flip")


def markers_identical(target: DataFrame, reference: DataFrame) -> DataFrame:
    """Whether both lists have the same keys in the same order: one row, `identical` and both sizes."""
    key = marker_key(F.col("chr"), F.col("bp"), F.col("a1"), F.col("a2"))
    a = target.select("variant_idx", key.alias("ka"))
    b = reference.select("variant_idx", key.alias("kb"))
    both = a.join(b, "variant_idx", "full_outer")
    return both.agg(F.coalesce(F.min(F.coalesce(F.col("ka") == F.col("kb"), F.lit(False))), F.lit(True)).alias("identical"), F.count("ka").alias("n_target"), F.count("kb").alias("n_reference"))


def merge_filesets(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Rows of several filesets over the same samples, one after the other; parts are (table, rows)."""
    out, base = None, 0
    for df, rows in parts:
        shifted = df.withColumn("variant_idx", F.col("variant_idx") + base)
        out, base = shifted if out is None else out.unionByName(shifted), base + rows
    if out is None:
        raise ValueError("nothing to merge")
    return out


def band_starts(rows: int, bands: int) -> list[int]:
    """First new place of each band when rows are dealt to bands in turn."""
    starts = [0]
    for b in range(bands - 1):
        starts.append(starts[-1] + len(range(b, rows, bands)))
    return starts


def band_permutation(variants: DataFrame, rows: int, bands: int) -> DataFrame:
    """Deal variants to bands in turn: `band`, and `permuted_idx`, the place where each then comes."""
    starts = F.array(*map(F.lit, band_starts(rows, bands)))
    band = F.pmod(F.col("variant_idx"), F.lit(bands))
    return variants.withColumn("band", band.cast("int")).withColumn("permuted_idx", (F.element_at(starts, (band + 1).cast("int")) + F.floor(F.col("variant_idx") / bands)).cast("long"))


def running_max(loadings: DataFrame, window: int = 1000) -> DataFrame:
    """Largest absolute loading among each variant and the window - 1 before it, for each component and chromosome."""
    w = Window.partitionBy("chr", "pc").orderBy("variant_idx").rowsBetween(1 - window, 0)
    return loadings.withColumn("running_max", F.max(F.abs("v")).over(w))
