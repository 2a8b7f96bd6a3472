"""Writers of the text and binary outputs. Tables written line by line keep the order of their key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenloom.functions.stats import significant


def write_lines(df: DataFrame, path: str, line: Column, order: list[str], header: str | None = None, compression: str = "none") -> None:
    """A folder of text parts in ascending order of the key; the header is a line of the first part."""
    lines = df.select(line.alias("value"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.lit(1).alias("_h"))
    keys = ["_h", *(f"_{i}" for i in range(len(order)))]
    if header is not None:
        blank = [F.lit(None).cast(t).alias(n) for n, t in lines.dtypes if n not in ("value", "_h")]
        lines = lines.unionByName(df.sparkSession.range(1).select(F.lit(header).alias("value"), *blank, F.lit(0).alias("_h")))
    lines.orderBy(*keys).select("value").write.option("compression", compression).text(path)


def write_vectors(rows: DataFrame, path: str, idx: str, vector: str) -> None:
    """One row of six-digit numbers for each sample or variant, by its place: .eigvecs and .loadings."""
    write_lines(rows, path, F.array_join(F.transform(vector, lambda x: significant(x)), "\t"), [idx])


def write_spectrum(spark_df: DataFrame, values: np.ndarray, path: str, header: tuple[int, int] | None = None) -> None:
    """One value a line, after a #N,M line if dimensions are given: .eigvals and .sigvals."""
    rows = spark_df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    write_lines(rows, path, F.format_string("%.10g", F.col("v")), ["i"], f"#{header[0]},{header[1]}" if header else None)


def write_scores_with_ids(scores: DataFrame, samples: DataFrame, path: str, k: int) -> None:
    """#FID IID PC1 .. lines, by sample: .eigvecs2."""
    wide = scores.groupBy("sample_idx").pivot("pc", list(range(1, k + 1))).agg(F.first("u"))
    rows = samples.join(wide, "sample_idx")
    line = F.concat_ws("\t", "fid", "iid", *(significant(F.col(str(i + 1))) for i in range(k)))
    write_lines(rows, path, line, ["sample_idx"], "\t".join(["#FID", "IID", *(f"PC{i + 1}" for i in range(k))]))


def write_variants(variants: DataFrame, path: str) -> None:
    """Six columns and, if there is an `af`, a seventh: .bim, .mbim and the lists of pruning."""
    cols = [F.col("chr"), F.col("id"), significant(F.col("cm")) if "cm" in variants.columns else F.lit("0"), F.col("bp").cast("string"), F.col("a1"), F.col("a2")]
    if "af" in variants.columns:
        cols.append(F.format_string("%.10g", F.col("af")))
    write_lines(variants, path, F.concat_ws("\t", *cols), ["variant_idx"])


def write_pairs(pairs: DataFrame, variants: DataFrame, path: str) -> None:
    """The r2 report, gzipped: places and names of both variants, r2 with six decimals."""
    name = variants.select("variant_idx", "id")
    rows = pairs.join(name.select(F.col("variant_idx").alias("i"), F.col("id").alias("id_i")), "i").join(name.select(F.col("variant_idx").alias("k"), F.col("id").alias("id_k")), "k")
    line = F.concat_ws("\t", "chr", F.col("bp_i").cast("string"), "id_i", "chr", F.col("bp_k").cast("string"), "id_k", F.coalesce(F.format_string("%.6f", F.col("r2")), F.lit("nan")))
    write_lines(rows, path, line, ["i", "k"], "CHR_A\tBP_A\tSNP_A\tCHR_B\tBP_B\tSNP_B\tR2", "gzip")


def write_clumps(clumps: DataFrame, path: str, header: str) -> None:
    """The association file's lines of index variants, with their members."""
    write_lines(clumps, path, F.concat_ws("\t", "line", "sp2"), ["chr", "p", "bp"], f"{header}\tSP2")


def write_hwe(found: DataFrame, variants: DataFrame, path: str) -> None:
    rows = found.join(variants.select("variant_idx", "id"), "variant_idx")
    line = F.concat_ws("\t", "id", *(significant(F.col(c)) for c in ("hwe_p", "lrt", "inbreeding")))
    write_lines(rows, path, line, ["variant_idx"], "#ID\tHWE_P\tLRT\tInbreeding_coefficient")


def write_inbreeding(found: DataFrame, samples: DataFrame, path: str) -> None:
    rows = found.join(samples, "sample_idx")
    write_lines(rows, path, F.concat_ws("\t", "fid", "iid", significant(F.col("inbreeding"))), ["sample_idx"], "#FID\tIID\tInbreeding_coefficient")


def write_bootstrap(summary: DataFrame, path: str) -> None:
    cols = ("baseline", "mean", "se", "min", "max", "rmsd")
    line = F.concat_ws("\t", F.col("sample_idx").cast("string"), F.col("pc").cast("string"), *(significant(F.col(c)) for c in cols))
    write_lines(summary, path, line, ["sample_idx", "pc"], "\t".join(["sample", "pc", *cols]))


def residual_block(rows: DataFrame, samples: int, variants: int) -> bytes:
    """Bytes of a residual matrix file, for matrices that fit one machine; larger ones stay Parquet tables."""
    data = [r.r for r in rows.orderBy("variant_idx").select("r").collect()]
    return np.array([variants, samples], "<u4").tobytes() + np.array(data, "<f4").tobytes()


def write_statistics(found: DataFrame, variants: DataFrame, path: str, columns: list[str]) -> None:
    """A name and six-digit numbers for each variant: .galinsky, .galinsky.pval, .zscore and the .pcadapt tables."""
    rows = found.join(variants.select("variant_idx", "id"), "variant_idx")
    write_lines(rows, path, F.concat_ws("\t", "id", *(significant(F.col(c)) for c in columns)), ["variant_idx"], "\t".join(["#ID", *columns]))


def write_square(rows: DataFrame, path: str, idx: str, row: str) -> None:
    """A square matrix by rows: .cov and the replicates' covariances."""
    write_vectors(rows, path, idx, row)


def write_residuals(rows: DataFrame, path: str, samples: int, variants: int) -> None:
    """A residual matrix as a partitioned table of 4-byte floats with its dimensions; nothing is collected."""
    packed = rows.select("variant_idx", F.transform("r", lambda x: x.cast("float")).alias("r"), F.lit(samples).alias("samples"), F.lit(variants).alias("variants"))
    packed.write.parquet(path)


def read_residual_parts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (variant_idx, r) of such a table, centred as those of the one-file form are."""
    rows = spark.read.parquet(path).select("variant_idx", F.transform("r", lambda x: x.cast("double")).alias("r"))
    mean = F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / F.size("r")
    return rows.select("variant_idx", F.zip_with("r", F.array_repeat(mean, F.size("r")), lambda x, m: x - m).alias("r"))


def write_log(spark: SparkSession, path: str, events: list[tuple[str, str]]) -> None:
    """Lines of a run's log, a date and what was done, in their order."""
    rows = spark.createDataFrame([(i, at, what) for i, (at, what) in enumerate(events)], "i int, at string, what string")
    write_lines(rows, path, F.concat_ws(" ", F.concat(F.lit("["), "at", F.lit("]")), "what"), ["i"])
