"""Text tables: sample and variant lists, likelihoods, counts, association results, and a model's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eigenloom.operators.variants import decode_beagle_allele


def numbered(lines: DataFrame, name: str) -> DataFrame:
    """Add each line's place, from 0, over all files by path, as a scan of text files gives them (filtered or not).

    A block of a file is read by one task and in order, so a line's place is the number of lines in the blocks
    before and its rank in its own. Lines stay where they were read; what is broadcast is one row for each block.
    """
    placed = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_lines"))
    blocks = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(blocks), ["_file", "_block"]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_file", "_block", "_at", "_first", "_before")


def fields(separators: str = r"[ \t]") -> Column:
    """A line's fields; neighbouring separators give empty ones."""
    return F.split("value", separators)


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a .bim list, or of a .mbim one, whose seventh column is `af`."""
    f = F.col("f")
    rows = numbered(spark.read.text(path).where("value <> ''"), "variant_idx").withColumn("f", F.split(F.trim("value"), r"[ \t]+"))
    return rows.select("variant_idx", f[0].alias("chr"), f[1].alias("id"), f[2].cast("double").alias("cm"), f[3].cast("long").alias("bp"), f[4].alias("a1"), f[5].alias("a2"), F.get(f, F.lit(6)).cast("double").alias("af"))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(variant_idx, af) of a .mbim list; a line without exactly seven columns is an error."""
    bad = spark.read.text(path).where(F.size(F.split(F.trim("value"), r"[ \t]+")) != 7).limit(1).collect()
    if bad:
        raise ValueError("a .mbim line must have seven columns")
    return read_bim(spark, path).select("variant_idx", "af")


def read_pvar(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a .pvar list, as of a .bim one: the first ALT allele is counted, REF is the other."""
    f = F.split("value", "\t")
    rows = numbered(spark.read.text(path).where("value <> '' and not startswith(value, '#')"), "variant_idx")
    return rows.select("variant_idx", f[0].alias("chr"), f[2].alias("id"), F.lit(0.0).alias("cm"), f[1].cast("long").alias("bp"), F.split(f[4], ",")[0].alias("a1"), f[3].alias("a2"), F.lit(None).cast("double").alias("af"))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"[ \t]+")
    return numbered(spark.read.text(path).where("value <> ''"), "sample_idx").select(F.col("sample_idx").cast("int").alias("sample_idx"), f[0].alias("fid"), f[1].alias("iid"))


def read_psam(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a .psam list: #FID IID .., or #IID .. with family 0. Lines with ## are comments."""
    lines = spark.read.text(path).where("value <> '' and not startswith(value, '##')")
    head = lines.where("startswith(value, '#')").first()
    names = head.value.lstrip("#").split() if head else ["FID", "IID"]
    f = F.split(F.trim("value"), r"[ \t]+")
    fid = f[names.index("FID")] if "FID" in names else F.lit("0")
    return numbered(lines.where("not startswith(value, '#')"), "sample_idx").select(F.col("sample_idx").cast("int").alias("sample_idx"), fid.alias("fid"), f[names.index("IID")].alias("iid"))


def read_beagle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Likelihoods and samples of a .beagle(.gz) file: (variants with p0, p1 arrays, samples).

    Columns after the first three come in threes for each sample; the third likelihood is implied. The marker
    name is chr_bp, alleles may be coded 0 to 3. The file is one stream, so rows are dealt out after reading.
    """
    lines = numbered(spark.read.text(path).where("value <> ''"), "at")
    head = lines.where("at = 0").first()
    names = head.value.split()
    if len(names) % 3 or len(names) < 6:
        raise ValueError("a BEAGLE header must have three columns, and three for each sample")
    n = len(names) // 3 - 1
    rows = lines.where("at > 0").repartition("at").withColumn("f", F.split(F.trim("value"), r"[ \t]+"))
    pick = lambda k: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(F.col("f"), i * 3 + 3 + k).cast("double"))
    f = F.col("f")
    marker = F.split(f[0], "_")
    out = rows.select((F.col("at") - 1).alias("variant_idx"), f[0].alias("id"), F.array_join(F.slice(marker, F.lit(1), F.size(marker) - 1), "_").alias("chr"), F.element_at(marker, -1).cast("long").alias("bp"), decode_beagle_allele(f[1]).alias("a1"), decode_beagle_allele(f[2]).alias("a2"), pick(0).alias("p0"), pick(1).alias("p1"))
    return out, spark.createDataFrame([(i, "0", names[3 + 3 * i]) for i in range(n)], "sample_idx int, fid string, iid string")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Cells (feature, sample, n) of a comma-separated matrix (also .zst, .gz): a line is a feature, no header.

    Lines with different numbers of fields are an error when their cells are used.
    """
    lines = numbered(spark.read.text(path).where("value <> ''"), "line").repartition("line")
    wide = F.size(F.split("value", ","))
    uneven = lines.agg(F.min(wide).alias("lo"), F.max(wide).alias("hi")).first()
    if uneven.lo != uneven.hi:
        raise ValueError("lines have different numbers of samples")
    return lines.select(F.col("line").cast("string").alias("feature"), F.posexplode(F.split("value", ",")).alias("sample", "n")).select("feature", F.col("sample").cast("string").alias("sample"), F.col("n").cast("double").alias("n"))


def read_associations(spark: SparkSession, path: str, names: tuple[str, str, str] = ("CHR", "BP", "P"), p_max: float | None = None) -> DataFrame:
    """Association results of a tab-separated file with a header: chr, bp, p and the raw line, with p <= p_max."""
    lines = spark.read.text(path)
    head = lines.first()
    columns = head.value.split("\t") if head else []
    missing = [n for n in names if n not in columns]
    if missing:
        raise ValueError(f"the association file lacks {missing}")
    f = F.split("value", "\t")
    out = lines.where(F.col("value") != head.value).select(f[columns.index(names[0])].alias("chr"), f[columns.index(names[1])].cast("long").alias("bp"), f[columns.index(names[2])].cast("double").alias("p"), F.col("value").alias("line"))
    return out if p_max is None else out.where(F.col("p") <= p_max)


def read_vectors(spark: SparkSession, path: str, k: int | None = None, rows: int | None = None) -> DataFrame:
    """Row vectors (idx, v) of a .eigvecs or .loadings file, their first k numbers; checks the number of rows."""
    out = numbered(spark.read.text(path).where("value <> ''"), "idx").select("idx", F.transform(F.split(F.trim("value"), r"[ \t]+"), lambda x: x.cast("double")).alias("v"))
    if rows is not None and (found := out.count()) != rows:
        raise ValueError(f"{path} has {found} rows instead of {rows}")
    return out if k is None else out.withColumn("v", F.slice("v", 1, k))


def read_spectrum(spark: SparkSession, path: str) -> tuple[list[float], tuple[int, int] | None]:
    """Values of a .eigvals or .sigvals file, and (N, M) if it has a #N,M header."""
    lines = [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]
    head = next((tuple(int(x) for x in s[1:].split(",")[:2]) for s in lines if s.startswith("#")), None)
    return [float(s) for s in lines if not s.startswith("#")], head
