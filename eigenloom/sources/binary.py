"""Binary matrices: PLINK .bed, fixed-width .pgen, and float matrices of residuals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first bytes of a variant-major .bed file, and what its two-bit codes 0 to 3 mean.
BED_MAGIC = b"\x6c\x1b\x01"
BED_VALUES = (1.0, np.nan, 0.5, 0.0)
#: The first bytes of a .pgen file of fixed-width hard calls (storage mode 2); codes 0 to 3 are
#: the copies of ALT, and missing. Its header has 12 bytes: these three, then variants and samples as u4, and flags.
PGEN_MAGIC = b"\x6c\x1b\x02"
PGEN_VALUES = (0.0, 0.5, 1.0, np.nan)


def decode_codes(raw: np.ndarray, samples: int, values: tuple[float, ...]) -> np.ndarray:
    """Values of rows of bytes with four two-bit codes each, lowest bits first."""
    codes = (raw[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return np.array(values)[codes.reshape(len(raw), -1)[:, :samples]]


def _packed_rows(spark: SparkSession, path: str, header: int, row_bytes: int, rows: int, decode, magic: bytes, per_task: int = 4096) -> DataFrame:
    """Rows (variant_idx, g) of a file of equal records: ranges of rows are dealt out as tasks.

    A task reads its own byte range where the path is a file that all executors see; other stores go through
    Spark's binary reader, which holds one file's bytes in a task.
    """
    local = path.removeprefix("file://") if path.startswith(("/", "file://")) else None

    def rows_of(data: bytes, first: int) -> pd.DataFrame:
        raw = np.frombuffer(data, np.uint8).reshape(-1, row_bytes)
        g = decode(raw)
        return pd.DataFrame({"variant_idx": np.arange(first, first + len(raw)), "g": [[None if np.isnan(x) else float(x) for x in r] for r in g]})

    if local:

        def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for first in part["id"]:
                    with open(local, "rb") as f:
                        if f.read(len(magic)) != magic:
                            raise ValueError(f"{path} does not begin as such a file does")
                        f.seek(header + int(first) * row_bytes)
                        yield rows_of(f.read(min(per_task, rows - int(first)) * row_bytes), int(first))

        tasks = -(-rows // per_task)
        return spark.range(0, rows, per_task, max(1, tasks)).mapInPandas(read, "variant_idx long, g array<double>")

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                if content[: len(magic)] != magic:
                    raise ValueError(f"{path} does not begin as such a file does")
                for first in range(0, rows, per_task):
                    at = header + first * row_bytes
                    yield rows_of(content[at : at + min(per_task, rows - first) * row_bytes], first)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(whole, "variant_idx long, g array<double>")


def read_bed(spark: SparkSession, path: str, samples: int, variants: int) -> DataFrame:
    """Genotypes (variant_idx, g) of a variant-major .bed file: half-dosages of A1, null where missing."""
    return _packed_rows(spark, path, 3, (samples + 3) // 4, variants, lambda raw: decode_codes(raw, samples, BED_VALUES), BED_MAGIC)


def read_pgen(spark: SparkSession, path: str, samples: int, variants: int) -> DataFrame:
    """Genotypes of a fixed-width hard-call .pgen file: half-dosages of ALT, null where missing.

    Variable-width .pgen files are not read; convert them, or load their dosages as a table.
    """
    return _packed_rows(spark, path, 12, (samples + 3) // 4, variants, lambda raw: decode_codes(raw, samples, PGEN_VALUES), PGEN_MAGIC)


def read_residuals(spark: SparkSession, path: str, samples: int, variants: int) -> DataFrame:
    """Rows (variant_idx, r) of a residual matrix: u4 variants and samples, then 4-byte floats by variant; centred."""
    magic = np.array([variants, samples], "<u4").tobytes()

    def decode(raw: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(raw).view("<f4").astype(float)
        return x - x.mean(axis=1, keepdims=True)

    return _packed_rows(spark, path, 8, 4 * samples, variants, decode, magic).withColumnRenamed("g", "r")


def model_frequencies(us: np.ndarray, loadings: DataFrame, frequencies: DataFrame) -> DataFrame:
    """pi = clip((U S v + 2 af) / 2) of each variant from a model's files: (variant_idx, pi)."""
    joined = loadings.withColumnRenamed("idx", "variant_idx").join(frequencies, "variant_idx")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            v = np.stack(part["v"]) if len(part) else np.zeros((0, us.shape[1]))
            pi = np.clip((v @ us.T + 2 * part["af"].to_numpy()[:, None]) / 2, 1e-4, 1 - 1e-4)
            yield pd.DataFrame({"variant_idx": part["variant_idx"], "pi": list(pi)})

    return joined.select("variant_idx", F.col("v"), "af").mapInPandas(run, "variant_idx long, pi array<double>")
