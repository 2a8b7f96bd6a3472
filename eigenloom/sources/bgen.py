"""BGEN files, layout 2, unphased diploid biallelic: dosages or probabilities of each variant."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _text(data: bytes, at: int, kind: str) -> tuple[str, int]:
    (n,) = struct.unpack_from(kind, data, at)
    at += struct.calcsize(kind)
    return data[at : at + n].decode(), at + n


def _unpack(block: bytes, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of no and of one copy of the second allele; NaN where missing."""
    n, alleles, low, high = struct.unpack_from("<IHBB", block)
    if n != samples or alleles != 2 or low != 2 or high != 2:
        raise ValueError("only diploid variants of two alleles are read")
    missing = np.frombuffer(block, np.uint8, n, 8) >> 7 == 1
    phased, bits = block[8 + n], block[9 + n]
    if phased:
        raise ValueError("phased variants are not read")
    stream = np.unpackbits(np.frombuffer(block, np.uint8, -1, 10 + n), bitorder="little")[: 2 * n * bits].reshape(2 * n, bits)
    p = (stream @ (1 << np.arange(bits, dtype=np.int64)) / ((1 << bits) - 1)).reshape(n, 2)
    p[missing] = np.nan
    return p[:, 0], p[:, 1]


def variants_of(data: bytes) -> Iterator[dict]:
    """Each variant of a file: its names, place and alleles, and the probabilities of its genotypes."""
    offset, header, m, n = struct.unpack_from("<4I", data)
    if data[16:20] not in (b"bgen", b"\0\0\0\0"):
        raise ValueError("not a BGEN file")
    (flags,) = struct.unpack_from("<I", data, header)
    compression, layout = flags & 3, flags >> 2 & 15
    if layout != 2:
        raise ValueError("only layout 2 is read")
    at = offset + 4
    for i in range(m):
        _, at = _text(data, at, "<H")
        rsid, at = _text(data, at, "<H")
        chr_, at = _text(data, at, "<H")
        bp, alleles = struct.unpack_from("<IH", data, at)
        at += 6
        names = []
        for _ in range(alleles):
            name, at = _text(data, at, "<I")
            names.append(name)
        (size,) = struct.unpack_from("<I", data, at)
        at += 4
        block = data[at : at + size]
        at += size
        if compression == 1:
            block = zlib.decompress(block[4:])
        elif compression == 2:
            import zstandard

            block = zstandard.ZstdDecompressor().decompress(block[4:], max_output_size=struct.unpack_from("<I", block)[0])
        none, one = _unpack(block, n)
        yield {"variant_idx": i, "chr": chr_, "id": rsid, "bp": bp, "a1": names[1], "a2": names[0], "p0": none, "p1": one}


def read_bgen(spark: SparkSession, path: str, probabilities: bool = False) -> DataFrame:
    """Variants of a .bgen file with g, the half-dosage of the minor allele, or with p0 and p1 of the second one.

    A file is one task's stream, since its records have no index; several files are read side by side.
    """
    values = "p0 array<double>, p1 array<double>" if probabilities else "g array<double>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed = lambda x: [None if np.isnan(v) else float(v) for v in x]
        for part in parts:
            for content in part["content"]:
                rows = []
                for v in variants_of(content):
                    p0, p1 = v.pop("p0"), v.pop("p1")
                    if probabilities:
                        v |= {"p0": listed(p0), "p1": listed(p1)}
                    else:
                        g = (p1 + 2 * (1 - p0 - p1)) / 2
                        if np.nansum(g) > (~np.isnan(g)).sum() / 2:  # the second allele is the common one
                            g, v["a1"], v["a2"] = 1 - g, v["a2"], v["a1"]
                        v["g"] = listed(g)
                    rows.append(v)
                    if len(rows) == 1024:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    schema = f"variant_idx long, chr string, id string, bp long, a1 string, a2 string, {values}"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)
