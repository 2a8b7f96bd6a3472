"""Files that are written and read back, and byte formats."""

import gzip

import numpy as np
import pytest
import zstandard

from eigenloom.operators import ld
from eigenloom.sources import binary, sinks, text

N, M = 7, 5
G = np.array([[0, 0.5, 1, np.nan, 0.5, 1, 0]] * M) * np.array([[1], [1], [1], [0], [1]])


def pack(codes):
    padded = np.zeros((len(codes), -(-codes.shape[1] // 4) * 4), np.uint8)
    padded[:, : codes.shape[1]] = codes
    quads = padded.reshape(len(codes), -1, 4)
    return (quads[:, :, 0] | quads[:, :, 1] << 2 | quads[:, :, 2] << 4 | quads[:, :, 3] << 6).astype(np.uint8).tobytes()


def matrix(df, column="g"):
    return np.array([[np.nan if x is None else x for x in getattr(r, column)] for r in df.orderBy("variant_idx").collect()])


def test_bed_and_pgen_hold_the_same(spark, tmp_path):
    bed = np.select([np.isnan(G), G == 1, G == 0.5], [1, 0, 2], 3).astype(np.uint8)
    pgen = np.select([np.isnan(G), G == 1, G == 0.5], [3, 2, 1], 0).astype(np.uint8)
    (tmp_path / "a.bed").write_bytes(binary.BED_MAGIC + pack(bed))
    (tmp_path / "a.pgen").write_bytes(binary.PGEN_MAGIC + np.array([M, N], "<u4").tobytes() + b"\x40" + pack(pgen))
    for got in (binary.read_bed(spark, str(tmp_path / "a.bed"), N, M), binary.read_pgen(spark, str(tmp_path / "a.pgen"), N, M)):
        assert np.array_equal(matrix(got), G, equal_nan=True)
    with pytest.raises(Exception, match="does not begin"):
        binary.read_bed(spark, str(tmp_path / "a.pgen"), N, M).collect()


def test_residuals_round_trip(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(M, N))
    x -= x.mean(axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "variant_idx long, r array<double>")
    (tmp_path / "r").write_bytes(sinks.residual_block(rows, N, M))
    assert np.allclose(matrix(binary.read_residuals(spark, str(tmp_path / "r"), N, M), "r"), x, atol=1e-6)


def test_lists(spark, tmp_path):
    (tmp_path / "a.bim").write_text("1\trs1\t0\t10\tA\tG\n1 rs2 0.5 20 C T\n")
    (tmp_path / "a.pvar").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\n1\t10\trs1\tG\tA,T\n1\t20\trs2\tT\tC\n")
    bim, pvar = (f(spark, str(tmp_path / p)).select("variant_idx", "chr", "id", "bp", "a1", "a2").collect() for f, p in ((text.read_bim, "a.bim"), (text.read_pvar, "a.pvar")))
    assert bim == pvar
    (tmp_path / "a.fam").write_text("F1 I1 0 0 1 -9\nF2 I2 0 0 1 -9\n")
    (tmp_path / "a.psam").write_text("##c\n#FID\tIID\tSEX\nF1\tI1\t1\nF2\tI2\t1\n")
    (tmp_path / "b.psam").write_text("#IID\nI1\nI2\n")
    assert text.read_fam(spark, str(tmp_path / "a.fam")).collect() == text.read_psam(spark, str(tmp_path / "a.psam")).collect()
    assert [r.fid for r in text.read_psam(spark, str(tmp_path / "b.psam")).collect()] == ["0", "0"]
    with pytest.raises(ValueError):
        text.read_frequencies(spark, str(tmp_path / "a.bim"))


def test_beagle(spark, tmp_path):
    with gzip.open(tmp_path / "a.beagle.gz", "wt") as f:
        f.write("marker\tallele1\tallele2\ts1\ts1\ts1\ts2\ts2\ts2\n1_10\t0\t2\t.9\t.08\t.02\t.1\t.8\t.1\nchr_x_20\tC\tT\t.2\t.3\t.5\t1\t0\t0\n")
    rows, samples = text.read_beagle(spark, str(tmp_path / "a.beagle.gz"))
    a, b = rows.orderBy("variant_idx").collect()
    assert (a.chr, a.bp, a.a1, a.a2, a.p0, a.p1) == ("1", 10, "A", "G", [0.9, 0.1], [0.08, 0.8])
    assert (b.chr, b.bp, b.a1, b.a2) == ("chr_x", 20, "C", "T") and [r.iid for r in samples.collect()] == ["s1", "s2"]


def test_counts(spark, tmp_path):
    (tmp_path / "c.csv.zst").write_bytes(zstandard.compress(b"1,2,3\n4,5,6\n"))
    cells = {(r.feature, r["sample"]): r.n for r in text.read_counts(spark, str(tmp_path / "c.csv.zst")).collect()}
    assert cells == {(str(i), str(j)): 3.0 * i + j + 1 for i in range(2) for j in range(3)}
    (tmp_path / "d.csv").write_text("1,2\n3\n")
    with pytest.raises(ValueError):
        text.read_counts(spark, str(tmp_path / "d.csv"))


def test_associations(spark, tmp_path):
    (tmp_path / "a.assoc").write_text("P\tCHR\tBP\n0.5\t1\t10\n0.001\t2\t20\n")
    rows = text.read_associations(spark, str(tmp_path / "a.assoc"), p_max=0.01).collect()
    assert [(r.chr, r.bp, r.p, r.line) for r in rows] == [("2", 20, 0.001, "0.001\t2\t20")]
    with pytest.raises(ValueError):
        text.read_associations(spark, str(tmp_path / "a.assoc"), ("CHR", "POS", "P"))


def test_writers_read_back(spark, tmp_path):
    v = spark.createDataFrame([(i, "1", f"rs{i}", 0.0, 10 * i, "A", "G", 0.25) for i in range(12)], "variant_idx long, chr string, id string, cm double, bp long, a1 string, a2 string, af double").repartition(4)
    sinks.write_variants(v, str(tmp_path / "v.mbim"))
    assert [r.id for r in text.read_bim(spark, str(tmp_path / "v.mbim")).orderBy("variant_idx").collect()] == [f"rs{i}" for i in range(12)]
    assert text.read_frequencies(spark, str(tmp_path / "v.mbim")).where("af = 0.25").count() == 12
    vectors = spark.createDataFrame([(i, [i / 3, -1.5]) for i in range(12)], "i long, v array<double>").repartition(3)
    sinks.write_vectors(vectors, str(tmp_path / "u"), "i", "v")
    back = text.read_vectors(spark, str(tmp_path / "u"), k=1, rows=12).orderBy("idx").collect()
    assert [r.v[0] for r in back] == [float(f"{i / 3:.6g}") for i in range(12)]
    with pytest.raises(ValueError):
        text.read_vectors(spark, str(tmp_path / "u"), rows=3)
    sinks.write_spectrum(v, np.array([2.5, 1.25]), str(tmp_path / "s"), (7, 12))
    assert text.read_spectrum(spark, str(tmp_path / "s")) == ([2.5, 1.25], (7, 12))
    pairs = spark.createDataFrame([("1", 0, 1, 0, 10, 0.5), ("1", 0, 2, 0, 20, None)], "chr string, i long, k long, bp_i long, bp_k long, r2 double")
    sinks.write_pairs(pairs, v, str(tmp_path / "p"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "p")).coalesce(1).collect()]
    assert "1\t0\trs0\t1\t10\trs1\t0.500000" in lines and len(lines) == 3
    clumps = ld.clump(pairs.fillna(0.0), v.drop("af"), spark.createDataFrame([("1", 0, 1e-5, "a"), ("1", 10, 1e-3, "b"), ("1", 20, 1e-3, "c")], "chr string, bp long, p double, line string"))
    sinks.write_clumps(clumps, str(tmp_path / "c"), "L")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect()) == ["L\tSP2", "a\t10"]


@pytest.mark.parametrize("codec", [0, 1, 2])
def test_bgen(spark, tmp_path, codec):
    import struct
    import zlib

    from eigenloom.sources.bgen import read_bgen

    p = np.array([[[255, 0], [0, 255], [0, 0], [51, 204]], [[0, 0], [0, 0], [0, 255], [0, 0]]], np.uint8)
    name = lambda s, k="<H": struct.pack(k, len(s)) + s.encode()
    body = b""
    for i, q in enumerate(p):
        block = struct.pack("<IHBB", 4, 2, 2, 2) + bytes([2, 2, 2, 0x82]) + bytes([0, 8]) + q.tobytes()
        packed = {0: block, 1: struct.pack("<I", len(block)) + zlib.compress(block), 2: struct.pack("<I", len(block)) + zstandard.compress(block)}[codec]
        body += name("") + name(f"rs{i}") + name("1") + struct.pack("<IH", 10 + i, 2) + name("A", "<I") + name("G", "<I") + struct.pack("<I", len(packed)) + packed
    (tmp_path / "a.bgen").write_bytes(struct.pack("<4I", 20, 20, 2, 4) + b"bgen" + struct.pack("<I", codec | 2 << 2) + body)
    a, b = read_bgen(spark, str(tmp_path / "a.bgen")).orderBy("variant_idx").collect()
    assert a.g == [0.0, 0.5, 1.0, None] and (a.id, a.bp, a.a1, a.a2) == ("rs0", 10, "G", "A")
    assert b.g == [0.0, 0.0, 0.5, None] and b.a1 == "A"
    r = read_bgen(spark, str(tmp_path / "a.bgen"), probabilities=True).where("variant_idx = 0").first()
    assert r.p0 == [1.0, 0.0, 0.0, None] and r.p1 == [0.0, 1.0, 0.0, None]


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    want = []
    for name in "ab":
        lines = [f"{name}{i}" + "x" * (i % 50) if i % 7 else "" for i in range(4000)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines))
        want += [x for x in lines if x]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = text.numbered(spark.read.text(str(tmp_path)).where("value <> ''"), "at")
        assert rows.rdd.getNumPartitions() > 5
        assert [r.value for r in rows.orderBy("at").collect()] == want
        assert [r.at for r in rows.where("at >= 0").orderBy("at").collect()] == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
