"""Projection of new samples onto components, and its bootstrap."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.operators.em import EDGE, posterior_dosage
from eigenloom.operators.matrix import batch_of, cut, rows_of, sum_arrays
from eigenloom.operators.normalize import genetic_scale
from eigenloom.operators.variants import with_each


def matched_rows(geno: DataFrame, matches: DataFrame, reference: DataFrame, standardize: bool = True, ploidy: int = 2) -> DataFrame:
    """Target rows with the reference's frequencies and loadings: (variant_idx, af, v, x), x null where missing.

    `matches` has variant_idx, ref_idx and flip, `reference` variant_idx, af and v. A swapped marker has
    frequency 1 - af and loadings -v. One join each, on the markers that match.
    """
    ref = reference.select(F.col("variant_idx").alias("ref_idx"), F.col("af").alias("ref_af"), F.col("v").alias("ref_v"))
    rows = geno.join(matches, "variant_idx").join(ref, "ref_idx")
    af = F.when(F.col("flip"), 1 - F.col("ref_af")).otherwise(F.col("ref_af"))
    rows = rows.withColumn("af", af).withColumn("v", F.when(F.col("flip"), F.transform("ref_v", lambda x: -x)).otherwise(F.col("ref_v")))
    scale = genetic_scale(F.col("af"), ploidy) if standardize else F.lit(1.0)
    values = [with_each(with_each(F.col("g"), F.col("af"), lambda x, a: x - a), scale, lambda x, s: x * s).alias("x")] if "g" in geno.columns else [F.col("p0"), F.col("p1")]
    return rows.select("variant_idx", "af", "v", *values)


def project_mean(rows: DataFrame, s: np.ndarray) -> np.ndarray:
    """U = X V / S with missing values at the mean."""

    def partial(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = None
        for b in batches:
            if b.num_rows:
                part = np.nan_to_num(rows_of(b, "x")).T @ rows_of(b, "v")[:, : len(s)]
                total = part if total is None else total + part
        return {} if total is None else {"u": total}

    return sum_arrays(rows.select("x", "v"), partial)["u"] / s


def normal_sums(x: np.ndarray, design: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every sample, over its observed values: sums of d d^T, of d x, and of the weights."""
    seen = (~np.isnan(x)).astype(float)
    if weight is not None:
        seen *= weight[:, None]
    k = design.shape[1]
    outer = (design[:, :, None] * design[:, None, :]).reshape(len(design), k * k)
    return seen.T @ outer, (seen * np.nan_to_num(x)).T @ design, seen.sum(axis=0)


def solve(ata: np.ndarray, atx: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Least squares of every sample from its sums; NaN with fewer observations than components."""
    k = atx.shape[1]
    u = (np.linalg.pinv(ata.reshape(-1, k, k), rcond=np.finfo(float).eps * k) @ atx[:, :, None])[:, :, 0]
    return np.where((seen >= k)[:, None], u, np.nan)


#: Numbers of the sums of one block of samples (8 MB), and variants whose part of these one task takes.
AT_ONCE, VARIANTS_AT_ONCE = 1 << 20, 1024


def solved(rows: DataFrame, k: int, sums: Callable, arrays: list[str], keep: list[str], replicates: int = 1, at_once: int = AT_ONCE) -> DataFrame:
    """Least-squares scores by blocks of samples: (first, u), `u` the bytes of replicates by samples by components.

    `sums(piece, first, r)` gives the normal sums of a piece of the rows: some variants, and samples from `first` on. Sums
    of a block are added and solved in one task, which holds `at_once` numbers of them.
    """
    block = max(1, min(4096, at_once // (replicates * (k * k + k + 1))))
    placed = rows.withColumn("c", F.floor(F.col("variant_idx") / VARIANTS_AT_ONCE))

    def part(t: pa.Table) -> pa.Table:
        t = t.sort_by("variant_idx")
        first = t["b"][0].as_py() * block
        each = [np.concatenate(sums(t, first, r), axis=1) for r in range(replicates)]
        return pa.table({"b": t["b"][:1], "c": t["c"][:1], "data": pa.array([np.stack(each).tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = ((b.column(0)[i].as_py(), b.column(2)[i].as_buffer()) for b in batches for i in range(b.num_rows))
        for b, of_block in groupby(records, key=lambda r: r[0]):
            total = None
            for _, data in of_block:
                total = np.frombuffer(data).copy() if total is None else np.add(total, np.frombuffer(data), out=total)
            total = total.reshape(replicates, -1, k * k + k + 1)
            u = np.stack([solve(x[:, : k * k], x[:, k * k : -1], x[:, -1]) for x in total])
            yield pa.RecordBatch.from_arrays([pa.array([b * block], pa.int64()), pa.array([u.tobytes()], pa.binary())], ["first", "u"])

    parts = cut(placed, block, arrays, ["variant_idx", "c", *keep]).groupBy("b", "c").applyInArrow(part, "b int, c long, data binary")
    return parts.repartition("b").sortWithinPartitions("b", "c").mapInArrow(add, "first long, u binary")


def weighted_sums(x: np.ndarray, design: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ata, atx, seen = normal_sums(x, design, weight)
    return ata, atx, seen[:, None]


def on_driver(blocks: DataFrame, k: int) -> np.ndarray:
    """Scores of `solved` without replicates, as one matrix."""
    parts = sorted(blocks.collect(), key=lambda r: r.first)
    return np.concatenate([np.frombuffer(r.u).reshape(-1, k) for r in parts]) if parts else np.zeros((0, k))


def project_least_squares(rows: DataFrame, s: np.ndarray) -> np.ndarray:
    """U that minimises |V S u - x| over each sample's observed values."""

    def sums(t: pa.Table, first: int, r: int) -> tuple[np.ndarray, ...]:
        return weighted_sums(rows_of(t, "x"), rows_of(t, "v")[:, : len(s)] * s)

    return on_driver(solved(rows, len(s), sums, ["x"], ["v"]), len(s))


def project_likelihoods(rows: DataFrame, s: np.ndarray, max_iter: int = 100, tol: float = 1e-5, iterations: int | None = None) -> np.ndarray:
    """Project genotype likelihoods: expected dosages (0..1, less af) and least squares in turn.

    `rows` has p0, p1, af and v. Dosages first use the reference's frequencies, then each sample's own,
    clip(U V S / 2 + af). Cells whose likelihoods leave no mass count as missing. One pass for each round.
    """
    u: np.ndarray | None = None
    for _ in range(1 + (iterations if iterations is not None else max_iter)):
        shared = rows.sparkSession.sparkContext.broadcast(u)

        def sums(t: pa.Table, first: int, r: int, shared=shared) -> tuple[np.ndarray, ...]:
            design, f = rows_of(t, "v")[:, : len(s)] * s, t["af"].to_numpy()[:, None]
            p0, p1 = rows_of(t, "p0"), rows_of(t, "p1")
            n = p0.shape[1]
            pi = np.repeat(f, n, 1) if shared.value is None else np.clip(design @ shared.value[first : first + n].T / 2 + f, EDGE, 1 - EDGE)
            return weighted_sums(posterior_dosage(p0, p1, pi) / 2 - f, design)

        before, u = u, on_driver(solved(rows, len(s), sums, ["p0", "p1"], ["af", "v"]), len(s))
        if iterations is None and before is not None and np.linalg.norm(u - before) / max(np.linalg.norm(before), 1e-12) < tol:
            break
    return u


def with_draws(rows: DataFrame, replicates: int, seed: int = 112, block: int = 4096) -> DataFrame:
    """Add `w`, how often each marker is drawn in each replicate of as many draws with replacement as markers.

    Draws are first dealt to blocks of markers in proportion to their size, then within a block: the same
    distribution as drawing at once, without a table of all draws. They depend on the seed and markers alone.
    """
    placed = rows.withColumn("_b", F.floor(F.col("variant_idx") / block))
    sizes = sorted((r["_b"], r["n"]) for r in placed.groupBy("_b").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in sizes)
    rng = np.random.default_rng(seed)
    dealt = rng.multinomial(total, np.array([n for _, n in sizes]) / max(1, total), size=replicates) if total else np.zeros((replicates, 0), int)
    of = rows.sparkSession.sparkContext.broadcast({b: dealt[:, i] for i, (b, _) in enumerate(sizes)})

    def draw(t: pa.Table) -> pa.Table:
        t = t.sort_by("variant_idx")
        b, n = t["_b"][0].as_py(), t.num_rows
        own = np.random.default_rng([seed, b])
        w = np.stack([own.multinomial(k, np.full(n, 1 / n)) for k in of.value[b]], axis=1)
        return pa.table({"variant_idx": t["variant_idx"], "w": pa.array(list(w.astype(float)), pa.list_(pa.float64()))})

    drawn = placed.select("variant_idx", "_b").groupBy("_b").applyInArrow(draw, "variant_idx long, w array<double>")
    return rows.join(drawn, "variant_idx")


def bootstrap(rows: DataFrame, s: np.ndarray, base: np.ndarray, replicates: int, at_once: int = AT_ONCE) -> DataFrame:
    """Least-squares scores of every replicate: (replicate, sample_idx, pc, u), signs as in `base`; null if not solvable.

    `rows` has x, v and w, each marker's weight in each replicate. Blocks of samples are solved in tasks that hold
    `at_once` numbers of their sums; one pass finds the signs of all replicates, one makes the rows.
    """
    if replicates < 2:
        raise ValueError("a bootstrap needs two replicates or more")
    k = base.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(base)

    def sums(t: pa.Table, first: int, r: int) -> tuple[np.ndarray, ...]:
        return weighted_sums(rows_of(t, "x"), rows_of(t, "v")[:, :k] * s, rows_of(t, "w")[:, r])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for b in batches:
            for i in range(b.num_rows):
                yield b.column(0)[i].as_py(), np.frombuffer(b.column(1)[i].as_buffer()).reshape(replicates, -1, k)

    def agreement(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros((replicates, k))
        for first, u in blocks(batches):
            total += np.nansum(u * shared.value[first : first + u.shape[1]], axis=1)
        return {"agreement": total}

    scored = solved(rows, k, sums, ["x"], ["v", "w"], replicates, at_once)
    sign = np.sign(sum_arrays(scored, agreement).get("agreement", np.zeros((replicates, k))))
    sign[sign == 0] = 1
    schema = "replicate int, sample_idx int, pc int, u double"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, u in blocks(batches):
            r, i, c = (x.ravel() for x in np.indices(u.shape))
            u = (u * sign[:, None, :]).ravel()
            yield batch_of(schema, r.astype(np.int32), (first + i).astype(np.int32), (c + 1).astype(np.int32), pa.array(u, mask=np.isnan(u)))

    return scored.mapInArrow(made, schema)


def bootstrap_summary(replicates: DataFrame, base: DataFrame) -> DataFrame:
    """Baseline, mean, standard error, range and root mean squared distance of each score."""
    both = replicates.where("u is not null").join(base.select("sample_idx", "pc", F.col("u").alias("baseline")), ["sample_idx", "pc"])
    return both.groupBy("sample_idx", "pc").agg(
        F.first("baseline").alias("baseline"),
        F.avg("u").alias("mean"),
        F.stddev_samp("u").alias("se"),
        F.min("u").alias("min"),
        F.max("u").alias("max"),
        F.sqrt(F.avg((F.col("u") - F.col("baseline")) ** 2)).alias("rmsd"),
    )


def bootstrap_covariance(replicates: DataFrame) -> DataFrame:
    """Variances, covariance and correlation of each pair of components of each sample."""
    a = replicates.where("u is not null").select("sample_idx", "replicate", F.col("pc").alias("pc_a"), F.col("u").alias("a"))
    b = replicates.where("u is not null").select("sample_idx", "replicate", F.col("pc").alias("pc_b"), F.col("u").alias("b"))
    pairs = a.join(b, ["sample_idx", "replicate"]).where("pc_a <= pc_b")
    sums = pairs.groupBy("sample_idx", "pc_a", "pc_b").agg(F.var_samp("a").alias("var_a"), F.var_samp("b").alias("var_b"), F.covar_samp("a", "b").alias("cov"))
    norm = F.sqrt(F.col("var_a") * F.col("var_b"))
    return sums.withColumn("corr", F.when(norm > 0, F.col("cov") / norm))


def scores_table(rows: DataFrame, u: np.ndarray) -> DataFrame:
    """Scores as rows; null where a sample could not be solved."""
    n, k = u.shape
    columns = {"sample_idx": np.repeat(np.arange(n, dtype=np.int32), k), "pc": np.tile(np.arange(1, k + 1, dtype=np.int32), n), "u": pa.array(u.ravel(), mask=np.isnan(u).ravel())}
    return rows.sparkSession.createDataFrame(pa.table(columns))
