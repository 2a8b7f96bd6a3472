"""Linkage disequilibrium: windowed r2, pruning, clumping, decay summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eigenloom.operators.matrix import SIDE, batch_of, column_of, gram_blocks, rows_of, turned
from eigenloom.operators.pca import sample_gram
from eigenloom.operators.variants import with_each

#: Samples whose part of a dot product one task takes.
SAMPLE_BLOCK = 8192

#: Variants of the list that one tile of the window join spans at most.
TILE = 1024

#: Independent pieces that start among so many variants go to one task.
PIECE = 4096

#: A tile's part in a meeting of two: all pairs within it, the earlier variants, the later ones.
BOTH, LEADS, FOLLOWS = 0, 1, 2


def unit_rows(rows: DataFrame, column: str) -> DataFrame:
    """Rows centred over samples and divided by their length, so that r is a dot product; null without variance."""
    n = F.size(column)
    mean = F.aggregate(column, F.lit(0.0), lambda a, x: a + x) / n
    centred = with_each(F.col(column), mean, lambda x, m: x - m)
    length = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("unit", with_each(centred, F.when(length > 0, length), lambda x, n: x / n)).withColumn("unit", F.when(F.get("unit", F.lit(0)).isNotNull(), F.col("unit")))


def r2_pairs(rows: DataFrame, variants: DataFrame, window_bp: int = 1_000_000, column: str = "r", n_samples: int | None = None) -> DataFrame:
    """r2 of all pairs of a chromosome's variants at most `window_bp` apart, the earlier one leading.

    Variants are cut into tiles: those of one stretch of the window's width and of TILE places in the list. The
    narrow list of tiles is joined with itself for the pairs of tiles that can hold a pair of variants; a task
    multiplies two tiles, for one block of samples at a time. So it holds 2 * TILE rows of SAMPLE_BLOCK numbers
    at most, however dense the variants lie. With more samples than a block, the partial products are summed by
    pair. Constant rows have null r2. Returns chr, i, k, bp_i, bp_k, r2.
    """
    placed = variants.select("variant_idx", "chr", "bp", F.floor(F.col("bp") / window_bp).alias("b"), F.floor(F.col("variant_idx") / TILE).alias("q"))
    tiles = placed.groupBy("chr", "b", "q").agg(F.min("bp").alias("lo"), F.max("bp").alias("hi"), F.min("variant_idx").alias("first"), F.max("variant_idx").alias("last"))
    lead = tiles.select("chr", *(F.col(c).alias(f"lead_{c}") for c in ("b", "q", "lo", "hi", "first")), F.explode(F.array("b", F.col("b") + 1)).alias("follow_b"))
    follow = tiles.select("chr", *(F.col(c).alias(f"follow_{c}") for c in ("b", "q", "lo", "hi", "last")))
    near = (F.col("follow_lo") - F.col("lead_hi") <= window_bp) & (F.col("follow_hi") >= F.col("lead_lo")) & (F.col("follow_last") > F.col("lead_first"))
    meets = lead.join(follow, ["chr", "follow_b"]).where(near).select("chr", "lead_b", "lead_q", "follow_b", "follow_q")
    own = (F.col("lead_b") == F.col("follow_b")) & (F.col("lead_q") == F.col("follow_q"))
    side = lambda s, role: F.struct(F.col(f"{s}_b").alias("b"), F.col(f"{s}_q").alias("q"), F.lit(role).alias("role"))
    sides = meets.select("*", F.explode(F.when(own, F.array(side("lead", BOTH))).otherwise(F.array(side("lead", LEADS), side("follow", FOLLOWS)))).alias("side"))
    meet = ["lead_b", "lead_q", "follow_b", "follow_q"]
    dealt = placed.join(sides.select("chr", *meet, "side.b", "side.q", "side.role"), ["chr", "b", "q"]).select("variant_idx", "chr", "bp", "role", *meet)
    dealt = unit_rows(rows.select("variant_idx", column), column).select("variant_idx", "unit").join(dealt, "variant_idx")
    if n_samples is None:
        n_samples = (rows.select(F.max(F.size(column))).first() or [0])[0] or 0
    blocks = max(1, -(-n_samples // SAMPLE_BLOCK))
    if blocks > 1:
        dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("unit", F.slice("unit", F.col("part") * SAMPLE_BLOCK + 1, F.lit(SAMPLE_BLOCK)))
    else:
        dealt = dealt.withColumn("part", F.lit(0))
    schema = "chr string, i long, k long, bp_i long, bp_k long, r double"

    def products(t: pa.Table) -> pa.Table:
        idx, bp, role = column_of(t, "variant_idx"), column_of(t, "bp"), column_of(t, "role")
        null = np.array(t["unit"].is_null().to_pylist(), bool)
        unit = np.full((len(idx), 1), np.nan)
        if not null.all():
            held = rows_of(t.filter(pa.array(~null)), "unit")
            unit = np.full((len(idx), held.shape[1]), np.nan)
            unit[~null] = held
        by = np.argsort(idx, kind="stable")
        leads, others = by[role[by] != FOLLOWS], by[role[by] != LEADS]
        gap = bp[others][None, :] - bp[leads][:, None]
        a, c = np.nonzero((idx[others][None, :] > idx[leads][:, None]) & (gap >= 0) & (gap <= window_bp))
        r = (unit[leads] @ unit[others].T)[a, c]
        i, k = leads[a], others[c]
        return pa.table({"chr": pa.array([t["chr"][0].as_py()] * len(a), pa.string()), "i": idx[i], "k": idx[k], "bp_i": bp[i], "bp_k": bp[k], "r": pa.array(r, pa.float64(), mask=np.isnan(r))})

    pairs = dealt.groupBy("chr", *meet, "part").applyInArrow(products, schema)
    if blocks > 1:
        pairs = pairs.groupBy("chr", "i", "k", "bp_i", "bp_k").agg(F.sum("r").alias("r"))
    return pairs.select("chr", "i", "k", "bp_i", "bp_k", (F.col("r") * F.col("r")).alias("r2"))


def independent_pieces(nodes: DataFrame, linked: str) -> DataFrame:
    """Add `piece`: no link of a chromosome's (chr, variant_idx, linked array of other variants) leaves its piece.

    A piece ends where no link spans the place between two variants, found by a running maximum. Those that start
    among the same PIECE variants are numbered alike, so a chromosome of many short ones makes few groups.
    """
    upto = Window.partitionBy("chr").orderBy("variant_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("chr").orderBy("variant_idx").rowsBetween(Window.unboundedPreceding, -1)
    cover = F.max(F.greatest("variant_idx", F.array_max(linked))).over(earlier)
    start = F.when(cover.isNull() | (cover < F.col("variant_idx")), F.col("variant_idx"))
    return nodes.withColumn("piece", start).withColumn("piece", F.floor(F.max("piece").over(upto) / PIECE))


def prune(pairs: DataFrame, variants: DataFrame, r2: float) -> DataFrame:
    """Variants that stay when linked ones go, chromosome by chromosome, in file order: adds `keep`.

    Each kept variant in turn looks at the later ones linked to it by r2 above the threshold that are still
    kept. Without column `af` these go. With it the one of lower minor allele frequency goes: the later one at
    ties, and the leading one if it is lower; it then still finishes its own turn. Only variants with a link above
    the threshold reach the greedy step, which is sequential within an independent piece of a chromosome.
    """
    known = "af" in variants.columns
    minor = F.least("af", 1 - F.col("af")) if known else F.lit(0.0)
    ends = F.explode(F.array(F.struct(F.col("i").alias("variant_idx"), F.col("k").alias("other")), F.struct(F.col("k").alias("variant_idx"), F.lit(None).cast("long").alias("other")))).alias("end")
    linked = pairs.where(F.col("r2") > r2).select("chr", ends).groupBy("chr", "end.variant_idx").agg(F.array_sort(F.collect_list("end.other")).alias("later"))
    nodes = independent_pieces(linked, "later").join(variants.select("variant_idx", minor.cast("double").alias("maf")), "variant_idx")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("variant_idx")
        frequency = dict(zip(pdf["variant_idx"], pdf["maf"], strict=True))
        kept = dict.fromkeys(pdf["variant_idx"], True)
        for lead, later in zip(pdf["variant_idx"], pdf["later"], strict=True):
            if not kept[lead]:
                continue
            for other in later:
                if kept.get(other):
                    kept[lead if frequency[other] > frequency[lead] else other] = False
        return pd.DataFrame({"variant_idx": list(kept), "keep": list(kept.values())})

    decided = nodes.groupBy("chr", "piece").applyInPandas(greedy, "variant_idx long, keep boolean")
    return variants.join(decided, "variant_idx", "left").withColumn("keep", F.coalesce("keep", F.lit(True)))


def clump(pairs: DataFrame, variants: DataFrame, assoc: DataFrame, p1: float = 1e-4, p2: float = 1e-2, r2: float = 0.5, window_bp: int = 250_000) -> DataFrame:
    """Clumps of associated variants: index variants by ascending p, and the members that each takes.

    `assoc` has chr, bp, p (and `line`, the raw record, if any). It is matched to the panel by place; of panel
    variants that share a place the last counts. Members have p <= p2, lie within the window and have
    r2 >= the threshold; they are taken once and then lead no clump. Ties of p go by bp. A task takes one
    independent piece of a chromosome's links. Returns chr, bp, p, [line,] and sp2: members' bp by p, joined by
    commas, or NONE.
    """
    line = ["line"] if "line" in assoc.columns else []
    last = variants.groupBy("chr", "bp").agg(F.max("variant_idx").alias("variant_idx"))
    hits = assoc.where(F.col("p") <= p2).select("chr", "bp", "p", *line).join(last, ["chr", "bp"])
    near = pairs.where((F.col("r2") >= r2) & (F.col("bp_k") - F.col("bp_i") <= window_bp)).select("i", "k")
    both = near.select(F.col("i").alias("a"), F.col("k").alias("b")).unionByName(near.select(F.col("k").alias("a"), F.col("i").alias("b")))
    ids = hits.select("variant_idx")
    both = both.join(ids.withColumnRenamed("variant_idx", "a"), "a", "left_semi").join(ids.withColumnRenamed("variant_idx", "b"), "b", "left_semi")
    links = both.groupBy("a").agg(F.collect_list("b").alias("linked")).withColumnRenamed("a", "variant_idx")
    nodes = hits.join(links, "variant_idx", "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<long>")))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "bp", "variant_idx"])
        facts = {v: (p, b) for v, p, b in zip(pdf["variant_idx"], pdf["p"], pdf["bp"], strict=True)}
        free, out = set(facts), []
        for row in pdf.itertuples():
            if row.p > p1 or row.variant_idx not in free:
                continue
            taken = sorted((v for v in row.linked if v in free and v != row.variant_idx), key=lambda v: facts[v])
            free.difference_update(taken)
            out.append([row.chr, row.bp, row.p, *(getattr(row, c) for c in line), ",".join(str(facts[v][1]) for v in taken) or "NONE"])
        return pd.DataFrame(out, columns=["chr", "bp", "p", *line, "sp2"])

    schema = "chr string, bp long, p double, " + "".join(f"{c} string, " for c in line) + "sp2 string"
    return independent_pieces(nodes, "linked").groupBy("chr", "piece").applyInPandas(greedy, schema)


def decay_bins(pairs: DataFrame, window_bp: int, bins: int = 500) -> DataFrame:
    """Pairs of each chromosome in bins of equal numbers by distance: number, mean and deviation of r2.

    A pair's rank in its chromosome is the number of pairs at smaller distances, from the counts by distance,
    and its rank among those at its own, so no task sorts a chromosome's pairs.
    """
    held = pairs.where("r2 is not null").withColumn("gap", F.col("bp_k") - F.col("bp_i"))
    counts = held.groupBy("chr", "gap").agg(F.count("*").alias("here"))
    by_gap = Window.partitionBy("chr").orderBy("gap").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("here").over(by_gap), F.lit(0))).withColumn("total", F.sum("here").over(Window.partitionBy("chr"))).drop("here")
    own = F.row_number().over(Window.partitionBy("chr", "gap").orderBy("i", "k"))
    rank = held.join(counts, ["chr", "gap"]).withColumn("rank", F.col("before") + own - 1)
    size, larger = F.floor(F.col("total") / bins), F.col("total") % bins  # the first bins hold one more
    edge = larger * (size + 1)
    tile = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (size + 1))).otherwise(larger + F.floor((F.col("rank") - edge) / F.greatest(size, F.lit(1))))
    out = rank.withColumn("bin", (tile + 1).cast("int")).groupBy("chr", "bin").agg(F.count("*").alias("num"), F.avg("r2").alias("avg_r2"), F.stddev_samp("r2").alias("std"))
    return out.withColumn("distance", F.col("bin") * (window_bp / bins)).select("chr", "distance", "num", "avg_r2", "std")


def cumulative_mean(pairs: DataFrame) -> DataFrame:
    """Mean r2 of all pairs of a chromosome up to each distance, from sums by distance: chr, distance, mean_r2."""
    w = Window.partitionBy("chr").orderBy("distance")
    return distance_summary(pairs).withColumn("mean_r2", F.sum("r2_total").over(w) / F.sum("num_pairs").over(w)).select("chr", "distance", "mean_r2")


def chromosome_runs(variants: DataFrame) -> DataFrame:
    """First and last place and number of each chromosome's variants; an error if a chromosome's lie apart.

    A list in the order of its file has each chromosome in one run exactly if its places are gapless.
    """
    runs = variants.groupBy("chr").agg(F.min("variant_idx").alias("first"), F.max("variant_idx").alias("last"), F.count("*").alias("n"))
    torn = [r.chr for r in runs.where(F.col("last") - F.col("first") + 1 != F.col("n")).limit(3).collect()]
    if torn:
        raise ValueError(f"the variants of chromosomes {torn} do not lie together")
    return runs


def distance_summary(pairs: DataFrame) -> DataFrame:
    """Sum of r2 and number of pairs at each distance of each chromosome."""
    return pairs.groupBy("chr", (F.col("bp_k") - F.col("bp_i")).alias("distance")).agg(F.sum("r2").alias("r2_total"), F.count("r2").alias("num_pairs"))


#: The upper distances of the curve's bins.
CURVE_BINS = (1000, 5000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000)


def curve_bins(pairs: DataFrame, edges: tuple[int, ...] = CURVE_BINS) -> DataFrame:
    """Pairs, sum of |r| and sum of r2 of all pairs whose distance is at most each edge and above the one before."""
    distance = F.col("bp_k") - F.col("bp_i")
    edge = F.coalesce(*(F.when(distance <= e, F.lit(e)) for e in edges))
    return pairs.withColumn("bin", edge).where("bin is not null").groupBy("bin").agg(F.count("r2").alias("counts"), F.sum(F.sqrt("r2")).alias("r_sum"), F.sum("r2").alias("r2_sum"))


def bias_corrected(r2: Column, n: int) -> Column:
    """r2 without what chance adds to it in n samples."""
    return r2 - (1 - r2) / (n - 2)


def weighted_decay(bins: DataFrame, n: int | None = None) -> DataFrame:
    """Mean r2 of all chromosomes at each distance, weighted by their numbers of pairs, corrected if n is given."""
    out = bins.groupBy("distance").agg((F.sum(F.col("avg_r2") * F.col("num")) / F.sum("num")).alias("r2"))
    return out if n is None else out.withColumn("r2", bias_corrected(F.col("r2"), n))


def _across(rows: DataFrame, variants: DataFrame, column: str) -> tuple[int, float]:
    """Number of pairs of variants on different chromosomes, and the sum of their r2.

    With no more variants than samples, the sum is over the entries of the variants' Gram matrix, each from sums over
    samples. Else it is the inner products of the chromosomes' Gram matrices of samples, so no pair is formed. Both are
    taken by blocks of these matrices, in tasks that return a number for each.
    """
    unit = unit_rows(rows.select("variant_idx", column), column).select("variant_idx", "unit").where("unit is not null")
    unit = unit.join(variants.select("variant_idx", "chr"), "variant_idx").persist()
    try:
        each = [r.asDict()["count"] for r in unit.groupBy("chr").count().collect()]
        m = sum(each)
        pairs = (m * m - sum(x * x for x in each)) // 2
        if not pairs:
            return 0, float("nan")
        n = unit.agg(F.max(F.size("unit"))).first()[0]
        if m > n:
            return pairs, gram_blocks(unit, n, _inner, "r2 double", "unit", tag="chr").agg(F.sum("r2")).first()[0]
        at = unit.select("variant_idx", "chr").toArrow().sort_by("variant_idx")["chr"]
        code = np.unique(at.to_pylist(), return_inverse=True)[1]
        shared = rows.sparkSession.sparkContext.broadcast(code)
        turn = turned(unit, m, "unit")
        if m <= SIDE:
            gram = sample_gram(turn)
            return pairs, float((gram**2)[code[:, None] < code[None, :]].sum())

        def fold(i: int, j: int, parts: Iterator[tuple[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for _, block in parts:
                a, b = shared.value[i : i + block.shape[0]], shared.value[j : j + block.shape[1]]
                yield batch_of("r2 double", [float((block**2)[a[:, None] != b[None, :]].sum()) / (2 if i == j else 1)])

        return pairs, gram_blocks(turn, m, fold, "r2 double").agg(F.sum("r2")).first()[0]
    finally:
        unit.unpersist()


def _inner(i: int, j: int, parts: Iterator[tuple[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sum of the inner products of each two chromosomes' blocks; those off the diagonal stand for two."""
    before, total = None, 0.0
    for _, block in parts:
        if before is not None:
            total += float((before * block).sum())
        before = block if before is None else np.add(before, block, out=before)
    yield batch_of("r2 double", [total * (1 if i == j else 2)])


def cross_chromosome_mean(rows: DataFrame, variants: DataFrame, first: str, second: str, column: str = "r") -> DataFrame:
    """Mean r2 of all pairs with one variant on each of two chromosomes: the background without linkage."""
    n, total = _across(rows, variants.where(F.col("chr").isin(first, second)), column)
    return rows.sparkSession.createDataFrame([(first, second, n, total / n if n else float("nan"))], "chr_a string, chr_b string, n_pairs long, mean_r2 double")


def background_mean(rows: DataFrame, variants: DataFrame, column: str = "r") -> DataFrame:
    """Mean r2 of all pairs of variants on different chromosomes, whichever: n_pairs, mean_r2 (NaN without a pair)."""
    n, total = _across(rows, variants, column)
    return rows.sparkSession.createDataFrame([(n, total / n if n else float("nan"))], "n_pairs long, mean_r2 double")
