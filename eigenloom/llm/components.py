"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.llm._common import drop_stash, stash


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has a link.

    `links` has long columns a and b. A round joins each node to the smallest of its neighbours, first the
    larger neighbours, then the smaller ones; rounds grow with the logarithm of the longest chain. Minima are
    aggregated before they are shuffled, and each round is written to the shared folder. Rows with a null or
    a = b link nothing; repeated links count once. Returns node, root (roots are not listed as nodes).
    """
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(low, "hi")
        small = joined.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        after = stash(small, "links")
        drop_stash(edges)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
