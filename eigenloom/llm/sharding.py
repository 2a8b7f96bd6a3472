"""Sampled splitters: shards of near-equal bytes by ranges of a text's hash. DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eigenloom.llm._common import constants, stash


def rank_in(bounds: list[int], key: Column) -> Column:
    """How many of the ascending bounds are at most the key, by halving."""
    table, n = constants(bounds), len(bounds)
    steps = [1 << b for b in range(max(n, 1).bit_length() - 1, -1, -1)]

    def step(low: Column, width: Column) -> Column:
        at = low + width
        return F.when((at <= F.lit(n)) & (F.get(table, (at - 1).cast("int")) <= key), at).otherwise(low)

    return F.aggregate(constants(steps), F.lit(0).cast("long"), step).cast("int")


def splitters(sample: list[tuple[int, int]], ranges: int) -> list[int]:
    """Boundaries at equal steps of the sampled weight; a key is never cut, so heavy keys give fewer boundaries."""
    sample = sorted(sample)
    total, run, bounds = sum(w for _, w in sample), 0, []
    for key, weight in sample:
        if run * ranges // max(total, 1) != (run + weight) * ranges // max(total, 1) and (not bounds or key > bounds[-1]):
            bounds.append(key)
        run += weight
    return bounds


def shard(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 256, samples_per_range: int = 16) -> DataFrame:
    """Put documents (doc_id, text) into `shards` shards of near-equal bytes; equal texts stay together.

    A row's size is its text's UTF-8 bytes plus 8; its key is the text's 64-bit hash, so copies are neighbours.
    Rows are sampled with probability in proportion to size, about shards * ranges_per_shard *
    samples_per_range of them at any input size, and the sample's weighted quantiles bound fine ranges. Exact
    sizes of these ranges show which are overfull (more than twice the mean): there, keys larger than a mean
    range get ranges of their own, dealt out by doc_id (only these copies part), and what else is too large is
    dealt out by key. There are at most a few times shards * ranges_per_shard ranges, so only their sizes
    reach the driver, which deals consecutive ranges to shards by cumulative bytes. Slots number a shard's rows
    by range, then key and doc_id, so no task ever sorts a whole shard.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null). Null texts count as empty
    in text_crc32 and have size 8. Repeated rows each get a slot of their own. Null doc_ids are kept. An empty
    table gives no rows. Other columns are not read.
    """
    text = F.col("text").cast("string")
    rows = stash(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "shard-rows",
    )
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ranges = shards * ranges_per_shard
    step = max(1, total // (ranges * samples_per_range))
    draw = F.pmod(F.xxhash64("key", "doc_id", F.lit(71)), F.lit(step))
    sample = [(r.key, max(r.size, step)) for r in rows.where(draw < F.col("size")).select("key", "size").collect()]
    bounds = splitters(sample, ranges)
    mean = max(1, total // ranges)
    rows_in = rows.withColumn("range", rank_in(bounds, F.col("key")))
    size_of = {r["range"]: r["bytes"] for r in rows_in.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}
    over = sorted(k for k, v in size_of.items() if v > 2 * mean)
    heavy: list[tuple[int, int]] = []
    if over:
        found = rows_in.where(F.array_contains(constants(over), F.col("range").cast("long"))).groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        heavy = sorted((r.key, min(r.n, -(-r.bytes // mean))) for r in found.where((F.col("bytes") > mean) & (F.col("n") > 1)).collect())
        heavy_bytes = {r: 0 for r in over}
        for r in found.where((F.col("bytes") > mean) & (F.col("n") > 1)).select("key", "bytes").collect():
            heavy_bytes[bisect_right(bounds, r.key)] += r.bytes
    parts_of, first_of, heavy_first, next_id = [], [], [], 0
    heavy_at: dict[int, list[int]] = {}
    for i, (key, _) in enumerate(heavy):
        heavy_at.setdefault(bisect_right(bounds, key), []).append(i)
    heavy_first = [0] * len(heavy)
    for r in range(len(bounds) + 1):
        left = size_of.get(r, 0) - (heavy_bytes[r] if r in over else 0)
        parts_of.append(-(-left // mean) if left > 2 * mean else 1)
        first_of.append(next_id)
        next_id += parts_of[-1]
        for i in heavy_at.get(r, []):
            heavy_first[i] = next_id
            next_id += heavy[i][1]
    piece = F.get(constants(first_of), F.col("range")) + F.pmod(F.xxhash64("key"), F.get(constants(parts_of), F.col("range")))
    if heavy:
        at = (F.array_position(constants([k for k, _ in heavy]), F.col("key")) - 1).cast("int")
        piece = F.when(at >= 0, F.get(constants(heavy_first), at) + F.pmod(F.xxhash64("doc_id", F.lit(5)), F.get(constants([n for _, n in heavy]), at))).otherwise(piece)
    pieces = rows_in.withColumn("piece", piece.cast("int")).drop("range")
    shard_of, base_of, run, used = [0] * next_id, [0] * next_id, 0, [0] * shards
    for r in sorted(pieces.groupBy("piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()):
        at = min(shards - 1, (2 * run + r.bytes) * shards // (2 * total))
        shard_of[r.piece], base_of[r.piece] = at, used[at]
        used[at] += r.n
        run += r.bytes
    order = Window.partitionBy("piece").orderBy("key", "doc_id", "size")
    return pieces.withColumn("nth", F.row_number().over(order)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.get(constants(shard_of), F.col("piece")).cast("int").alias("shard"),
        (F.get(constants(base_of), F.col("piece")) + F.col("nth") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
