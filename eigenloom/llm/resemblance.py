"""Near-duplicates by the Jaccard similarity of word shingles: SimHash blocks for candidates, sets compared in full."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from eigenloom.llm._common import drop_stash, map_arrow, stash
from eigenloom.llm.components import components
from eigenloom.llm.simhash import SEED, keep_one, shingle_hashes, with_text_key

#: Shingles whose bits are counted at once.
CHUNK = 1 << 12

#: Bins of a set's shingles; the counts of two sets bound what they share.
BINS = 128

#: Fingerprints: 64-bit words, their columns, and bits.
WORDS = 4
PRINT = [f"f{w}" for w in range(WORDS)]
BITS = 64 * WORDS
#: What hashes are multiplied by for each word, odd; the first word has the hashes themselves.
MIX = np.concatenate(([np.uint64(1)], np.random.default_rng(SEED).integers(0, 1 << 63, WORDS - 1, np.uint64) * np.uint64(2) + np.uint64(1)))

#: Rows of a bucket that meet at once, and rows that a bucket of unrelated texts has about.
TILE = 256
CROWD = 1024


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text in order; a null text counts as empty."""
    return np.unique(np.array(shingle_hashes(text or "", words), np.uint64))


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes, in WORDS words: the bits set in over half of them; zero for an empty set.

    The first word counts the hashes themselves, the others count them mixed. (A bit set in just half of them must not
    follow one of them: a set without that one would differ in all such bits at once.)
    """
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(found), CHUNK):
        mixed = found[a : a + CHUNK, None] * MIX
        for shift, by in ((32, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53), (32, 1)):
            mixed[:, 1:] = (mixed[:, 1:] ^ mixed[:, 1:] >> np.uint64(shift)) * np.uint64(by)
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):
            ones += np.add.reduce(bits[b : b + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found), bitorder="little").view("<u8").astype(np.uint64)


def flip_chance(least: float) -> float:
    """How often a bit of two sets of similarity `least` differs: their angle for large sets, 3/16 for 4 of 5 shingles."""
    return max(3 / 16, math.acos(2 * least / (1 + least)) / math.pi)


def block_bits(nodes: int, flip: float, miss: float) -> tuple[np.ndarray, int]:
    """Blocks of fingerprint bits (a row of bit numbers for each) and the radius, for `nodes` fingerprints.

    Blocks grow with the number of fingerprints, so that about CROWD unrelated ones agree in a block at every size.
    They are cut from shuffled orders of all bits. There are so many that two fingerprints whose bits
    differ with the chance `flip` agree in none, or differ in more bits than the radius, in `miss` of all cases at most.
    """
    size = min(24, max(4, round(math.log2(max(1, nodes) / CROWD))))
    chance = [math.comb(BITS, d) * flip**d * (1 - flip) ** (BITS - d) for d in range(BITS + 1)]
    radius = next(d for d in range(BITS + 1) if sum(chance[d + 1 :]) <= miss / 2)
    agree = [math.comb(BITS - d, size) / math.comb(BITS, size) for d in range(radius + 1)]
    count = BITS // size
    while sum(c * (1 - a) ** count for c, a in zip(chance, agree, strict=False)) > miss / 2:
        count += 1
    rng = np.random.default_rng(SEED)
    orders = [rng.permutation(BITS)[: BITS // size * size].reshape(-1, size) for _ in range(-(-count // (BITS // size)))]
    return np.concatenate(orders)[:count], radius


def in_blocks(nodes: DataFrame, blocks: np.ndarray) -> DataFrame:
    """A row for each node and block, with `bucket`: the block's number and the bits that the fingerprint has there."""
    size = blocks.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(words_of(batch).astype("<u8").view(np.uint8), axis=1, bitorder="little")
            keys = bits[:, blocks].astype(np.int64) @ (1 << np.arange(size)) + (np.arange(len(blocks)) << size)
            rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), len(blocks))))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *rows.columns], ["bucket", *batch.schema.names])

    return map_arrow(nodes, run, "bucket long, " + ", ".join(f"{n} {t}" for n, t in nodes.dtypes))


def words_of(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Fingerprints of the rows, WORDS unsigned words each."""
    return np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in PRINT], axis=1).view(np.uint64)


def close_rows(prints: np.ndarray, radius: int, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j), i < j, that differ in at most `radius` bits, a tile at a time: by j, then by i.

    Tiles whose rows all have one `root` are passed over.
    """
    for b in range(0, len(prints), TILE):
        for a in range(0, b + 1, TILE):
            if root is not None and (root[a : a + TILE] == root[b]).all() and (root[b : b + TILE] == root[b]).all():
                continue
            x, y = prints[b : b + TILE], prints[a : a + TILE]
            differ = np.zeros((len(x), len(y)), np.uint16)
            for w in range(WORDS):
                differ += np.bitwise_count(x[:, None, w] ^ y[None, :, w])
            j, i = np.nonzero(differ <= radius)
            i, j = i + a, j + b
            yield i[i < j], j[i < j]


def block_masks(blocks: np.ndarray) -> np.ndarray:
    masks = np.zeros((len(blocks), WORDS), np.uint64)
    for bit in blocks.T:
        masks[np.arange(len(blocks)), bit // 64] |= np.uint64(1) << (bit % 64).astype(np.uint64)
    return masks


def first_shared(prints: np.ndarray, i: np.ndarray, j: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The first block in which the rows i and j agree."""
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), 1 << 12):
        x = prints[i[at : at + (1 << 12)]] ^ prints[j[at : at + (1 << 12)]]
        out[at : at + (1 << 12)] = ((x[:, None, :] & masks) == 0).all(axis=2).argmax(axis=1)
    return out


def drawn(node: np.ndarray, turn: int) -> np.ndarray:
    """An order of the nodes, another one for each turn, that is the same in all buckets."""
    x = (node.view(np.uint64) ^ np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD)
    return np.argsort(x ^ x >> np.uint64(29), kind="stable")


def ranks(j: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The place of each of a tile's pairs among those of its row j; `seen` counts earlier pairs and is brought up."""
    out = np.arange(len(j)) - np.searchsorted(j, j) + seen[j]
    seen += np.bincount(j, minlength=len(seen))
    return out


def spread(met: DataFrame, most: int, centres: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) to compare at first, and the nodes of crowds: those marked (a, a) and those in over `most` pairs.

    Of the pairs of two nodes of crowds, `centres` for each node stay, those with the others drawn first; all of these
    nodes meet again.
    """
    ends = met.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
    apart = F.col("node") != F.col("other")
    drawn_first = [F.min(F.when(apart, F.struct(F.xxhash64("other", F.lit(i)).alias("draw"), "other"))).getField("other") for i in range(centres)]
    nodes = ends.groupBy("node").agg(F.count_if(apart).alias("times"), F.max(~apart).alias("marked"), F.array(*drawn_first).alias("drawn"))
    many = stash(nodes.where((F.col("times") > most) | F.col("marked")).select("node", "drawn"), "near-many")
    pairs = met.where("a <> b")
    lone = lambda end: pairs.join(many.select(F.col("node").alias(end)), end, "left_anti").select("a", "b")
    stars = many.select("node", F.explode("drawn").alias("other")).where("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    return lone("a").unionByName(lone("b")).unionByName(stars).distinct(), many


def named_pairs(node: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    i, j = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in found)]) for k in (0, 1))
    return pa.table({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})


def crowd_meeting(blocks: np.ndarray, radius: int, most: int) -> Callable[[pa.Table], pa.Table]:
    """For one bucket: each node with over `most` candidates there, and that one of them which the block draws first."""

    def run(bucket: pa.Table) -> pa.Table:
        order = drawn(bucket.column("node").to_numpy(), len(blocks) + (bucket.column("bucket")[0].as_py() >> blocks.shape[1]))
        node, prints = bucket.column("node").to_numpy()[order], words_of(bucket)[order]
        times, other = np.zeros(len(order), np.int64), np.full(len(order), len(order))
        for i, j in close_rows(prints, radius):
            times += np.bincount(i, minlength=len(order)) + np.bincount(j, minlength=len(order))
            np.minimum.at(other, i, j)
            np.minimum.at(other, j, i)
        crowd = np.flatnonzero(times > most)
        return pa.table({"node": node[crowd], "other": node[other[crowd]]})

    return run


def first_meeting(blocks: np.ndarray, radius: int, most: int, centres: int) -> Callable[[pa.Table], pa.Table]:
    """For one bucket: the pairs (a, b) of nodes within the radius, each in the first bucket they share, but for crowds.

    Nodes with a true `known`, where there is such a column, are of crowds and do not meet one another. Each other node
    meets them and those drawn before it. One with over `most` candidates in a bucket is left with `centres` of them
    there; what loses a pair so, and is not known, comes out as (a, a) too, so that later meetings find the rest.
    """
    masks = block_masks(blocks)

    def run(bucket: pa.Table) -> pa.Table:
        order = drawn(bucket.column("node").to_numpy(), 0)
        known = bucket.column("known").to_numpy()[order] if "known" in bucket.column_names else np.zeros(len(order), bool)
        order = np.concatenate([order[known], order[~known]])
        known = np.arange(len(order)) < known.sum()
        node, prints, seen = bucket.column("node").to_numpy()[order], words_of(bucket)[order], np.zeros(len(order), np.int64)
        held, lost = [(np.zeros(0, np.int64),) * 3], np.zeros(len(order), bool)
        for i, j in close_rows(prints, radius, np.where(known, -1, np.arange(len(order)))):
            i, j = i[~known[j]], j[~known[j]]  # known ones come first: a pair of two has a known j
            rank = ranks(j, seen)
            few = rank < max(most, centres)
            held.append((i[few], j[few], rank[few]))
            lost[i[~few]] = lost[j[~few]] = True
        i, j, rank = (np.concatenate([h[k] for h in held]) for k in range(3))
        here = first_shared(prints, i, j, masks) == bucket.column("bucket")[0].as_py() >> blocks.shape[1]
        i, j, keep = i[here], j[here], (seen[j[here]] <= most) | (rank[here] < centres)
        lost[i[~keep]] = lost[j[~keep]] = True
        return named_pairs(node, [(i[keep], j[keep]), (np.flatnonzero(lost & ~known),) * 2])

    return run


def later_meeting(blocks: np.ndarray, radius: int, least: float, centres: int | None, turn: int) -> Callable[[pa.Table], pa.Table]:
    """For one bucket: pairs within the radius that have different roots and may be similar by their counts.

    All of them, each in the first bucket they share; with `centres`, of these only each node's first `centres` there.
    """
    masks = block_masks(blocks)

    def run(bucket: pa.Table) -> pa.Table:
        root = bucket.column("root").to_numpy()
        order = drawn(bucket.column("node").to_numpy(), turn) if centres else np.argsort(root, kind="stable")
        node, prints, root = bucket.column("node").to_numpy()[order], words_of(bucket)[order], root[order]
        n, s = (bucket.column(c).to_numpy()[order] for c in ("n", "s"))
        bins = bucket.column("bins").combine_chunks().flatten().to_numpy().reshape(-1, BINS)[order]
        found, seen = [], np.zeros(len(order), np.int64)
        for i, j in close_rows(prints, radius, root):
            able = np.flatnonzero(root[i] != root[j])
            able = able[may_be_similar(least, n, s, bins, i[able], j[able])]
            i, j = i[able], j[able]
            if centres:
                few = ranks(j, seen) < centres
                i, j = i[few], j[few]
            here = first_shared(prints, i, j, masks) == bucket.column("bucket")[0].as_py() >> blocks.shape[1]
            found.append((i[here], j[here]))
        return named_pairs(node, found)

    return run


def may_be_similar(least: float, n: np.ndarray, s: np.ndarray, bins: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether counts leave it open that the rows i and j are similar.

    Two sets share at most the smaller s, and in each bin at most the smaller count. Only pairs that cannot reach
    the similarity are ruled out.
    """
    asked = least * (n[i] + n[j]) - 1e-6
    able = np.minimum(s[i], s[j]) * (1 + least) >= asked
    left = np.flatnonzero(able)
    for at in range(0, len(left), 1 << 12):
        k = left[at : at + (1 << 12)]
        able[k] = np.minimum(bins[i[k]], bins[j[k]]).sum(axis=1, dtype=np.int64) * (1 + least) >= asked[k]
    return able


def similar(a: str, b: str, words: int, least: float) -> bool:
    x, y = shingle_set(a, words), shingle_set(b, words)
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both) >= least


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts are similar; `texts` has node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(x, y, words, least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")).hint("merge"), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
    return map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long")


def shared_shingles(many: DataFrame, texts: DataFrame, words: int, least: float, rounds: int) -> DataFrame:
    """Nodes of crowds that can be similar to any other of them: node, n (its shingles), s (those that others have too).

    Two sets with s of n and t of m shingles in common with any others share at most min(s, t), so a node with
    less than `least` of its shingles in others has no partner; without it, others may have none either, which
    the further rounds find. No pair is looked at for this.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingle_set(text, words).view(np.int64)
                for at in range(0, len(found), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[at : at + (1 << 16)]), node, np.int64)), pa.array(found[at : at + (1 << 16)])], ["node", "shingle"])

    held = texts.join(many.select("node").distinct(), "node", "left_semi").select("node", "text")
    sets = stash(map_arrow(held, run, "node long, shingle long"), "near-shingles")
    sizes = sets.groupBy("node").agg(F.count("*").alias("n"))
    live = able = None
    for _ in range(rounds):
        own = sets if live is None else sets.join(live.select("node"), "node", "left_semi")
        often = own.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1").select("shingle")
        shared = own.join(often, "shingle").groupBy("node").agg(F.count("*").alias("s"))
        able = stash(shared.join(sizes, "node").where(F.col("s") >= least * F.col("n") - 1e-6).select("node", "n", "s"), "near-live")
        if live is not None:
            drop_stash(live)
        live = able
    drop_stash(sets)
    return able


def with_bins(able: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Add to each node the numbers of its shingles in BINS bins by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [np.bincount((shingle_set(t, words) % np.uint64(BINS)).astype(np.int64), minlength=BINS).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins, pa.list_(pa.int32()))], ["node", "bins"])

    held = texts.join(able.select("node"), "node", "left_semi").select("node", "text")
    return able.join(map_arrow(held, run, "node long, bins array<int>"), "node")


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, bucket_pairs: int = 32, centres: int = 4, rounds: int = 8, miss: float = 5e-8) -> DataFrame:
    """Component of each distinct text of (doc_id, text) under links of Jaccard similarity `least` or more.

    Texts of equal shingle sets are one node, however many rows share them. A node has the SimHash fingerprint of
    its set, BITS bits long. Nodes that agree in a block of bits meet; those within the radius are candidates, and
    every candidate pair is compared by its whole sets, unless both are in one component already. A pair at `least` is
    missed with a probability of at most `miss`, see `block_bits`. Sets too small to resemble another without being
    equal to it meet nobody. Nodes of crowds, with over `bucket_pairs` candidates in all or drawn before them in a
    bucket, are compared with a few of one another, `centres` at a time in each of `rounds` rounds, which brings nearly
    all that belongs together into one component; what is still apart is then compared with all its other candidates
    outside its own component, but for pairs that counts rule out (`may_be_similar`). The first `centres` blocks find
    most of them, so that the others need not name them, or pairs of two of them, once for each block; crowds that show
    only in later blocks are found there. Texts of fewer words than a shingle are one shingle; those without words are
    copies of one another, as are null texts. Repeated rows and doc_ids change nothing. An empty table gives no rows.
    Returns _k1, _k2 (the text's key, see `with_text_key`), node (of its shingle set) and root (of its component).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(2).to_pylist()]
            node = [xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets]
            prints = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(p) for p in prints.T.copy())], ["_k1", "_k2", "node", "shingles", *PRINT])

    texts = with_text_key(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    once = texts.groupBy("_k1", "_k2").agg(F.first("text").alias("text"))
    rows = stash(map_arrow(once.select("_k1", "_k2", "text"), run, "_k1 long, _k2 long, node long, shingles long, " + ", ".join(f"{c} long" for c in PRINT)), "near-rows")
    enough = rows.where(F.col("shingles") * (1 - least) >= least - 1e-6)  # n of n + 1 shingles are the nearest unequal sets
    nodes = stash(enough.groupBy("node").agg(F.min(F.struct("_k1", "_k2")).alias("of"), *(F.first(c).alias(c) for c in PRINT)), "near-nodes")
    blocks, radius = block_bits(nodes.count(), flip_chance(least), miss)
    crowds = stash(in_blocks(nodes.select("node", *PRINT), blocks[:centres]).groupBy("bucket").applyInArrow(crowd_meeting(blocks, radius, bucket_pairs), "node long, other long"), "near-crowds")
    known = crowds.select("node").distinct()
    flagged = nodes.join(known.withColumn("known", F.lit(True)), "node", "left").select("node", *PRINT, F.coalesce("known", F.lit(False)).alias("known"))
    first = in_blocks(flagged, blocks).groupBy("bucket").applyInArrow(first_meeting(blocks, radius, bucket_pairs, centres), "a long, b long")
    met = stash(first.unionByName(known.select(F.col("node").alias("a"), F.col("node").alias("b"))).distinct(), "near-met")
    pairs, many = spread(met, bucket_pairs, centres)
    pairs = pairs.unionByName(crowds.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))).distinct()
    # only texts of nodes that have a candidate are ever compared
    ends = met.unionByName(crowds.toDF("a", "b")).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = nodes.join(ends, "node", "left_semi").select("node", "of._k1", "of._k2")
    wanted = stash(texts.join(asked.hint("merge"), ["_k1", "_k2"]).groupBy("node").agg(F.first("text").alias("text")), "near-texts")
    links = stash(verified(pairs, wanted, words, least), "near-links")
    roots = components(links)
    if many.limit(1).count():
        able = shared_shingles(many, wanted, words, least, 3)
        able = stash(with_bins(able.join(nodes.select("node", *PRINT), "node"), wanted, words), "near-able")
        reads, fruitful = able.count() * len(blocks), True
        for turn in [*range(1, rounds), 0]:
            if turn and not fruitful:
                continue
            named = in_blocks(able.join(roots, "node", "left").select("node", *PRINT, "n", "s", "bins", F.coalesce("root", "node").alias("root")), blocks)
            meeting = later_meeting(blocks, radius, least, centres if turn else None, turn)
            apart = stash(named.groupBy("bucket").applyInArrow(meeting, "a long, b long").distinct(), "near-apart")
            found = stash(verified(apart, wanted, words, least), "near-links")
            links = links.unionByName(found)
            roots = components(links)
            fruitful = 100 * found.count() > reads  # a round reads all its nodes in all blocks; the last step is exact
            drop_stash(apart)
        drop_stash(able)
    drop_stash(wanted, met, many, crowds, nodes)
    return rows.select("_k1", "_k2", "node").join(roots, "node", "left").select("_k1", "_k2", "node", F.coalesce("root", "node").alias("root"))


def without_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each component of near copies, the smallest doc_id of it, with all its columns; see `keep_one`."""
    return keep_one(docs, near_copies(docs, words, least))
