"""SimHash near-duplicates: fingerprints, pigeonhole block joins, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from eigenloom.llm._common import map_arrow, stash
from eigenloom.llm.components import components

SEED = 42
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 17


def shingle_hashes(text: str, words: int = 3) -> list[int]:
    """XXH64 of each shingle of lower-cased words joined by single spaces; fewer words are one shingle."""
    tokens = text.encode().lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    starts = [0]
    for t in tokens:
        starts.append(starts[-1] + len(t) + 1)
    if len(tokens) <= words:
        return [xxh64_intdigest(joined, SEED)]
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[words:])]  # noqa: B905


def fingerprints(counts_of: list[list[int]]) -> np.ndarray:
    """A fingerprint for each list of hashes: bits set in over half of them; zero for none."""
    out = np.zeros(len(counts_of), np.uint64)
    full = [i for i, h in enumerate(counts_of) if h]
    at = 0
    while at < len(full):
        group, n = [full[at]], len(counts_of[full[at]])
        while at + len(group) < len(full) and n + len(counts_of[full[at + len(group)]]) <= CHUNK:
            n += len(counts_of[full[at + len(group)]])
            group.append(full[at + len(group)])
        at += len(group)
        size = np.array([len(counts_of[i]) for i in group], np.int64)
        ones = np.zeros((len(group), 64), np.int64)
        if len(group) == 1:  # one long text, in pieces
            hashes = counts_of[group[0]]
            for a in range(0, len(hashes), CHUNK):
                ones[0] += np.unpackbits(np.array(hashes[a : a + CHUNK], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            bits = np.unpackbits(np.fromiter((h for i in group for h in counts_of[i]), "<u8", n).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(size)[:-1])), axis=0, dtype=np.int32)
        out[group] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_table(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprints([shingle_hashes(t or "", words) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of every choice of blocks - distance blocks: fingerprints within the distance agree under one."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, distance: int = 2, blocks: int = 5, bucket_pairs: int = 32) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within `distance` bits into the same components.

    Close pairs agree on at least blocks - distance blocks, so each fingerprint is keyed by every such choice
    and joined on equal keys; the Hamming distance is then verified. Keys of a single fingerprint are dropped
    before the join. A key with over `bucket_pairs` fingerprints would give all their pairs; there, each
    fingerprint is instead entered under itself and under each of its one-bit neighbours, and linked to the
    smallest entry. Two fingerprints share such an entry exactly if they differ in two bits or fewer, so no link
    between components is lost and links stay proportional to fingerprints. (For a distance other than two,
    that way holds for distance 2 * (distance // 2), so only even distances of two are accepted.)
    """
    if distance != 2:
        raise ValueError("the way for large buckets is exact for a distance of two")
    masks = block_masks(blocks, distance)
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)))).alias("k")).select("k.way", "k.key", "fp")
    size = keyed.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = stash(keyed.join(size, ["way", "key"]), "simhash-buckets")
    few = held.where(F.col("n") <= bucket_pairs)
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = few.select("way", "key", F.col("fp").alias("a")).join(few.select("way", "key", F.col("fp").alias("b")), ["way", "key"]).where((F.col("a") < F.col("b")) & (differ <= distance)).select("a", "b")
    many = held.where(F.col("n") > bucket_pairs).select("fp").distinct()
    entries = many.select("fp", F.explode(F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)).cast("long") for i in range(64)))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("entry"))
    low = entries.groupBy("entry").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = entries.join(low, "entry").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, blocks: int = 5) -> DataFrame:
    """Fingerprint and component of each document (doc_id, text).

    Equal fingerprints are one node, however many rows share them, so a hot group costs one row from each
    task. Texts without words have fingerprint zero and are linked like others. Null texts count as empty.
    Repeated rows share a component; a null doc_id is kept and never a component's id (null only if all are).
    An empty table gives no rows. Other columns are not read.
    Returns doc_id, fp (signed long), component_id (smallest doc_id reachable).
    """
    rows = stash(fingerprint_table(docs, words), "fingerprints")
    nodes = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(near_links(nodes.select("fp"), distance, blocks))
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def with_text_key(docs: DataFrame) -> DataFrame:
    """The documents with a 128-bit key of their text, in _k1 and _k2; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(SEED), text)})


def keep_one(docs: DataFrame, components_of: DataFrame) -> DataFrame:
    """Exactly one row of each component, with all its columns: the smallest doc_id (null last), then text key.

    `components_of` has _k1, _k2 and root for each distinct text of `docs`. Rows are told apart by doc_id and
    text, so rows that share a doc_id but not a text stand for their own components; of rows equal in both, one
    stays. Texts are shuffled once, by a merge at every size, since what is kept grows with the corpus.
    """
    doc = F.col("doc_id").cast("long")
    rows = with_text_key(docs).withColumns({"_d": F.coalesce(doc, F.lit(0)), "_n": doc.isNull()})
    key = ["_n", "_d", "_k1", "_k2"]
    least = F.min(F.struct(*key))
    # the least row of each text first, so that a hot group of copies costs a row from each task
    texts = rows.select(*key).groupBy("_k1", "_k2").agg(least.alias("row"))
    named = texts.join(components_of, ["_k1", "_k2"]).groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    return rows.join(named.hint("merge"), key, "left_semi").dropDuplicates(key).drop(*key)
