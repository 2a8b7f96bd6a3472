import random
import zlib

from eigenloom.llm.sharding import shard, splitters


def check_law(rows, out, shards):
    assert len(out) == len(rows)
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in out) == want
    for s in range(shards):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None for r in out)


def test_bytes_are_near_equal_and_copies_together(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("abcdé ", k=rng.randrange(0, 400))), "z") for i in range(3000)]
    rows += [(5000 + i, "hot text " * 20, "z") for i in range(1500)] + [(7000 + i, "pair", None) for i in range(3)]
    rows += [(None, None, None), (1, None, None), (2, "", None), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string")
    out = shard(docs, shards=6).collect()
    check_law(rows, out, 6)
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(6)]
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 6
    assert len({r.shard for r in out if r.text_crc32 == zlib.crc32(b"pair")}) == 1


def test_small_and_empty(spark):
    docs = spark.createDataFrame([(1, "x" * 5000), (2, "y")], "doc_id long, text string")
    check_law([(1, "x" * 5000), (2, "y")], shard(docs).collect(), 24)
    assert shard(docs.limit(0)).count() == 0


def test_splitters_do_not_cut_a_key():
    bounds = splitters([(7, 50), (7, 50), (1, 1), (9, 3)], 10)
    assert bounds == sorted(set(bounds))
