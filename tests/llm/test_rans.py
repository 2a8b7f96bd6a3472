import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eigenloom.llm.rans import SCALE_BITS, Block, Table, encode_block, opened, read_ids, segment_row, units_of, write_ids
from eigenloom.llm.tokenization import encode_decode

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(3)
    out = ["", None, "<|endoftext|> x", "中 文", "word " * 4000, "\x85é"]
    return out + ["".join(rng.choices(["the ", "cat", " é", "\n", "Zq", "7 "], k=rng.randrange(0, 60))) for _ in range(80)]


def test_blocks_round_trip_and_start_at_checkpoints():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (5, 3), (70, 1), (5000, 50000), (40_000, 300)):
        ids = np.minimum(rng.geometric(8 / top, n) if top > 8 else rng.integers(0, top, n), 50256).astype(np.uint32)
        table = Table.of(ids)
        assert int(table.short.sum()) == 1 << SCALE_BITS and table.short.min() >= 1
        table = Table.load(table.dump())
        raw = encode_block(ids, table, max_lanes=16, checkpoint_steps=32)
        block = Block(raw, table)
        assert (np.concatenate([block.decode(u) for u in range(block.units)]) == ids).all()
        lanes = max(1, min(16, n // 64))
        assert block.units == units_of(n, lanes, 32) and (block.units > 3 or n < 5000)
        for unit in reversed(range(block.units)):  # any stretch by itself, from its checkpoint
            a = unit * 32 * lanes
            assert (Block(raw, table).decode(unit) == ids[a : a + 32 * lanes]).all()
        with pytest.raises(ValueError):
            Block(raw[:30] + bytes([raw[30] ^ 1]) + raw[31:], table)
    wrong = Block(raw, table)
    wrong.words = wrong.words.copy()
    wrong.words[wrong.places[3]] ^= 1
    with pytest.raises(ValueError):
        wrong.decode(3)
    assert (wrong.decode(0) == ids[: 32 * lanes]).all()  # the other stretches stand
    entropy = -(p := np.bincount(ids) / n)[p > 0] @ np.log2(p[p > 0]) * n / 8
    assert len(encode_block(ids, Table.of(ids), max_lanes=16, checkpoint_steps=1 << 20)) < 1.02 * entropy + 400


def test_blocks_of_a_segment_end_with_documents():
    ids = [np.array([5, 2], np.uint32), np.array([2], np.uint32), np.arange(900, dtype=np.uint32), np.array([7] * 60 + [2], np.uint32), np.array([2], np.uint32)]
    freq, blocks = segment_row([4, None, -3, 4, 9], ids, 100, max_lanes=4, checkpoint_steps=8)
    assert [b["doc_ids"] for b in blocks] == [[4, None, -3], [4, 9]] and [b["start"] for b in blocks] == [0, 903]
    table = opened(freq)
    for b, part in zip(blocks, (ids[:3], ids[3:]), strict=True):
        block = Block(b["payload"], table)
        assert block.units == b["units"] and (np.concatenate([block.decode(u) for u in range(block.units)]) == np.concatenate(part)).all()
    with pytest.raises(ValueError):
        opened(freq[:9] + bytes([freq[9] ^ 4]) + freq[10:])
    assert segment_row([], [], 100)[1] == []


def test_files_against_the_library(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    rows = [(1000 - 7 * i, t, "n") for i, t in enumerate(texts())] + [(None, "null id", None), (1000, "again", "n"), (1000, "again", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    write_ids(docs, str(tmp_path / "f"), PATH, segment_tokens=700, block_tokens=150, max_lanes=4, checkpoint_steps=8)
    out = sorted(read_ids(spark, str(tmp_path / "f")).withColumn("crc", F.crc32("ids")).collect(), key=lambda r: r.start)
    ids_of = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [r.doc_id for r in out] == [r[0] for r in sorted(rows, key=key)]
    at = 0
    for r in out:
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and r.crc == zlib.crc32(r.ids)
        at += r.n_tokens
    want = sorted((key((d,)), ids_of(t)) for d, t, _ in rows)
    assert sorted((key((r.doc_id,)), np.frombuffer(r.ids, "<u4").tolist()) for r in out) == want
    write_ids(docs.limit(0), str(tmp_path / "e"), PATH)
    assert read_ids(spark, str(tmp_path / "e")).count() == 0


def test_encode_decode_against_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t, "n") for i, t in enumerate(texts())] + [(None, "null id", None), (1000, "again", "n"), (1000, "again", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = encode_decode(docs, PATH, share=1e-3).collect()
    assert len(out) == len(rows)
    want = {d: library.encode(t or "", add_special_tokens=False).ids for d, t, _ in rows}
    for r in out:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want[r.doc_id] and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert hashlib.sha256(r.ids).hexdigest()
    assert encode_decode(docs.limit(0), PATH).count() == 0
