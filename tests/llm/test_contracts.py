"""Each opN query as registered, over the whole small tables: columns, types, and values by independent means."""

import hashlib
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from eigenloom.llm.queries import QUERIES
from eigenloom.llm.simhash import CHUNK, near_duplicates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], (x or "" for x in t["text"]), strict=True))


@pytest.fixture(scope="module")
def ids(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: library.encode(t, add_special_tokens=False).ids for d, t in docs.items()}, library


def run(spark, prefix):
    name = next(q for q in QUERIES if q.startswith(prefix))
    df = QUERIES[name](spark, SF)
    return dict(df.dtypes), df.collect()


def packed(x):
    return np.array(x, "<u4").tobytes()


def test_op1(spark, docs, ids):
    types, rows = run(spark, "op1_")
    assert list(types.items())[:7] == [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    sequences = {}
    for r in rows:
        own = [*ids[0][r.doc_id], 1]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(packed(own[r.start : r.start + r.length]))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(x) + 1 for x in ids[0].values())
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(parts)) and sum(n for _, n in parts) <= 2048


def test_op2(spark, docs, ids):
    types, rows = run(spark, "op2_")
    assert types == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} and len(rows) == len(docs)
    for r in rows:
        own = ids[0][r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(packed(own)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(ids[1].decode(own, skip_special_tokens=False).encode()).hexdigest()


def test_op3(spark, docs):
    types, rows = run(spark, "op3_")
    assert list(types.items())[:7] == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id].encode()) + 8, zlib.crc32(docs[r.doc_id].encode()), "bytes", None) for r in rows)
    by = Counter(r.shard for r in rows)
    assert set(by) <= set(range(24)) and all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in by.items())


def test_op5(spark):
    types, rows = run(spark, "op5_")
    assert types == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    t = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    v = {i: np.floor(256 * np.array(x, np.float64)).astype(np.int64) for i, x in zip(t["vec_id"], t["embedding"], strict=True)}
    want = {(q, n + 1): (i, -s) for q in v if q % 50 == 0 for n, (s, i) in enumerate(sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[:5])}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows} == want


def test_op6(spark, docs):
    types, rows = run(spark, "op6_")
    assert list(types.items())[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")] and len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_op7(spark, docs):
    types, rows = run(spark, "op7_")
    assert list(types.items())[:8] == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", "boolean"), ("kept", "boolean")]
    for r in rows:
        text = docs[r.doc_id]
        raw = text.encode().split()
        windows = Counter(tuple(raw[i : i + 8]) for i in range(len(raw) - 7))
        twice = {j for i in range(len(raw) - 7) if windows[tuple(raw[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.encode().split(b"\n") if x.split()]
        failed = len(raw) < 20 or 100 * len(twice) > 30 * len(raw)
        want = (len(raw), sum(len(w.decode()) for w in raw), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice), failed)
        assert tuple(r)[1:7] == want and not (r.kept and failed)


def test_op8(spark, docs, ids):
    types, rows = run(spark, "op8_")
    assert types == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    at, found = 0, {r.doc_id: r for r in rows}
    for d in sorted(docs):
        own = [*ids[0][d], 2]
        assert tuple(found[d]) == (d, at, len(own), zlib.crc32(packed(own)))
        at += len(own)


def fingerprint(text):
    words = text.encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op9(spark, docs):
    types, rows = run(spark, "op9_")
    assert types == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    prints = {d: fingerprint(t) for d, t in docs.items()}
    root = {d: d for d in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{prints[d]:016x}", root[d]) for d in docs}


def test_op9_of_a_text_over_one_chunk(spark):
    """More shingles than are counted at once."""
    text = " ".join(f"w{i % 977} x{i % 1013}" for i in range(CHUNK // 2 + 3000))
    got = near_duplicates(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).where("doc_id = 1").first()
    assert got.fp % (1 << 64) == fingerprint(text)


def test_op10(spark, docs):
    types, rows = run(spark, "op10_")
    assert types == {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    tokens = {d: [*t.encode().lower().split(), b""] for d, t in docs.items()}
    count = Counter(w for d, x in tokens.items() if not held[d] for w in x)
    n, v = sum(count.values()), len(count)
    for r in rows:
        x = tokens[r.doc_id]
        assert tuple(r)[1:5] == (held[r.doc_id], len(x), sum(count[w] > 0 for w in x), n)
        assert abs(r.base_score - sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) < 1e-6 and r.score < 0


def test_op4_lists_each_document_once(spark, docs):
    types, rows = run(spark, "op4_")
    assert types == {"doc_id": "bigint", "n_sentences": "bigint", "n_matches": "bigint", "licences": "string"}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
