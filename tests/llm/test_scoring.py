import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from eigenloom.llm.scoring import BEFORE, END, Places, chances, distinct, from_planes, levels_of, lm_scores, packed, planes, squeezed, unpacked, words_by_shard, words_in, words_of


def brute_ppm(raw, order, least, text):
    """Counts by dictionary; one symbol at a time, excluding symbols known to longer contexts."""
    count = [Counter() for _ in range(order + 1)]
    for r in raw:
        s = bytes([BEFORE] * order) + r + bytes([END])
        for i in range(order, len(s)):
            for j in range(order + 1):
                count[j][s[i - j : i], s[i]] += 1
    total = [Counter() for _ in range(order + 1)]
    known = [{} for _ in range(order + 1)]
    for j in range(order + 1):
        for (c, x), n in count[j].items():
            if j or n >= least:
                total[j][c] += n
            if n >= least:
                known[j].setdefault(c, {})[x] = n
    s, out = bytes([BEFORE] * order) + text + bytes([END]), 0.0
    for i in range(order, len(s)):
        excluded, p = set(), 1.0
        for j in range(order, -1, -1):
            c = s[i - j : i]
            if c not in known[j]:
                continue
            mine = {x: n for x, n in known[j][c].items() if x not in excluded}
            t = total[j][c] - sum(n for x, n in known[j][c].items() if x in excluded)
            if s[i] in mine:
                p *= (mine[s[i]] - 0.5) / t
                break
            if t:
                p *= (t - sum(mine.values()) + len(mine) / 2) / t
            excluded |= set(known[j][c])
        else:
            p /= 256 - len(excluded)
        out += math.log10(p)
    return out


def test_chances_sum_to_one():
    rng = random.Random(3)
    raw = ["".join(rng.choices(["ab", "c", " ", "dé", "ba"], k=rng.randrange(0, 60))).encode() for _ in range(50)]
    for order in (1, 2, 4, 6):
        levels = levels_of(*distinct(raw, order), 1, range(order + 1), [])
        for context in (b"\xfe" * order, b"ab c\xc3\xa9ba"[-order:], b"zzzzzzzz"[-order:], b"abababab"[-order:]):
            asked = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
            assert abs((10.0 ** chances(levels, asked)).sum() - 1) < 1e-9


def test_packing_of_messages():
    for values in ([], [5], [0, 2**63, 2**63 + 7]):
        keys = np.array(values, np.uint64)
        assert unpacked(packed(keys)).tolist() == values and from_planes(planes(keys)).tolist() == values
    for words in ([], [b""], [b"", b"a", b"\xff"]):
        assert words_of(squeezed(b" ".join(words)), len(words)) == words
    words = [str(i * 7 % 500).encode() for i in range(500)]
    found = words_by_shard(pa.array(words, pa.large_binary()), 7)
    assert [words_of(w, len(at)) for _, at, w in found] == [sorted(words[i] for i in at) for _, at, _ in found]
    assert sorted(i for _, at, _ in found for i in at) == list(range(500))


def test_words_of_texts():
    texts = ["", " \t a\x1cB\x0b\x0cÉx  A\n", "ÀÉ\u00a0ß İ", "one", "\r\r"]
    codes, text_of, words = words_in(pa.array(texts, pa.large_string()))
    got = [[] for _ in texts]
    for c, t in zip(codes, text_of, strict=True):
        got[t].append(words[int(c)].as_py())
    assert got == [t.encode().lower().split() for t in texts]


def test_places_of_keys():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 56, 5000, np.uint64))
    asked = np.tile(keys, 3)
    assert (keys[Places(keys).of(asked)] == asked).all()


def test_scores_against_brute_force(spark):
    rng = random.Random(6)
    words = ["the", "The", "a", "bé", "x\x1cy", "rare1", "rare2", "zq"]
    rows = [(i, " ".join(rng.choices(words, weights=[30, 9, 20, 8, 3, 1, 1, 1], k=rng.randrange(0, 50))), "s") for i in range(80)]
    rows += [(1000, "only here once", None), (None, "a the", "q"), (7, None, "q"), (7, "", "q"), (8, "the a\tthe\n", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for d, t, _ in rows if not held(d) for w in tokens(t))
    size = sum(c.values()) + 0.5 * (len(c) + 1)
    raw = [(t or "").encode() for d, t, _ in rows if not held(d)]
    want = sorted((d is None, d or 0, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 0.5) / size) for w in tokens(t)), 6)) for d, t, _ in rows)
    for piece in (16 << 20, 200):  # one piece a task, and many
        out = lm_scores(docs, order=3, piece_bytes=piece).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
        assert {r.train_tokens for r in out} == {sum(c.values())}
    by_id = {r.doc_id: r.score for r in out}
    for d, t, _ in rows:
        if d not in (7, 8):
            assert abs(by_id[d] - brute_ppm(raw, 3, 1, (t or "").encode())) < 1e-3 * max(1, abs(by_id[d]))


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert lm_scores(spark.createDataFrame([], schema)).count() == 0
    d = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm_scores(spark.createDataFrame([(d, "ab")], schema)).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and abs(r.score + 3 * math.log10(256)) < 1e-5


def test_rare_contexts_are_kept_at_every_size(spark):
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    train = [d for d in range(400) if not held(d)]
    once, asked = next(d for d in range(400, 500) if not held(d)), next(d for d in range(400, 500) if held(d))
    rows = [(d, "the cat sat on a mat. " * 300) for d in train] + [(once, "Qzxj vwkp"), (asked, "Qzxj vwkp")]
    raw = [t.encode() for d, t in rows if d != asked]
    assert 1e-6 * sum(len(r) + 1 for r in raw) > 1  # a share of 1e-6 leaves out what occurs once
    got = next(r.score for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id == asked)
    assert abs(got - brute_ppm(raw, 5, 1, b"Qzxj vwkp")) < 1e-3


def test_contexts_of_six_bytes_by_default(spark):
    rng = random.Random(9)
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    rows = [(d, " ".join(rng.choices(["banana", "bananas", "ananab", "nan"], k=12))) for d in range(60)]
    raw = [t.encode() for d, t in rows if not held(d)]
    got = {r.doc_id: r.score for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(abs(got[d] - brute_ppm(raw, 6, 1, t.encode())) < 1e-3 for d, t in rows)
    assert any(abs(got[d] - brute_ppm(raw, 5, 1, t.encode())) > 1e-2 for d, t in rows)
