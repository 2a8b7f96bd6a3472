import random
import re
from collections import Counter

import numpy as np
from xxhash import xxh64_intdigest

from eigenloom.llm.quality import Rules, fit_rules, quality_filter, quality_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed)


def brute_buckets(text, size):
    h = [xxh64_intdigest(w.encode(), 0) for w in WORD.findall(text or "")]
    m = 1 << 64
    return [x % size for x in h] + [((((a * 0x9E3779B97F4A7C15 % m) ^ b) * 0xFF51AFD7ED558CCD % m) >> 20) % size for a, b in zip(h, h[1:], strict=False)]


def corpus():
    rng = random.Random(9)
    words = ["a", "bé", "c,", "d|", "\x1c", "f#", " g", " "]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 90))) for _ in range(60)]
    texts += ["x y\nx y\n\n \n \nx y", "one two three four five six seven eight nine " * 4, None, "", " \t\n", "z " * 5000]
    texts += ["\n".join(rng.choices(["l 1", "l 2", "\x0b", "l\r"], k=30)) for _ in range(8)]
    return [(i, t, "n") for i, t in enumerate(texts)] + [(None, texts[0], None), (1, texts[1], "n")]


def test_measures_and_ratio_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 3)] + [(None,), (3,)], "doc_id long")
    size, smooth = 50, 2.0
    rules = fit_rules(docs, trusted, size=size, smoothing=smooth, threshold=-0.01)
    raw, target = np.full(size, smooth), np.full(size, smooth)
    for d, t, _ in rows:
        for b in brute_buckets(t, size):
            raw[b] += 1
            target[b] += d is not None and d < 60 and d % 3 == 0
    weights = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(rules.weights, weights)
    out = quality_scores(docs, rules).collect()
    assert len(out) == len(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    want = sorted(((d, *brute(t)) for d, t, _ in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=key) == want
    text_of = {d: t for d, t, _ in rows}
    for r in out:
        b = brute_buckets(text_of[r.doc_id], size)
        llr = float(np.mean(weights[b])) if b else 0.0
        assert abs(r.llr - llr) < 1e-9 and r.kept == (not r.base_failed and llr >= -0.01)
    kept = sorted((r.doc_id or -1) for r in out if r.kept)
    assert sorted((r.doc_id or -1) for r in quality_filter(docs, rules).collect()) == kept


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    rules = fit_rules(docs, docs)
    assert quality_scores(docs, rules).count() == 0
    one = spark.createDataFrame([(1, " ".join(map(str, range(30))))], "doc_id long, text string")
    assert quality_scores(one, fit_rules(one, docs)).first().kept


def test_rules_of_no_texts():
    assert len(Rules(np.zeros(5), 0.0)([])["kept"]) == 0
