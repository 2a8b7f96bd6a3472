import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eigenloom.llm.bpe import Encoder, Lexicon, Vocabulary
from eigenloom.llm.packing import assign, capacities, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
SOURCE = open(PATH, encoding="utf-8").read()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(SOURCE)


def texts(n, seed=3):
    rng = random.Random(seed)
    pool = [chr(c) for c in range(0x250)]
    out = ["", " ", "\n\n x", "<|endoftext|>a<|endoftext|>", "中文 абв", "a" * 3000, "  \x1c\x85 y", "I'll we've 'S"]
    return out + ["".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice(" ab1'\nsét") for _ in range(rng.randrange(80))) for _ in range(n)]


@pytest.mark.parametrize("compiled", [True, False])
def test_encoder_is_the_library(library, compiled):
    vocabulary = Vocabulary(SOURCE)
    if not compiled:
        vocabulary.merger = lambda: vocabulary.merge
    encoder = Encoder(vocabulary, memo_words=500)
    for text in texts(1500):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_lexicon_finds_exactly_its_words(tmp_path):
    rng = random.Random(5)
    words = {bytes(rng.choices(b"abc", k=rng.randrange(1, 7))): [rng.randrange(9)] for _ in range(400)} | {b"": [7]}
    (tmp_path / "lexicon").write_bytes(Lexicon.build(words.items()))
    lexicon = Lexicon.mapped(str(tmp_path / "lexicon"))
    asked = [*words, b"zz", b"abcabcabcabc", b"ab\xff"]
    rows = lexicon.find(asked).tolist()
    for word, row in zip(asked, rows, strict=True):
        assert (row >= 0) == (word in words)
        if row >= 0:
            assert np.frombuffer(lexicon.sequences(np.array([row]))[0], "<u4").tolist() == words[word]
    assert lexicon.states < sum(map(len, words))


def test_encoder_with_a_lexicon_is_the_library(library):
    vocabulary = Vocabulary(SOURCE)
    sample = texts(400)
    words = {w for t in sample[::2] for part in Encoder(vocabulary)._cut(t) if not isinstance(part, bytes) for w in part}
    encoder = Encoder(vocabulary, Lexicon(Lexicon.build((w.encode(), vocabulary.merge(w.encode())) for w in words)), memo_words=300)
    for a in range(0, len(sample), 50):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(sample[a : a + 50])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in sample[a : a + 50]]
    assert encoder.found > encoder.asked / 3 and encoder.merged <= encoder.asked - encoder.found
    assert Encoder(vocabulary, Lexicon(Lexicon.build([]))).encode_all(["a b", ""]) == [np.array(library.encode("a b", add_special_tokens=False).ids, "<u4").tobytes(), b""]


def test_assign_fills_every_sequence():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randrange(1, 64) for _ in range(rng.randrange(1, 90))]
        placed = assign(lengths, 64, 1.0, 0.01)
        room = capacities(sum(lengths), 64)
        assert sum(room) == sum(lengths)
        for at, size in enumerate(room):
            assert sum(n for _, _, n, s in placed if s == at) == size
        for item, length in enumerate(lengths):
            spans = sorted((s, n) for i, s, n, _ in placed if i == item)
            assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
            assert sum(n for _, n in spans) == length


def test_pack_holds_each_id_once(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts(60) + ["word " * 5000])] + [(None, None, "y"), (3, "twice", None), (3, "twice", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    out = pack(docs, PATH, max_len=64, window_docs=16).collect()
    got, seqs = {}, {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(got[i])
        flat = [x for _, p in pieces for x in p]
        if i != 3:
            assert flat == ids and [s for s, _ in pieces] == list(np.cumsum([0, *(len(p) for _, p in pieces)])[:-1])
    for pieces in seqs.values():
        pieces.sort()
        total = sum(n for _, n in pieces)
        assert [o for o, _ in pieces] == list(np.cumsum([0, *(n for _, n in pieces)])[:-1])
        assert total <= 64 and total & (total - 1) == 0
    assert pack(docs.limit(0), PATH).count() == 0
