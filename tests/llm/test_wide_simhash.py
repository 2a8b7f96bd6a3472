import random

import numpy as np
import pytest

from eigenloom.llm import resemblance
from eigenloom.llm.resemblance import BITS, WORDS, block_bits, close_rows, drawn, first_meeting, flip_chance, in_blocks, later_meeting, near_copies, shingle_set, spread, wide_fingerprint
from tests.llm.test_resemblance import edited, least_of, linked, planted, shingles
from tests.llm.test_simhash import brute


def whole(words):
    return sum(int(w) << 64 * i for i, w in enumerate(words))


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 255, 256, 999, resemblance.CHUNK + 77):
        found = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        print_of = [whole(wide_fingerprint(np.array([h], np.uint64))) for h in found.tolist()]  # one hash: its own bits
        assert [p & (1 << 64) - 1 for p in print_of] == found.tolist()
        want = sum(1 << b for b in range(BITS) if 2 * sum(p >> b & 1 for p in print_of) > n)
        assert whole(wide_fingerprint(found)) == want
    text = "one two three four five six"  # no shingle is repeated, so the first word is operator 9's fingerprint
    assert int(wide_fingerprint(shingle_set(text, 3))[0]) == brute(text)
    assert not wide_fingerprint(np.zeros(0, np.uint64)).any()


def test_similar_sets_agree_in_a_block_within_the_radius():
    blocks, radius = block_bits(170_000, flip_chance(0.8), 5e-8)
    rng = np.random.default_rng(5)
    sizes = [(4, 5, 4), (5, 6, 5), (7, 8, 7), (8, 10, 8), (13, 14, 12), (18, 18, 16), (90, 90, 80), (450, 450, 400)]
    for n, m, both in sizes * 40:
        assert both / (n + m - both) >= 0.8
        pool = rng.integers(0, 1 << 64, n + m - both, np.uint64)
        bits = [np.unpackbits(wide_fingerprint(np.unique(p)).view(np.uint8), bitorder="little") for p in (pool[:n], pool[n - both :])]
        same = bits[0] == bits[1]
        assert (~same).sum() <= radius and same[blocks].all(axis=1).any()
    for nodes in (0, 1000, 10_000_000):
        blocks, radius = block_bits(nodes, flip_chance(0.8), 5e-8)
        first = blocks[: BITS // blocks.shape[1]].ravel()
        assert len(set(first.tolist())) == len(first) and (1 << blocks.shape[1]) * resemblance.CROWD * 2 > nodes


@pytest.mark.parametrize("most", [1, 1000])
def test_meetings_against_brute_force(spark, most):
    """Every pair within the radius that agrees in a block comes out, or, of a crowd, when all its nodes meet again."""
    rng = random.Random(9)
    seed = rng.getrandbits(BITS)
    prints = [rng.getrandbits(BITS) for _ in range(30)] + [seed ^ sum(1 << b for b in rng.sample(range(BITS), rng.randrange(1, 60))) for _ in range(50)]
    signed = lambda p: np.array([p >> 64 * w & (1 << 64) - 1 for w in range(WORDS)], np.uint64).view(np.int64).tolist()
    columns = ", ".join(f"f{w} long" for w in range(WORDS))
    blocks, radius = block_bits(len(prints), 3 / 16, 5e-8)
    blocks = blocks[:20]
    masks = [sum(1 << int(b) for b in block) for block in blocks]
    near = {(a, b) for b, q in enumerate(prints) for a, p in enumerate(prints[:b]) if (p ^ q).bit_count() <= radius and any(not (p ^ q) & m for m in masks)}
    nodes = spark.createDataFrame([(i, *signed(p)) for i, p in enumerate(prints)], f"node long, {columns}")
    met = {(r.a, r.b) for r in in_blocks(nodes, blocks).groupBy("bucket").applyInArrow(first_meeting(blocks, radius, most, 1), "a long, b long").collect()}
    crowd = {a for a, b in met if a == b}
    found = {(a, b) for a, b in met if a != b}
    assert found <= near and all((a, b) in found or {a, b} <= crowd for a, b in near)
    assert found == near if most == 1000 else found < near
    # full bins rule nothing out; two roots: only pairs across them
    again = spark.createDataFrame([(i, *signed(p), 9, 9, [9] * resemblance.BINS, i % 2) for i, p in enumerate(prints)], f"node long, {columns}, n long, s long, bins array<int>, root long")
    rows = in_blocks(again, blocks).groupBy("bucket").applyInArrow(later_meeting(blocks, radius, 0.8, None, 0), "a long, b long").collect()
    assert sorted((r.a, r.b) for r in rows) == sorted((a, b) for a, b in near if a % 2 != b % 2)


def test_pairs_are_put_off_only_between_nodes_of_crowds(spark):
    pairs = {(a, b) for a in range(20) for b in range(a + 1, 20)} | {(a, 100 + a) for a in range(20)} | {(200, 201), (202, 203)}
    met = spark.createDataFrame([*pairs, (200, 200), (300, 300)], "a long, b long")
    first, many = spread(met, 5, 2)
    found, crowd = [(r.a, r.b) for r in first.collect()], {r.node for r in many.collect()}
    assert crowd == {*range(20), 200, 300} and len(found) == len({*found}) and {*found} <= pairs
    assert all((a, b) in found or {a, b} <= crowd for a, b in pairs)
    among = [p for p in found if {*p} <= crowd]
    assert 0 < len(among) <= 2 * len(crowd) and {(a, 100 + a) for a in range(20)} <= {*found}


def test_close_rows_over_many_tiles():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 64, (3 * resemblance.TILE + 5, WORDS), np.uint64)
    prints[1::2] = prints[:-1:2] ^ np.uint64(5)
    root = np.arange(len(prints)) // 300
    bits = np.unpackbits(prints.view(np.uint8), axis=1).astype(np.int16)
    differ = (bits[:, None] != bits[None]).sum(axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(differ <= 100), strict=True) if i < j}
    pairs = lambda found: [(i, j) for a, b in found for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(pairs(close_rows(prints, 100))) == sorted(want)
    across = [(i, j) for i, j in pairs(close_rows(prints, 100, root)) if root[i] != root[j]]
    assert sorted(across) == sorted((i, j) for i, j in want if root[i] != root[j])
    assert sorted(drawn(np.arange(50), 1)) == list(range(50)) and drawn(np.arange(50), 1).tolist() != drawn(np.arange(50), 2).tolist()


def test_fingerprints_alone_name_the_candidates(spark, monkeypatch):
    """The stage links through fingerprints in blocks: with no bit allowed to differ, no edited copy is found."""
    rows = [r for r in planted() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    roots = lambda: {r.node: r.root for r in near_copies(docs).collect()}
    found = roots()
    assert any(n != r for n, r in found.items())
    kept = block_bits(len(rows), flip_chance(0.8), 5e-8)
    monkeypatch.setattr(resemblance, "block_bits", lambda *_: (kept[0], 0))
    assert all(n == r for n, r in roots().items())


def test_small_sets_that_are_similar(spark):
    """Four of five shingles are 0.8 alike, three of four are not."""
    rng = random.Random(14)
    rows = []
    for i in range(40):
        words = [f"v{rng.randrange(10**6)}" for _ in range(9)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words[:8])), (10 * i + 2, " ".join(words[:7])), (10 * i + 3, edited(rng, words, 1))]
    found = near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.node for r in found}) == 160 and len({r.root for r in found}) == len({*least_of(rows).values()}) < 125
    assert linked(shingles(rows[0][1]), shingles(rows[1][1])) and not linked(shingles(rows[1][1]), shingles(rows[2][1]))
