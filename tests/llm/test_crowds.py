import random

import numpy as np

from eigenloom.llm import resemblance
from eigenloom.llm.resemblance import BITS, WORDS, block_bits, crowd_meeting, first_meeting, in_blocks, near_copies
from eigenloom.llm.simhash import with_text_key
from tests.llm.test_resemblance import edited, least_of


def test_crowds_are_named_once_and_every_pair_is_left_to_some_meeting(spark):
    """Pairs within the radius that agree in a block come out, or both ends are known or come out for the later meetings."""
    rng = random.Random(10)
    seeds = [rng.getrandbits(BITS) for _ in range(3)]
    near_to = lambda s, most: s ^ sum(1 << b for b in rng.sample(range(BITS), rng.randrange(1, most)))
    prints = [rng.getrandbits(BITS) for _ in range(30)] + [near_to(s, most) for s, most, n in zip(seeds, (12, 70, 50), (40, 50, 6), strict=True) for _ in range(n)]
    columns = ", ".join(f"f{w} long" for w in range(WORDS))
    signed = lambda p: np.array([p >> 64 * w & (1 << 64) - 1 for w in range(WORDS)], np.uint64).view(np.int64).tolist()
    blocks, radius = block_bits(len(prints), 3 / 16, 5e-8)
    blocks = blocks[:20]
    masks = [sum(1 << int(b) for b in block) for block in blocks]
    close = [(a, b) for b, q in enumerate(prints) for a, p in enumerate(prints[:b]) if (p ^ q).bit_count() <= radius]
    share = lambda a, b, m: not (prints[a] ^ prints[b]) & m
    near = {(a, b) for a, b in close if any(share(a, b, m) for m in masks)}

    nodes = spark.createDataFrame([(i, *signed(p)) for i, p in enumerate(prints)], f"node long, {columns}")
    stars = [(r.node, r.other) for r in in_blocks(nodes, blocks[:2]).groupBy("bucket").applyInArrow(crowd_meeting(blocks, radius, 8), "node long, other long").collect()]
    times = [[sum(x in p and share(*p, m) for p in close) for m in masks[:2]] for x in range(len(prints))]
    assert sorted(x for x, _ in stars) == [x for x, each in enumerate(times) for t in each if t > 8]
    assert all((min(p), max(p)) in near for p in stars)
    known = {x for x, _ in stars}
    assert {*range(30, 70)} <= known and len(known) < len(prints) - 30

    flagged = spark.createDataFrame([(i, *signed(p), i in known) for i, p in enumerate(prints)], f"node long, {columns}, known boolean")
    for most in (1, 8, 1000):
        met = [(r.a, r.b) for r in in_blocks(flagged, blocks).groupBy("bucket").applyInArrow(first_meeting(blocks, radius, most, 1), "a long, b long").collect()]
        marked, found = {a for a, b in met if a == b}, {(a, b) for a, b in met if a != b}
        assert found <= near and not any({*p} <= known for p in found) and not marked & known
        assert all(p in found or {*p} <= known | marked for p in near)
        assert most < 1000 or (found == {p for p in near if not {*p} <= known} and not marked)
        assert most > 1 or marked


def test_a_crowd_of_near_copies_makes_few_rows_in_its_first_meetings(spark, monkeypatch):
    rng = random.Random(22)
    words = [f"w{i}" for i in rng.choices(range(400), k=150)]
    rows = [(i, edited(rng, words, rng.choice([1, 2, 4, 9]))) for i in range(200)]
    made = spark.sparkContext.accumulator(0)

    def counted(of):
        def make(*args):
            run = of(*args)

            def count(bucket):
                out = run(bucket)
                made.add(out.num_rows)
                return out

            return count

        return make

    for name in ("crowd_meeting", "first_meeting"):
        if hasattr(resemblance, name):
            monkeypatch.setattr(resemblance, name, counted(getattr(resemblance, name)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = with_text_key(docs).join(near_copies(docs), ["_k1", "_k2"]).collect()
    least = {}
    for r in found:
        least[r.root] = min(r.doc_id, least.get(r.root, 1 << 60))
    assert {r.doc_id: least[r.root] for r in found} == least_of(rows)
    assert 0 < made.value < 10 * len(rows)
