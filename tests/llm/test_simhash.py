import random

from xxhash import xxh64_intdigest

from eigenloom.llm.components import components
from eigenloom.llm.simhash import block_masks, near_duplicates, near_links, signed


def brute(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {n: top(n) for n in nodes}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "Éta", "delta", "eps"]
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 120))) for _ in range(40)]
    texts = base + [" ".join([*b.split(), rng.choice(words)]) for b in base] + base[:5] + ["", None, " \n", "a b c", "x\x1cy z q"]
    rows = [(i * 3, t, "q") for i, t in enumerate(texts)] + [(0, texts[0], "again"), (None, texts[1], None)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = {t: brute(t) for t in {*texts}}
    assert sorted((r.doc_id or 0, r.fp) for r in out) == sorted((d or 0, signed(fps[t])) for d, t, _ in rows)
    roots = brute_components(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[roots[fps[t]]] = min(d, least.get(roots[fps[t]], 1 << 60))
    for r in out:
        assert r.component_id == least[roots[r.fp % (1 << 64)]]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(30)}
    seed = rng.getrandbits(64)
    for _ in range(120):
        fps.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 5]))))
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    for cap in (2, 32, 1000):
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in near_links(df, bucket_pairs=cap).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        pairs = set(links) | {(b, a) for a, b in links}
        assert brute_components(fps, lambda a, b: (a, b) in pairs) == want


def test_masks_cover_every_pair_of_flips():
    masks = block_masks(5, 2)
    assert all(any(not m & (1 << i | 1 << j) for m in masks) for i in range(64) for j in range(64))


def test_components_of_a_long_chain(spark):
    n = 300
    rows = [(i, i + 1) for i in range(n)] + [(1000, 1000), (2000, 2001), (2001, 2000), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {2001: 2000}
