import random

import corpus_pipeline
from eigenloom.llm.resemblance import near_copies, without_copies
from eigenloom.llm.simhash import with_text_key
from tests.llm.test_simhash import brute_components


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def least_of(rows):
    sets = {shingles(t) for _, t in rows}
    order = sorted(sets, key=lambda s: (len(s), sorted(s)))
    roots = brute_components(range(len(order)), lambda i, j: linked(order[i], order[j]))
    root = {s: roots[i] for i, s in enumerate(order)}
    least = {}
    for d, t in rows:
        if d is not None:
            r = root[shingles(t)]
            least[r] = min(d, least.get(r, 1 << 60))
    return {d: least[root[shingles(t)]] for d, t in rows if d is not None}


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def planted():
    rng = random.Random(21)
    plain = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(30):
        words = rng.choices(plain, k=rng.randrange(60, 200))
        rows += [(i, " ".join(words)), (100 + i, edited(rng, words, 1)), (200 + i, edited(rng, words, rng.randrange(2, 12)))]
    words = rng.choices(plain, k=150)
    rows += [(1000 + i, edited(rng, words, rng.choice([0, 1, 2, 4]))) for i in range(40)]
    return rows + [(2000, "a b c"), (2001, "A  b c"), (2002, "a b d"), (2003, ""), (2004, None), (None, rows[0][1]), (2, rows[2][1])]


def test_planted_edited_copies_against_brute_force(spark):
    rows = planted()
    want = least_of([r for r in rows if r[0] != 2])
    docs = spark.createDataFrame([r for r in rows if r[0] != 2], "doc_id long, text string")
    for cap in (2, 32):
        found = near_copies(docs, bucket_pairs=cap, centres=2, rounds=2)
        rows_of = with_text_key(docs).join(found, ["_k1", "_k2"]).where("doc_id is not null").collect()
        least = {}
        for r in rows_of:
            least[r.root] = min(r.doc_id, least.get(r.root, 1 << 60))
        assert {r.doc_id: least[r.root] for r in rows_of} == want
    assert sum(want[100 + i] == i for i in range(30) if i != 2) == 29


def test_the_stage_removes_edited_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in rng.choices(range(400), k=120)]
    rows = [(1, " ".join(words), "a"), (2, edited(rng, words, 1), "b"), (3, edited(rng, words, 60), "c")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_component_by_row(spark):
    """Rows that share a doc_id but not a text stand for their own texts; null ids, copies and clashing columns."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    schema = "doc_id long, text string, root string, node string"
    for rows, want in (
        ([(1, b), (5, b), (5, a)], [(1, b), (5, a)]),
        ([(5, a), (5, b), (1, b)], [(1, b), (5, a)]),
        ([(None, a), (None, b), (7, b), (7, b), (7, c)], [(None, a), (7, b), (7, c)]),
        ([(3, None), (2, ""), (None, " \n")], [(2, "")]),
        ([], []),
    ):
        docs = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
        kept = [tuple(r) for r in without_copies(docs).collect()]
        assert sorted(kept, key=str) == sorted([(*r, "x", "y") for r in want], key=str)
