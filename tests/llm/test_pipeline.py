import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from eigenloom.llm.quality import fit_rules
from eigenloom.llm.toxicity import fit_toxicity
from tests.llm.test_quality import brute, brute_buckets
from tests.llm.test_resemblance import least_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(160):
        words = rng.choices(plain, k=rng.randrange(10, 90))
        if i % 5 == 0:
            words[3] = "Grumble!"
        if i % 7 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(i % 7 != 0), int(i % 5 == 0)))
    rows += [(200 + i, rows[i][1], "en", "s", 1) for i in range(20)] + [(300, None, "en", "s", 0), (301, "", None, "s", 0), (2, rows[2][1], "en", "t", 9)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, folder)
    assert kept.columns == docs.columns
    model = fit_toxicity(docs, labels)
    rows = [tuple(r) for r in docs.collect()]
    a = [r for r in rows if model.score(r[1]) < 0.5]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(a, key=key) and 0 < len(a) < len(rows)
    assert not any("Grumble" in (r[1] or "") for r in a)

    second = corpus_pipeline.quality_rules(spark, kept, folder)
    rules = fit_rules(kept, labels.where("quality = 1").select("doc_id"))
    llr = lambda t: float(np.mean(rules.weights[brute_buckets(t, len(rules.weights))]))
    b = [r for r in a if not brute(r[1])[-1] and llr(r[1]) >= rules.threshold]
    assert sorted(map(tuple, second.collect()), key=key) == sorted(b, key=key) and 0 < len(b) < len(a)
    assert all("###" not in r[1] for r in b)

    third = corpus_pipeline.near_duplicates(spark, second, folder)
    least = {x: x for x in least_of([(r[0], r[1]) for r in b]).values()}
    assert sorted(r.doc_id for r in third.collect()) == sorted(least.values()) and len(least) < len(b)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = corpus_pipeline.run(spark, folder).collect()
    text = {r[0]: r[1] for r in b}
    for d in least.values():
        ids = library.encode(text[d], add_special_tokens=False).ids + [1]
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in last if r.doc_id == d)
        assert [s for s, _, _ in pieces] == list(np.cumsum([0, *(n for _, n, _ in pieces)])[:-1])
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c in pieces)
        assert sum(n for _, n, _ in pieces) == len(ids)
    assert {r.doc_id for r in last} == set(least.values())


def test_an_empty_table_and_null_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"word{i} over the hill and far" for i in range(12))
    for name, rows in (("none", []), ("nulls", [(None, words, "en", "s", 1), (None, None, None, None, None), (4, words, "en", "s", 1), (4, words + " again", "en", "s", 2)])):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        assert {r.doc_id for r in out} == ({4} if rows else set())
