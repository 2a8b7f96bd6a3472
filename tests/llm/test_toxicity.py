import math
import random
import zlib

import numpy as np

from eigenloom.llm.toxicity import Toxicity, fit_linear, fit_toxicity, label_model, toxicity_filter, toxicity_scores


def corpus(n=500):
    rng = random.Random(11)
    plain = ["lorem", "ipsum", "dolor", "amet", "elit", "sed", "do", "tempor", "magna", "aliqua"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(5, 40))
        bad = rng.random() < 0.25
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["Grumble", "vexing!", "snark###", "blahter" + rng.choice("abcdefgh"), "SNARK"]))
        rows.append((i, " ".join(words), 1))
        if rng.random() < 0.8:
            labels.append((i, int(bad) if rng.random() < 0.97 else int(not bad), 1))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (1, None, 0), labels[0]], "doc_id long, toxic int, score int")
    model = fit_toxicity(docs, marks)
    out = {r.doc_id: r for r in toxicity_scores(docs, model).collect()}
    truth = {i: any(w in t.lower() for w in ("grumble", "vexing", "snark", "blahter")) for i, t, _ in rows}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in set(held)) for i in out)
    assert np.mean([out[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    kept = {r.doc_id for r in toxicity_filter(docs, model).collect()}
    assert kept == {i for i, r in out.items() if not r.predicted}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows, labels = corpus(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    flip = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t, _ in labels]
    a = fit_toxicity(docs, spark.createDataFrame([x[:2] for x in labels], "doc_id long, toxic int"))
    b = fit_toxicity(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert a.weights == b.weights and a.intercept == b.intercept


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x " * 3000), (2, "x " * 3000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity_scores(docs, fit_toxicity(docs, none)).collect()
    assert len(out) == 4 and all(r.predicted == 0 for r in out)
    clean = spark.createDataFrame([(2, 0), (1, 0)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity_scores(docs, fit_toxicity(docs, clean)).collect())
    empty = docs.limit(0)
    assert toxicity_scores(empty, fit_toxicity(empty, none)).count() == 0


def brute_label_model(votes, toxic, labels, prior, rounds):
    """The same estimates with loops over rows, voters and pairs."""
    n, m = len(votes), len(votes[0])
    post = []
    for x in votes:
        b = sum(v if t else -v for v, t in zip(x, toxic)) + (1 if labels[len(post)] == 1 else -1)
        post.append(1 / (1 + math.exp(-(2 * b if b > 0 else math.log(prior / (1 - prior)) + 2 * b))))
    for _ in range(rounds):
        mass = [sum(post), n - sum(post)]
        p = [post, [1 - x for x in post]]
        rate = [[(sum(p[c][i] * votes[i][j] for i in range(n)) + 0.5) / (mass[c] + 1) for j in range(m)] for c in (0, 1)]
        held = [(sum(p[c][i] for i in range(n) if labels[i] == 1) + 0.5) / (mass[c] + 1) for c in (0, 1)]
        rest = [[votes[i][j] - post[i] * rate[0][j] - (1 - post[i]) * rate[1][j] for j in range(m)] for i in range(n)]
        cov = [[sum(rest[i][a] * rest[i][b] for i in range(n)) for b in range(m)] for a in range(m)]
        tied = [[1.0 if a == b else 0.9 * max(0.0, cov[a][b]) / math.sqrt(cov[a][a] * cov[b][b]) for b in range(m)] for a in range(m)]
        share = [min(1.0, max(0.0, x)) for x in np.linalg.inv(np.array(tied)).sum(axis=1)]
        after = []
        for i in range(n):
            odds = math.log(mass[0] / mass[1])
            for j in range(m):
                a, b = (rate[0][j], rate[1][j]) if votes[i][j] else (1 - rate[0][j], 1 - rate[1][j])
                odds += share[j] * math.log(a / b)
            a, b = held if labels[i] == 1 else (1 - held[0], 1 - held[1])
            after.append(1 / (1 + math.exp(-(odds + math.log(a / b)))))
        post = after
    return post, share


def test_label_model_against_brute_force():
    rng = np.random.default_rng(2)
    y = rng.random(120) < 0.4
    votes = (rng.random((120, 4)) < np.where(y[:, None], [0.7, 0.6, 0.5, 0.1], [0.1, 0.2, 0.1, 0.5])).astype(float)
    votes = np.column_stack((votes, np.where(rng.random(120) < 0.9, votes[:, 0], 1 - votes[:, 0])))
    toxic, labels = np.array([1, 1, 1, 0, 1], bool), np.where(rng.random(120) < 0.9, y, ~y).astype(int)
    for rounds in (1, 4):
        post, _, _, share = label_model(votes, toxic, labels, 0.3, rounds)
        want, shares = brute_label_model(votes.tolist(), toxic, labels.tolist(), 0.3, rounds)
        assert np.allclose(post, want, atol=1e-9) and np.allclose(share, shares, atol=1e-9)


def test_wrong_labels_are_outvoted():
    rng = np.random.default_rng(4)
    y = rng.random(3000) < 0.3
    votes = (rng.random((3000, 6)) < np.where(y[:, None], 0.6, 0.05)).astype(float)
    labels = np.where(rng.random(3000) < 0.8, y, ~y)
    post, rates, held, _ = label_model(votes, np.ones(6, bool), labels.astype(int), 0.3)
    assert ((post > 0.5) == y).mean() > 0.96 > (labels == y).mean()
    assert abs(held[0] - 0.8) < 0.05 and abs(held[1] - 0.2) < 0.05
    assert np.allclose(rates[0], 0.6, atol=0.06) and np.allclose(rates[1], 0.05, atol=0.03)


def test_scores_by_hand_and_ties(spark):
    model = Toxicity({"bad": 2.0, "vile*": 1.5, "kind": -1.0}, 0.7, -3.0, frozenset({"bad", "vile*"}))
    cases = {"Bad bad": -3 + 2 + 0.7 * math.log(2), "vilest BAD kind": -3 + 2 + 1.5 - 1 + 0.7 * math.log(3), "vile": -3.0, "": -3.0}
    for text, odds in cases.items():
        assert abs(model.score(text) - 1 / (1 + math.exp(-odds))) < 1e-12
    tie = Toxicity({"even": 3.0}, 0.0, -3.0)
    docs = spark.createDataFrame([(1, "even"), (2, "odd"), (3, "even")], "doc_id long, text string")
    assert {r.doc_id: (r.score, r.predicted) for r in toxicity_scores(docs, tie).collect()}[1] == (0.5, 1)
    assert [r.doc_id for r in toxicity_filter(docs, tie).collect()] == [2]


def test_correlated_voters_share_their_evidence():
    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.3).astype(int)
    a = (rng.random(2000) < np.where(y, 0.6, 0.1)).astype(float)
    b = (rng.random(2000) < np.where(y, 0.6, 0.1)).astype(float)
    post, rates, _, share = label_model(np.column_stack((a, a, a, b)), np.ones(4, bool), y, 0.3)
    assert share[0] < 0.4 and share[3] > 0.9
    assert abs(rates[0, 3] - 0.6) < 0.08 and abs(rates[1, 3] - 0.1) < 0.05
    w = fit_linear(np.column_stack((a, b)).astype(np.uint8), np.zeros((2000, 0)), post)
    assert w[0] > 0 and w[1] > 0 and w[2] < 0
