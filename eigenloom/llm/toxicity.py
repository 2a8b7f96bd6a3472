"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.llm._common import drop_stash, map_arrow, stash
from eigenloom.llm.scoring import fold_of

LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are pattern voters.
STEMS = range(4, 8)
FOLDS, HELD_FOLD = 5, 0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def voters_of(word: str) -> list[str]:
    """The lexicon voter of a word, and the pattern voters of its beginnings."""
    return [word, *(f"{word[:n]}*" for n in STEMS if n < len(word))]


def terms(text: str | None) -> set[str]:
    """Every voter that a text could fire."""
    return set(chain.from_iterable(map(voters_of, set(LETTERS.findall(text.lower()))))) if text else set()


def _slices(n: int) -> list[slice]:
    return [slice(a, a + 1024) for a in range(0, n, 1024)]


def _of_columns(weight: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """weight @ votes for votes of one byte each, a thousand rows at a time."""
    return sum((weight[..., s] @ votes[s].astype(float) for s in _slices(len(votes))), np.zeros((*weight.shape[:-1], votes.shape[1])))


def _of_rows(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """votes @ weight, likewise."""
    return np.concatenate([np.zeros(0), *(votes[s].astype(float) @ weight for s in _slices(len(votes)))])


def label_model(votes: np.ndarray, toxic: np.ndarray, labels: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, voters' and the labels' rates of firing on toxic and clean rows, and shares of evidence.

    `votes` (rows x voters) says which voters fire, `toxic` which of them vote for toxic (the others vote for
    clean). The labels are one more voter, which votes for either side. The first posteriors are the voters'
    agreement alone: the balance of all votes, with the prior's odds where none is for toxic on balance. Then
    the labels' two rates are estimated like the others'. From the posteriors come the rates; the pairwise correlations of
    voters within the classes (of what the rates leave unexplained), shrunk by a tenth, negative ones (which the posteriors bring about) to none; and each
    voter's share of evidence, the solution of correlations x shares = 1, so that k copies of a voter count as
    one. Shares stay between 0 and 1. Rounds end when no posterior moves by 1e-4.
    """
    n, m = votes.shape
    base = float(np.log(prior / (1 - prior)))
    votes = votes.astype(np.uint8)
    together = sum((votes[s].T.astype(float) @ votes[s].astype(float) for s in _slices(n)), np.zeros((m, m)))
    balance = _of_rows(votes, np.where(toxic, 1.0, -1.0)) + np.where(labels == 1, 1.0, -1.0)
    post = 1 / (1 + np.exp(-np.clip(np.where(balance > 0, 2 * balance, base + 2 * balance), -30, 30)))
    rates, held, share = np.zeros((2, m)), np.zeros(2), np.ones(m)
    for _ in range(rounds):
        weight = np.stack((post, 1 - post))
        mass = weight.sum(axis=1)
        fired = _of_columns(weight, votes)
        rates = (fired + 0.5) / (mass[:, None] + 1)
        held = (weight @ (labels == 1) + 0.5) / (mass + 1)
        # products of what is left of the votes without the expected ones, weight.T @ rates
        cross = fired.T @ rates
        tied = together - cross - cross.T + rates.T @ (weight @ weight.T) @ rates
        spread = np.sqrt(np.maximum(0, tied.diagonal())) + 1e-9
        tied = 0.9 * np.maximum(0, tied / spread[:, None] / spread)
        np.fill_diagonal(tied, 1)
        share = np.clip(np.linalg.solve(tied, np.ones(m)), 0, 1) if m else share
        fired, silent = np.log(rates[0] / rates[1]), np.log((1 - rates[0]) / (1 - rates[1]))
        odds = np.log(mass[0] / mass[1]) + _of_rows(votes, share * (fired - silent)) + (share * silent).sum()
        odds += np.where(labels == 1, np.log(held[0] / held[1]), np.log((1 - held[0]) / (1 - held[1])))
        before, post = post, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(post - before).max(initial=0) < 1e-4:
            break
    return post, rates, held, share


def fit_linear(votes: np.ndarray, dense: np.ndarray, target: np.ndarray, ridge: float = 2.0, rounds: int = 12) -> np.ndarray:
    """Logistic regression of soft targets on votes (one byte each) and dense columns, by Newton steps.

    The last weight is the intercept, which is not shrunk. A thousand rows are taken at a time, so memory is that
    of the votes and a matrix of the voters' number squared.
    """
    rows_of = lambda s: np.column_stack((votes[s].astype(float), dense[s], np.ones(len(target[s]))))
    size = votes.shape[1] + dense.shape[1] + 1
    w, shrink = np.zeros(size), np.full(size, ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        curve, slope = np.diag(shrink), -shrink * w
        for s in _slices(len(target)):
            x = rows_of(s)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve += (x * (p * (1 - p) + 1e-6)[:, None]).T @ x
            slope += x.T @ (target[s] - p)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


class Toxicity:
    """The fitted classifier: voters' weights, the weight of how many vote for toxic, and the intercept."""

    bound = 200_000  # words whose voters a worker keeps

    def __init__(self, weights: dict[str, float], count_weight: float, intercept: float, toxic: frozenset[str] = frozenset()):
        self.weights, self.count_weight, self.intercept, self.toxic = weights, count_weight, intercept, toxic
        self.memo: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        fired: set[str] = set()
        if text:
            memo, weights = self.memo, self.weights
            for word in set(LETTERS.findall(text.lower())):
                found = memo.get(word)
                if found is None:
                    if len(memo) >= self.bound:
                        memo.clear()
                    found = memo[word] = tuple(v for v in voters_of(word) if v in weights)
                if found:
                    fired.update(found)
        odds = self.intercept + sum(self.weights[v] for v in sorted(fired)) + self.count_weight * np.log1p(len(fired & self.toxic))
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))


def evidence(fired: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Likelihood-ratio statistic (G) of each term: does it fire alike in clean and toxic rows? `fired` is 2 x terms."""
    table = np.stack((fired, rows[:, None] - fired))  # fires or not, by clean and toxic, by term
    expected = table.sum(axis=1, keepdims=True) * rows[None, :, None] / max(1.0, rows.sum())
    return 2 * np.where(table > 0, table * np.log(np.maximum(table, 1e-300) / np.maximum(expected, 1e-300)), 0).sum(axis=(0, 1))


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 10_000, least_rows: int = 3, least_ratio: float = 4.0, chance: float = 0.05, least_right: float = 0.6) -> Toxicity:
    """Fit on about `fit_rows` labelled documents, the documented bound; all are used if there are no more.

    `labels` has doc_id and toxic (0 or 1; nulls are left out, of several labels the highest counts). Rows of
    the held-out fold, crc32(doc_id as text) modulo 5 = 0, are never read for labels. The sample is drawn by a
    hash of doc_id. Every term in at least `least_rows` sampled texts is tried. It becomes a voter if it is at
    least `least_ratio` times likelier in one class than in the other, and more so than chance would have any
    of the terms tried (G over the chi-square bound of chance / terms), and if at least `least_right` of the texts
    it fires on are of its class: a voter for toxic or for clean. There is
    no cap on voters; what bounds them is the sample. The label model then estimates their rates and
    correlations, with the labels as one more voter, and a linear classifier is trained on its posteriors.
    Without toxic labels every score is the prior, and 0 without any labels.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(fold_of(F.col("doc_id"), FOLDS) != HELD_FOLD)
    total = known.count()
    if not total:
        return Toxicity({}, 0.0, -500.0)
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(total)) < fit_rows)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    sample = stash(chosen.select("doc_id", "text", "toxic"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def sent() -> Iterator[pa.RecordBatch]:
            for toxic, own in enumerate(found):
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(own), pa.int64()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["toxic", "term", "n"])
                own.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found[int(toxic == 1)].update(terms(text))
                found[int(toxic == 1)][""] += 1  # no term: it counts texts
            if sum(map(len, found)) > 500_000:
                yield from sent()
        yield from sent()

    by = F.col("toxic") == 1
    often = map_arrow(sample, count, "toxic long, term string, n long").groupBy("term").agg(F.sum(F.when(~by, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(by, F.col("n")).otherwise(0)).alias("toxic"))
    often = stash(often.where(F.col("clean") + F.col("toxic") >= least_rows), "toxicity-terms")
    rows_of = np.zeros(2)
    for r in often.where("term = ''").collect():
        rows_of = np.array([r.clean, r.toxic], float)
    tried = often.count()
    # what cannot reach the ratio in either class stays on the executors
    likelier = (F.col("toxic") + 0.5) * (rows_of[0] + 1) / ((F.col("clean") + 0.5) * (rows_of[1] + 1))
    pool = sorted((r.term, r.clean, r.toxic) for r in often.where("term <> ''").where((likelier >= least_ratio) | (likelier <= 1 / least_ratio)).collect())
    drop_stash(often)
    seen = np.array([[c, t] for _, c, t in pool], float).reshape(-1, 2).T
    well, sick = rows_of
    prior = float(np.log((sick + 0.5) / (well + 0.5)))
    # a chi-square of one degree is over x with a chance of at most exp(-x / 2)
    telling = evidence(seen, rows_of) > 2 * np.log(max(1, tried) / chance) if sick else np.zeros(len(pool), bool)
    for_toxic = (seen[1] + 0.5) * (well + 1) > (seen[0] + 0.5) * (sick + 1)
    telling &= np.where(for_toxic, seen[1], seen[0]) >= least_right * seen.sum(axis=0)
    voters = np.flatnonzero(telling).tolist()
    if not voters:
        drop_stash(sample)
        return Toxicity({}, 0.0, prior)
    column = spark.sparkContext.broadcast({pool[v][0]: k for k, v in enumerate(voters)})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted(column.value[t] for t in terms(x) & column.value.keys()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hits, pa.list_(pa.int32()))], ["doc_id", "toxic", "hits"])

    rows = sorted(map_arrow(sample, mark, "doc_id long, toxic int, hits array<int>").collect(), key=lambda r: (r.doc_id, r.hits))
    drop_stash(sample)
    y = np.array([r.toxic for r in rows], np.int64)
    votes = np.zeros((len(rows), len(voters)), np.uint8)
    for i, r in enumerate(rows):
        votes[i, r.hits] = 1
    toxic = for_toxic[voters]
    post, _, _, _ = label_model(votes, toxic, y, (sick + 0.5) / (sick + well + 1))
    w = fit_linear(votes, np.log1p(_of_rows(votes, toxic.astype(float)))[:, None], post)
    return Toxicity({pool[v][0]: float(w[k]) for k, v in enumerate(voters)}, float(w[-2]), float(w[-1]), frozenset(pool[v][0] for v, t in zip(voters, toxic, strict=True) if t))


def toxicity_scores(docs: DataFrame, model: Toxicity) -> DataFrame:
    """Score of each document (doc_id, text) over its whole text; only the text is an input of the score.

    Null and empty texts fire no voter and get the intercept's score. Repeated rows are scored each; a null
    doc_id counts as empty text for the fold. An empty table gives no rows. Other columns are not read.
    Returns doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            scores = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            held = [zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_FOLD for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def toxicity_filter(docs: DataFrame, model: Toxicity) -> DataFrame:
    """The rows whose text is not predicted toxic, with all their columns, whatever they are named besides `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
