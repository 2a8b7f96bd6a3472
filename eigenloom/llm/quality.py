"""Quality rules: base measures and a hashed n-gram log-likelihood ratio, length-normalised and thresholded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from eigenloom.llm._common import drop_stash, map_arrow, stash

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class _Hashes(dict):
    """Hash of each word; starts afresh when it holds `bound` words."""

    bound = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        self[word] = found = xxh64_intdigest(word, 0)
        return found


_hashes = _Hashes()


def word_hashes(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """UTF-8 of each text, the hashes of all their words in order, and where each text's words end."""
    raw, lists = [], []
    for t in texts:
        raw.append((t or "").encode())
        lists.append(raw[-1].split())
    ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))) if lists else np.zeros(0, np.int64)
    hashes = np.fromiter((h for words in lists for h in map(_hashes.__getitem__, words)), np.uint64, int(ends[-1]) if len(ends) else 0)
    return raw, hashes, ends


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each text's values."""
    run = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return run[ends] - run[np.concatenate((np.zeros(1, np.int64), ends[:-1]))]


def buckets(hashes: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of each pair of neighbouring words, and which pairs lie within one text."""
    ones = (hashes % np.uint64(size)).astype(np.int64)
    if len(hashes) < 2:
        return ones, np.zeros(0, np.int64), np.zeros(0, bool)
    mixed = ((hashes[:-1] * _ODD) ^ hashes[1:]) * _MIX >> np.uint64(20)
    within = np.ones(len(hashes) - 1, bool)
    within[ends[(ends > 0) & (ends < len(hashes))] - 1] = False
    return ones, (mixed % np.uint64(size)).astype(np.int64), within


def repeated_words(hashes: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of words found twice or more in that text."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(len(ends), np.int64)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * _ODD + hashes[k : k + n]
    text_of = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    whole = text_of[:n] == text_of[window - 1 :]
    rolled = (rolled ^ (text_of[:n].astype(np.uint64) * _MIX)) * _MIX
    rolled ^= rolled >> np.uint64(29)
    ordered = np.sort(rolled[whole])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(ends), np.int64)
    at = np.minimum(np.searchsorted(twice, rolled), len(twice) - 1)
    hit = np.flatnonzero((twice[at] == rolled) & whole)
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + window, -1)
    return sums((np.cumsum(steps)[:-1] > 0).astype(np.int64), ends)


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def word_chars(text: str | None) -> int:
    return len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")) if text else 0


def ngram_counts(docs: DataFrame, trusted: DataFrame, size: int, broadcast_ids: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed words and word pairs over all documents, and over those whose doc_id `trusted` lists.

    Up to `broadcast_ids` trusted ids, which are counted first, are sent to the tasks (some tens of megabytes),
    so no text is shuffled; more are joined by a merge. The counts are the same either way.
    """
    marks = stash(trusted.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted")).where("doc_id is not null").distinct(), "trusted-ids")
    few = marks.count() <= broadcast_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(marks.hint("broadcast" if few else "merge"), "doc_id", "left").select("text", "trusted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            marked = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            _, hashes, ends = word_hashes(batch.column(0).to_pylist())
            if not len(hashes):
                continue
            ones, pairs, within = buckets(hashes, ends, size)
            chosen = np.repeat(marked, np.diff(np.concatenate(([0], ends))))
            for at, mask in ((0, None), (1, chosen)):
                total[at] += np.bincount(ones if mask is None else ones[mask], minlength=size)
                total[at] += np.bincount(pairs[within if mask is None else within & mask[:-1]], minlength=size)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["bucket", "raw", "target"])

    counted = map_arrow(rows, run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(size), np.zeros(size)
    for r in counted.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    drop_stash(marks)
    return raw, target


def ratios(raw: np.ndarray, target: np.ndarray, smoothing: float) -> np.ndarray:
    """Log ratio of each bucket's probability under the trusted and the raw multinomial, each smoothed alike."""
    share = lambda c: np.log((c + smoothing) / (c.sum() + smoothing * len(c)))
    return share(target) - share(raw)


class Rules:
    """Measures and verdicts of texts, given the buckets' log ratios."""

    def __init__(self, weights: np.ndarray, threshold: float):
        self.weights, self.threshold = weights, threshold

    def __call__(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        raw, hashes, ends = word_hashes(texts)
        n_words = np.diff(np.concatenate(([0], ends)))
        ones, pairs, within = buckets(hashes, ends, len(self.weights))
        gain = self.weights[ones] if len(ones) else np.zeros(0)
        gain[: len(pairs)] += np.where(within, self.weights[pairs], 0.0)
        llr = sums(gain, ends) / np.maximum(1, 2 * n_words - 1)
        repeats = repeated_words(hashes, ends)
        failed = (n_words < 20) | (100 * repeats > 30 * n_words)
        return {
            "n_words": n_words,
            "word_chars": np.fromiter(map(word_chars, texts), np.int64, len(texts)),
            "n_symbols": np.fromiter((len(b) - len(b.translate(None, SYMBOLS)) for b in raw), np.int64, len(texts)),
            "n_dup_lines": np.fromiter(map(duplicate_lines, raw), np.int64, len(texts)),
            "n_repeat_words": repeats,
            "base_failed": failed,
            "llr": llr,
            "kept": ~failed & (llr >= self.threshold),
        }


def fit_rules(docs: DataFrame, trusted: DataFrame, size: int = 10_000, smoothing: float = 20.0, threshold: float = -0.08) -> Rules:
    """Count n-grams over every document and every trusted one; weights are `size` numbers at any input size.

    With no trusted document the two multinomials are set equal, so only the base rules reject.
    """
    raw, target = ngram_counts(docs, trusted, size)
    return Rules(ratios(raw, target if target.sum() else raw, smoothing), threshold)


def quality_scores(docs: DataFrame, rules: Rules) -> DataFrame:
    """Measures and verdict of each document (doc_id, text), whole texts.

    Words are runs without ASCII white space. llr is the mean log ratio of a text's words and word pairs, 0
    without words; a document is kept if it passes the base rules and llr is at least the threshold. Null and
    empty texts have no words and fail. Repeated rows and null doc_ids are measured like others. An empty table
    gives no rows. Other columns are not read. Returns SCHEMA.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], ["doc_id", *found])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def quality_filter(docs: DataFrame, rules: Rules) -> DataFrame:
    """The rows whose text is kept, with all their columns, whatever they are named besides `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value(batch.column(at).to_pylist())["kept"]))

    return map_arrow(docs, run, docs.schema)
