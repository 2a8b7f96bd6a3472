"""Language-model scores: prediction by partial matching over bytes, beside a smoothed unigram base."""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenloom.llm._common import drop_stash, map_arrow, settled, stash

#: Bytes that no UTF-8 text holds: what stands before a text, and its end.
BEFORE, END = 0xFE, 0xFF
#: Bytes of text whose distinct grams and words are sent together.
PIECE = 16 << 20
#: Grams whose look-up is done at once.
CHUNK = 1 << 20
#: Levels up to this one are sent to all tasks: at most 2**24 grams of three bytes, however large the corpus.
NEAR = 2


def streams(raw: list[bytes], order: int) -> np.ndarray:
    """Each text after `order` BEFORE bytes and followed by END, one after the other."""
    lead, tail = bytes([BEFORE]) * order, bytes([END])
    return np.frombuffer(b"".join(x for r in raw for x in (lead, r, tail)), np.uint8)


def grams(stream: np.ndarray, order: int) -> np.ndarray:
    """Every predicted byte with the `order` bytes before it, seven at most, as one number."""
    n = len(stream) - order
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate((stream, np.zeros(8, np.uint8)))
    eights = np.ndarray((n,), ">u8", padded, strides=(1,))
    return eights[stream[order:] != BEFORE].astype(np.uint64) >> np.uint64(8 * (7 - order))


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their counts (one each by default)."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def shard_of(gram: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a gram, from the three bytes before its last: all its contexts of three bytes or more are there."""
    mixed = (gram >> np.uint64(8) & np.uint64(0xFFFFFF)) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)
    return (mixed >> np.uint64(12)) % np.uint64(shards)


def squeezed(data: bytes) -> bytes:
    """Bytes behind their number, compressed."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def planes(values: np.ndarray, kind: str = "<u8") -> bytes:
    """Numbers by their byte planes."""
    values = values.astype(kind)
    return squeezed(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def from_planes(data: bytes, kind: str = "<u8") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(unsqueezed(data), np.uint8).reshape(width, -1).T).view(kind)[:, 0]


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The shards of ascending keys, and where each one's keys lie, in ascending order."""
    of = shard_of(keys, shards).astype(np.int64)
    by = np.argsort(of, kind="stable")
    ids, first = np.unique(of[by], return_index=True)
    return ids, np.split(by, first[1:]) if len(ids) else []


def distinct(raw: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of texts and how often each occurs, gathered a few million at a time."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = 0
    while at < len(raw):
        part, size = [raw[at]], len(raw[at])
        while at + len(part) < len(raw) and size < 4 * CHUNK:
            part.append(raw[at + len(part)])
            size += len(part[-1])
        at += len(part)
        k, n = tally(grams(streams(part, order), order))
        keys, counts = tally(np.concatenate((keys, k)), np.concatenate((counts, n)))
    return keys, counts


class Places:
    """Where asked keys lie among distinct keys, by two tables of hashed places; what both lack is searched for."""

    MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.tables = [np.zeros(1 << bits, np.int32) for _ in self.MIX]
        for mix, table in zip(self.MIX, self.tables, strict=True):
            table[keys * mix >> self.shift] = np.arange(len(keys), dtype=np.int32)

    def of(self, asked: np.ndarray) -> np.ndarray:
        """The place of each asked key, all of which are among the keys."""
        out = self.tables[0][asked * self.MIX[0] >> self.shift]
        left = np.flatnonzero(self.keys[out] != asked)
        out[left] = self.tables[1][asked[left] * self.MIX[1] >> self.shift]
        left = left[self.keys[out[left]] != asked[left]]
        out[left] = np.searchsorted(self.keys, asked[left])
        return out


def looked_up(raw: list[bytes], order: int, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Sum of each text's grams' values, which `logs` has for the ascending `keys`."""
    out, places = np.zeros(len(raw)), Places(keys)
    at = 0
    while at < len(raw):
        part, size = [raw[at]], len(raw[at])
        while at + len(part) < len(raw) and size < CHUNK:
            part.append(raw[at + len(part)])
            size += len(part[-1])
        asked = grams(streams(part, order), order)
        text_of = np.repeat(np.arange(len(part)), [len(r) + 1 for r in part])
        for a in range(0, len(asked), CHUNK):
            out[at : at + len(part)] += np.bincount(text_of[a : a + CHUNK], logs[places.of(asked[a : a + CHUNK])], minlength=len(part))
        at += len(part)
    return out


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of texts, A-Z lower-cased: each word's number and its text's, and the distinct words by number."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, text_of = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    words = flat.filter(full).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False), text_of.filter(full).to_numpy(), words.dictionary.cast(pa.large_binary())


def words_by_shard(words: pa.Array, shards: int) -> list[tuple[int, np.ndarray, bytes]]:
    """Each shard that distinct words fall to, the places of its words in ascending order of these, and them packed."""
    order, plain = pc.array_sort_indices(words).to_numpy(), words.to_pylist()
    of = np.fromiter(map(zlib.crc32, plain), np.uint32, len(plain))[order] % shards
    by = np.argsort(of, kind="stable")
    ids, first = np.unique(of[by], return_index=True)
    groups = np.split(order[by], first[1:]) if len(ids) else []
    return [(int(s), at, squeezed(b" ".join([plain[i] for i in at.tolist()]))) for s, at in zip(ids, groups, strict=True)]


def words_of(blob: bytes, n: int) -> list[bytes]:
    """The `n` words, free of white space, that were joined by it."""
    return unsqueezed(blob).split(b" ") if n else []


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """A task's rows (doc_id, text) in runs of about `size` bytes: the run's number, ids and texts; null texts are empty."""
    number, held, waiting = TaskContext.get().partitionId() << 33, 0, []
    for batch in batches:
        text = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        reached = np.cumsum(pc.binary_length(text).to_numpy()) + held
        at = 0
        while at < len(text):
            n = int(np.searchsorted(reached[at:], size)) + 1
            part = slice(at, at + n)
            waiting.append((batch.column(0)[part], text[part]))
            at = min(at + n, len(text))
            if reached[at - 1] >= size:
                yield number, *map(pa.concat_arrays, zip(*waiting, strict=True))
                reached = reached - reached[at - 1]
                number, waiting = number + 1, []
        held = int(reached[-1]) if len(text) else held
    if waiting:
        yield number, *map(pa.concat_arrays, zip(*waiting, strict=True))


def with_end(words: pa.Array) -> pa.Array:
    """The words and, last, the empty word, which stands for a text's end."""
    return pa.concat_arrays([words, pa.array([b""], pa.large_binary())])


def plain_bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.large_binary()).to_pylist()


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's text, modulo the folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


class Level:
    """Contexts of one length: all their predictions, and their known symbols, those counted `least` times or more."""

    def __init__(self, length: int, keys: np.ndarray, counts: np.ndarray, least: float, shorter: Level | None):
        mask = np.uint64((1 << 8 * (length + 1)) - 1)
        grams_, n = tally(keys & mask, counts)
        held = n >= least
        self.grams, self.n = grams_[held], n[held]
        self.contexts = np.unique(self.grams >> np.uint64(8))
        size = len(self.contexts)
        node = np.searchsorted(self.contexts, self.grams >> np.uint64(8))
        sums = lambda at, x=None: np.bincount(at, x, minlength=size).astype(float)
        self.kinds, self.known = sums(node), sums(node, self.n)
        at, found = self._find(self.contexts, grams_ >> np.uint64(8))
        self.total = sums(at[found], n[found]) if length else self.known
        self.gone = np.zeros(size)  # what a context excludes from its suffix
        if shorter is not None and len(self.grams):
            at, _ = self._find(shorter.grams, self.grams & mask >> np.uint64(8))
            self.gone = sums(node, shorter.n[at])
        self.mask = mask

    @staticmethod
    def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return at, keys[at] == asked


def levels_of(keys: np.ndarray, counts: np.ndarray, least: float, lengths: range, below: list[Level]) -> list[Level]:
    """`below`, and a level for each further length from the counts of grams at least as long."""
    out = list(below)
    for j in lengths:
        out.append(Level(j, keys, counts, least, out[-1] if out else None))
    return out


def chances(levels: list[Level], asked: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's last byte after the others.

    In a context with `total` predictions and `kinds` known symbols, a known symbol has (count - 1/2) / total, and
    the halves, kinds / (2 total), escape to the context without its first byte, where the symbols known above are
    excluded; past the empty context all bytes that are still open are equally likely. What exclusion takes from a
    suffix depends on the context above alone, so it is summed beforehand.
    """
    out = np.zeros(len(asked))
    open_, above = np.arange(len(asked)), np.full(len(asked), -1)
    for j in range(len(levels) - 1, -1, -1):
        level, g = levels[j], asked[open_] & levels[j].mask
        node, there = level._find(level.contexts, g >> np.uint64(8))
        at, hit = level._find(level.grams, g)
        if there.any():
            c, up = node[there], above[there]
            longer = levels[j + 1] if j + 1 < len(levels) else None
            less, kinds = (np.where(up >= 0, x[up], 0.0) if longer is not None and len(x) else np.zeros(len(up)) for x in ((longer.gone, longer.kinds) if longer else (np.zeros(0), np.zeros(0))))
            size = level.total[c] - less
            left = level.total[c] - level.known[c] + (level.kinds[c] - kinds) / 2
            share = np.where(hit[there], level.n[at[there]] - 0.5, left)
            out[open_[there]] += np.where(size > 0, np.log10(np.maximum(share, 1e-300)) - np.log10(np.maximum(size, 1e-300)), 0.0)
        above = np.where(there, node, -1)[~hit]
        open_ = open_[~hit]
    out[open_] -= math.log10(max(1, 256 - len(levels[0].grams)))
    return out


_near: dict[str, list[Level]] = {}

MESSAGE = "piece long, shard int, grams binary, counts binary, words binary, word_counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def lm_scores(docs: DataFrame, order: int = 6, held_fold: int = 1, folds: int = 5, piece_bytes: int = PIECE) -> DataFrame:
    """Score each document (doc_id, text) by contexts of bytes and a unigram base, both learned from the other folds.

    Training documents are those whose crc32(doc_id as text) modulo `folds` is not `held_fold`; every one of
    them is counted whole, and every gram and word of theirs is in the model, at every size. Texts are read in
    pieces of `piece_bytes`. A piece sends each shard its distinct grams and words with their counts in its
    training texts, zero included: that is its share of the counts and its question at once. Grams are sharded
    by the three bytes before the predicted one, so a shard holds the trie below these; it adds up the counts
    and answers each piece. The first levels, grams of up to three bytes, are sent to all tasks. A piece's
    answers then meet its texts, which travel once. Rows must lie in the same partitions when they are read
    again, so whatever is not a mere scan is written first; an answer that does not fit its question is an error.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are words (runs
    without ASCII white space, A-Z lower-cased) and one end. score is the model's log10 probability of the
    text's bytes and its end. Null texts count as empty; they and empty ones have the end alone. Repeated rows
    are counted and scored each; a null doc_id counts as empty text for the fold. Without training documents
    train_tokens and n_known are 0, every base probability is 1 and every byte has probability 1/256. An empty
    table gives no rows. Other columns are not read.
    """
    rows = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    spark = docs.sparkSession
    shards = max(64, rows.rdd.getNumPartitions() // 4)
    short = np.uint64((1 << 8 * (min(order, NEAR) + 1)) - 1)

    def trained(ids: pa.Array) -> np.ndarray:
        return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds != held_fold for i in ids.to_pylist()], bool)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = 0
        for _, ids, texts in pieces(batches, piece_bytes):
            texts = texts.filter(pa.array(trained(ids)))
            if not len(texts):
                continue
            codes, _, words = words_in(texts)
            total += len(codes) + len(texts)
            for s, at, packed_words in words_by_shard(with_end(words), shards):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "words": pa.array([packed_words]), "gram": pa.nulls(1, pa.int64()), "n": [len(at)]})
            k, c = distinct(plain_bytes(texts), min(order, NEAR))
            keys, n = tally(np.concatenate((keys, k & short)), np.concatenate((n, c)))
        if len(keys):
            m = len(keys) + 1  # the last row is the number of tokens
            yield pa.RecordBatch.from_pydict({"shard": pa.nulls(m, pa.int32()), "words": pa.nulls(m, pa.binary()), "gram": pa.array([*keys.astype(np.int64).tolist(), -1]), "n": pa.array([*n.tolist(), total])})

    def size_up(t: pa.Table) -> pa.Table:
        words: set[bytes] = set()
        for w, n in zip(t["words"].to_pylist(), t["n"].to_pylist(), strict=True):
            words.update(words_of(w, n))
        return pa.table({"kinds": pa.array([len(words)], pa.int64())})

    found = stash(map_arrow(rows, survey, "shard int, words binary, gram long, n long"), "lm-survey")
    sums = found.where("shard is not null").select("shard", "words", "n").groupBy("shard").applyInArrow(size_up, "kinds long")
    kinds = sums.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    near = found.where("shard is null").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    drop_stash(found)
    near = {g: n for g, n in zip(near["gram"].to_pylist(), near["n"].to_pylist(), strict=True)}
    total = near.pop(-1, 0)
    model = spark.sparkContext.broadcast((np.array(list(near), np.uint64), np.array(list(near.values()), np.int64)))
    size, name = total + 0.5 * (kinds + 1), uuid.uuid4().hex

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, ids, texts in pieces(batches, piece_bytes):
            use = trained(ids)
            raw = plain_bytes(texts)
            (keys, n), (other, _) = (distinct([r for r, x in zip(raw, use, strict=True) if x is want], order) for want in (np.True_, np.False_))
            keys, n = tally(np.concatenate((keys, other)), np.concatenate((n, np.zeros(len(other), np.int64))))
            codes, text_of, words = words_in(texts)
            words = with_end(words)
            counts = np.append(np.bincount(codes[use[text_of]], minlength=len(words) - 1), use.sum())
            by_word = {s: (at, packed_words) for s, at, packed_words in words_by_shard(words, shards)}
            by_gram = dict(zip(*by_shard(keys, shards), strict=True))
            none = np.zeros(0, np.int64)
            for s in sorted(by_word.keys() | by_gram.keys()):
                at, (of, w) = by_gram.get(s, none), by_word.get(s, (none, squeezed(b"")))
                yield pa.RecordBatch.from_pydict({"piece": [piece], "shard": pa.array([s], pa.int32()), "grams": [packed(keys[at])], "counts": [planes(n[at])], "words": [w], "word_counts": [planes(counts[of])]})

    def answer(t: pa.Table) -> pa.Table:
        if name not in _near:
            _near.clear()
            _near[name] = levels_of(*model.value, 1, range(min(order, NEAR) + 1), [])
        none = np.zeros(0, np.uint64)
        keys = np.concatenate([none, *map(unpacked, t["grams"].to_pylist())])
        n = np.concatenate([none, *map(from_planes, t["counts"].to_pylist())]).astype(np.int64)
        keys, n = tally(keys[n > 0], n[n > 0])
        levels = levels_of(keys, n, 1, range(NEAR + 1, order + 1), _near[name])
        known: defaultdict[bytes, int] = defaultdict(int)
        for w, c in zip(t["words"].to_pylist(), t["word_counts"].to_pylist(), strict=True):
            c = from_planes(c)
            for x, n in zip(words_of(w, len(c)), c.tolist(), strict=True):
                known[x] += n
        logs, counts = [], []
        for g, w, c in zip(t["grams"].to_pylist(), t["words"].to_pylist(), t["word_counts"].to_pylist(), strict=True):
            logs.append(planes(chances(levels, unpacked(g)), "<f4"))
            counts.append(planes(np.array([known[x] for x in words_of(w, len(from_planes(c)))], np.int64)))
        return pa.table({"piece": t["piece"], "shard": t["shard"], "logs": pa.array(logs, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, ids, texts in pieces(batches, piece_bytes):
            buffer = pa.BufferOutputStream()
            table = pa.table({"doc_id": ids, "text": texts})
            with pa.ipc.new_stream(buffer, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_pydict({"piece": [piece], "data": pa.array([buffer.getvalue().to_pybytes()], pa.binary())})

    def add_up(piece: pa.Table, answers: pa.Table) -> pa.Table:
        table = pa.ipc.open_stream(piece["data"][0].as_py()).read_all().combine_chunks()
        ids, texts = table["doc_id"], pa.concat_arrays(table["text"].chunks)
        raw = plain_bytes(texts)
        keys, _ = distinct(raw, order)
        given = {s: (a, c) for s, a, c in zip(answers["shard"].to_pylist(), answers["logs"].to_pylist(), answers["counts"].to_pylist(), strict=True)}
        logs = np.zeros(len(keys))
        for s, at in zip(*by_shard(keys, shards), strict=True):
            logs[at] = from_planes(given[s][0], "<f4")  # of another length only if the texts are not those asked for
        codes, text_of, words = words_in(texts)
        words = with_end(words)
        count = np.zeros(len(words), np.int64)
        for s, at, _ in words_by_shard(words, shards):
            count[at] = from_planes(given[s][1], "<i8")
        gain, n = np.log10((count + 0.5) / size), len(texts)
        return pa.table(
            {
                "doc_id": ids,
                "held_out": pa.array(~trained(ids)),
                "n_tokens": pa.array(np.bincount(text_of, minlength=n) + 1),
                "n_known": pa.array(np.bincount(text_of, count[codes] > 0, minlength=n).astype(np.int64) + int(count[-1] > 0)),
                "base_score": pa.array(np.bincount(text_of, gain[codes], minlength=n) + gain[-1]),
                "score": pa.array(looked_up(raw, order, keys, logs), pa.float64()),
            }
        )

    asked = map_arrow(rows, ask, MESSAGE)
    answers = asked.groupBy("shard").applyInArrow(answer, "piece long, shard int, logs binary, counts binary")
    texts = map_arrow(rows, sent, "piece long, data binary")
    scored = texts.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(add_up, SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
