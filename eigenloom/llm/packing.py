"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.llm._common import map_arrow
from eigenloom.llm.bpe import worker_encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def capacities(total: int, max_len: int) -> list[int]:
    """Room of the sequences that hold `total` tokens exactly: full ones, then powers of two for the rest."""
    rest = total % max_len
    return [max_len] * (total // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], max_len: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """Place items by descending length, each into the sequence of lowest cost that has room for it.

    A piece of n tokens costs linear * n + quadratic * n * n. What fits nowhere is cut: its head fills the
    sequence with most room (of equals, the cheapest) and its rest is placed in turn. The sequences' room is
    the items' total, so none is left. Returns (item, start in the item, length, sequence), by sequence then
    order of placing.
    """
    room = np.array(capacities(sum(lengths), max_len), np.int64)
    cost, placed = np.zeros(len(room)), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = room >= left
            if fits.any():
                at = int(np.argmin(np.where(fits, cost, np.inf)))
            else:
                at = int(np.argmin(np.where(room == room.max(), cost, np.inf)))
            n = min(left, int(room[at]))
            placed.append((item, start, n, at))
            room[at] -= n
            cost[at] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return sorted(placed, key=lambda p: p[3])


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, window_docs: int = 8192, window_tokens: int = 4_000_000) -> DataFrame:
    """Encode documents (doc_id, text), append `end_id`, and pack every id into sequences of `max_len`.

    Each task packs its own rows, so nothing is shuffled and no key can be hot. A document's leading runs of
    `max_len` ids are sequences by themselves; its rest waits in a window of at most `window_docs` documents or
    `window_tokens` ids, which `assign` then packs. A window's last ids form sequences of power-of-two lengths,
    so none needs padding. Sequence ids are (task << 33) + count: unique, and the same if a task runs again.

    Returns SCHEMA; `ids` holds little-endian 32-bit integers. Null and empty texts are one end id. Repeated
    rows and equal doc_ids are packed each on its own; a null doc_id stays null. An empty table gives no rows.
    Columns other than doc_id and text are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(source.value), struct.pack("<I", end_id)
        base, count = TaskContext.get().partitionId() << 33, 0
        out: list[tuple] = []
        window: list[tuple[int | None, int, int, bytes]] = []
        held = 0

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count, held
            last, offset, used = -1, 0, 0
            for item, start, n, at in assign([len(w[3]) // 4 for w in window], max_len, linear, quadratic):
                doc, before, total, ids = window[item]
                offset = 0 if at != last else offset
                last, used = at, at + 1
                out.append((doc, before + start, n, total, base + count + at, offset, ids[4 * start : 4 * (start + n)]))
                offset += n
                if len(out) >= 4096:
                    yield emit()
            count, held = count + used, 0
            window.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                total = len(ids) // 4
                full = total // max_len * max_len
                for start in range(0, full, max_len):
                    out.append((doc, start, max_len, total, base + count, 0, ids[4 * start : 4 * (start + max_len)]))
                    count += 1
                if len(out) >= 4096:
                    yield emit()
                if full < total:
                    window.append((doc, full, total, ids[4 * full :]))
                    held += total - full
                if len(window) >= window_docs or held >= window_tokens:
                    yield from flush()
        yield from flush()
        if out:
            yield emit()

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)
