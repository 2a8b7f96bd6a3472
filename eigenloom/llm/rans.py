"""Token ids in files coded by a static range asymmetric numeral system.

A file set is a Parquet table whose rows are segments, so that Spark commits and reads it in any store. A
segment has one frequency table, which its blocks share, and for each block the documents in it. Blocks are
coded independently; a block ends where a document ends. In a block, token i belongs to lane i % lanes; the
lanes are coders that take each step together and share one stream of 32-bit words. Checkpoints hold the lanes'
states and the place in the stream every so many steps: a reader's unit of work is a block's stretch from one
checkpoint to the next. Blocks, tables and the ids of each stretch carry CRC-32 checksums.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from eigenloom.llm._common import constants, map_arrow
from eigenloom.llm.bpe import worker_encoder
from eigenloom.llm.tokenization import read_vocabulary

MAGIC = b"RANSSEG1"
SCALE_BITS = 20
LOW = np.uint64(1 << 31)  # states lie in [2**31, 2**63)
_32 = np.uint64(32)


class Table:
    """Frequencies of symbols, which sum to 2**SCALE_BITS; each symbol that occurs has at least one."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.short = symbols.astype(np.uint32), freq.astype(np.uint32)
        top = int(symbols.max()) + 1 if len(symbols) else 1
        self.freq, self.start = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self.freq[symbols] = freq
        self.start[symbols] = np.cumsum(freq) - freq
        self.slot = np.repeat(self.symbols, self.short)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts, whole = counts[symbols], 1 << SCALE_BITS
        if len(symbols) > whole:
            raise ValueError("more symbols than slots")
        freq = np.maximum(1, counts * whole // max(1, counts.sum()))
        excess = int(freq.sum()) - whole
        by = np.argsort(-freq, kind="stable")
        at = 0
        while excess and len(freq):  # the largest give or take what is over
            i = by[at % len(by)]
            change = max(-excess, 1 - int(freq[i])) if excess > 0 else -excess
            freq[i] += change
            excess += change
            at += 1
        return cls(symbols, freq)

    def dump(self) -> bytes:
        return zlib.compress(self.symbols.astype("<u4").tobytes() + self.short.astype("<u4").tobytes(), 1)

    @classmethod
    def load(cls, raw: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(raw), "<u4")
        return cls(both[: len(both) // 2], both[len(both) // 2 :].astype(np.int64))


LANES, CHECKPOINT_STEPS = 2048, 256


def units_of(n: int, lanes: int, every: int) -> int:
    """Stretches of a block of n ids, one at least."""
    return max(1, -(-n // (lanes * every)))


def lanes_for(n: int, most: int) -> int:
    return max(1, min(most, n // 64))


def encode_block(ids: np.ndarray, table: Table, max_lanes: int = LANES, checkpoint_steps: int = CHECKPOINT_STEPS) -> bytes:
    """One block: counts, the stretches' checksums, lanes' first states, checkpoints, words, and a checksum of all these."""
    n = len(ids)
    lanes = lanes_for(n, max_lanes)
    steps = -(-n // lanes)
    state = np.full(lanes, LOW)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    shift, bits = np.uint64(63 - SCALE_BITS), np.uint64(SCALE_BITS)
    for step in range(steps - 1, -1, -1):
        sym = ids[step * lanes : (step + 1) * lanes]
        x, f = state[: len(sym)], table.freq[sym]
        full = x >= f << shift
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> _32, x)
        q = x // f
        state[: len(sym)] = (q << bits) + (x - q * f) + table.start[sym]
        if step and step % checkpoint_steps == 0:
            marks.append((step, state.copy()))
    words.reverse()
    marks.reverse()
    before = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    stretch = lanes * checkpoint_steps
    sums = np.array([zlib.crc32(ids[a : a + stretch].astype("<u4").tobytes()) for a in range(0, max(1, n), stretch)], "<u4")
    head = struct.pack("<5I", n, lanes, checkpoint_steps, len(marks), int(before[-1])) + sums.tobytes()
    body = head + state.astype("<u8").tobytes() + b"".join(struct.pack("<I", int(before[s])) + m.astype("<u8").tobytes() for s, m in marks) + b"".join(w.tobytes() for w in words)
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A coded block; its checksum is checked when it is opened."""

    def __init__(self, raw: bytes, table: Table):
        body, self.table = raw[:-4], table
        if zlib.crc32(body) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block's checksum does not hold")
        self.n, self.lanes, self.every, n_marks, n_words = struct.unpack_from("<5I", body)
        self.steps, self.units = -(-self.n // self.lanes), n_marks + 1
        self.sums = np.frombuffer(body, "<u4", self.units, 20)
        at = 20 + 4 * self.units
        self.states, self.places = [np.frombuffer(body, "<u8", self.lanes, at)], [0]
        for k in range(n_marks):
            mark = at + 8 * self.lanes + k * (4 + 8 * self.lanes)
            self.places.append(struct.unpack_from("<I", body, mark)[0])
            self.states.append(np.frombuffer(body, "<u8", self.lanes, mark + 4))
        self.words = np.frombuffer(body, "<u4", n_words, at + 8 * self.lanes + n_marks * (4 + 8 * self.lanes))

    def decode(self, unit: int) -> np.ndarray:
        """The ids from a checkpoint (the block's begin is number 0) to the next, checked against their checksum.

        It must also arrive at the next checkpoint's states, or at those the coder began with.
        """
        first, last = unit * self.every, min(self.steps, (unit + 1) * self.every)
        table, lanes, place = self.table, self.lanes, self.places[unit]
        state = self.states[unit].copy()
        out = np.empty(min(self.n, last * lanes) - first * lanes, np.uint32)
        mask, bits, done = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), 0
        for step in range(first, last):
            m = min(lanes, self.n - step * lanes)
            x = state[:m]
            slot = x & mask
            sym = table.slot[slot]
            x = table.freq[sym] * (x >> bits) + slot - table.start[sym]
            low = np.flatnonzero(x < LOW)
            x[low] = x[low] << _32 | self.words[place : place + len(low)]
            place += len(low)
            state[:m] = x
            out[done : done + m] = sym
            done += m
        ends = (self.states[unit + 1], self.places[unit + 1]) if unit + 1 < self.units else (np.full(lanes, LOW), len(self.words))
        if (state != ends[0]).any() or place != ends[1]:
            raise ValueError("a stretch does not end where the next begins")
        if zlib.crc32(out.astype("<u4").tobytes()) != self.sums[unit]:
            raise ValueError("a stretch's ids do not have their checksum")
        return out


FILES = "part int, segment int, start_in_part long, n_tokens long, freq binary, blocks array<struct<start:long,units:int,payload:binary,doc_ids:array<long>,lengths:array<long>>>"


def segment_row(doc_ids: list[int | None], ids: list[np.ndarray], block_tokens: int, max_lanes: int = LANES, checkpoint_steps: int = CHECKPOINT_STEPS) -> tuple[bytes, list[dict]]:
    """A segment's table, checksum before it, and its blocks; a block ends with the document that fills it."""
    packed = Table.of(np.concatenate([np.zeros(0, np.uint32), *ids])).dump()
    table = Table.load(packed)
    blocks, start, at = [], 0, 0
    while at < len(ids):
        n, upto = 0, at
        while upto < len(ids) and (n < block_tokens or upto == at):
            n += len(ids[upto])
            upto += 1
        payload = encode_block(np.concatenate(ids[at:upto]), table, max_lanes, checkpoint_steps)
        units = units_of(n, lanes_for(n, max_lanes), checkpoint_steps)
        blocks.append({"start": start, "units": units, "payload": payload, "doc_ids": doc_ids[at:upto], "lengths": [len(x) for x in ids[at:upto]]})
        start, at = start + n, upto
    return struct.pack("<I", zlib.crc32(packed)) + packed, blocks


def opened(freq: bytes) -> Table:
    if zlib.crc32(freq[4:]) != struct.unpack("<I", freq[:4])[0]:
        raise ValueError("a table's checksum does not hold")
    return Table.load(freq[4:])


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, segment_tokens: int = 4_000_000, block_tokens: int = 1 << 20, max_lanes: int = LANES, checkpoint_steps: int = CHECKPOINT_STEPS) -> None:
    """Encode documents (doc_id, text), append `end_id` to each, and write their ids to `path` by ascending doc_id.

    Texts are dealt out by ranges of doc_id (nulls first, ties by the text's hash, then by place, so an id that
    many rows repeat is spread as well) and each task codes its range in segments of about `segment_tokens` ids,
    which bounds its memory; one long text makes a longer segment. Null texts count as empty. Repeated rows are
    all written. An empty table writes an empty table. Other columns are not read.
    """
    source = read_vocabulary(docs, tokenizer_path)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place"))
    keys = ("doc_id", "tie", "place")
    schema = to_arrow_schema(StructType.fromDDL(FILES))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part = worker_encoder(source.value), struct.pack("<I", end_id), TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        segment, before = 0, 0

        def sent() -> pa.RecordBatch:
            nonlocal segment, before
            n = sum(map(len, ids))
            freq, blocks = segment_row(doc_ids, ids, block_tokens, max_lanes, checkpoint_steps)
            row = [part, segment, before, n, freq, blocks]
            segment, before = segment + 1, before + n
            doc_ids.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        held = 0
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(np.frombuffer(encoder.encode(t or "") + end, "<u4"))
                doc_ids.append(doc)
                held += len(ids[-1])
                if held >= segment_tokens:
                    yield sent()
                    held = 0
        if ids:
            yield sent()

    map_arrow(ordered, run, FILES).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Read such files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit integers).

    The ranges' sizes, one number for each of the writer's tasks, come from their own column. Each unit, a
    block's stretch from one checkpoint to the next, is a row of its own, decoded in any order: it gives the
    documents that begin in it, and goes on into the next stretches only for what its last document has there.
    """
    files = spark.read.schema(FILES).parquet(path)
    sizes = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, run_ = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(run_)
        run_ += sizes.get(part, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = table = payload = block = None
        for batch in batches:
            for start, packed, raw, doc_ids, lengths, unit in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if packed != freq:
                    freq, table, payload = packed, opened(packed), None
                if raw != payload:
                    payload, block = raw, Block(raw, table)
                size = np.array(lengths, np.int64)
                ends = np.cumsum(size)
                first, last = unit * block.every * block.lanes, min(block.n, (unit + 1) * block.every * block.lanes)
                own = np.flatnonzero((ends - size >= first) & ((ends - size < last) | (unit == block.units - 1)))
                if not len(own):
                    continue
                got, onward = [block.decode(unit)], unit + 1
                while first + sum(map(len, got)) < ends[own[-1]]:
                    got.append(block.decode(onward))
                    onward += 1
                flat = np.concatenate(got).astype("<u4").tobytes()
                for a in range(0, len(own), 512):
                    at = own[a : a + 512]
                    e, n = ends[at], size[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_ids[i] for i in at.tolist()], pa.int64()), pa.array(start + e - n), pa.array(n), pa.array([flat[4 * (x - y - first) : 4 * (x - first)] for x, y in zip(e.tolist(), n.tolist(), strict=True)], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    placed = files.select((F.get(constants(starts), F.col("part")) + F.col("start_in_part")).alias("start"), "freq", F.explode("blocks").alias("b"))
    units = placed.select((F.col("start") + F.col("b.start")).alias("start"), "freq", "b.payload", "b.doc_ids", "b.lengths", F.explode(F.sequence(F.lit(0), F.col("b.units") - 1)).alias("unit"))
    return units.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
