"""Distributed sums of dense blocks: the one reduction under Gram matrices, power passes and normal equations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Numbers of an array that one row holds (4 MB).
BLOCK = 1 << 19

#: Bytes of rows that a step in Python takes up at once, and bytes of a block of samples that is turned.
STEP_BYTES, TURN_BYTES = 8 << 20, 8 << 20

#: Rows of one array that the driver adds up, if it has fewer blocks.
LANES = 16

#: Samples on one side of a block of their Gram matrix (a block takes 32 MB), and variants of one piece of its factors.
SIDE, PIECE = 2048, 256

#: Partitions that the pairs of blocks are dealt to, if there are so many.
PAIR_PARTITIONS = 4096


def rows_of(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """An array column as a matrix, one row each; missing values are NaN."""
    column = batch.column(batch.schema.get_field_index(name))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def column_of(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[name].to_numpy()


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about STEP_BYTES, or of one row, so that what is made of them stays as small."""
    for b in batches:
        height = max(1, b.num_rows * STEP_BYTES // max(1, b.nbytes))
        for first in range(0, b.num_rows, height):
            yield b.slice(first, height)


def sum_arrays(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sum of the named arrays that `partial` makes of each partition, on the driver.

    Arrays travel in blocks of BLOCK numbers. A block's parts are dealt to a few lanes (one, where the array has
    LANES blocks or more); a task adds up a lane's parts one after the other, in the order of partitions, so it
    holds one block however many partitions there are, and sums repeat to the last bit. The driver gets at most
    LANES blocks of a smaller array and each block of a larger one once. Results must fit the driver: they are
    of the smaller dimension squared, or of a dimension times a few components.
    """
    names = ["part", "name", "block", "lane", "shape", "data"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for name, value in partial(steps(batches)).items():
            value = np.asarray(value, float)
            flat, blocks = value.ravel(), max(1, -(-value.size // BLOCK))
            for block in range(blocks):
                yield row(part, name, block, part % max(1, LANES // blocks), list(value.shape), flat[block * BLOCK : (block + 1) * BLOCK].tobytes())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                part, name, block, lane, shape = (batch.column(c)[i].as_py() for c in range(5))
                data = np.frombuffer(batch.column(5)[i].as_buffer())
                if held is not None and held[1:4] == (name, block, lane):
                    total += data
                    continue
                if held is not None:
                    yield row(*held, total.tobytes())
                held, total = (part, name, block, lane, shape), data.copy()
        if held is not None:
            yield row(*held, total.tobytes())

    schema = "part long, name string, block long, lane long, shape array<long>, data binary"
    key = ["name", "block", "lane"]
    sums = df.mapInArrow(run, schema).repartition(*key).sortWithinPartitions(*key, "part").mapInArrow(add, schema)
    out: dict[str, np.ndarray] = {}
    for r in sorted(sums.collect(), key=lambda r: (r.name, r.block, r.lane)):
        if r.name not in out:
            out[r.name] = np.zeros(r.shape)
        data = np.frombuffer(r.data)
        out[r.name].reshape(-1)[r.block * BLOCK : r.block * BLOCK + data.size] += data
    return out


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Apply `fn` to each Arrow batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            yield fn(batch)

    return df.mapInArrow(run, schema)


def batch_of(schema: str, *columns) -> pa.RecordBatch:
    """A batch from numpy arrays or lists, with the names and types of a schema string."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32())}
    names, types = zip(*(x.strip().split(" ", 1) for x in schema.split(", ")), strict=True)
    arrays = []
    for kind, values in zip(types, columns, strict=True):
        if kind.startswith("array") and isinstance(values, np.ndarray):
            values = pa.ListArray.from_arrays(np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32) if values.shape[1] else np.zeros(len(values) + 1, np.int32), pa.array(values.ravel(), kinds[kind].value_type))
            arrays.append(values)
        else:
            arrays.append(pa.array(values, kinds[kind]))
    return pa.RecordBatch.from_arrays(arrays, list(names))


def cut(rows: DataFrame, block: int, arrays: list[str], keep: list[str]) -> DataFrame:
    """Rows in blocks of samples: `b`, the kept columns, and the slice of each array."""
    last = F.floor((F.size(arrays[0]) - 1) / block).cast("int")
    each = rows.select(*keep, F.explode(F.sequence(F.lit(0), last)).alias("b"), *arrays)
    return each.select(*keep, "b", *(F.slice(a, F.col("b") * block + 1, F.lit(block)).alias(a) for a in arrays))


def turned(rows: DataFrame, m: int, column: str = "x", diagonal: str | None = None) -> DataFrame:
    """The matrix of `m` variants by sample: its number as `variant_idx`, and `x`, its values in the variants' order.

    With `diagonal` also `e`, the sum of the sample's values in that array. Each task turns blocks of TURN_BYTES.
    """
    block = max(1, min(4096, TURN_BYTES // (8 * max(1, m))))
    arrays = [column, *([diagonal] if diagonal else [])]
    schema = "variant_idx long, x array<double>" + (", e double" if diagonal else "")

    def turn(t: pa.Table) -> pa.Table:
        t = t.sort_by("variant_idx")
        x = rows_of(t, column).T
        extra = [rows_of(t, diagonal).sum(axis=0)] if diagonal else []
        return pa.Table.from_batches([batch_of(schema, t["b"][0].as_py() * block + np.arange(len(x)), x, *extra)])

    return cut(rows, block, arrays, ["variant_idx"]).groupBy("b").applyInArrow(turn, schema)


def gathered(scores: DataFrame, n: int, k: int) -> np.ndarray:
    """Rows (variant_idx, v) of n samples as one matrix on the driver."""
    t, out = scores.toArrow(), np.empty((n, k))
    if t.num_rows:
        out[column_of(t, "variant_idx")] = rows_of(t, "v")
    return out


def gram_blocks(rows: DataFrame, n: int, fold: Callable, schema: str, column: str = "x", diagonal: str | None = None, tag: str | None = None) -> DataFrame:
    """Sum over rows of x x^T, samples by samples, in square blocks; `fold` makes batches of `schema` of each.

    `fold(i, j, parts)` gets a block's first sample on each side, i <= j, and an iterator of (tag, block), one for each
    value of the column `tag` (one, if there is none). Sums of the arrays `diagonal` are added to the diagonal. A task
    holds one block and two pieces of the rows at a time; the whole matrix exists nowhere.
    """
    blocks = max(1, -(-n // SIDE))
    arrays = [column, *([diagonal] if diagonal else [])]
    named = rows.select("variant_idx", F.col(tag).cast("string").alias("tag") if tag else F.lit("").alias("tag"), F.floor(F.col("variant_idx") / PIECE).alias("c"), *arrays)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("variant_idx")
        extra = rows_of(t, diagonal).sum(axis=0) if diagonal else np.zeros(0)
        return pa.table({"b": t["b"][:1], "tag": t["tag"][:1], "c": t["c"][:1], "n": pa.array([t.num_rows], pa.int64()), "x": pa.array([rows_of(t, column).tobytes()], pa.binary()), "d": pa.array([extra.tobytes()], pa.binary())})

    packed = cut(named, SIDE, arrays, ["variant_idx", "tag", "c"]).groupBy("b", "tag", "c").applyInArrow(pack, "b int, tag string, c long, n long, x binary, d binary")
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("lo", F.least("b", "other").cast("long")).withColumn("hi", F.greatest("b", "other").cast("long"))
    pairs = min(PAIR_PARTITIONS, blocks * (blocks + 1) // 2)
    place = F.pmod(F.expr("hi * (hi + 1) div 2 + lo"), F.lit(pairs)).cast("int")
    names = ["lo", "hi", "tag", "c", "b", "n", "x", "d"]

    def parts(records: Iterator[tuple], square: bool) -> Iterator[tuple[str, np.ndarray]]:
        for name, of_tag in groupby(records, key=lambda r: r[2]):
            total, first = None, None
            for _, _, _, c, _, height, x, d in of_tag:
                x = np.frombuffer(x).reshape(height, -1)
                if not square and (first is None or first[0] != c):
                    first = (c, x)
                    continue
                part = (x if square else first[1]).T @ x
                total = part if total is None else np.add(total, part, out=total)
                if square and diagonal:
                    total[np.diag_indices(len(total))] += np.frombuffer(d)
            yield name, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = ((*(b.column(k)[i].as_py() for k in range(6)), b.column(6)[i].as_buffer(), b.column(7)[i].as_buffer()) for b in batches for i in range(b.num_rows))
        for (lo, hi), of_pair in groupby(records, key=lambda r: r[:2]):
            yield from fold(lo * SIDE, hi * SIDE, parts(of_pair, lo == hi))

    return met.repartitionById(pairs, place).sortWithinPartitions("lo", "hi", "tag", "c", "b").select(*names).mapInArrow(run, schema)


def gram_cells(rows: DataFrame, n: int, value: Callable[[np.ndarray], np.ndarray], column: str = "x", diagonal: str | None = None) -> DataFrame:
    """Upper half of the samples' Gram matrix, `value` of each block: i, j (i <= j), k."""
    schema = "i long, j long, k double"

    def fold(i: int, j: int, parts: Iterator[tuple[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for _, block in parts:
            height = max(1, (1 << 17) // block.shape[1])
            for top in range(0, len(block), height):
                k = value(block[top : top + height])
                a, b = np.repeat(np.arange(i + top, i + top + len(k)), k.shape[1]), np.tile(np.arange(j, j + k.shape[1]), len(k))
                held = a <= b
                yield batch_of(schema, a[held], b[held], k.ravel()[held])

    return gram_blocks(rows, n, fold, schema, column, diagonal)
