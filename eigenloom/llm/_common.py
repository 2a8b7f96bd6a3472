"""What the corpus operators share: the shared folder, stashed tables, and Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python function gets at once; few, since one text may hold megabytes. Between the JVM and Python,
#: Spark's own bounds of rows and bytes (spark.sql.execution.arrow.*) hold.
BATCH_ROWS = 256

_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. On a single machine one of our own where it is unset.

    Elsewhere an unset folder is an error: other executors would not see a local one.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="eigenloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, under one folder for each application that goes when the driver ends."""
    top = f"{shared_dir(spark)}/stash-{spark.sparkContext.applicationId}"
    if top not in _swept:
        _swept.add(top)
        atexit.register(_sweep, spark._jvm, spark._jsc.hadoopConfiguration(), top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def _sweep(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended first
        _delete(jvm, conf, path)


def _delete(jvm, conf, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    with _few_rows(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


@contextlib.contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows for what runs within; the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_stash(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration(), df._stash_path)


def settled(docs: DataFrame) -> DataFrame:
    """The table itself where it is a mere scan, whose rows lie in the same partitions each time it is read; else a stash."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    moves = ("Exchange", "MapIn", "Python", "ExistingRDD", "Rand", "InMemory")
    return stash(docs, "settled") if any(x in plan for x in moves) else docs


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows, cut in the worker: no session setting is touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def constants(values: list[int]) -> Column:
    """A constant array of longs; the optimizer folds it, so plans stay small."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")
