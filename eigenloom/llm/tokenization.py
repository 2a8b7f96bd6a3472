"""BPE encoding and decoding with a lexicon of the corpus's frequent words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenloom.llm._common import drop_stash, map_arrow, scratch_path, stash
from eigenloom.llm.bpe import Lexicon, Vocabulary, worker_encoder

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def read_vocabulary(docs: DataFrame, tokenizer_path: str) -> Broadcast:
    """The vocabulary file's text, for the workers; a few megabytes whatever the input."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def word_counts(docs: DataFrame, source: Broadcast, hold: int = 400_000) -> DataFrame:
    """How often each pre-tokenised word occurs in all texts. A task sends its counts on once it holds `hold` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, found = worker_encoder(source.value), Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found.update(encoder.split(text))
            if len(found) > hold:
                yield sent()
        if found:
            yield sent()

    return map_arrow(docs.select(F.col("text").cast("string")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, source: Broadcast, share: float = 3e-6) -> bytes:
    """Compile the words that hold at least `share` of all words' occurrences, and two at least: 1 / share words at most."""
    counts = stash(word_counts(docs, source).where("n > 1"), "lexicon-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = [r.word for r in counts.where(F.col("n") >= max(2.0, share * total)).select("word").collect()]
    drop_stash(counts)
    merge = Vocabulary(source.value).merger()
    raw = {w.encode() for w in words}
    return Lexicon.build((w, merge(w)) for w in raw)


def publish(spark: SparkSession, block: bytes, name: str) -> str:
    """Write a block to the shared folder and have Spark fetch it to each executor once; the name to ask SparkFiles for."""
    path = scratch_path(spark, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(block))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def encode_decode(docs: DataFrame, tokenizer_path: str, share: float = 3e-6) -> DataFrame:
    """Encode every whole text of documents (doc_id, text), and decode its ids.

    Frequent words, counted over all texts, are compiled into a minimal acyclic transducer; its file is mapped
    by all workers of an executor together. Each batch's distinct words are looked up there, and words that it
    lacks are merged exactly. Ids equal the tokenizers library's for the vocabulary file, without added special
    tokens; strings of the vocabulary's own added tokens become their ids.

    Returns SCHEMA; `ids` holds little-endian 32-bit integers. Null texts count as empty, which have no ids.
    Repeated rows and null doc_ids are encoded like others. An empty table gives no rows. Other columns are
    not read.
    """
    source = read_vocabulary(docs, tokenizer_path)
    name = publish(docs.sparkSession, build_lexicon(docs, source, share), "lexicon")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(source.value, SparkFiles.get(name))
        tokens = encoder.vocabulary.tokens
        for batch in batches:
            ids = encoder.encode_all([t or "" for t in batch.column(1).to_pylist()])
            decoded = [b"".join(map(tokens.__getitem__, np.frombuffer(i, "<u4").tolist())).decode("utf-8", "replace") for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)
