"""A corpus pipeline over `documents`: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is
written and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenloom.llm._common import drop_stash, stash
from eigenloom.llm.packing import pack
from eigenloom.llm.quality import fit_rules, quality_filter
from eigenloom.llm.queries import table, tokenizer_path, trusted_ids
from eigenloom.llm.resemblance import without_copies
from eigenloom.llm.toxicity import fit_toxicity, toxicity_filter


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' labels, does not predict toxic."""
    return toxicity_filter(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold; both multinomials count these documents."""
    return quality_filter(docs, fit_rules(docs, trusted_ids(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a similarity of 0.8 or more, that of the smallest doc_id."""
    return without_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents' ids in sequences of 2048."""
    pieces = pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("packing", packing)]

#: SQL expresses neither the classifier nor the fingerprints; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if n:
            drop_stash(before)
    return STAGES[-1][1](spark, docs, sf_dir)
