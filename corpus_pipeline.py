"""Documents to packed training sequences: language, near-duplicates, benchmark passages, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written and read again as the next stage's documents.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeledger.llm import decontaminate, language_id, packing, pii, simhash
from cladeledger.llm.common import table
from cladeledger.llm.queries import tokenizer_path
from cladeledger.workspace import materialize


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; learnt from labelled documents outside the held-out third."""
    return language_id.keep_identified(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their sequence and place in it."""
    return packing.pack(packing.cut_pieces(docs, tokenizer_path(), end_id=0))


STAGES = [
    ("language_id", identified),
    ("simhash_near_dedup", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("personal_data", redacted),
    ("best_fit_packing", packed),
]

# Trained models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
