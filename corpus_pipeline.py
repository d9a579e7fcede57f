"""Corpus preparation: the documents table through five stages, each by one of the corpus operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read back before the next stage.
All but the last return the columns of documents:

1. ``quality``: documents that the weak-label classifier rejects go;
2. ``near_duplicates``: one document of each class of the n-gram Jaccard join stays, the one with the least doc_id;
3. ``decontaminate``: documents that hold a benchmark item go;
4. ``secrets``: secrets are replaced by a mark, and n_chars follows the text;
5. ``pack``: the documents are tokenised and packed into sequences, one row for each piece.

Nulls, empty texts and tables, ties and repeated rows: as the operators' modules define them; in stage 2 rows that repeat
a doc_id count as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, ngram_join, packing, quality, secret_scan
from ledgerloom.llm.scratch import documents, staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("pack", pack_sequences),
]

#: The stages are trained models, similarity search and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
