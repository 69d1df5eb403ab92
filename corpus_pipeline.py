"""A training corpus from the documents table: good, different, without personal data, mixed, packed.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that ``run``
writes to the shared folder and reads again as the next stage's documents. All but the last return the columns of
documents. Labels come from ``sf_dir``; they are used for fitting only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seamline.llm import jaccard, mixing, packing, pii, quality
from seamline.llm.shared import Scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: one document of each group of near duplicates, the one with the smallest doc_id."""
    with Scratch(spark) as scratch:
        return jaccard.representatives(docs, jaccard.ngram_join(docs, scratch))


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: personal data in the texts replaced by its kind."""
    return pii.mask(docs, pii.train(docs))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: sources mixed to their targets; a row for each use of a document, in training order."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: the pieces of all documents, with their sequences and places."""
    with Scratch(spark) as scratch:
        return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", different_documents),
    ("PII", masked_documents),
    ("mixing sources to target weights", mixed_documents),
    ("best-fit packing", packed_sequences),
]

#: No stage can be written in SQL; a test in tests/llm/test_methods.py compares with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for k, (_, stage) in enumerate(STAGES):
            settled = scratch.settle(stage(spark, docs, sf_dir), keep=k == len(STAGES) - 1)
            if k:
                scratch.drop(docs)
            docs = settled
    return docs
