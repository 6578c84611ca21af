"""The corpus pipeline: quality rules, quality classifier, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns a
DataFrame. The first three return the columns of documents; the last one returns the packed pieces
(doc_id, piece, start, length, ids_crc32, sequence_id, offset).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm import _common as c
from lakeweave.llm import classifier, near_copies, packing, quality_rules, queries


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    return quality_rules.filter_documents(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on this stage's own input, keeps."""
    return classifier.filter_documents(docs, c.table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their five-word shingles or more), that with the smallest id.

    SimHash fingerprints meet by covering masks over parts of their bits, a check of the shingles follows; links beyond the radius are
    found by covering masks over the shingles: see near_copies."""
    return near_copies.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's tokens, packed into sequences."""
    return packing.pack_documents(docs, queries.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("simhash_dedup", simhash_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the trained stages; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before kept, written and read again; a stage's table goes once the next is written."""
    docs = c.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = c.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        c.discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
