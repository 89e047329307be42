"""The corpus pipeline: documents are filtered, deduplicated, decontaminated and encoded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but
the last return the columns of documents. Defined results are those of the operators that the stages call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewise.llm import bpe, decontamination, jaccard_join, quality_classifier, suffix_dedup
from framewise.llm.common import discard, materialize, release, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote accepts."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the least doc_id."""
    return jaccard_join.deduplicated(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that an earlier document holds."""
    return suffix_dedup.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark windows; documents that are mostly benchmark go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", encoded),
]

#: The vote and the encoding are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        docs = found
        if k < len(STAGES) - 1:
            docs = materialize(found, f"stage-{k}")
            release(found)
            if before is not None:
                discard(before)
            before = docs
    return docs
