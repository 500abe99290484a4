"""From raw documents to shuffled training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import exact_dedup, jaccard, mixing, quality, sentencepiece
from sluice.llm.common import hold, read
from sluice.llm.queries import pieces

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the decision list learned from the labels."""
    return quality.well_written(docs, read(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, by a fresh digest index."""
    return exact_dedup.exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    return jaccard.one_of_each(docs, shingle=5, similarity=0.8)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights, in shuffled order."""
    return mixing.mix(docs, mixing.source_rates(docs)).select(*docs.columns)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's pieces, checked by decoding them."""
    return sentencepiece.encode(docs, pieces(), verify=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing to target weights", target_weights),
    ("SentencePiece encoding", piece_ids),
]

# A learned decision list, fingerprints by XXH64 and merges by rank are beyond SQL: tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = hold(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
