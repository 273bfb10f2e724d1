"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes what the stage before kept, as written to Parquet and read
again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import common, decontaminate, language_id, line_dedup, packing, simhash


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null, letterless and undecided texts go."""
    return language_id.of_known_language(docs, language_id.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate within their source.

    Null and empty texts stay as they are, repeated rows each stay, and an empty
    table gives an empty one.
    """
    return line_dedup.documents_without_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id.

    Linked are fingerprints two bits apart at most, by op 1's method, and sets
    of five-word shingles of similarity 0.8.
    Null and empty texts are one group. Of rows that share a doc_id the
    smallest as JSON stays; rows without a doc_id all stay.
    """
    return simhash.without_similar(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts hold none and stay; repeated rows share their fate."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids in sequences of 2048. A null or empty text is its end id; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

#: Compression, SimHash, edit distance and tokenisation have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that come of all documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = made if name == STAGES[-1][0] else common.materialise(made)
    return docs
