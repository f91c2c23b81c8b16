"""A training corpus from ``documents``: quality, near duplicates, decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import fmindex, jaccard, mixing, quality, sharding
from lectern.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link at 80 percent of their 5-word shingles the one of least doc_id stays."""
    return jaccard.one_of_each_group(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words within a benchmark window are cut out; a document that was nothing else goes."""
    return fmindex.without_hits(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch in which the mix takes words of a document, with the words it takes."""
    return mixing.mixed_texts(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: shard and slot, with its size and checksum; ``sharding.shard_files`` writes the texts so."""
    rows = written(sharding.digests(docs, "lang", "source", "n_chars"), "digests")
    return sharding.assign(rows).select("doc_id", "lang", "source", "n_chars", "size", "tokens", "text_crc32", "shard", "slot")


STAGES = [
    ("quality_crf", keep_quality),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("fm_index_decontamination", cut_benchmark),
    ("hypergeometric_mix", mix_sources),
    ("vector_bin_packing", shard),
]

#: SQL can't express a fitted model or a keyed permutation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
