"""Corpus pipeline: quality, exact dedup, near dedup, mixing, token ids. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakline.llm import bpe, common, exact_dedup, mixture, near_dedup, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity lies within their language's thresholds, from the trusted rows among docs."""
    return quality.keep(docs, common.table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal text (A-Z lower-cased) that with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked by a similarity of 0.8 or more."""
    return near_dedup.deduplicate(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixture.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_decode(docs, bpe.word_bpe_file())


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixture", mix_sources),
    ("bpe", encode),
]
#: Perplexities, minima and ranks have no SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way is deleted once its result is written."""
    docs, before = common.table(spark, sf_dir, "documents"), common.written()
    for name, stage in STAGES[:-1]:
        path = common.fresh_path(spark, name)
        docs = common.put(stage(spark, docs, sf_dir), path)
        common.sweep(spark, before, (path,))
    return STAGES[-1][1](spark, docs, sf_dir)
