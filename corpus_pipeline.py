"""The corpus pipeline: each stage works on all that the one before it kept.

run() applies the stages to documents, each result written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netquill.llm import kneser_ney, lpt, mixing, simhash, winnow
from netquill.llm.common import drop_stash, forget, made, stash, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts within their language's quantile of trusted perplexity.

    Null, empty and white-space texts go; repeated rows stay or go together, rows
    without an id are never trusted, and further columns come back as they are.
    """
    return kneser_ney.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the row with the smallest doc_id.

    Rows are told apart by doc_id and text: a text that only shares another's
    doc_id stays. Rows without a doc_id come last in their group; ties go by the
    text's key. Of repeated rows one stays; null and empty texts are one group.
    """
    return simhash.first_of_groups(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that share no ten words in a row with a benchmark item, nor hold a shorter item.

    Null and empty texts stay, and equal texts stay or go together.
    """
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target; repeated rows get equal numbers of copies, null sources are one source."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and their shard, 0 to 15; equal texts share one. An input column of the name shard is replaced."""
    return lpt.with_shards(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: The classifier and SimHash are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage wrote besides its result goes when the stage ends."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        since = made()
        done = stash(stage(spark, docs, sf_dir), f"stage{k}")
        forget(spark, since, done)
        if k:
            drop_stash(docs)
        docs = done
    return docs
