"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing and encoding, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import bpe, mixing, quality_rules, simhash_dedup, substring_dedup
from chronoweave.llm.common import read, stored
from chronoweave.llm.queries import vocabulary_text

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned rule rejects."""
    learned = quality_rules.learn(docs, read(spark, sf_dir, "labels"))
    return quality_rules.clean(docs.select(COLUMNS), learned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash_dedup.first_of_groups(docs.select(COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that an earlier document has in a run of 13; the others as they are."""
    kept = substring_dedup.dedup(docs.select(COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at a flatter temperature: each document once at least, no source more than twice."""
    return mixing.mix(docs.select(COLUMNS), max_repetition=2.0).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary_text())
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return encoded.select("doc_id", "lang", "source", F.size("tokens").cast("long").alias("n_tokens"), "tokens", exact.alias("decodes"))


STAGES = [
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", passages),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]
#: SQL cannot learn the rules or hash as the fingerprints do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What STAGES make of documents, each stage written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
