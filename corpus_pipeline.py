"""The corpus pipeline: from raw documents to packed sequences, by operators of docweave.llm.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns rows with the columns of documents; the
last one returns the pieces of the packed sequences.

Defined cases, in every stage: docs may have more columns, whatever their names, and they stay (all but in the last stage); an empty table gives
no rows. What nulls, empty and long texts, ties and repeated rows give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import discard, stored
from docweave.llm.neighbours import keep_by_quality
from docweave.llm.packing import best_fit_pack
from docweave.llm.rules import keep_by_rules
from docweave.llm.simhash import near_dedup
from docweave.llm.substrings import cut_repeats


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier rejects go.

    Null, empty and blank texts get the share of good labels as their score. Repeated rows stay or go together; null ids have no labels.
    """
    return keep_by_quality(docs, _labels(spark, sf_dir))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go.

    Null, empty and blank texts have no words and go. Null languages are a stratum of their own; repeated rows stay or go together.
    """
    return keep_by_rules(docs, _labels(spark, sf_dir))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, the one with the smallest id.

    Null ids come last; of rows of one id a single one stays. Null and empty texts are one component.
    """
    return near_dedup(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere too are cut out; n_chars is that of the text that is left.

    Null texts stay null with their n_chars; a character that a cut leaves incomplete goes; repeated rows lose what they share, all of it.
    """
    out = cut_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, tokenised, as pieces of sequences of at most 1024 tokens.

    A null or empty text is one piece that holds the end id alone; null ids and repeated rows are packed like any other.
    """
    return best_fit_pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the trained stages; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, before = stored(stage(spark, docs, sf_dir), name), docs
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
