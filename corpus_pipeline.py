"""The corpus pipeline: each stage takes what the one before has kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last return the columns of documents.
Learning, corpus-wide frequencies and packing have no SQL, so ORACLE_SQL is None; the tests hold every
stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolith.llm.common import documents, labels, stored
from chronolith.llm.line_dedup import line_dedup, near_pages
from chronolith.llm.near_dedup import near_dedup
from chronolith.llm.packing import best_fit_packing
from chronolith.llm.quality_classifier import quality_classifier
from chronolith.llm.toxicity import toxicity

ORACLE_SQL = None
#: Words of a shingle and similarity of near copies.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts."""
    return toxicity(docs, labels(spark, sf_dir)).where("predicted = 0").select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' votes accept."""
    return quality_classifier(docs, labels(spark, sf_dir)).where("predicted = 1").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the boilerplate lines of its source; n_chars follows the text.

    Near copies (as in the next stage) count as one page, so that the one that stage keeps is whole.
    """
    out = line_dedup(docs, near=near_pages(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), that with the smallest id.

    Rows that share an id are told apart by their text; exact copies of a row count as one.
    """
    keyed = docs.withColumn("__near_key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))
    found = near_dedup(keyed, doc_id="__near_key", width=NEAR_WIDTH, percent=NEAR_PERCENT)
    kept = found.where("kept").select(F.col("doc_id").alias("__near_key")).distinct()
    return keyed.join(kept, "__near_key", "left_semi").dropDuplicates(["__near_key"]).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces with their sequences."""
    return best_fit_packing(docs)


STAGES = [("toxicity", drop_toxic), ("quality_classifier", drop_low_quality), ("line_dedup", drop_boilerplate),
          ("near_dedup", drop_near_copies), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
