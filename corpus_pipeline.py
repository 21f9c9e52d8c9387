"""A training-corpus pipeline: language, quality, exact and near duplicates, packing.

Every stage works on all that its predecessor kept.  All but the last return the columns of
documents, whatever these are called.  Empty tables pass every stage.  Stages bound the session's
batches to Python workers by bytes (`small_batches`), so an executor's memory is bounded too.
"""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.llm import exact, langid, neardup, packing, quality
from barspan.llm.common import cut, small_batches


def _rows(docs: DataFrame, *reads: str | Column) -> DataFrame:
    """The columns an operator reads, beside the whole row as one, so that no column of docs can clash with its results."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *reads)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter and those whose best language has under half the posterior.

    Null and empty texts have no letter and go.  Null ids and languages, repeated rows and very long
    texts are judged by their text like any other; an empty table stays empty.
    """
    small_batches(spark)
    found = langid.identify(_rows(docs, "doc_id", "text", "lang"))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select("row.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose quality score is under 0.3.

    Null and empty texts have a score like any other; nulls elsewhere, ties and repeated rows do not
    matter; an empty table stays empty.
    """
    small_batches(spark)
    found = quality.score(_rows(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.filter("predicted = 1").select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: one with the largest id, where ids are equal that with the least hash.

    Null and empty texts are equal.  A null id stays only where no equal text has an id.
    """
    small_batches(spark)
    decided = exact.dedup(docs).filter("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"))
    kept = decided.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "n")
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = _rows(docs, "doc_id", F.sha2(lower.cast("binary"), 256).alias("sha"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
    once = rows.join(kept.filter("n = 1"), same, "semi").select("row")
    # Rows that repeat id and text: aggregated before they are shuffled, so a hot one is no hot task.
    repeated = rows.join(kept.filter("n > 1"), same, "semi").groupBy("doc_id", "sha").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return once.unionByName(repeated).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on shingles of five words the smallest id stays.

    Rows are told apart by a number of their own, so null and repeated ids link and go like others:
    null ids count as the largest, and of equal ids the first row stays.  Null and empty texts link
    with nothing and stay.
    """
    small_batches(spark)
    numbered = cut(_rows(docs, "doc_id", "text").withColumn("number", F.monotonically_increasing_id()), "numbered")
    groups = neardup.near_duplicates(numbered, id_col="number", width=5, percent=80).select(F.col("number").alias("n"), "component_id")
    ids = cut(groups.join(numbered.select("number", "doc_id"), F.col("number") == F.col("n")).select("n", "doc_id", "component_id"), "groups")
    stay = ids.groupBy("component_id").agg(F.min_by("n", F.struct(F.col("doc_id").isNull(), "doc_id", "n")).alias("n")).select("n")
    return numbered.join(stay, F.col("number") == F.col("n"), "semi").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; one row per piece, as the packing operator gives it.

    Null ids and repeated rows are packed each; a null or empty text is one piece with the end token.
    """
    small_batches(spark)
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("packing", packed),
]

#: The models of the first two stages and the packing have no SQL form; tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
