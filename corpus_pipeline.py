"""A corpus pipeline: each stage's result is stored as Parquet and is the next stage's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import jaccard, packing, suffixdedup, toxicity
from quadlake.llm.common import discard, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic window scores below 0.5; empty and null texts count as windows without words."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one of smallest doc_id; rows without one come last.

    Rows are told apart by a number of their own, so repeated rows and rows without a doc_id
    are members like others. Texts without words are near copies of nothing and all stay.
    """
    key = "__row" + "_" * max(map(len, docs.columns))
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows")  # stored: another run may give other numbers
    links = jaccard.jaccard_join(rows.select(F.col(key).alias("doc_id"), "text"))
    found = links.select(F.col("doc_id").alias("row"), "component_id")
    named = rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    kept = stored(found.join(named, "row").groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias(key)), "kept")
    discard(links)
    # merged at every size: a broadcast of all row numbers has no bound
    return rows.join(kept.hint("merge"), key, "left_semi").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words, or of 400 bytes, that stand anywhere else too;
    n_chars follows the text.

    A null text stays null, an empty one empty, an empty table empty; texts of any length are
    judged whole.
    """
    kept = suffixdedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else kept


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, mixed by source; a null or empty text is an end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", drop_repeats), ("packing", pack)]
#: None of the stages can be expressed in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages kept.

    Null and empty texts pass every stage and are packed as an end id; repeated rows are one
    group of near copies, if they hold words; extra columns are carried to the last stage; an
    empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
