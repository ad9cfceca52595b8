"""Token records of `clean_corpus`, shared by the counting operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.materialize import kept
from ..sources.tables import table

#: White space between tokens: the Unicode property, and the four separators that are white space to most tokenizers.
GAP = r"(?U)[\s\x1c-\x1f]+"


def tokens_of(text: str | Column) -> Column:
    """Pieces between white space, in lower case, in their order."""
    return F.filter(F.split(F.lower(text), GAP), lambda t: t != "")


def token_records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, tokens) per id with at least one token.

    Rows of one id are one record; where their texts differ, the greatest text holds. Rows with a null id or without any
    token are left out. Other columns are ignored, whatever their names.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & (F.size(F.coalesce(tokens_of("text"), F.array())) > 0))
    return rows.groupBy("doc_id").agg(F.max("text").alias("text")).select("doc_id", tokens_of("text").alias("tokens"))


def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of `clean_corpus`, kept for the several passes that the operators make."""
    return kept(token_records(table(spark, sf_dir, "clean_corpus")))


def token_counts(records: DataFrame) -> DataFrame:
    """(doc_id, token, tf): how often each token stands in each record."""
    return records.select("doc_id", F.explode("tokens").alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))
