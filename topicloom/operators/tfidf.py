"""Tf-idf as a long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .dictionary import doc_tokens, looked_up


def tfidf(corpus: DataFrame, n_docs: int, binary: bool = True, normalised: bool = True) -> DataFrame:
    """(doc_id, word, tfidf): tf (ln((1 + N) / (1 + df)) + 1), divided by the document's length.

    `binary` counts a word once a document, as corpora of distinct words do. Documents without words have no rows.
    """
    tf = doc_tokens(corpus).withColumn("tf", F.lit(1) if binary else F.col("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    raw = looked_up(tf, df, "df").select("doc_id", F.col("token").alias("word"), (F.col("tf") * (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)).alias("x"))
    if not normalised:
        return raw.select("doc_id", "word", F.col("x").alias("tfidf"))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norms, "doc_id").select("doc_id", "word", (F.col("x") / F.col("norm")).alias("tfidf"))


def top_words(scores: DataFrame, k: int = 20) -> DataFrame:
    """(word, total): the k words of greatest summed score, ties to the first in the alphabet."""
    return scores.groupBy("word").agg(F.sum("tfidf").alias("total")).orderBy(F.desc(F.round("total", 9)), "word").limit(k)


def word_features(scores: DataFrame) -> DataFrame:
    """(word, docs, ws): the transposed matrix, a sparse vector over documents for every word."""
    entries = scores.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tfidf"))).alias("e"))
    return entries.select("word", F.col("e.doc_id").alias("docs"), F.col("e.tfidf").alias("ws"))
