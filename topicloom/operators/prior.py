"""From responsibilities to a topic-word prior, on long tables (ix, topic, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def deduplicated(predictions: DataFrame) -> DataFrame:
    """(ix, topic, p): repeated rows once (the greatest p), null ids out, null p as 0."""
    rows = predictions.where(F.col("ix").isNotNull() & F.col("topic").isNotNull())
    return rows.groupBy("ix", "topic").agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("p"))


def soft_prior(predictions: DataFrame, n_topics: int, epsilon: float = 0.01) -> DataFrame:
    """(ix, topic, prior): (p + eps) / sum (p + eps) over all topics, those left out of the table included."""
    rows = deduplicated(predictions)
    sums = rows.groupBy("ix").agg(F.sum("p").alias("s"), F.map_from_entries(F.collect_list(F.struct("topic", "p"))).alias("m"))
    total = F.col("s") + n_topics * epsilon
    full = sums.select("ix", total.alias("total"), "m", F.explode(F.sequence(F.lit(0), F.lit(n_topics - 1))).alias("topic"))
    return full.select("ix", "topic", ((F.coalesce(F.try_element_at("m", F.col("topic")), F.lit(0.0)) + epsilon) / F.col("total")).alias("prior"))


def transpose(prior: DataFrame) -> DataFrame:
    """(topic, ix, eta): the prior by topic."""
    return prior.select("topic", "ix", F.col("prior").alias("eta"))


def align_eta(prior: DataFrame, vectors: DataFrame, dictionary: DataFrame, n_topics: int) -> DataFrame:
    """(topic, token_id, eta): the prior's words by their name in the dictionary; dictionary words without one get 0.

    Words outside the dictionary are dropped; of a repeated word the greatest ix holds.
    """
    names = vectors.where(F.col("word").isNotNull()).groupBy("word").agg(F.max("ix").alias("ix"))
    rows = prior.join(names, "ix").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("topic", "prior"))).alias("m"))
    full = dictionary.select("token_id", F.col("token").alias("word")).join(rows, "word", "left")
    full = full.select("token_id", "m", F.explode(F.sequence(F.lit(0), F.lit(n_topics - 1))).alias("topic"))
    return full.select("topic", "token_id", F.coalesce(F.try_element_at("m", F.col("topic")), F.lit(0.0)).alias("eta"))
