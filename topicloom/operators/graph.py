"""The weighted word graph of a corpus: edges (u, v, weight), u < v.

Within a document the length of its tf-idf row cancels in the ratio of two scores, so with one occurrence a word an edge
weighs its number of documents times the ratio of the smaller to the larger idf. Counts are added up first, exactly and in
any order, and scaled once at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .paircount import count_lists

#: Words of most documents whose pairs are counted in a bit matrix.
DENSE = 512


def _idf(df, n_docs: int):
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def cooccurrence(bow: DataFrame, dic: DataFrame, n_docs: int, mode: str = "star") -> DataFrame:
    """Edges between words of a document, from (doc_id, token_id) and the dictionary (token_id, df).

    `star` joins a document's word of smallest id to its other words, linear in the corpus; `all_pairs` joins every two, counted
    by block before any shuffle. Repeats in a document count once; documents of one word have no edge.
    """
    rows = bow.select("doc_id", "token_id").distinct()
    if mode == "star":
        hubs = rows.groupBy("doc_id").agg(F.min("token_id").alias("u"))
        pairs = rows.join(hubs, "doc_id").select("u", F.col("token_id").alias("v")).where(F.col("v") != F.col("u"))
    elif mode == "all_pairs":
        return _weighted(_all_pairs(rows, dic), dic, n_docs)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return _weighted(pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("c")), dic, n_docs)


def _all_pairs(rows: DataFrame, dic: DataFrame) -> DataFrame:
    """(u, v, c): the number of documents that hold both words."""
    frequent = np.sort([r["token_id"] for r in dic.orderBy(F.desc("df"), "token_id").limit(DENSE).select("token_id").collect()])
    lists = rows.groupBy("doc_id").agg(F.collect_list(F.col("token_id").cast("long")).alias("items")).where(F.size("items") > 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from count_lists(batches, frequent)

    counts = lists.select("items").mapInPandas(run, "a long, b long, c long")
    return counts.groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("c").alias("c"))


def _weighted(counts: DataFrame, dic: DataFrame, n_docs: int) -> DataFrame:
    for side in ("u", "v"):
        counts = counts.join(dic.select(F.col("token_id").alias(side), _idf(F.col("df"), n_docs).alias(f"idf_{side}")), side)
    return counts.select("u", "v", (F.col("c") * F.least("idf_u", "idf_v") / F.greatest("idf_u", "idf_v")).alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(i, j, w): both directions of every edge; the diagonal is empty."""
    one = edges.where(F.col("u") != F.col("v"))
    return one.select(F.col("u").alias("i"), F.col("v").alias("j"), F.col("weight").alias("w")).union(one.select("v", "u", "weight"))


def canonical(edges: DataFrame) -> DataFrame:
    """A stored edge list as an undirected graph: u < v, repeated rows once, null weights and loops out, weights of one edge added."""
    rows = edges.dropna(subset=["u", "v", "weight"]).select("u", "v", "weight").distinct().where(F.col("u") != F.col("v"))
    return rows.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("weight").alias("weight"))
