"""Measures of embeddings and assignments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .knn import nearest


def grassmann(a: DataFrame, b: DataFrame, width: int) -> float:
    """Sum of squared sines of the principal angles between the column spaces of two tables (id, vec) with the same ids."""
    from .spectral import small_gram

    aa, bb, ab = small_gram(a, width), small_gram(b, width), small_gram(a, width, b)
    ra, rb = (np.linalg.inv(np.linalg.cholesky(g + 1e-14 * np.trace(g) * np.eye(width))) for g in (aa, bb))
    cosines = np.clip(np.linalg.svd(ra @ ab @ rb.T, compute_uv=False), 0, 1)
    return float((1 - cosines**2).sum())


def grassmann_each(a: DataFrame, b: DataFrame, width: int) -> np.ndarray:
    """1 minus the squared cosine of each pair of columns."""
    from .spectral import small_gram

    aa, bb, ab = small_gram(a, width), small_gram(b, width), small_gram(a, width, b)
    return 1 - np.diag(ab) ** 2 / (np.diag(aa) * np.diag(bb))


def grassmann_1d(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(dist), one row: 1 minus the squared cosine of two columns."""
    sums = pairs.agg(F.sum(F.col(a) * F.col(b)).alias("ab"), F.sum(F.col(a) * F.col(a)).alias("aa"), F.sum(F.col(b) * F.col(b)).alias("bb"))
    return sums.select((1 - F.try_divide(F.col("ab") * F.col("ab"), F.col("aa") * F.col("bb"))).alias("dist"))


def knn_votes(vectors: DataFrame, labels: DataFrame, n_neighbors: int = 10) -> DataFrame:
    """(id, label, vote): the label of most of the n + 1 nearest vectors, those at distance 0 without a vote, ties to the smallest label."""
    near = nearest(vectors, n_neighbors + 1, "euclidean")
    voted = near.where(F.col("dist") > 0).join(labels.select(F.col("id").alias("j"), "label"), "j").groupBy("i", "label").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("i").orderBy(F.desc("n"), "label")
    best = voted.withColumn("rn", F.row_number().over(order)).where(F.col("rn") == 1).select(F.col("i").alias("id"), F.col("label").alias("vote"))
    return labels.join(best, "id", "left").select("id", "label", "vote")


def knn_score(vectors: DataFrame, labels: DataFrame, n_neighbors: int = 10) -> DataFrame:
    """(accuracy), one row."""
    return knn_votes(vectors, labels, n_neighbors).agg(F.avg(F.when(F.col("vote") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"))


def cost_matrix(counts: DataFrame) -> DataFrame:
    """(cluster, label, cost): of each cluster's size, the members without the label; `counts` is (cluster, label, n), each label present."""
    total = F.sum("n").over(Window.partitionBy("cluster"))
    return counts.select("cluster", "label", (total - F.col("n")).alias("cost"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest one-to-one assignment of a small square matrix, by augmenting paths with potentials."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0, low, back, used = i, 0, np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reach = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = reach < low[free]
            low[free[better]], back[free[better]] = reach[better], j0
            j1 = free[low[free].argmin()]
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[free] -= step
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[back[j0]], back[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, n + 1))


def labels_from(indices: list[tuple[int, int]]) -> list[int]:
    """The second of each pair."""
    return [b for _, b in indices]
