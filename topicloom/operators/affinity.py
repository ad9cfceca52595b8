"""Kernel scales, kernels, affinities and Laplacians on sparse entries (i, j, w); nothing is made dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.materialize import kept
from .knn import nearest
from .vectors import cosine, dot, euclidean


def shifted(near: DataFrame) -> DataFrame:
    """Neighbour distances less the first of each row, not below zero."""
    first = near.where(F.col("rank") == 1).select("i", F.col("dist").alias("_first"))
    return near.join(first, "i").select("i", "j", "rank", F.greatest(F.col("dist") - F.col("_first"), F.lit(0.0)).alias("dist"))


def local_scale(near: DataFrame, median: bool = True) -> DataFrame:
    """(i, scale): the median (the mean of the middle two) or the greatest of each row's distances."""
    return near.groupBy("i").agg((F.expr("percentile(dist, 0.5)") if median else F.max("dist")).alias("scale"))


def global_scale(near: DataFrame, k: int = 2, median: bool = True) -> DataFrame:
    """(scale), one row: the median or greatest distance of all k-th neighbours."""
    return near.where(F.col("rank") == k).agg((F.expr("percentile(dist, 0.5)") if median else F.max("dist")).alias("scale"))


def kernel(kind: str, d: Column, scale: Column) -> Column:
    """gaussian exp(-d^2 / s^2), laplace exp(-d / s), or t 1 / (1 + d^2), which has no scale."""
    s = F.greatest(scale, F.lit(1e-7))
    if kind == "gaussian":
        return F.exp(-d * d / (s * s))
    if kind == "laplace":
        return F.exp(-d / s)
    if kind == "t":
        return 1.0 / (1.0 + d * d)
    raise ValueError(f"unknown kernel {kind!r}")


def symmetrised(entries: DataFrame) -> DataFrame:
    """(i, j, w): half the sum with the transpose, so an entry that stands one way keeps half its weight."""
    half = entries.select("i", "j", (F.col("w") / 2).alias("w"))
    return half.union(half.select("j", "i", "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))


def pair_distances(near: DataFrame, vectors: DataFrame, metric: str) -> DataFrame:
    """Adds `d`, the distance in another metric, to neighbour rows."""
    a, b = vectors.select(F.col("id").alias("i"), F.col("vec").alias("_a")), vectors.select(F.col("id").alias("j"), F.col("vec").alias("_b"))
    d = euclidean("_a", "_b") if metric == "euclidean" else 1 - cosine("_a", "_b")
    return near.join(a, "i").join(b, "j").withColumn("d", d).drop("_a", "_b")


def affinity(vectors: DataFrame, n_nbg: int = 10, scale_k: int = 2, is_local: bool = True, kind: str = "laplace", metric: str = "euclidean", near: DataFrame | None = None) -> DataFrame:
    """(i, j, w): kernel weights between each vector and its `n_nbg` cosine neighbours, the nearest (itself) left out, symmetrised.

    The scale comes from the neighbours' cosine distances, the kernel's distance is `metric`; by default they differ, as in
    the settings that this reproduces. `near` gives the neighbours (i, j, rank, dist), themselves included, where an index has
    found them; by default they are exact, in quadratic work.
    """
    near = shifted(kept(nearest(vectors, n_nbg + 1, "cosine") if near is None else near))
    pairs = pair_distances(near.where(F.col("rank") > 1), vectors, metric)
    scaled = pairs.join(local_scale(near), "i") if is_local else pairs.crossJoin(F.broadcast(global_scale(near, scale_k)))  # one row
    return symmetrised(scaled.select("i", "j", kernel(kind, F.col("d"), F.col("scale")).alias("w")))


def union_affinity(vectors: DataFrame, n_neighbors: int = 10) -> DataFrame:
    """(i, j, w): exp(-d^2) to the n - 1 nearest others in Euclidean distance, the same both ways, not averaged."""
    return united(nearest(vectors, n_neighbors - 1, "euclidean", include_self=False))


def united(near: DataFrame) -> DataFrame:
    """(i, j, w): exp(-d^2) of neighbour rows, the same both ways."""
    one = near.select("i", "j", F.exp(-F.col("dist") * F.col("dist")).alias("w"))
    return one.union(one.select("j", "i", "w")).groupBy("i", "j").agg(F.max("w").alias("w"))


def degrees(w: DataFrame) -> DataFrame:
    return w.groupBy("i").agg(F.sum("w").alias("degree"))


def laplacian(w: DataFrame, kind: str = "unnormalized") -> DataFrame:
    """(i, j, l): D - W, I - W / D (`rw`) or I - D^-1/2 W D^-1/2 (`symmetric`); of a node of degree zero only the diagonal stands, 0 or 1."""
    deg = degrees(w)
    unnormalized = kind == "unnormalized"
    diagonal = deg.select("i", F.col("i").alias("j"), (F.col("degree") if unnormalized else F.lit(1.0)).alias("l"))
    rows = w.join(deg, "i")
    if unnormalized:
        off = rows.select("i", "j", (-F.col("w")).alias("l"))
    elif kind == "rw":
        off = rows.select("i", "j", F.coalesce(F.try_divide(-F.col("w"), F.col("degree")), F.lit(0.0)).alias("l"))
    else:
        rows = rows.join(deg.select(F.col("i").alias("j"), F.col("degree").alias("_dj")), "j")
        off = rows.select("i", "j", F.coalesce(F.try_divide(-F.col("w"), F.sqrt(F.col("degree") * F.col("_dj"))), F.lit(0.0)).alias("l"))
    return diagonal.union(off).groupBy("i", "j").agg(F.sum("l").alias("l"))


def rayleigh_loss(lap: DataFrame, embedding: DataFrame) -> DataFrame:
    """(loss), one row: tr(Y' L Y) / m for the embedding (id, vec) of m rows."""
    a, b = embedding.select(F.col("id").alias("i"), F.col("vec").alias("_a")), embedding.select(F.col("id").alias("j"), F.col("vec").alias("_b"))
    total = lap.join(a, "i").join(b, "j").agg(F.sum(F.col("l") * dot("_a", "_b")).alias("s"))
    return total.crossJoin(embedding.agg(F.count(F.lit(1)).alias("m"))).select(F.try_divide("s", F.col("m").cast("double")).alias("loss"))  # one row each
