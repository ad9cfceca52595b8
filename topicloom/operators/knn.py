"""Exact nearest neighbours in blocks, top-k look-ups, and an approximate join for larger collections.

The exact operator compares every two blocks of at most BLOCK vectors as one matrix product in a task of its own: no task
and no broadcast grows with the collection. Its work is quadratic; the hashing join serves where that is too much.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .vectors import cosine

BLOCK = 4096


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    if metric == "euclidean":
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))
    raise ValueError(f"unknown metric {metric!r}")


def lowest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k lowest finite values of each row, in order, ties to the first column."""
    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < d.shape[1] else np.inf
    r, c = np.nonzero((d <= kth) & np.isfinite(d))
    order = np.lexsort((c, d[r, c], r))
    r, c = r[order], c[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first]


def block_pairs(vectors: DataFrame, blocks: int, queries: DataFrame | None = None) -> DataFrame:
    """(i, j, ask, id, vec): every query (by default every vector) once for each block, and every vector once as a target of each."""
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = vectors.select("id", "vec", own.alias("own"))
    asking = rows if queries is None else queries.select("id", "vec", own.alias("own"))
    ask = asking.select(F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"), F.lit(True).alias("ask"), "id", "vec")
    give = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), F.col("own").alias("j"), F.lit(False).alias("ask"), "id", "vec")
    return ask.union(give)


def nearest(vectors: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK, include_self: bool = True, queries: DataFrame | None = None) -> DataFrame:
    """(i, j, rank, dist): the k nearest of every vector, or of every row of `queries`; rank from 1, ties to the smaller id; the vector itself counts unless excluded.

    k is capped at the number of vectors; all-zero vectors have no cosine and neither ask nor answer.
    """
    kind = vectors.schema["id"].dataType
    out = T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("dist", T.DoubleType())])
    blocks = max(1, math.ceil(vectors.count() / block))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf["ask"]], pdf[~pdf["ask"]].sort_values("id", ignore_index=True)
        if not len(q) or not len(t):
            return pd.DataFrame({"i": pdf["id"][:0], "j": pdf["id"][:0], "dist": np.zeros(0)})
        x, y, ids = np.stack(q["vec"].to_numpy()), np.stack(t["vec"].to_numpy()), t["id"].to_numpy()
        parts = []
        for at in range(0, len(q), 512):
            d, own = distances(x[at : at + 512], y, metric), q["id"].to_numpy()[at : at + 512]
            same = ids == own[:, None]
            d[same] = 0 if include_self and metric == "euclidean" else d[same] if include_self else np.nan
            r, c = lowest(np.round(np.where(np.isnan(d), np.inf, d), 12), k)
            parts.append(pd.DataFrame({"i": own[r], "j": ids[c], "dist": d[r, c]}))
        return pd.concat(parts)

    found = block_pairs(vectors, blocks, queries).groupBy("i", "j").applyInPandas(search, out)
    order = Window.partitionBy("i").orderBy(F.round("dist", 12), "j")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "j", "rank", "dist")


def nearest_sparse(rows: DataFrame, k: int, block: int = BLOCK, slice_: int = 1024) -> DataFrame:
    """(i, j, rank, dist): the k nearest others in Euclidean distance of sparse vectors (id, dims, ws), dims long, distinct in a row;
    ties to the smaller id. A task makes no more than `slice_` dimensions dense at once."""
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("dist", T.DoubleType())])

    def flat(pdf: pd.DataFrame):
        size = np.array([len(v["dims"]) for v in pdf["vec"]])
        return len(pdf), np.repeat(np.arange(len(pdf)), size), *(np.concatenate([np.zeros(0), *(np.asarray(v[c]) for v in pdf["vec"])]) for c in ("dims", "ws"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf["ask"]], pdf[~pdf["ask"]].sort_values("id", ignore_index=True)
        if not len(q) or not len(t):
            return pd.DataFrame({"i": pdf["id"][:0], "j": pdf["id"][:0], "dist": np.zeros(0)})
        sides = (flat(q), flat(t))
        dims = np.intersect1d(sides[0][2], sides[1][2])
        inner, norms = np.zeros((len(q), len(t))), [np.bincount(r, w * w, n) for n, r, _, w in sides]
        for at in range(0, len(dims), slice_):
            part, both = dims[at : at + slice_], []
            for n, r, d, w in sides:
                m, on = np.zeros((n, len(part))), np.isin(d, part)
                m[r[on], np.searchsorted(part, d[on])] = w[on]
                both.append(m)
            inner += both[0] @ both[1].T
        d = np.round(np.sqrt(np.maximum(norms[0][:, None] + norms[1] - 2 * inner, 0)), 12)
        d[q["id"].to_numpy()[:, None] == t["id"].to_numpy()] = np.inf
        r, c = lowest(d, k)
        return pd.DataFrame({"i": q["id"].to_numpy()[r], "j": t["id"].to_numpy()[c], "dist": d[r, c]})

    vectors = rows.select("id", F.struct("dims", "ws").alias("vec"))
    found = block_pairs(vectors, max(1, math.ceil(rows.count() / block))).groupBy("i", "j").applyInPandas(search, out)
    order = Window.partitionBy("i").orderBy("dist", "j")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "j", "rank", "dist")


def pairwise(vectors: DataFrame, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(i, j, dist) of all pairs: the dense matrix, for collections that are meant to have one."""
    kind = vectors.schema["id"].dataType
    blocks = max(1, math.ceil(vectors.count() / block))
    out = T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("dist", T.DoubleType())])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf["ask"]], pdf[~pdf["ask"]]
        if not len(q) or not len(t):
            return pd.DataFrame({"i": pdf["id"][:0], "j": pdf["id"][:0], "dist": np.zeros(0)})
        d = distances(np.stack(q["vec"].to_numpy()), np.stack(t["vec"].to_numpy()), metric)
        d[q["id"].to_numpy()[:, None] == t["id"].to_numpy()] = 0
        return pd.DataFrame({"i": np.repeat(q["id"].to_numpy(), len(t)), "j": np.tile(t["id"].to_numpy(), len(q)), "dist": d.ravel()})

    return block_pairs(vectors, blocks).groupBy("i", "j").applyInPandas(fill, out)


def most_similar(vectors: DataFrame, query: Sequence, k: int = 5) -> DataFrame:
    """(query, id, rank, score): the k vectors of greatest cosine for each query id, itself excluded, ties to the smaller id.

    The queries are a list whose vectors are broadcast, up to BLOCK of them; an unknown id has no rows.
    """
    if len(query) > BLOCK:
        raise ValueError(f"more than {BLOCK} queries; ask nearest(queries=...)")
    asked = F.broadcast(vectors.where(F.col("id").isin(*query)).select(F.col("id").alias("query"), F.col("vec").alias("qvec")))
    scores = vectors.join(asked, F.col("id") != F.col("query")).select("query", "id", cosine("vec", "qvec").alias("score")).where(F.col("score").isNotNull())
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "id", "rank", "score")


def approximate(vectors: DataFrame, k: int, tables: int = 4, width: float = 1.0, radius: float = 2.0, seed: int = 7) -> DataFrame:
    """(i, j, rank, dist): Euclidean neighbours within `radius` that meet in a random-projection hash, nearest first."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("id", array_to_vector("vec").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=tables, bucketLength=width, seed=seed).fit(rows)
    close = model.approxSimilarityJoin(rows, rows, radius, "dist").select(F.col("datasetA.id").alias("i"), F.col("datasetB.id").alias("j"), "dist").where(F.col("i") != F.col("j"))
    order = Window.partitionBy("i").orderBy("dist", "j")
    return close.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "j", "rank", "dist")


def sparse_batch(vectors: DataFrame, neighbours: DataFrame, size: int, near: int = 4) -> DataFrame:
    """(id): a batch for sparse graphs, a fifth of `size` vectors in order of id and `near` neighbours of each; ids may repeat."""
    seeds = vectors.orderBy("id").limit(max(1, size // 5)).select("id")
    more = neighbours.where(F.col("rank") <= near).join(seeds.withColumnRenamed("id", "i"), "i", "left_semi").select(F.col("j").alias("id"))
    return seeds.union(more)
