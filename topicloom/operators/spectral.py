"""Spectral embeddings of sparse symmetric affinities (i, j, w).

The random-walk Laplacian is not symmetric, so its eigenvectors come from those of the symmetric one: u = D^-1/2 v. Graphs of
up to EXACT nodes (counted) are solved on the driver; larger ones by subspace iteration with a Chebyshev filter on S, in
which the block lives in a table, a multiplication is a join and a group-by, and only width x width matrices reach the
driver. It ends when every residual is below a tolerance, and is an error if that doesn't happen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.materialize import discarded, kept, written
from .affinity import affinity, degrees
from .knn import distances

#: Nodes up to which a graph is solved on the driver; vectors that serve as landmarks (both are bounds of what is collected).
EXACT, LANDMARKS = 2048, 1024
#: Multiplications in one round of the filter.
DEGREE = 8


def small_gram(rows: DataFrame, width: int, others: DataFrame | None = None) -> np.ndarray:
    """A'A, or A'B for two tables with the same ids, of tables (id, vec): a small matrix a partition, added up."""
    pairs = rows.select("vec", F.col("vec").alias("other")) if others is None else rows.join(others.select("id", F.col("vec").alias("other")), "id").select("vec", "other")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for b in batches:
            if len(b):
                total = total + np.stack(b["vec"].to_numpy()).T @ np.stack(b["other"].to_numpy())
        if not np.isscalar(total):
            yield pd.DataFrame({"r": np.repeat(np.arange(total.shape[0]), total.shape[1]), "c": np.tile(np.arange(total.shape[1]), total.shape[0]), "x": total.ravel()})

    got = pairs.mapInPandas(run, "r int, c int, x double").groupBy("r", "c").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((width, max([width, *(r["c"] + 1 for r in got)])))
    for r in got:
        out[r["r"], r["c"]] = r["x"]
    return out


def times(rows: DataFrame, m: np.ndarray) -> DataFrame:
    """(id, vec @ m)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"].to_numpy(), "vec": list(np.stack(b["vec"].to_numpy()) @ m)})

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, vec array<double>")


def times_shift(rows: DataFrame, mean: np.ndarray, dev: np.ndarray) -> DataFrame:
    """(id, (vec - mean) / dev)."""
    from .network import mapped

    return mapped(rows, lambda x: (x - mean) / dev)


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns with a positive entry of greatest size."""
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def _normal(w: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of S = D^-1/2 W D^-1/2, degrees); nodes of degree zero drop out."""
    deg = degrees(w).where(F.col("degree") > 0)
    s = w.join(deg, "i").join(deg.select(F.col("i").alias("j"), F.col("degree").alias("_d")), "j").select("i", "j", (F.col("w") / F.sqrt(F.col("degree") * F.col("_d"))).alias("s"))
    return s, deg


def _orthonormal(y: DataFrame, width: int) -> DataFrame:
    value, vec = np.linalg.eigh(small_gram(y, width))
    return times(y, vec / np.sqrt(np.maximum(value, 1e-14 * value.max())))


def _multiplied(s: DataFrame, y: DataFrame, width: int) -> DataFrame:
    """S Y as (id, vec), for a table of entries (i, j, s) and a block (id, vec)."""
    return s.join(y.select(F.col("id").alias("j"), "vec"), "j").groupBy(F.col("i").alias("id")).agg(F.array(*[F.sum(F.col("s") * F.col("vec")[d]) for d in range(width)]).alias("vec"))


def _combined(*terms: tuple[float, DataFrame]) -> DataFrame:
    """The weighted sum of blocks (id, vec) with the same ids."""
    def scaled(weight: float, block: DataFrame) -> DataFrame:
        return block.select("id", F.transform("vec", lambda x: x * F.lit(float(weight))).alias("vec"))

    out = scaled(*terms[0])
    for term in terms[1:]:
        out = out.join(scaled(*term).withColumnRenamed("vec", "_v"), "id").select("id", F.zip_with("vec", "_v", lambda x, y: x + y).alias("vec"))
    return out


def eigenvectors(w: DataFrame, n: int, tol: float = 1e-7, most: int = 200, seed: int = 11) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """((id, vec), eigenvalues ascending, degrees): the n smallest eigenpairs of the symmetric Laplacian, the trivial one first.

    Beyond EXACT nodes each vector's residual |L v - value v| is below `tol`, or the call fails after `most` rounds.
    """
    spark = w.sparkSession
    s, deg = _normal(w)
    deg = kept(deg)
    m = deg.count()
    n = min(n, m)
    if m <= EXACT:
        ids = np.array(sorted(r["i"] for r in deg.collect()))
        e = s.toPandas()
        dense = np.zeros((m, m))
        dense[np.searchsorted(ids, e["i"]), np.searchsorted(ids, e["j"])] = e["s"]
        value, vec = np.linalg.eigh(np.eye(m) - (dense + dense.T) / 2)
        vec = _signed(vec[:, :n])
        kind = f"id {w.schema['i'].dataType.simpleString()}, vec array<double>"
        return spark.createDataFrame([(i.item(), v) for i, v in zip(ids, vec.tolist())], kind), value[:n], deg
    s, width = kept(s), n + min(8, m - n)
    y = deg.select(F.col("i").alias("id"), F.array(*[(F.pmod(F.xxhash64("i", F.lit(seed + d)), F.lit(1_000_003)) / 500_001.5 - 1) for d in range(width)]).alias("vec"))
    for _ in range(most):
        y = written(_orthonormal(y, width))
        z = written(_multiplied(s, y, width))
        inner = small_gram(y, width, z)
        theta, rotation = np.linalg.eigh((inner + inner.T) / 2)
        theta, rotation = theta[::-1], rotation[:, ::-1]
        length = np.diag(rotation.T @ small_gram(z, width) @ rotation)
        if np.sqrt(np.maximum(length - theta**2, 0))[:n].max() < tol:
            return written(times(y, rotation[:, :n])), 1 - theta[:n], deg
        # Chebyshev polynomials of S grow outside [-1, the block's smallest value] and stay small inside
        centre, half = (theta[-1] - 1) / 2, max((theta[-1] + 1) / 2, 1e-3)
        before, now = y, written(_combined((1 / half, z), (-centre / half, y)))
        for _ in range(DEGREE - 1):
            after = written(_combined((2 / half, _multiplied(s, now, width)), (-2 * centre / half, now), (-1, before)))
            if before is not y:
                discarded(before)
            before, now = now, after
        for block in (y, z, before):
            discarded(block)
        y = now
    raise RuntimeError(f"no convergence to {tol} in {most} rounds")


def spectral_embedding(w: DataFrame, n: int, drop_first: bool = True) -> tuple[DataFrame, np.ndarray]:
    """((id, vec), eigenvalues): eigenvectors of the random-walk Laplacian, without the constant one."""
    vec, value, deg = eigenvectors(w, n + drop_first)
    skip = int(drop_first)
    scaled = vec.join(deg.select(F.col("i").alias("id"), "degree"), "id").select("id", F.transform(F.slice("vec", 1 + skip, n), lambda x: x / F.sqrt("degree")).alias("vec"))
    return scaled, value[skip:]


def diffusion_map(w: DataFrame, n: int, t: int = 1) -> tuple[DataFrame, np.ndarray]:
    """The spectral embedding with each column times (1 - eigenvalue)^t."""
    vec, value = spectral_embedding(w, n)
    return vec.select("id", F.array(*[F.col("vec")[d] * float((1 - v) ** t) for d, v in enumerate(value)]).alias("vec")), value


class ScalableEmbedding:
    """A spectral embedding that carries over to new vectors, with fit, transform, fit_transform and get_eigenvalues.

    A bounded sample of landmarks is embedded exactly; every other vector takes the affinity-weighted mean of its nearest
    landmarks' rows divided by 1 minus the eigenvalue (the extension of Nystrom). Mean and deviation are those of all rows, and
    a Rayleigh-Ritz step over batches of all rows turns the result to eigenvectors and gives the values. network.ScaSE is
    trained to the same end and has the same contract.
    """

    def __init__(self, n_components: int, n_nbg: int = 10, scale_k: int = 2, is_local_scale: bool = True, t: int = 0, kind: str = "laplace", landmarks: int = LANDMARKS) -> None:
        if not n_components or n_components < 1:
            raise ValueError("n_components must be a positive number")
        self.n, self.n_nbg, self.scale_k, self.is_local, self.t, self.kind, self.landmarks = n_components, n_nbg, scale_k, is_local_scale, t, kind, landmarks

    def fit(self, vectors: DataFrame) -> "ScalableEmbedding":
        from .network import column_statistics, ritz_rotation

        vectors = kept(vectors.select("id", "vec"))
        self.mean, self.dev = column_statistics(vectors)
        rows = sorted(vectors.orderBy(F.xxhash64("id"), "id").limit(self.landmarks).collect(), key=lambda r: r["id"])
        self.points = (np.array([r["vec"] for r in rows]) - self.mean) / self.dev
        here = vectors.sparkSession.createDataFrame([(r["id"], p) for r, p in zip(rows, self.points.tolist())], vectors.select("id", "vec").schema)
        w = kept(affinity(here, self.n_nbg, self.scale_k, self.is_local, self.kind))
        vec, values = spectral_embedding(w, self.n)
        got = {r["id"]: r["vec"] for r in vec.collect()}
        self.rows, self.shrink = np.array([got.get(r["id"], [0.0] * len(values)) for r in rows]), np.maximum(1 - values, 1e-6)
        self.rotation, self.values = np.eye(len(values)), np.zeros(len(values))
        pairs = times_shift(vectors, self.mean, self.dev).join(self.transform(vectors).withColumnRenamed("vec", "y"), "id")
        self.rotation, self.values = ritz_rotation(pairs, 512, self.n_nbg, self.scale_k, self.is_local, "rw")
        return self

    def transform(self, vectors: DataFrame) -> DataFrame:
        """(id, vec): map-only, the landmarks are broadcast."""
        shared = vectors.sparkSession.sparkContext.broadcast((self.points, self.rows, self.shrink, self.mean, self.dev, self.n_nbg, self.rotation * (1 - self.values) ** self.t))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            points, rows, shrink, mean, dev, k, power = shared.value
            for b in batches:
                for at in range(0, len(b), 1024):
                    part = b.iloc[at : at + 1024]
                    x = (np.stack(part["vec"].to_numpy()) - mean) / dev
                    d = distances(x, points, "euclidean")
                    near = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, : k + 1]
                    dist = np.take_along_axis(d, near, 1)
                    scale = np.maximum(np.median(dist, 1, keepdims=True), 1e-7)
                    w = np.exp(-(dist - dist.min(1, keepdims=True)) / scale)
                    y = np.einsum("nk,nkc->nc", w / w.sum(1, keepdims=True), rows[near]) / shrink @ power
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "vec": list(y)})

        return vectors.select("id", "vec").mapInPandas(run, f"id {vectors.schema['id'].dataType.simpleString()}, vec array<double>")

    def fit_transform(self, vectors: DataFrame) -> DataFrame:
        return self.fit(vectors).transform(vectors)

    def get_eigenvalues(self) -> np.ndarray:
        return self.values

    def grassmann_distance(self, vectors: DataFrame) -> float:
        """Distance of the embedding's subspace from the exact one's."""
        from .metrics import grassmann

        exact, _ = spectral_embedding(kept(affinity(vectors, self.n_nbg, self.scale_k, self.is_local, self.kind)), self.n)
        return grassmann(self.transform(vectors), exact, self.n)


def pca(vectors: DataFrame, k: int) -> DataFrame:
    """(id, vec): scores on the first k principal components, of centred data."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector("vec").alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(rows).transform(rows)
    return PCA(k=k, inputCol="c", outputCol="p").fit(centred).transform(centred).select("id", vector_to_array("p").alias("vec"))


def singular_vectors(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((id, vec), singular values ascending) of a matrix (id, vec): left vectors in the order of their values, from its small Gram
    matrix. Vectors of a value that is zero are zero."""
    first = rows.first()
    if not first:
        return rows.select("id", "vec"), np.zeros(0)
    value, right = np.linalg.eigh(small_gram(rows, len(first["vec"])))
    size = np.sqrt(np.maximum(value, 0))
    return times(rows, right * np.where(size > 1e-9 * max(size.max(), 1e-300), 1 / np.maximum(size, 1e-300), 0.0)), size


def random_walk_embedding(w: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """Eigenvectors of the random-walk Laplacian with the trivial one, scaled by 1 minus their eigenvalues."""
    from .vectors import eigen_scale

    vec, value = spectral_embedding(w, n, drop_first=False)
    return eigen_scale(vec, value.tolist()), value
