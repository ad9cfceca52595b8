"""Clustering of embedded vectors (id, vec): k-means, and Gaussian mixtures by block EM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.materialize import kept


def kmeans(vectors: DataFrame, k: int, n_init: int = 10, seed: int = 0, max_iter: int = 20) -> DataFrame:
    """(id, label): the best of `n_init` seeds by within-cluster cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = kept(vectors.select("id", array_to_vector("vec").alias("features")))
    models = [KMeans(k=k, seed=seed + s, maxIter=max_iter).fit(rows) for s in range(n_init)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select("id", F.col("prediction").alias("label"))


def spark_mixture(vectors: DataFrame, k: int, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """(id, p) by the built-in mixture; it collapses silently on unit-variance data beyond 20 dimensions, so wider data is refused."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = kept(vectors.select("id", array_to_vector("vec").alias("features"), F.size("vec").alias("d")))
    if rows.agg(F.max("d")).first()[0] > 20:
        raise ValueError("the built-in mixture is for at most 20 dimensions; use Mixture")
    return GaussianMixture(k=k, seed=seed, maxIter=max_iter).fit(rows).transform(rows).select("id", vector_to_array("probability").alias("p"))


class Mixture:
    """A full-covariance Gaussian mixture: log-sum-exp responsibilities, covariance floor, k-means start.

    A pass adds up statistics by partition and then by component, and the driver turns the k sums into parameters.
    """

    def __init__(self, k: int, max_iter: int = 30, tol: float = 1e-3, reg_covar: float = 1e-6, seed: int = 0, sample: int = 20_000) -> None:
        self.k, self.max_iter, self.tol, self.reg, self.seed, self.sample = k, max_iter, tol, reg_covar, seed, sample

    @staticmethod
    def _log_density(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(weights)))
        for k in range(len(weights)):
            c = np.linalg.cholesky(covs[k])
            z = np.linalg.solve(c, (x - means[k]).T)
            out[:, k] = np.log(weights[k]) - 0.5 * (z * z).sum(0) - np.log(np.diag(c)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    @staticmethod
    def _responsibilities(log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = log.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        return np.exp(log - total[:, None]), total

    def _start(self, x: np.ndarray) -> np.ndarray:
        """Centres by k-means++ and ten rounds on the bounded sample."""
        rng = np.random.default_rng(self.seed)
        c = x[[rng.integers(len(x))]]
        while len(c) < self.k:
            far = ((x[:, None] - c) ** 2).sum(2).min(1) if len(x) * len(c) < 5e6 else np.min([((x - m) ** 2).sum(1) for m in c], 0)
            c = np.r_[c, x[[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))]]]
        for _ in range(10):
            near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
            c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(self.k)])
        return c

    def fit(self, vectors: DataFrame) -> "Mixture":
        rows = kept(vectors.select("id", "vec"))
        x = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(self.sample).collect()], float)
        d, n = x.shape[1], rows.count()
        centres = self._start(x)
        near = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
        spread = np.atleast_2d(np.cov(x.T)) * 0.0 + np.diag(np.maximum(np.var(x - centres[near], axis=0), self.reg))
        self.weights, self.means, self.covs = np.maximum(np.bincount(near, minlength=self.k) / len(x), 1e-3), centres, np.array([spread + self.reg * np.eye(d)] * self.k)
        self.weights, self.log_likelihood = self.weights / self.weights.sum(), []
        for _ in range(self.max_iter):
            nk, s, ss, ll = self._pass(rows, d)
            self.log_likelihood.append(ll)
            live = np.maximum(nk, 1e-9)
            self.weights = np.maximum(nk / n, 1e-12) / np.maximum(nk / n, 1e-12).sum()
            self.means = s / live[:, None]
            self.covs = ss / live[:, None, None] - np.einsum("ki,kj->kij", self.means, self.means) + self.reg * np.eye(d)
            if len(self.log_likelihood) > 1 and abs(ll - self.log_likelihood[-2]) < self.tol * n:
                break
        return self

    def _pass(self, rows: DataFrame, d: int):
        shared, k = rows.sparkSession.sparkContext.broadcast((self.weights, self.means, self.covs)), self.k

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, bound = np.zeros((k, 1 + d + d * d)), 0.0
            for b in batches:
                for at in range(0, len(b), 4096):
                    x = np.stack(b["vec"].iloc[at : at + 4096].to_numpy())
                    r, ll = Mixture._responsibilities(Mixture._log_density(x, *shared.value))
                    total[:, 0] += r.sum(0)
                    total[:, 1 : d + 1] += r.T @ x
                    for c in range(k):
                        total[c, d + 1 :] += ((x * r[:, c : c + 1]).T @ x).ravel()
                    bound += ll.sum()
            yield pd.DataFrame({"c": np.arange(k, dtype=np.int32), "t": [t.tobytes() for t in total], "ll": np.r_[bound, np.zeros(k - 1)]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"c": pdf["c"][:1], "t": [sum(np.frombuffer(t) for t in pdf["t"]).tobytes()], "ll": [pdf["ll"].sum()]})

        kind, t, ll = "c int, t binary, ll double", np.zeros((k, 1 + d + d * d)), 0.0
        for r in rows.mapInPandas(run, kind).groupBy("c").applyInPandas(add, kind).toLocalIterator():
            t[r["c"]], ll = np.frombuffer(r["t"]), ll + r["ll"]
        return t[:, 0], t[:, 1 : d + 1], t[:, d + 1 :].reshape(k, d, d), ll

    def predict_proba(self, vectors: DataFrame) -> DataFrame:
        """(id, p): responsibilities, each row's sum is 1."""
        shared = vectors.sparkSession.sparkContext.broadcast((self.weights, self.means, self.covs))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    r, _ = Mixture._responsibilities(Mixture._log_density(np.stack(b["vec"].to_numpy()), *shared.value))
                    yield pd.DataFrame({"id": b["id"].to_numpy(), "p": list(r)})

        return vectors.select("id", "vec").mapInPandas(run, f"id {vectors.schema['id'].dataType.simpleString()}, p array<double>")


def random_batch(vectors: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """`size` rows in an order drawn from a seed and the id."""
    return vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(size)
