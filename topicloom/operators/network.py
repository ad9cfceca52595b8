"""Neural spectral embeddings in numpy: a network is fitted on a bounded sample on the driver and applied to all rows map-only.

The spectral network maps a vector to approximate eigenvectors of the affinity graph. Its last step is a matrix that makes
the outputs of a batch orthonormal; training alternates between renewing that matrix on one batch and a gradient step on the
Rayleigh quotient tr(Y' L Y) / m of another. Statistics that standardise the data and the rotation to true eigenvectors are
taken over all rows, not over the sample.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.materialize import kept
from .affinity import affinity
from .cluster import Mixture, kmeans, random_batch

#: The bound of the sample that a network is fitted on, on the driver.
SAMPLE = 20_000


def mapped(vectors: DataFrame, run: Callable[[np.ndarray], np.ndarray], rows: int = 2048) -> DataFrame:
    """(id, vec): a matrix function over blocks of rows."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), rows):
                part = b.iloc[at : at + rows]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vec": list(run(np.stack(part["vec"].to_numpy())).astype(np.float64))})

    return vectors.select("id", "vec").mapInPandas(blocks, f"id {vectors.schema['id'].dataType.simpleString()}, vec array<double>")


def sampled(vectors: DataFrame, most: int) -> np.ndarray:
    """At most `most` vectors in an order that hashes of their ids draw."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(most).select("vec").toPandas()["vec"]
    return np.stack(rows.to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 0))


def column_statistics(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sample deviation) of each dimension over all rows; a dimension without variance has mean 0 and deviation 1, so it stays as it is."""
    stats = vectors.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("dev")).orderBy("dim").toPandas()
    dev = stats["dev"].fillna(0).to_numpy()
    return np.where(dev > 0, stats["mean"], 0.0), np.where(dev > 0, dev, 1.0)


def batch_affinity(x: np.ndarray, n_nbg: int, scale_k: int = 15, is_local: bool = True, metric: str = "cosine") -> np.ndarray:
    """The dense Laplace-kernel affinity of one batch: the scale from cosine distances to the nearest vectors, less the first."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d, k = 1 - unit @ unit.T, min(n_nbg + 1, len(x))
    np.fill_diagonal(d, -1)  # itself comes first
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    np.fill_diagonal(d, 0)
    far = np.take_along_axis(d, near, 1)
    far = np.maximum(far - far[:, :1], 0)
    scale = np.median(far, axis=1, keepdims=True) if is_local else np.full((len(x), 1), np.median(far[:, min(scale_k, k) - 1]))
    rows = np.arange(len(x))[:, None]
    if metric == "euclidean":
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0))
    w = np.zeros_like(d)
    w[rows, near[:, 1:]] = np.exp(-np.take_along_axis(d, near[:, 1:], 1) / np.maximum(scale, 1e-7))
    return (w + w.T) / 2


def batch_laplacian(w: np.ndarray, kind: str = "rw") -> np.ndarray:
    """D - W, I - W / D (`rw`) or the symmetric one; nodes without neighbours have degree 1."""
    degree = w.sum(1)
    if kind == "unnormalized":
        return np.diag(degree) - w
    degree = np.where(degree > 0, degree, 1.0)
    return np.eye(len(w)) - (w / degree[:, None] if kind == "rw" else w / np.sqrt(np.outer(degree, degree)))


def spectral_loss(lap: np.ndarray, y: np.ndarray) -> float:
    """tr(Y' L Y) / m."""
    return float((y * (lap @ y)).sum() / len(y))


class Layers:
    """Fully connected layers with their activations, in single precision."""

    def __init__(self, sizes: Sequence[int], kinds: Sequence[str], seed: int = 0) -> None:
        rng, self.kinds = np.random.default_rng(seed), list(kinds)
        reach = [1 / math.sqrt(a) for a in sizes[:-1]]
        self.weights = [rng.uniform(-r, r, (a, b)).astype(np.float32) for r, a, b in zip(reach, sizes, sizes[1:])]
        self.biases = [rng.uniform(-r, r, b).astype(np.float32) for r, b in zip(reach, sizes[1:])]

    def forward(self, x: np.ndarray, upto: int | None = None) -> list[np.ndarray]:
        """The input and each layer's output."""
        out = [x.astype(np.float32)]
        for w, b, kind in list(zip(self.weights, self.biases, self.kinds))[:upto]:
            z = out[-1] @ w + b
            out.append(np.tanh(z) if kind == "tanh" else np.maximum(z, 0) if kind == "relu" else np.where(z > 0, z, 0.01 * z) if kind == "leaky" else z)
        return out

    def backward(self, out: list[np.ndarray], g: np.ndarray) -> list[np.ndarray]:
        """Gradients of weights, then of biases, from the gradient of the last output."""
        gw, gb, g = [], [], g.astype(np.float32)
        for k in range(len(self.weights) - 1, -1, -1):
            y, kind = out[k + 1], self.kinds[k]
            if kind == "tanh":
                g = g * (1 - y * y)
            elif kind != "linear":
                g = g * np.where(y > 0, np.float32(1), np.float32(0.01 if kind == "leaky" else 0))
            gw.append(out[k].T @ g)
            gb.append(g.sum(0))
            g = g @ self.weights[k].T
        return gw[::-1] + gb[::-1]


class Adam:
    """Adam steps whose rate falls by `decay` once the watched loss hasn't improved for `patience` epochs, down to `least`."""

    def __init__(self, parameters: list[np.ndarray], rate: float, decay: float, least: float, patience: int) -> None:
        self.p, self.rate, self.decay, self.least, self.patience = parameters, rate, decay, least, patience
        self.m, self.v, self.t = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
        self.best, self.bad = math.inf, 0

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, m, v, g in zip(self.p, self.m, self.v, grads):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)

    def watch(self, loss: float) -> None:
        if loss < self.best * (1 - 1e-4):
            self.best, self.bad = loss, 0
        else:
            self.bad += 1
        if self.bad > self.patience:
            self.rate, self.bad = self.rate * self.decay, 0
        self.rate = max(self.rate, self.least)


def split(x: np.ndarray, rng: np.random.Generator, held: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(training rows, validation rows): a shuffled 90 / 10 split; tiny sets are validated on all of their rows."""
    order = rng.permutation(len(x))
    n = int(held * len(x))
    return (x[order[n:]], x[order[:n]]) if n >= 2 else (x, x)


def batches_of(x: np.ndarray, size: int, rng: np.random.Generator, least: int = 2) -> Iterator[np.ndarray]:
    """Shuffled batches; a last one of fewer than `least` rows is left out, unless it is the only one."""
    order = rng.permutation(len(x))
    for at in range(0, len(x), size):
        if at == 0 or len(x) - at >= least:
            yield x[order[at : at + size]]


class SpectralNetwork:
    """Leaky ReLU layers, a tanh layer, and the matrix that orthonormalises the outputs."""

    def __init__(self, sizes: Sequence[int], seed: int = 0) -> None:
        self.layers = Layers(sizes, ["leaky"] * (len(sizes) - 2) + ["tanh"], seed)
        self.ortho = np.eye(sizes[-1])

    def orthonormalise(self, x: np.ndarray) -> None:
        """Renews the matrix from one batch: sqrt(m) times the inverse of R in Y = Q R."""
        y = self.layers.forward(x)[-1].astype(np.float64)
        r = np.linalg.qr(y, mode="r")
        small = np.abs(np.diag(r)) < 1e-7
        r = r + np.diag(np.where(small, 1e-7 * np.where(np.diag(r) < 0, -1, 1), 0))
        self.ortho = math.sqrt(len(y)) * np.linalg.inv(r)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.layers.forward(x)[-1].astype(np.float64) @ self.ortho


class SpectralTrainer:
    """Fits a SpectralNetwork; `losses` holds each epoch's (training, validation) loss.

    Training ends after `epochs`, or when the validation loss, to seven digits, has been the same five epochs in a row. The
    weights of the epoch of least validation loss are kept, because outputs that have collapsed can make it rise again.
    """

    def __init__(self, hiddens: Sequence[int], epochs: int = 30, lr: float = 1e-3, lr_decay: float = 0.1, min_lr: float = 1e-8, patience: int = 10, batch_size: int = 2048, n_nbg: int = 30,
                 scale_k: int = 15, is_local_scale: bool = True, laplacian_kind: str = "rw", is_sparse_graph: bool = False, seed: int = 0) -> None:
        self.hiddens, self.epochs, self.lr, self.lr_decay, self.min_lr, self.patience, self.batch_size = list(hiddens), epochs, lr, lr_decay, min_lr, patience, batch_size
        self.n_nbg, self.scale_k, self.is_local_scale, self.laplacian_kind, self.is_sparse_graph, self.seed = n_nbg, scale_k, is_local_scale, laplacian_kind, is_sparse_graph, seed

    def laplacian(self, x: np.ndarray) -> np.ndarray:
        return batch_laplacian(batch_affinity(x, self.n_nbg, self.scale_k, self.is_local_scale), self.laplacian_kind)

    def _batch(self, part: np.ndarray, everyone: np.ndarray) -> np.ndarray:
        """For sparse graphs a fifth of the batch and four neighbours of each row, else the batch."""
        if not self.is_sparse_graph:
            return part
        seeds = part[: max(1, len(part) // 5)]
        d = (seeds * seeds).sum(1)[:, None] + (everyone * everyone).sum(1) - 2 * seeds @ everyone.T
        near = np.argsort(d, axis=1, kind="stable")[:, 1:5]
        return np.concatenate([seeds, everyone[near.ravel()]])

    def validate(self, net: SpectralNetwork, x: np.ndarray) -> float:
        parts = [self._batch(p, x) for p in batches_of(x, self.batch_size, np.random.default_rng(self.seed))]
        return float(np.mean([spectral_loss(self.laplacian(p), net(p)) for p in parts]))

    def train(self, x: np.ndarray) -> SpectralNetwork:
        rng = np.random.default_rng(self.seed)
        net = SpectralNetwork([x.shape[1], *self.hiddens], self.seed)
        fit, held = split(x, rng)
        adam = Adam(net.layers.weights + net.layers.biases, self.lr, self.lr_decay, self.min_lr, self.patience)
        self.losses, last, same, best = [], math.nan, 0, (math.inf, [], net.ortho)
        least = 2 * self.hiddens[-1]
        for _ in range(self.epochs):
            losses = []
            for grad, orth in zip(batches_of(fit, self.batch_size, rng, least), batches_of(fit, self.batch_size, rng, least)):
                net.orthonormalise(self._batch(orth, fit))
                part = self._batch(grad, fit)
                out, lap = net.layers.forward(part), self.laplacian(part)
                y = out[-1].astype(np.float64) @ net.ortho
                losses.append(spectral_loss(lap, y))
                adam.step(net.layers.backward(out, ((lap + lap.T) @ y / len(y)) @ net.ortho.T))
            net.orthonormalise(self._batch(fit[rng.permutation(len(fit))[: self.batch_size]], fit))
            valid = self.validate(net, held)
            self.losses.append((float(np.mean(losses)), valid))
            adam.watch(valid)
            if valid < best[0]:
                best = (valid, [p.copy() for p in adam.p], net.ortho)
            same = same + 1 if round(valid, 7) == last else 0
            last = round(valid, 7)
            if same == 5:
                break
        for p, kept_p in zip(adam.p, best[1]):
            p[...] = kept_p
        net.ortho = best[2]
        return net


class Autoencoder:
    """ReLU layers to a linear code and back, fitted to the mean squared error with a 90 / 10 split; nothing is kept between uses.

    `hiddens` ends with the width of the code.
    """

    def __init__(self, hiddens: Sequence[int] = (512, 512, 2048, 10), epochs: int = 40, lr: float = 1e-3, lr_decay: float = 0.1, min_lr: float = 1e-7, patience: int = 10, batch_size: int = 256, seed: int = 0, sample: int = SAMPLE) -> None:
        self.hiddens, self.epochs, self.lr, self.lr_decay, self.min_lr, self.patience, self.batch_size, self.seed, self.sample = list(hiddens), epochs, lr, lr_decay, min_lr, patience, batch_size, seed, sample

    def train(self, x: np.ndarray) -> "Autoencoder":
        rng, n = np.random.default_rng(self.seed), len(self.hiddens)
        sizes = [x.shape[1], *self.hiddens, *self.hiddens[-2::-1], x.shape[1]]
        self.layers = Layers(sizes, ["relu"] * (n - 1) + ["linear"] + ["relu"] * (n - 1) + ["linear"], self.seed)
        fit, held = split(x, rng)
        adam = Adam(self.layers.weights + self.layers.biases, self.lr, self.lr_decay, self.min_lr, self.patience)
        self.losses = []
        for _ in range(self.epochs):
            losses = []
            for part in batches_of(fit, self.batch_size, rng):
                out = self.layers.forward(part)
                g = out[-1] - part
                losses.append(float((g * g).mean()))
                adam.step(self.layers.backward(out, 2 * g / g.size))
            valid = self.validate(held)
            self.losses.append((float(np.mean(losses)), valid))
            adam.watch(valid)
            if adam.rate <= self.min_lr:
                break
        return self

    def validate(self, x: np.ndarray) -> float:
        return float(((self.layers.forward(x)[-1] - x) ** 2).mean())

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.layers.forward(x, len(self.hiddens))[-1]

    def fit(self, vectors: DataFrame) -> "Autoencoder":
        return self.train(sampled(vectors, self.sample))

    def embed(self, vectors: DataFrame) -> DataFrame:
        """(id, vec): the codes of all rows."""
        shared = vectors.sparkSession.sparkContext.broadcast(self)
        return mapped(vectors, lambda x: shared.value.encode(x))


class SpectralNet:
    """Spectral clustering by a network: fit on a bounded sample, embed and predict over all rows."""

    def __init__(self, n_clusters: int, should_use_ae: bool = False, is_sparse_graph: bool = False, ae_hiddens: Sequence[int] = (512, 512, 2048, 10), ae_epochs: int = 40, ae_lr: float = 1e-3,
                 ae_lr_decay: float = 0.1, ae_min_lr: float = 1e-7, ae_patience: int = 10, ae_batch_size: int = 256, spectral_hiddens: Sequence[int] = (1024, 1024, 512, 10), spectral_epochs: int = 30,
                 spectral_lr: float = 1e-3, spectral_lr_decay: float = 0.1, spectral_min_lr: float = 1e-8, spectral_patience: int = 10, spectral_batch_size: int = 2048, spectral_n_nbg: int = 30,
                 spectral_scale_k: int = 15, spectral_is_local_scale: bool = True, laplacian_kind: str = "rw", seed: int = 0, sample: int = SAMPLE) -> None:
        if not n_clusters or n_clusters < 1:
            raise ValueError("n_clusters must be a positive number")
        self.n_clusters, self.seed, self.sample = n_clusters, seed, sample
        self.autoencoder = Autoencoder(ae_hiddens, ae_epochs, ae_lr, ae_lr_decay, ae_min_lr, ae_patience, ae_batch_size, seed, sample) if should_use_ae else None
        self.trainer = SpectralTrainer(spectral_hiddens, spectral_epochs, spectral_lr, spectral_lr_decay, spectral_min_lr, spectral_patience, spectral_batch_size, spectral_n_nbg, spectral_scale_k,
                                       spectral_is_local_scale, laplacian_kind, is_sparse_graph, seed)

    def validate_hiddens(self) -> None:
        """The last layer is as wide as the number of clusters; a caller who embeds in another width doesn't ask."""
        if self.trainer.hiddens[-1] != self.n_clusters:
            raise ValueError("the last layer must be as wide as the number of clusters")

    def fit(self, vectors: DataFrame) -> "SpectralNet":
        x = sampled(vectors, self.sample)
        if not len(x):
            raise ValueError("there are no vectors to fit")
        if self.autoencoder:
            x = self.autoencoder.train(x).encode(x).astype(np.float64)
        self.network = self.trainer.train(x)
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.autoencoder.encode(x).astype(np.float64) if self.autoencoder else x

    def embed(self, vectors: DataFrame) -> DataFrame:
        """(id, vec): the network's outputs, map-only."""
        shared = vectors.sparkSession.sparkContext.broadcast(self)
        return mapped(vectors, lambda x: shared.value.network(shared.value.encode(x)))

    def predict(self, vectors: DataFrame) -> DataFrame:
        """(id, p): responsibilities of a mixture that is fitted to the embedding of these rows."""
        rows = kept(self.embed(vectors))
        return Mixture(self.n_clusters, seed=self.seed).fit(rows).predict_proba(rows)

    def predict_kmeans(self, vectors: DataFrame) -> DataFrame:
        """(id, label): the best of ten k-means runs on the embedding."""
        return kmeans(self.embed(vectors), self.n_clusters, n_init=10, seed=self.seed)

    def random_batch(self, vectors: DataFrame, size: int = 1024) -> tuple[DataFrame, DataFrame]:
        """(raw, encoded) rows of a batch that a seed draws from all rows."""
        raw = random_batch(vectors, size, self.seed)
        shared = vectors.sparkSession.sparkContext.broadcast(self)
        return raw, mapped(raw, lambda x: shared.value.encode(x))


def ritz_rotation(pairs: DataFrame, batch: int, n_nbg: int, scale_k: int, is_local: bool, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, values ascending) from the mean of V' L V over batches of (id, vec, y): V is a batch's y with unit columns, L
    the Laplacian of its vec. Every row is in one batch of about `batch` rows, so the work is linear; only small matrices meet.
    """
    n = pairs.count()
    many = max(1, n // batch)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, v = np.stack(pdf["vec"].to_numpy()), np.stack(pdf["y"].to_numpy())
        v = v / np.maximum(np.linalg.norm(v, axis=0), 1e-12)
        return pd.DataFrame({"m": [(v.T @ batch_laplacian(batch_affinity(x, n_nbg, scale_k, is_local, "euclidean"), kind) @ v).tobytes()]})

    total, count = 0.0, 0
    for r in pairs.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(many))).groupBy("_b").applyInPandas(run, "m binary").toLocalIterator():
        total, count = total + np.frombuffer(r["m"]), count + 1
    width = math.isqrt(len(total))
    inner = total.reshape(width, width) / count
    values, rotation = np.linalg.eigh((inner + inner.T) / 2)
    return rotation, values


class ScaSE:
    """A trained spectral embedding for data of any size, with fit, transform, fit_transform and get_eigenvalues.

    The network gives n_components + 1 outputs; a rotation over all rows turns them to eigenvectors, the first of which, the
    constant one, is dropped. With t > 0 each column is scaled by (1 - eigenvalue)^t, and then the rotation is always made.
    """

    def __init__(self, n_components: int, is_sparse_graph: bool = False, spectral_hiddens: Sequence[int] = (1024, 1024, 512), spectral_max_epochs: int = 100, spectral_lr: float = 1e-2,
                 spectral_lr_decay: float = 1e-4, spectral_min_lr: float = 1e-6, spectral_patience: int | None = None, spectral_batch_size: int = 512, spectral_n_nbg: int | None = None,
                 spectral_scale_k: int = 15, spectral_is_local_scale: bool = True, should_true_eigenvectors: bool = True, t: int = 0, ae_hiddens: Sequence[int] = (512, 512, 2048, 10),
                 ae_epochs: int = 40, ae_lr: float = 1e-3, ae_lr_decay: float = 0.1, ae_min_lr: float = 1e-7, ae_patience: int = 10, ae_batch_size: int = 256, should_use_ae: bool = False,
                 laplacian_kind: str = "rw", seed: int = 0, sample: int = SAMPLE) -> None:
        if not n_components or n_components < 1:
            raise ValueError("n_components must be a positive number")
        self.n, self.t, self.rotate, self.patience, self.batch = n_components, t, should_true_eigenvectors or t > 0, spectral_patience, spectral_batch_size
        self.n_nbg = spectral_n_nbg or max(5, spectral_batch_size // 200)
        self.net = SpectralNet(n_components, should_use_ae, is_sparse_graph, ae_hiddens, ae_epochs, ae_lr, ae_lr_decay, ae_min_lr, ae_patience, ae_batch_size, [*spectral_hiddens, n_components + 1],
                               spectral_max_epochs, spectral_lr, spectral_lr_decay, spectral_min_lr, 10, spectral_batch_size, self.n_nbg, spectral_scale_k, spectral_is_local_scale, laplacian_kind, seed, sample)

    def _standardised(self, vectors: DataFrame) -> DataFrame:
        mean, dev = self.mean, self.dev
        return mapped(vectors, lambda x: (x - mean) / dev)

    def fit(self, vectors: DataFrame) -> "ScaSE":
        vectors = kept(vectors.select("id", "vec"))
        n = vectors.count()
        self.mean, self.dev = column_statistics(vectors)
        trainer = self.net.trainer
        trainer.batch_size = min(self.batch, n)
        many = n // trainer.batch_size
        trainer.patience = self.patience or (10 if many <= 25 else max(1, 250 // many))
        rows = kept(self._standardised(vectors))
        self.net.fit(rows)
        if self.rotate:
            pairs = rows.join(self.net.embed(rows).withColumnRenamed("vec", "y"), "id")
            self.rotation, self.values = ritz_rotation(pairs, trainer.batch_size, self.n_nbg, trainer.scale_k, trainer.is_local_scale, trainer.laplacian_kind)
        else:
            self.rotation, self.values = np.eye(self.n + 1), np.zeros(self.n + 1)
        return self

    def transform(self, vectors: DataFrame) -> DataFrame:
        """(id, vec) of any rows, standardised as the fitted ones were; map-only."""
        shared = vectors.sparkSession.sparkContext.broadcast(self)

        def run(x: np.ndarray) -> np.ndarray:
            m = shared.value
            return (m.net.network(m.net.encode((x - m.mean) / m.dev)) @ m.rotation * np.sign(1 - m.values) ** m.t * np.abs(1 - m.values) ** m.t)[:, 1:]

        return mapped(vectors, run)

    def fit_transform(self, vectors: DataFrame) -> DataFrame:
        return self.fit(vectors).transform(vectors)

    def get_eigenvalues(self) -> np.ndarray:
        return self.values[1:]

    def grassmann_distance(self, vectors: DataFrame) -> float:
        """Distance of the embedding's subspace from that of the exact spectral embedding of the standardised rows; the number of
        neighbours grows with the rows a batch stands for."""
        from .metrics import grassmann
        from .spectral import spectral_embedding

        rows, t = kept(self._standardised(vectors)), self.net.trainer
        k = max(self.n_nbg, self.n_nbg * (rows.count() // t.batch_size))
        exact, _ = spectral_embedding(kept(affinity(rows, k, t.scale_k, t.is_local_scale)), self.n)
        return grassmann(self.transform(vectors), exact, self.n)
