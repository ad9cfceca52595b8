"""Latent Dirichlet allocation by variational Bayes, for a topic-by-word prior and, in steps of the built-in online model, for a symmetric one.

Documents are packed once into blocks of about equal length, so a pass is a few products of small matrices a block. A
document leaves the inner iteration when it has converged itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.materialize import kept


def doc_rows(bow: DataFrame) -> DataFrame:
    """(doc_id, ids, counts): a sparse row a document."""
    e = bow.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("token_id", "tf"))).alias("e"))
    return e.select("doc_id", F.col("e.token_id").alias("ids"), F.col("e.tf").cast("array<double>").alias("counts"))


#: Cells (words of documents, filled up to the block's length) of a block.
CELLS = 16384


def packed(bow: DataFrame) -> DataFrame:
    """(n, ids, counts): blocks of documents of about the same number of words, as bytes, filled up with word 0 of count 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["ids"].str.len().to_numpy()
            step = np.maximum(1, 2.0 ** np.floor(np.log2(np.maximum(size, 1)) - 3)).astype(int)  # at most an eighth is filled up
            width = -(-size // step) * step
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                for at in range(0, len(rows), max(1, CELLS // w)):
                    some = rows[at : at + max(1, CELLS // w)]
                    there, ids, counts = np.arange(w) < size[some, None], np.zeros((len(some), w), np.int32), np.zeros((len(some), w))
                    ids[there], counts[there] = np.concatenate(b["ids"].iloc[some].to_list()), np.concatenate(b["counts"].iloc[some].to_list())
                    yield pd.DataFrame({"n": [len(some)], "ids": [ids.tobytes()], "counts": [counts.tobytes()]})

    return doc_rows(bow).mapInPandas(run, "n int, ids binary, counts binary")


def symmetric(bow: DataFrame, n_words: int, topics: int = 104, passes: int = 10, seed: int = 0) -> DataFrame:
    """(topic, token_id, weight): topic-word weights, each topic's sum is 1. Priors, start, step sizes and the fitted weights of topics
    are those of the built-in online model with all documents in each batch."""
    model = MatrixPriorLDA(np.full((topics, n_words), 1.0 / topics), passes=passes, seed=seed, online=True)
    return model.fit(bow).topics(bow)


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6, then the asymptotic series."""
    x, out = np.array(x, float), 0.0
    while (small := x < 6).any():
        out = out - np.where(small, 1 / x, 0.0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 7, then Stirling's series."""
    x, out = np.array(x, float), 0.0
    while (small := x < 7).any():
        out = out - np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def _expected_log(g: np.ndarray) -> np.ndarray:
    return digamma(g) - digamma(g.sum(-1, keepdims=True))


def _psi(x: np.ndarray) -> np.ndarray:
    """Digamma in the precision of x: the recurrence over six steps as one fraction, then the asymptotic series."""
    p, y = x * (x + 5), x + 6
    r = 1 / (y * y)
    return np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240))) - (2 * x + 5) * ((3 * p + 20) * p + 24) / (p * (p + 4) * (p + 6))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function, by the same steps."""
    p, y = x * (x + 5), x + 6
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - np.log(p * (p + 4) * (p + 6))


def _trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    r = 1 / (y * y)
    return sum(1 / (x + i) ** 2 for i in range(6)) + 1 / y + r / 2 + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def _theta(gamma: np.ndarray) -> np.ndarray:
    """Expected topic weights of documents, up to a factor a document: the greatest is 1."""
    log = _psi(gamma)
    return np.exp(log - log.max(1, keepdims=True))


def document_step(own: np.ndarray, counts: np.ndarray, alpha: np.ndarray, inner: int) -> np.ndarray:
    """gamma (documents, topics) of documents with word weights `own` (documents, words, topics). A word's weights and a document's theta
    may have any factor: it cancels. A document is done when its gamma changes by less than 1e-3 on average, or after `inner` steps."""
    tiny = np.asarray(1e-30 if own.dtype == np.float32 else 1e-100, own.dtype)
    out, at = np.ones((len(own), own.shape[2]), own.dtype), np.arange(len(own))
    gamma = out.copy()
    for _ in range(inner):
        theta = _theta(gamma)
        share = counts / (np.matmul(own, theta[:, :, None])[:, :, 0] + tiny)
        last, gamma = gamma, alpha + theta * np.matmul(share[:, None, :], own)[:, 0, :]
        going = np.abs(gamma - last).mean(1) >= 1e-3
        if going.all():
            continue
        out[at] = gamma
        if not going.any():
            return out
        if going.sum() <= 0.8 * len(at):
            at, own, counts, gamma = at[going], own[going], counts[going], gamma[going]
    out[at] = gamma
    return out


class MatrixPriorLDA:
    """Batch variational Bayes whose topic-word prior is a matrix (topics, words).

    A pass broadcasts the expected word probabilities (topics x words, refused beyond MOST cells), runs the document step in
    blocks and adds up the sufficient statistics, by task and then by range of SPAN words; the driver gets their sum once.
    `online` takes the built-in online model's decreasing part of each pass's statistics and fits the topics' weights, as it does.
    """

    MOST, SPAN = 50_000_000, 4096

    def __init__(self, eta: np.ndarray, alpha: float | None = None, passes: int = 10, inner: int = 30, seed: int = 0, online: bool = False) -> None:
        if eta.size > self.MOST:
            raise ValueError("topics times words exceed what is broadcast; filter the dictionary further")
        self.eta, self.alpha, self.passes, self.inner, self.seed, self.online = np.maximum(eta, 1e-12), alpha or 1.0 / len(eta), passes, inner, seed, online

    def fit(self, bow: DataFrame) -> "MatrixPriorLDA":
        rows, (k, v), inner, span = kept(packed(bow)), self.eta.shape, self.inner, self.SPAN
        self.lam, self.bounds = np.random.default_rng(self.seed).gamma(100.0, 0.01, (k, v)) + (0 if self.online else self.eta), []
        for turn in range(self.passes):
            alpha = np.broadcast_to(np.asarray(self.alpha, float), (k,)).copy()
            log_beta = _expected_log(self.lam)
            most = log_beta.max(0)
            shared = rows.sparkSession.sparkContext.broadcast((np.exp(log_beta - most).T.copy(), most))

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                beta, most = shared.value
                small, a32 = beta.astype(np.float32), alpha.astype(np.float32)
                stats, bound, log_p, docs = np.zeros((v, k)), 0.0, np.zeros(k), 0
                for b in batches:
                    for n, ids, counts in zip(b["n"], b["ids"], b["counts"]):
                        ids, counts = np.frombuffer(ids, np.int32).reshape(n, -1), np.frombuffer(counts).reshape(n, -1)
                        own = small[ids]
                        gamma = document_step(own, counts.astype(np.float32), a32, inner)
                        theta = _theta(gamma)
                        norm = np.matmul(own, theta[:, :, None])[:, :, 0].astype(float)
                        gamma, theta = gamma.astype(float), theta.astype(float)
                        low = np.flatnonzero(((norm < 1e-25) & (counts > 0)).any(1))
                        if len(low):  # beyond single precision
                            wide = beta[ids[low]]
                            gamma[low] = document_step(wide, counts[low], alpha, inner)
                            theta[low] = _theta(gamma[low])
                            norm[low] = np.matmul(wide, theta[low][:, :, None])[:, :, 0]
                        norm += 1e-100
                        cells = np.flatnonzero(counts.ravel() > 0)
                        cells = cells[np.argsort(ids.ravel()[cells], kind="stable")]
                        words, first = np.unique(ids.ravel()[cells], return_index=True)
                        stats[words] += np.add.reduceat(theta[cells // ids.shape[1]] * (counts / norm).ravel()[cells, None], first, axis=0)
                        log = _psi(gamma)
                        shift, log_theta = log.max(1), log - _psi(gamma.sum(1))[:, None]
                        bound += float((counts * (np.log(norm) + (shift - _psi(gamma.sum(1)))[:, None] + most[ids])).sum() + ((alpha - gamma) * log_theta + _lgamma(gamma) - _lgamma(alpha)).sum() + (_lgamma(alpha.sum()) - _lgamma(gamma.sum(1))).sum())
                        log_p, docs = log_p + log_theta.sum(0), docs + n
                stats = (stats * beta).T
                parts = [stats[:, at : at + span] for at in range(0, v, span)]
                there = [n for n, p in enumerate(parts) if n == 0 or p.any()]
                yield pd.DataFrame({"n": np.array(there, np.int32), "stats": [parts[n].tobytes() for n in there], "more": [np.array([bound, docs, *log_p]).tobytes() if n == 0 else np.zeros(k + 2).tobytes() for n in there]})

            def add(pdf: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({"n": pdf["n"][:1], **{c: [sum(np.frombuffer(s) for s in pdf[c]).tobytes()] for c in ("stats", "more")}})

            kind, stats, more = "n int, stats binary, more binary", np.zeros((k, v)), np.zeros(k + 2)
            for r in rows.mapInPandas(run, kind).groupBy("n").applyInPandas(add, kind).toLocalIterator():
                stats[:, r["n"] * span : (r["n"] + 1) * span] = np.frombuffer(r["stats"]).reshape(k, -1)
                more += np.frombuffer(r["more"])
            shared.unpersist()
            topics = ((self.eta - self.lam) * log_beta + log_gamma(self.lam) - log_gamma(self.eta)).sum() + (log_gamma(self.eta.sum(1)) - log_gamma(self.lam.sum(1))).sum()
            self.bounds.append(float(more[0] + topics))
            part = (1024.0 + turn + 1) ** -0.51 if self.online else 1.0
            self.lam = (1 - part) * self.lam + part * (self.eta + stats)
            if self.online and more[1]:
                self.alpha = self._fitted(alpha, more[2:] / more[1], part)
        return self

    @staticmethod
    def _fitted(alpha: np.ndarray, log_p: np.ndarray, part: float) -> np.ndarray:
        """A part of a Newton step of the topics' weights towards those that suit the documents' mean expected logarithms."""
        slope, c, q = log_p - (digamma(alpha) - digamma(alpha.sum())), _trigamma(alpha.sum()), -_trigamma(alpha)
        step = -(slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
        return alpha + part * step if (alpha + part * step > 0).all() else alpha

    def topics(self, bow: DataFrame) -> DataFrame:
        """(topic, token_id, weight), each topic's sum is 1."""
        p = self.lam / self.lam.sum(1, keepdims=True)
        shared = bow.sparkSession.sparkContext.broadcast(p)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for t in b["id"]:
                    w = shared.value[t]
                    yield pd.DataFrame({"topic": np.full(len(w), t, np.int32), "token_id": np.arange(len(w), dtype=np.int32), "weight": w})

        return bow.sparkSession.range(len(p)).mapInPandas(run, "topic int, token_id int, weight double")


def eta_matrix(eta: DataFrame, topics: int, n_words: int, floor: float = 0.0) -> np.ndarray:
    """The long table (topic, token_id, eta) as a matrix; its size is that of the model's own parameters."""
    if topics * n_words > MatrixPriorLDA.MOST:
        raise ValueError("topics times words exceed what is broadcast; filter the dictionary further")
    out = np.full((topics, n_words), floor)
    cells = eta.where((F.col("eta") > 0) & (F.col("topic") < topics) & (F.col("token_id") < n_words)).select("topic", "token_id", "eta").toArrow()
    topic, word, value = (cells.column(k).to_numpy() for k in range(3))
    out[topic, word] = np.maximum(value, floor)
    return out
