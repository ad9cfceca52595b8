"""The three entry points: an embedding prior (A), a word graph (B) and the prior for a topic model (C)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import tokenized
from ..operators import cluster, dictionary as dic, graph, knn, lda, network, prior, spectral, tfidf, vectors as vec
from ..operators.affinity import affinity, united
from ..operators.prior import soft_prior
from ..sources.corpus import read_corpus, read_vectors
from .materialize import kept

#: scase and sn train a network, landmarks extends an exact embedding of a sample; the others have nothing to train but the mixture.
MODES = ("scase", "sn", "landmarks", "pca", "umap", "rw", "gmm")


@dataclass
class Settings:
    mode: str = "scase"
    topics: int = 100
    components: int = 10
    n_nbg: int = 10
    scale_k: int = 2
    is_local_scale: bool = True
    drop_index_zero: bool = True
    epochs: int = 50
    sn_epochs: int = 30
    rate: float = 1e-4
    hiddens: tuple[int, ...] = (1024, 1024, 512)
    bounds: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")


def prepare_corpus(corpus: DataFrame, words: DataFrame | None = None, **bounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dictionary, filtered corpus, vocabulary) of a raw corpus (doc_id, text)."""
    tokens = kept(tokenized(corpus))
    dictionary, text = dic.filtered_corpus(tokens, tokens.count(), words, **bounds)
    return dictionary, text, dictionary.select("token")


def aligned_vectors(corpus: DataFrame, word_vectors: DataFrame, settings: Settings) -> DataFrame:
    """(ix, word, vec) of the corpus words that have a vector."""
    known = word_vectors.where(F.col("word").isNotNull()).select("word")
    dictionary, _, vocabulary = prepare_corpus(corpus, known, **settings.bounds)
    return vec.align(vocabulary.withColumnRenamed("token", "word"), word_vectors, settings.drop_index_zero)


def scase_model(settings: Settings) -> network.ScaSE:
    return network.ScaSE(settings.components, spectral_hiddens=settings.hiddens, spectral_max_epochs=settings.epochs, spectral_lr=settings.rate, spectral_n_nbg=settings.n_nbg, spectral_is_local_scale=settings.is_local_scale)


def sn_model(settings: Settings) -> network.SpectralNet:
    return network.SpectralNet(settings.topics, spectral_hiddens=(*settings.hiddens, settings.components), spectral_epochs=settings.sn_epochs, spectral_n_nbg=settings.n_nbg, spectral_is_local_scale=settings.is_local_scale)


def embedded(points: DataFrame, settings: Settings) -> DataFrame:
    """(id, vec): the representation that is clustered, by mode. `umap` uses the spectral embedding of the neighbour graph in its place."""
    m, k = settings.mode, settings.components
    if m == "gmm":
        return points
    if m == "pca":
        return spectral.pca(points, 20)
    if m in ("scase", "landmarks"):
        model = scase_model(settings) if m == "scase" else spectral.ScalableEmbedding(k, settings.n_nbg, settings.scale_k, settings.is_local_scale)
        return vec.eigen_scale(model.fit_transform(points), model.get_eigenvalues().tolist())
    if m == "sn":
        return sn_model(settings).fit(points).embed(points)
    w = kept(affinity(points, settings.n_nbg, settings.scale_k, settings.is_local_scale))
    if m == "rw":
        return spectral.random_walk_embedding(w, k)[0]
    return spectral.spectral_embedding(w, 20 if m == "umap" else k)[0]


def soft_predictions(points: DataFrame, settings: Settings) -> DataFrame:
    """(ix, topic, p): responsibilities of a mixture over the embedding; no points give no rows."""
    if points.isEmpty():
        return points.select(F.col("id").alias("ix"), F.lit(0).alias("topic"), F.lit(0.0).alias("p")).limit(0)
    rows = kept(embedded(points, settings))
    p = cluster.Mixture(settings.topics).fit(rows).predict_proba(rows)
    return p.select(F.col("id").alias("ix"), F.posexplode("p").alias("topic", "p"))


def run_prior(points: DataFrame, settings: Settings) -> DataFrame:
    """(ix, topic, prior) of entry point A."""
    return soft_prior(soft_predictions(points, settings), settings.topics)


def run_embedding_prior(spark: SparkSession, corpus_path: str, kind: str, vectors_path: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Entry point A in one call: ((ix, word), (topic, ix, eta)) from a stored corpus (json, csv or parquet) and a file of word vectors."""
    words = kept(aligned_vectors(read_corpus(spark, corpus_path, kind), read_vectors(spark, vectors_path), settings))
    points = kept(vec.finite(words, "ix", "vec"))
    return words.select("ix", "word"), prior.transpose(run_prior(points, settings))


def run_topic_model(corpus: DataFrame, vectors: DataFrame, predictions: DataFrame, topics: int, words: DataFrame | None = None, passes: int = 10, **bounds) -> lda.MatrixPriorLDA:
    """Entry point C: the topic model of a tokenised corpus under the prior of saved predictions (ix, topic, p) of `vectors` (ix, word)."""
    bow, dictionary = dic.lda_input(corpus, corpus.count(), words, **bounds)
    dictionary = kept(dictionary)
    eta = prior.align_eta(soft_prior(predictions, topics), vectors, dictionary, topics)
    return lda.MatrixPriorLDA(lda.eta_matrix(eta, topics, dictionary.count(), floor=1e-3), passes=passes).fit(kept(bow))


def run_graph(corpus: DataFrame, mode: str = "star", top: int = 100_000, **bounds) -> DataFrame:
    """Edges (u, v, weight) of entry point B over the `top` words of most documents."""
    tokens = kept(tokenized(corpus))
    n = tokens.count()
    words = kept(dic.filter_extremes(dic.dictionary(tokens), n, keep_n=top, **bounds))
    return graph.cooccurrence(dic.doc2bow(tokens, words), words, n, mode)


def run_term_affinity(scores: DataFrame, words: DataFrame, n_neighbors: int = 10) -> DataFrame:
    """(i, j, w): the affinity of words as sparse columns of the tf-idf table (doc_id, word, tfidf); `words` is (word, id)."""
    rows = tfidf.word_features(scores).join(words, "word").select("id", F.col("docs").alias("dims"), "ws")
    return united(knn.nearest_sparse(kept(rows), n_neighbors - 1))


def run_tfidf(corpus: DataFrame, **bounds) -> DataFrame:
    """(doc_id, word, tfidf) of a filtered raw corpus."""
    tokens = kept(tokenized(corpus))
    n = tokens.count()
    words = dic.filter_extremes(dic.dictionary(tokens), n, **bounds)
    kept_words = dic.token_rows(tokens).join(words.select("token"), "token", "left_semi").groupBy("doc_id").agg(F.collect_list("token").alias("tokens"))
    return tfidf.tfidf(kept_words, n)
