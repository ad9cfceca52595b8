"""Queries whose results are learned: checked by invariants in the tests, not by SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import affinity as aff, cluster, dictionary as dic, graph, knn, lda, network, prior, spectral, tfidf, vectors as vec
from ..plans import pipeline
from ..plans.materialize import kept
from ..sources.tables import table
from .corpus import cleaned, documents, six
from .numeric import TOPICS, points


def _long(df: DataFrame) -> DataFrame:
    return vec.long_form(df).select("id", "dim", six("x").alias("x"))


def pca(spark, d):
    return _long(spectral.pca(points(spark, d), 10))


def spectral_embedding(spark, d):
    return _long(spectral.spectral_embedding(kept(aff.affinity(points(spark, d))), 10)[0])


def diffusion_map(spark, d):
    return _long(spectral.diffusion_map(kept(aff.affinity(points(spark, d))), 10, 2)[0])


def rw_embedding(spark, d):
    return _long(spectral.random_walk_embedding(kept(aff.affinity(points(spark, d))), 10)[0])


def scase(spark, d):
    """The trained network's embedding of all rows."""
    return _long(pipeline.scase_model(pipeline.Settings()).fit_transform(points(spark, d)))


def scase_landmarks(spark, d):
    return _long(spectral.ScalableEmbedding(10).fit_transform(points(spark, d)))


def scase_losses(spark, d):
    """Training and validation loss of every epoch."""
    model = pipeline.scase_model(pipeline.Settings()).fit(points(spark, d))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(model.net.trainer.losses)], "epoch int, train double, valid double")


def sn_predict(spark, d):
    p = points(spark, d)
    return pipeline.sn_model(pipeline.Settings(topics=10)).fit(p).predict(p).select("id", F.posexplode("p").alias("topic", "p"))


def sorted_eigenvectors(spark, d):
    """What the plot of Laplacian eigenvectors shows: their values in the order of (label, id)."""
    from ..plans.ids import numbered
    from .numeric import labels

    place = numbered(labels(spark, d), "place", F.col("label"), F.col("id")).select("id", "place")
    return vec.long_form(spectral.spectral_embedding(kept(aff.affinity(points(spark, d))), 10)[0].join(place, "id").select(F.col("place").alias("id"), "vec")).select("id", "dim", six("x").alias("x"))


def term_affinity(spark, d):
    """The affinity of all words of `documents` as tf-idf columns."""
    c = documents(spark, d)
    words = dic.dictionary(c).select(F.col("token").alias("word"), F.col("token_id").alias("id"))
    return pipeline.run_term_affinity(kept(tfidf.tfidf(c, c.count())), words).select("i", "j", six("w").alias("w"))


def eigenvalues(spark, d):
    values = spectral.spectral_embedding(kept(aff.affinity(points(spark, d))), 10)[1]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "rank int, value double")


def ae_embed(spark, d):
    return _long(network.Autoencoder().fit(points(spark, d)).embed(points(spark, d)))


def kmeans(spark, d):
    return cluster.kmeans(points(spark, d), 10, n_init=10)


def gmm_topics(spark, d):
    rows = kept(spectral.pca(points(spark, d), 10))
    return cluster.Mixture(10).fit(rows).predict_proba(rows).select(F.col("id"), F.posexplode("p").alias("topic", "p"))


def _prior(mode):
    return lambda spark, d: pipeline.run_prior(points(spark, d), pipeline.Settings(mode=mode))


def _bow(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    c = cleaned(spark, d)
    bow, words = dic.lda_input(c, c.count())
    words = kept(words)
    return kept(bow), words, words.count()


def lda_symmetric(spark, d):
    bow, _, n = _bow(spark, d)
    return lda.symmetric(bow, n, topics=TOPICS, passes=10)


def lda_eta(spark, d):
    bow, words, n = _bow(spark, d)
    p = prior.soft_prior(table(spark, d, "predictions"), TOPICS)
    eta = prior.align_eta(p, table(spark, d, "word_vectors"), words, TOPICS)
    return lda.MatrixPriorLDA(lda.eta_matrix(eta, TOPICS, n, floor=1e-3), passes=10).fit(bow).topics(bow)


def ann_knn(spark, d):
    return knn.approximate(points(spark, d), 10).select("i", "j", "rank", six("dist").alias("dist"))


def sparse_batch(spark, d):
    p = points(spark, d)
    return knn.sparse_batch(p, knn.nearest(p, 5, "euclidean", include_self=False), 100)


def grassmann(spark, d):
    model = spectral.ScalableEmbedding(5)
    p = points(spark, d)
    model.fit(p)
    return spark.createDataFrame([(model.grassmann_distance(p),)], "dist double")


def embedding_map(spark, d):
    """What the scatter plot shows: two principal components of the spectral embedding, scaled; a caller picks the words to draw."""
    flat = spectral.pca(spectral.spectral_embedding(kept(aff.affinity(points(spark, d))), 10)[0], 2)
    return flat.select("id", six(F.col("vec")[0] * 1e5).alias("x"), six(F.col("vec")[1] * 1e5).alias("y"))


def graph_prior(spark, d):
    """The corpus graph of entry point B over all words, as an affinity, embedded and clustered into topics."""
    edges = kept(pipeline.run_graph(table(spark, d, "documents"), "all_pairs"))
    vecs, values = spectral.spectral_embedding(kept(graph.adjacency(edges)), 10)
    rows = kept(vec.eigen_scale(vecs, [float(min(v, math.nextafter(1, 0))) for v in values]))
    return cluster.Mixture(8).fit(rows).predict_proba(rows).select(F.col("id").alias("token_id"), F.posexplode("p").alias("topic", "p"))


QUERIES = {
    f.__name__: f
    for f in (
        pca, spectral_embedding, diffusion_map, rw_embedding, scase, scase_landmarks, scase_losses, sn_predict, sorted_eigenvectors, term_affinity, eigenvalues, ae_embed, kmeans, gmm_topics, lda_symmetric, lda_eta,
        ann_knn, sparse_batch, grassmann, embedding_map, graph_prior,
    )
} | {"topic_prior": _prior("scase")} | {f"topic_prior_{m}": _prior(m) for m in ("pca", "rw", "gmm", "umap", "sn", "landmarks")}

_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)"
SQL = {
    "sparse_batch": f"""WITH {_E}, s AS (SELECT id FROM e ORDER BY id LIMIT 20), p AS (SELECT a.id AS i, b.id AS j, list_distance(a.vec, b.vec) AS dist FROM e a, e b WHERE a.id <> b.id AND a.id IN (SELECT id FROM s)),
        k AS (SELECT j FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(dist, 12), j) <= 4) SELECT id FROM s UNION ALL SELECT j FROM k""",
}
