"""Queries on vectors, neighbours, affinities, Laplacians, priors and measures. Every one runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import affinity as aff, knn, metrics, prior, vectors as vec
from ..plans.materialize import kept
from ..sources.corpus import clean_words
from ..sources.tables import table
from .corpus import six

#: Topics of the saved predictions; eigenvalues of the scaling query.
TOPICS, EIGENVALUES = 104, [0.0, 0.2, 0.5, 0.9, 1.1]


def points(spark: SparkSession, d: str) -> DataFrame:
    return kept(vec.finite(table(spark, d, "embeddings"), "vec_id", "embedding"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")


def l2_normalize(spark, d):
    return vec.long_form(vec.l2_normalize(vec.finite(table(spark, d, "word_vectors"), "ix", "vec"))).select("id", "dim", six("x").alias("x"))


def zscore(spark, d):
    return vec.zscore(vec.finite(table(spark, d, "word_vectors"), "ix", "vec", 50)).select("id", "dim", six("x").alias("x"))


def embedding_align(spark, d):
    got = vec.align(clean_words(table(spark, d, "clean_vocab")), table(spark, d, "word_vectors"))
    return got.select("ix", "word", F.size("vec").alias("width"), six(F.get("vec", F.lit(0)).cast("double")).alias("first"))


def word2vec_lookup(spark, d):
    got = vec.word2vec(clean_words(table(spark, d, "clean_vocab")), table(spark, d, "word_vectors"), [0.5] * 50)
    return got.select("word", six(F.get("vec", F.lit(0))).alias("first"))


def cosine_matrix(spark, d):
    return knn.pairwise(points(spark, d), "cosine").select("i", "j", six(1 - F.col("dist")).alias("score"))


def cosine_distances(spark, d):
    return knn.pairwise(points(spark, d), "cosine").select("i", "j", six("dist").alias("dist"))


def euclid_matrix(spark, d):
    return knn.pairwise(points(spark, d), "euclidean").select("i", "j", six("dist").alias("dist"))


def most_similar(spark, d):
    return knn.most_similar(points(spark, d), [0], 5).select("id", "rank", six("score").alias("score"))


def most_similar_batch(spark, d):
    """The stated query set, every id that 50 divides, against all vectors."""
    p = points(spark, d)
    near = knn.nearest(p, 5, "cosine", include_self=False, queries=p.where(F.col("id") % 50 == 0))
    return near.select(F.col("i").alias("query"), F.col("j").alias("id"), "rank", six(1 - F.col("dist")).alias("score"))


def knn_cosine(spark, d):
    return knn.nearest(points(spark, d), 3, "cosine").select("i", "j", "rank", six("dist").alias("dist"))


def knn_euclid(spark, d):
    return knn.nearest(points(spark, d), 10, "euclidean").select("i", "j", "rank", six("dist").alias("dist"))


def _near(spark, d) -> DataFrame:
    return aff.shifted(knn.nearest(points(spark, d), 11, "cosine"))


def scale_local(spark, d):
    return aff.local_scale(_near(spark, d)).select("i", six("scale").alias("scale"))


def scale_max(spark, d):
    return aff.local_scale(_near(spark, d), median=False).select("i", six("scale").alias("scale"))


def scale_global(spark, d):
    return aff.global_scale(_near(spark, d)).select(six("scale").alias("scale"))


def scale_global_max(spark, d):
    return aff.global_scale(_near(spark, d), median=False).select(six("scale").alias("scale"))


def _affinity(**settings):
    return lambda spark, d: aff.affinity(points(spark, d), **settings).select("i", "j", six("w").alias("w"))


def affinity_rbf_union(spark, d):
    return aff.union_affinity(points(spark, d)).select("i", "j", six("w").alias("w"))


def _laplacian(kind):
    return lambda spark, d: aff.laplacian(kept(aff.affinity(points(spark, d))), kind).select("i", "j", six("l").alias("l"))


def laplacian_sorted(spark, d):
    lap = aff.laplacian(kept(aff.affinity(points(spark, d))))
    return vec.reordered(lap, labels(spark, d)).select("i", "j", six("l").alias("l"))


def rayleigh_loss(spark, d):
    p = points(spark, d)
    lap = aff.laplacian(kept(aff.affinity(p)))
    return aff.rayleigh_loss(lap, p.select("id", F.slice("vec", 1, 4).alias("vec"))).select(six("loss").alias("loss"))


def soft_prior(spark, d):
    return prior.soft_prior(table(spark, d, "predictions"), TOPICS).select("ix", "topic", six("prior").alias("prior"))


def prior_transpose(spark, d):
    return prior.transpose(prior.soft_prior(table(spark, d, "predictions"), TOPICS)).select("topic", "ix", six("eta").alias("eta"))


def eta_align(spark, d):
    p = prior.soft_prior(table(spark, d, "predictions"), TOPICS)
    return prior.align_eta(p, table(spark, d, "word_vectors"), table(spark, d, "dictionary"), TOPICS).select("topic", "token_id", six("eta").alias("eta"))


def eigen_scale(spark, d):
    scaled = vec.eigen_scale(points(spark, d).select("id", F.slice("vec", 1, 5).alias("vec")), EIGENVALUES)
    return vec.long_form(scaled).select("id", "dim", six("x").alias("x"))


def knn_score(spark, d):
    return metrics.knn_score(points(spark, d), labels(spark, d)).select(six("accuracy").alias("accuracy"))


def knn_votes(spark, d):
    return metrics.knn_votes(points(spark, d), labels(spark, d))


def cost_matrix(spark, d):
    """Clusters are the vectors by the sign of their first two elements."""
    rows = points(spark, d).select("id", (F.when(F.col("vec")[0] > 0, 1).otherwise(0) + F.when(F.col("vec")[1] > 0, 2).otherwise(0)).alias("cluster")).join(labels(spark, d), "id")
    seen = rows.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    grid = rows.select("cluster").distinct().crossJoin(rows.select("label").distinct())  # clusters by labels: few
    return metrics.cost_matrix(grid.join(seen, ["cluster", "label"], "left").select("cluster", "label", F.coalesce("n", F.lit(0)).alias("n")))


def grassmann_1d(spark, d):
    return metrics.grassmann_1d(points(spark, d).select(F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b")), "a", "b").select(six("dist").alias("dist"))


QUERIES = {
    f.__name__: f
    for f in (
        l2_normalize, zscore, embedding_align, word2vec_lookup, cosine_matrix, cosine_distances, euclid_matrix, most_similar, most_similar_batch, knn_cosine, knn_euclid, scale_local, scale_max, scale_global,
        scale_global_max, affinity_rbf_union, laplacian_sorted, rayleigh_loss, soft_prior, prior_transpose, eta_align, eigen_scale, knn_score, knn_votes, cost_matrix, grassmann_1d,
    )
} | {
    "kernel_gaussian": _affinity(kind="gaussian"), "kernel_laplace": _affinity(kind="laplace", is_local=False), "kernel_t": _affinity(kind="t"), "affinity_mixed": _affinity(), "affinity_cosine": _affinity(metric="cosine"),
    "laplacian_unnorm": _laplacian("unnormalized"), "laplacian_rw": _laplacian("rw"), "laplacian_sym": _laplacian("symmetric"),
}

_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)"
_COS = f"WITH {_E}, p AS (SELECT a.id AS i, b.id AS j, CASE WHEN a.id = b.id THEN 0 ELSE 1 - list_cosine_similarity(a.vec, b.vec) END AS dist FROM e a, e b)"
_EUC = f"WITH {_E}, p AS (SELECT a.id AS i, b.id AS j, list_distance(a.vec, b.vec) AS dist FROM e a, e b)"
_KNN = ", near AS (SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY round(dist, 12), j)::INT AS rank FROM p QUALIFY rank <= {})"
_SHIFT = _COS + _KNN.format(11) + ", sh AS (SELECT i, j, rank, greatest(dist - first_value(dist) OVER (PARTITION BY i ORDER BY rank), 0) AS dist FROM near), loc AS (SELECT i, quantile_cont(dist, 0.5) AS s FROM sh GROUP BY i), glo AS (SELECT quantile_cont(dist, 0.5) AS s FROM sh WHERE rank = 2)"
_D = {"euclidean": "list_distance(a.vec, b.vec)", "cosine": "1 - list_cosine_similarity(a.vec, b.vec)"}


def _aff(kernel: str, metric: str = "euclidean", scale: str = "JOIN loc ON loc.i = sh.i") -> str:
    s = "loc.s" if "loc" in scale else "glo.s"
    k = kernel.replace("{s}", f"greatest({s}, 1e-7)")
    return f"""{_SHIFT}, x AS (SELECT sh.i, sh.j, {_D[metric]} AS d, {s} AS s FROM sh JOIN e a ON a.id = sh.i JOIN e b ON b.id = sh.j {scale} WHERE rank > 1),
        k AS (SELECT i, j, {kernel.replace('{s}', 'greatest(s, 1e-7)')} / 2 AS w FROM x), aw AS (SELECT i, j, sum(w) AS w FROM (SELECT * FROM k UNION ALL SELECT j, i, w FROM k) GROUP BY ALL)"""


_MIXED = _aff("exp(-d / {s})")
_DEG = _MIXED + ", deg AS (SELECT i, sum(w) AS d FROM aw GROUP BY i), lap AS (SELECT i, j, sum(l) AS l FROM ({}) GROUP BY ALL)"
_UNNORM = _DEG.format("SELECT i, i AS j, d AS l FROM deg UNION ALL SELECT i, j, -w FROM aw")
_RW = _DEG.format("SELECT i, i AS j, 1.0::DOUBLE AS l FROM deg UNION ALL SELECT aw.i, aw.j, -w / d FROM aw JOIN deg ON deg.i = aw.i")
_SYM = _DEG.format("SELECT i, i AS j, 1.0::DOUBLE AS l FROM deg UNION ALL SELECT aw.i, aw.j, -w / sqrt(a.d * b.d) FROM aw JOIN deg a ON a.i = aw.i JOIN deg b ON b.i = aw.j")
_OK = "vec IS NOT NULL AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0"
_WORDS = "voc AS (SELECT DISTINCT lower(trim(word)) AS word FROM clean_vocab WHERE lower(trim(word)) <> '')"
_PRIOR = f"""WITH q AS (SELECT ix, topic, coalesce(max(p), 0) AS p FROM predictions WHERE ix IS NOT NULL AND topic IS NOT NULL GROUP BY ALL), s AS (SELECT ix, sum(p) AS s FROM q GROUP BY ix),
    pr AS (SELECT s.ix, t.topic::INT AS topic, (coalesce(q.p, 0) + 0.01) / (s.s + {TOPICS} * 0.01) AS prior FROM s CROSS JOIN range({TOPICS}) t(topic) LEFT JOIN q ON q.ix = s.ix AND q.topic = t.topic)"""
_VOTES = _EUC + _KNN.format(11) + """, v AS (SELECT n.i, l.label, count(*) AS n FROM near n JOIN embeddings l ON l.vec_id = n.j WHERE n.dist > 0 GROUP BY ALL),
    b AS (SELECT i, label FROM v QUALIFY row_number() OVER (PARTITION BY i ORDER BY n DESC, label) = 1), r AS (SELECT e2.vec_id AS id, e2.label, b.label AS vote FROM embeddings e2 LEFT JOIN b ON b.i = e2.vec_id)"""

SQL = {
    "l2_normalize": f"WITH v AS (SELECT ix AS id, vec::DOUBLE[] AS vec FROM word_vectors WHERE {_OK}), u AS (SELECT id, unnest(range(len(vec)))::INT AS dim, vec, sqrt(list_inner_product(vec, vec)) AS n FROM v) SELECT id, dim, round(vec[dim + 1] / nullif(n, 0), 6) + 0.0 AS x FROM u",
    "zscore": f"""WITH v AS (SELECT ix AS id, vec::DOUBLE[] AS vec FROM word_vectors WHERE len(vec) = 50 AND {_OK}), u AS (SELECT id, unnest(range(len(vec)))::INT AS dim, unnest(vec) AS x FROM v)
        SELECT id, dim, round(CASE WHEN stddev_samp(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w ELSE x END, 6) + 0.0 AS x FROM u WINDOW w AS (PARTITION BY dim)""",
    "embedding_align": f"""WITH {_WORDS}, v AS (SELECT word, max(ix) AS old, arg_max_null(vec, ix) AS vec FROM word_vectors WHERE word IS NOT NULL GROUP BY word)
        SELECT row_number() OVER (ORDER BY old) - 1 AS ix, word, len(vec)::INT AS width, round(vec[1]::DOUBLE, 6) + 0.0 AS first FROM v WHERE old <> 0 AND word IN (SELECT word FROM voc)""",
    "word2vec_lookup": f"""WITH {_WORDS}, v AS (SELECT word, arg_max(vec, ix) AS vec FROM word_vectors WHERE word IS NOT NULL AND vec IS NOT NULL GROUP BY word)
        SELECT voc.word, round(CASE WHEN v.vec IS NULL THEN 0.5 ELSE v.vec[1]::DOUBLE END, 6) + 0.0 AS first FROM voc LEFT JOIN v ON v.word = voc.word""",
    "cosine_matrix": f"{_COS} SELECT i, j, round(1 - dist, 6) + 0.0 AS score FROM p",
    "cosine_distances": f"{_COS} SELECT i, j, round(dist, 6) + 0.0 AS dist FROM p",
    "euclid_matrix": f"{_EUC} SELECT i, j, round(dist, 6) + 0.0 AS dist FROM p",
    "most_similar": f"{_COS} SELECT j AS id, row_number() OVER (PARTITION BY i ORDER BY round(1 - dist, 12) DESC, j)::INT AS rank, round(1 - dist, 6) + 0.0 AS score FROM p WHERE i = 0 AND j <> i QUALIFY rank <= 5",
    "most_similar_batch": f"{_COS} SELECT i AS query, j AS id, row_number() OVER (PARTITION BY i ORDER BY round(1 - dist, 12) DESC, j)::INT AS rank, round(1 - dist, 6) + 0.0 AS score FROM p WHERE i % 50 = 0 AND j <> i QUALIFY rank <= 5",
    "knn_cosine": f"{_COS}{_KNN.format(3)} SELECT i, j, rank, round(dist, 6) + 0.0 AS dist FROM near",
    "knn_euclid": f"{_EUC}{_KNN.format(10)} SELECT i, j, rank, round(dist, 6) + 0.0 AS dist FROM near",
    "scale_local": f"{_SHIFT} SELECT i, round(s, 6) + 0.0 AS scale FROM loc",
    "scale_max": f"{_SHIFT} SELECT i, round(max(dist), 6) + 0.0 AS scale FROM sh GROUP BY i",
    "scale_global": f"{_SHIFT} SELECT round(s, 6) + 0.0 AS scale FROM glo",
    "scale_global_max": f"{_SHIFT} SELECT round(max(dist), 6) + 0.0 AS scale FROM sh WHERE rank = 2",
    "kernel_gaussian": f"{_aff('exp(-d * d / ({s} * {s}))')} SELECT i, j, round(w, 6) + 0.0 AS w FROM aw",
    "kernel_laplace": f"{_aff('exp(-d / {s})', scale='CROSS JOIN glo')} SELECT i, j, round(w, 6) + 0.0 AS w FROM aw",
    "kernel_t": f"{_aff('1 / (1 + d * d)')} SELECT i, j, round(w, 6) + 0.0 AS w FROM aw",
    "affinity_mixed": f"{_MIXED} SELECT i, j, round(w, 6) + 0.0 AS w FROM aw",
    "affinity_cosine": f"{_aff('exp(-d / {s})', 'cosine')} SELECT i, j, round(w, 6) + 0.0 AS w FROM aw",
    "affinity_rbf_union": f"{_EUC}, near AS (SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY round(dist, 12), j) AS rank FROM p WHERE i <> j QUALIFY rank <= 9), k AS (SELECT i, j, exp(-dist * dist) AS w FROM near) SELECT i, j, round(max(w), 6) + 0.0 AS w FROM (SELECT * FROM k UNION ALL SELECT j, i, w FROM k) GROUP BY ALL",
    "laplacian_unnorm": f"{_UNNORM} SELECT i, j, round(l, 6) + 0.0 AS l FROM lap",
    "laplacian_rw": f"{_RW} SELECT i, j, round(l, 6) + 0.0 AS l FROM lap",
    "laplacian_sym": f"{_SYM} SELECT i, j, round(l, 6) + 0.0 AS l FROM lap",
    "laplacian_sorted": f"{_UNNORM}, o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label, vec_id) - 1 AS place FROM embeddings) SELECT a.place AS i, b.place AS j, round(l, 6) + 0.0 AS l FROM lap JOIN o a ON a.id = lap.i JOIN o b ON b.id = lap.j",
    "rayleigh_loss": f"{_UNNORM} SELECT round(sum(l * list_inner_product(a.vec[1:4], b.vec[1:4])) / (SELECT count(*) FROM e), 6) + 0.0 AS loss FROM lap JOIN e a ON a.id = lap.i JOIN e b ON b.id = lap.j",
    "soft_prior": f"{_PRIOR} SELECT ix, topic, round(prior, 6) AS prior FROM pr",
    "prior_transpose": f"{_PRIOR} SELECT topic, ix, round(prior, 6) AS eta FROM pr",
    "eta_align": f"""{_PRIOR}, nm AS (SELECT word, max(ix) AS ix FROM word_vectors WHERE word IS NOT NULL GROUP BY word)
        SELECT t.topic::INT AS topic, d.token_id, round(coalesce(pr.prior, 0), 6) AS eta FROM dictionary d CROSS JOIN range({TOPICS}) t(topic) LEFT JOIN nm ON nm.word = d.token LEFT JOIN pr ON pr.ix = nm.ix AND pr.topic = t.topic""",
    "eigen_scale": "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings) SELECT id, dim::INT AS dim, round(vec[dim + 1] * [1.0, 0.8, 0.5, 0.1][dim + 1], 6) + 0.0 AS x FROM v, range(4) t(dim)",
    "knn_votes": f"{_VOTES} SELECT id, label, vote FROM r",
    "knn_score": f"{_VOTES} SELECT round(avg(CASE WHEN vote = label THEN 1.0 ELSE 0 END), 6) AS accuracy FROM r",
    "cost_matrix": """WITH r AS (SELECT (embedding[1] > 0)::INT + 2 * (embedding[2] > 0)::INT AS cluster, label FROM embeddings), g AS (SELECT c.cluster, l.label, count(r.label) AS n FROM (SELECT DISTINCT cluster FROM r) c CROSS JOIN (SELECT DISTINCT label FROM r) l
        LEFT JOIN r ON r.cluster = c.cluster AND r.label = l.label GROUP BY ALL) SELECT cluster, label, (sum(n) OVER (PARTITION BY cluster) - n)::BIGINT AS cost FROM g""",
    "grassmann_1d": "WITH v AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) SELECT round(1 - sum(a * b) * sum(a * b) / (sum(a * a) * sum(b * b)), 6) AS dist FROM v",
}
