"""Learned results as numbers that don't depend on signs, rotations or seeds, so that SQL can state what they must be."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import affinity as aff, cluster, knn, lda, metrics, network, spectral, vectors as vec
from ..plans import pipeline
from ..plans.materialize import kept
from ..sources.models import load_model, save_model
from .corpus import six
from .learned import QUERIES as LEARNED
from .numeric import points
from .storage import place


def _sums(name, key, value):
    """Each row's (or topic's) total of a query's probabilities."""
    return lambda spark, d: LEARNED[name](spark, d).groupBy(key).agg(six(F.sum(value)).alias("total"))


def pca_variance(spark, d):
    """With all components, the variances of the scores add up to the data's, and the scores are centred."""
    rows = vec.long_form(spectral.pca(points(spark, d), 64)).groupBy("dim").agg(F.var_samp("x").alias("v"), F.avg("x").alias("m"))
    return rows.agg(six(F.sum("v")).alias("variance"), six(F.max(F.abs("m"))).alias("mean"))


def singular_values(spark, d):
    """Singular values of the first two columns, ascending."""
    _, size = spectral.singular_vectors(kept(points(spark, d).select("id", F.slice("vec", 1, 2).alias("vec"))))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(size)], "rank int, value double").select("rank", six("value").alias("value"))


def singular_vectors(spark, d):
    """Inner products of the left singular vectors of all columns: the identity."""
    left, size = spectral.singular_vectors(points(spark, d))
    g = spectral.small_gram(kept(left), len(size))
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(len(g)) for j in range(len(g))], "i int, j int, x double").select("i", "j", six("x").alias("x"))


def eigen_residual(spark, d):
    """The largest entry of L u - value u of the embedding by the random-walk Laplacian, and whether the values ascend within [0, 2]."""
    w = kept(aff.affinity(points(spark, d)))
    u, values = spectral.spectral_embedding(w, 10)
    u = kept(u)
    lap = aff.laplacian(w, "rw")
    product = lap.join(u.select(F.col("id").alias("j"), "vec"), "j").groupBy("i").agg(F.array(*[F.sum(F.col("l") * F.col("vec")[k]) for k in range(10)]).alias("p"))
    off = product.join(u, product["i"] == u["id"]).select(F.posexplode(F.zip_with("p", F.zip_with("vec", F.lit(values.tolist()), lambda x, v: x * v), lambda a, b: F.abs(a - b))).alias("dim", "off"))
    rising = bool((values[1:] >= values[:-1] - 1e-12).all() and values[0] >= 0 and values[-1] <= 2)
    return off.groupBy("dim").agg(six(F.max("off")).alias("off")).withColumn("rising", F.lit(rising))


def grassmann_planes(spark, d):
    """Distance of the planes that columns 0, 1 and columns 2, 3 span."""
    p = points(spark, d)
    dist = metrics.grassmann(p.select("id", F.slice("vec", 1, 2).alias("vec")), p.select("id", F.slice("vec", 3, 2).alias("vec")), 2)
    return spark.createDataFrame([(float(dist),)], "dist double").select(six("dist").alias("dist"))


def cluster_assignment(spark, d):
    """The cheapest one-to-one assignment of the four sign clusters to the first four labels, as (cluster, label)."""
    from .numeric import cost_matrix

    rows = cost_matrix(spark, d).toPandas()  # clusters by labels: few
    grid = rows.pivot(index="cluster", columns="label", values="cost").sort_index()
    grid = grid[sorted(grid.columns)[:4]]
    pairs = metrics.assignment(grid.to_numpy(float))
    total = float(sum(grid.iloc[a, b] for a, b in pairs))
    return spark.createDataFrame([(total, len(set(metrics.labels_from(pairs))))], "total double, labels int")


def saved_models(spark, d):
    """Models that were saved and loaded give the same results as before: the largest difference of each."""
    p, path, out = points(spark, d), place(spark), []
    small = dict(hiddens=(64, 32), epochs=3, sn_epochs=3, topics=5)
    models = {
        "scase": (pipeline.scase_model(pipeline.Settings(**small)).fit(p), lambda m: m.transform(p)), "landmarks": (spectral.ScalableEmbedding(5).fit(p), lambda m: m.transform(p)),
        "autoencoder": (network.Autoencoder((32, 5), epochs=3).fit(p), lambda m: m.embed(p)), "sn": (pipeline.sn_model(pipeline.Settings(**small)).fit(p), lambda m: m.embed(p)),
        "mixture": (cluster.Mixture(3).fit(p.select("id", F.slice("vec", 1, 4).alias("vec"))), lambda m: m.predict_proba(p.select("id", F.slice("vec", 1, 4).alias("vec"))).withColumnRenamed("p", "vec")),
    }
    for name, (model, use) in models.items():
        save_model(spark, model, f"{path}/{name}")
        before, after = use(model), use(load_model(spark, f"{path}/{name}")).withColumnRenamed("vec", "again")
        off = F.array_max(F.zip_with("vec", "again", lambda a, b: F.abs(a - b)))
        out.append(before.join(after, "id").agg(F.count(F.lit(1)).alias("n"), six(F.max(off)).alias("off")).select(F.lit(name).alias("model"), "n", "off"))
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def unknown_word(spark, d):
    """Words without a vector share one random vector: how many there are, and how many vectors they have."""
    from ..sources.corpus import clean_words
    from ..sources.tables import table

    words, known = clean_words(table(spark, d, "clean_vocab")), table(spark, d, "word_vectors")
    got = vec.word2vec(words, known, 50).join(known.where(F.col("vec").isNotNull()).select("word"), "word", "left_anti")
    return got.agg(F.count(F.lit(1)).alias("words"), F.countDistinct("vec").alias("vectors"))


def affinity_of_index(spark, d):
    """The affinity with its neighbours given as a table is the affinity that finds them."""
    p = points(spark, d)
    return aff.affinity(p, near=knn.nearest(p, 11, "cosine")).select("i", "j", six("w").alias("w"))


QUERIES = {
    f.__name__: f for f in (pca_variance, singular_values, singular_vectors, eigen_residual, grassmann_planes, cluster_assignment, saved_models, unknown_word, affinity_of_index)
} | {
    "gmm_sums": _sums("gmm_topics", "id", "p"), "sn_sums": _sums("sn_predict", "id", "p"), "lda_eta_sums": _sums("lda_eta", "topic", "weight"), "lda_symmetric_sums": _sums("lda_symmetric", "topic", "weight"),
} | {f"topic_prior{m}_sums": _sums(f"topic_prior{m}", "ix", "prior") for m in ("", "_pca", "_rw", "_gmm", "_umap", "_sn", "_landmarks")}

_ROW = "SELECT vec_id AS {}, 1.0::DOUBLE AS total FROM embeddings"
_TOPIC = "SELECT topic::INT AS topic, 1.0::DOUBLE AS total FROM range(104) t(topic)"
_COLUMNS = "v AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings)"


def _inverse(p: str, q: str, x: str, y: str) -> str:
    """u' G^-1 w for the plane of columns p, q with u = (p.x, q.x), w = (p.y, q.y)."""
    return f"(({q}{q} * {p}{x} * {p}{y}) - ({p}{q} * ({p}{x} * {q}{y} + {q}{x} * {p}{y})) + ({p}{p} * {q}{x} * {q}{y})) / ({p}{p} * {q}{q} - {p}{q} * {p}{q})"


SQL = {
    "pca_variance": "WITH x AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings) SELECT round(sum(v), 6) + 0.0 AS variance, 0.0::DOUBLE AS mean FROM (SELECT var_samp(x) AS v FROM x GROUP BY dim)",
    "singular_values": f"""WITH {_COLUMNS}, g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM v), r AS (SELECT (aa + bb) / 2 AS m, sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS h FROM g)
        SELECT k::INT AS rank, round(sqrt(m + (2 * k - 1) * h), 6) + 0.0 AS value FROM r, range(2) t(k)""",
    "singular_vectors": "SELECT a::INT AS i, b::INT AS j, (CASE WHEN a = b THEN 1.0 ELSE 0.0 END)::DOUBLE AS x FROM range(64) s(a), range(64) t(b)",
    "eigen_residual": "SELECT k::INT AS dim, 0.0::DOUBLE AS off, true AS rising FROM range(10) t(k)",
    "grassmann_planes": f"""WITH {_COLUMNS}, g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(c * c) AS cc, sum(c * d) AS cd, sum(d * d) AS dd, sum(a * c) AS ac, sum(a * d) AS ad, sum(b * c) AS bc, sum(b * d) AS bd FROM v),
        m AS (SELECT *, {_inverse('a', 'b', 'c', 'c')} AS mcc, {_inverse('a', 'b', 'c', 'd')} AS mcd, {_inverse('a', 'b', 'd', 'd')} AS mdd FROM g)
        SELECT round(2 - (dd * mcc - 2 * cd * mcd + cc * mdd) / (cc * dd - cd * cd), 6) + 0.0 AS dist FROM m""",
    "cluster_assignment": """WITH r AS (SELECT (embedding[1] > 0)::INT + 2 * (embedding[2] > 0)::INT AS k, label FROM embeddings), l AS (SELECT DISTINCT label FROM r ORDER BY label LIMIT 4), n AS (SELECT k, count(*) AS n FROM r GROUP BY k),
        c AS (SELECT n.k, l.label, any_value(n.n) - count(r.label) AS cost FROM n CROSS JOIN l LEFT JOIN r ON r.k = n.k AND r.label = l.label GROUP BY ALL)
        SELECT min(w.cost + x.cost + y.cost + z.cost)::DOUBLE AS total, 4::INT AS labels FROM c w, c x, c y, c z
        WHERE w.k = 0 AND x.k = 1 AND y.k = 2 AND z.k = 3 AND len(list_distinct([w.label, x.label, y.label, z.label])) = 4""",
    "saved_models": "SELECT model, n, 0.0::DOUBLE AS off FROM (SELECT unnest(['scase', 'landmarks', 'autoencoder', 'sn', 'mixture']) AS model), (SELECT count(*) AS n FROM embeddings)",
    "unknown_word": "WITH w AS (SELECT DISTINCT lower(trim(word)) AS word FROM clean_vocab WHERE lower(trim(word)) <> '') SELECT count(*) AS words, least(count(*), 1) AS vectors FROM w WHERE word NOT IN (SELECT word FROM word_vectors WHERE word IS NOT NULL AND vec IS NOT NULL)",
    "gmm_sums": _ROW.format("id"), "sn_sums": _ROW.format("id"), "lda_eta_sums": _TOPIC, "lda_symmetric_sums": _TOPIC,
} | {f"topic_prior{m}_sums": _ROW.format("ix") for m in ("", "_pca", "_rw", "_gmm", "_umap", "_sn", "_landmarks")}
