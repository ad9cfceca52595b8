"""Units on small literal tables: edge cases that the data sets don't guarantee."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions.text import clean_letters, clean_plain, lemmatised, stem, tokenized
from topicloom.operators import affinity as aff, cluster, dictionary as dic, graph, knn, lda, metrics, network, prior, spectral, tfidf, vectors as vec
from topicloom.plans import materialize, pipeline
from topicloom.plans.ids import numbered
from topicloom.sources import corpus as src


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_stem(spark):
    cases = [("tables", "table"), ("readable", "read"), ("lovely", "love"), ("was", "was"), ("ably", "ab"), ("s", "s")]
    got = frame(spark, cases, "w string, want string").select(stem(F.col("w")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_clean_letters(spark):
    rows = [(1, ""), (2, "... !!"), (3, "Don't STOP stopping stopping"), (4, "café naïve"), (5, None), (6, "abc abcd abcdefghijkl abcdefghijklm"), (7, "Kelvin")]
    got = {r[0]: r[1] for r in frame(spark, rows, "doc_id long, text string").select("doc_id", clean_letters("text")).collect()}
    assert got == {1: [], 2: [], 3: ["stop", "stopping", "stopping"], 4: [], 5: [], 6: ["abcd", "abcdefghijkl"], 7: ["elvin"]}


def test_clean_plain_tests_stopwords_before_punctuation(spark):
    got = frame(spark, [(1, "the, foo-bar the"), (2, None)], "doc_id long, text string").select(clean_plain("text").alias("t")).collect()
    assert [r["t"] for r in got] == [["the", "foobar"], []]
    lemmas = F.create_map(F.lit("mice"), F.lit("mouse"))
    assert frame(spark, [("mice run",)], "text string").select(clean_plain("text", lemmas=lemmas)).first()[0] == ["mouse", "run"]


@pytest.fixture
def tiny(spark):
    return frame(spark, [(1, ["b", "a", "b"]), (2, ["a"]), (3, []), (4, ["c", "a", "d"]), (5, None)], "doc_id long, tokens array<string>")


def test_dictionary(tiny):
    got = {r["token"]: (r["token_id"], r["df"], r["cf"]) for r in dic.dictionary(tiny).collect()}
    assert got == {"a": (0, 3, 3), "b": (1, 1, 2), "c": (2, 1, 1), "d": (3, 1, 1)}


def test_filtered_corpus_keeps_empty_documents(tiny):
    words, text = dic.filtered_corpus(tiny, 5)
    assert {r["doc_id"]: r["text"] for r in text.collect()} == {1: "a b", 2: "a", 3: "", 4: "a c d", 5: ""}
    assert sorted(r["token_id"] for r in words.collect()) == [0, 1, 2, 3]


def test_extremes(spark):
    d = frame(spark, [("a", 0, 9, 9), ("b", 1, 5, 5), ("c", 2, 5, 5), ("d", 3, 1, 1)], "token string, token_id int, df long, cf long")
    names = lambda **k: [r["token"] for r in dic.filter_extremes(d, 10, **k).collect()]
    assert names(no_below=0.2, no_above=0.5, compat=False) == ["b", "c"]
    assert names(no_below=0.2, no_above=0.5, compat=True) == ["a", "b", "c"]
    assert names(no_below=0, no_above=1.0, keep_n=2) == ["a", "b"]
    assert dic.filter_extremes(d.limit(0), 0).count() == 0


def test_unknown_and_repeated_words_are_ignored(spark, tiny):
    words = frame(spark, [("a",), ("a",), ("zzz",), (None,)], "word string")
    assert [r["token"] for r in dic.filter_tokens(dic.dictionary(tiny), words).collect()] == ["a"]


def test_numbered_is_gapless_and_ordered(spark):
    got = numbered(spark.range(5000).select((F.col("id") * 7 % 5003).alias("v")), "n", F.col("v")).orderBy("v").collect()
    assert [r["n"] for r in got] == list(range(5000))


def test_graph_modes(spark, tiny):
    words = dic.dictionary(tiny)
    bow = dic.doc2bow(tiny, words)
    star = {(r["u"], r["v"]) for r in graph.cooccurrence(bow, words, 5, "star").collect()}
    pairs = {(r["u"], r["v"]) for r in graph.cooccurrence(bow, words, 5, "all_pairs").collect()}
    assert star == {(0, 1), (0, 2), (0, 3)} and pairs == star | {(2, 3)}
    with pytest.raises(ValueError):
        graph.cooccurrence(bow, words, 5, "other")


def test_tfidf_rows_have_unit_length(tiny):
    got = tfidf.tfidf(tiny, 5).groupBy("doc_id").agg(F.sum(F.col("tfidf") ** 2).alias("s")).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 4} and all(abs(r["s"] - 1) < 1e-12 for r in got)


def test_vectors_edge(spark):
    v = frame(spark, [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0, 4.0])], "id long, vec array<double>")
    unit = {r["id"]: r["vec"] for r in vec.l2_normalize(v).collect()}
    assert unit[1] == [None, None] and unit[2] == [0.6, 0.8]
    flat = vec.zscore(frame(spark, [(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id long, vec array<double>")).collect()
    assert {(r["id"], r["dim"]): round(r["x"], 6) for r in flat} == {(1, 0): -0.707107, (2, 0): 0.707107, (1, 1): 5.0, (2, 1): 5.0}
    near = knn.nearest(v, 5, "cosine").collect()
    assert {(r["i"], r["j"]) for r in near} == {(2, 2), (2, 3), (3, 2), (3, 3)}
    assert knn.nearest(v.limit(0), 3).count() == 0


def test_knn_blocks_agree(spark):
    rng = np.random.default_rng(1)
    v = frame(spark, [(i, x) for i, x in enumerate(rng.normal(size=(90, 4)).tolist())], "id long, vec array<double>")
    key = lambda df: sorted((r["i"], r["rank"], r["j"]) for r in df.collect())
    for metric in ("cosine", "euclidean"):
        assert key(knn.nearest(v, 4, metric)) == key(knn.nearest(v, 4, metric, block=20))
    with pytest.raises(Exception):
        knn.nearest(v, 4, "other").count()


def test_align_and_lookup(spark):
    w = frame(spark, [(0, "zero", [1.0]), (1, "a", [2.0]), (2, "a", [3.0]), (3, None, [4.0]), (4, "b", None)], "ix int, word string, vec array<float>")
    words = frame(spark, [("a",), ("zero",), ("x",), ("b",), (None,)], "word string")
    assert [(r["ix"], r["word"], r["vec"]) for r in vec.align(words, w).orderBy("ix").collect()] == [(0, "a", [3.0]), (1, "b", None)]
    assert [r["word"] for r in vec.align(words, w, drop_index_zero=False).orderBy("ix").collect()] == ["zero", "a", "b"]
    assert {r["word"]: r["vec"] for r in vec.word2vec(words, w, [9.0]).collect()} == {"a": [3.0], "zero": [1.0], "x": [9.0], "b": [9.0]}


def test_laplacians(spark):
    w = frame(spark, [(0, 1, 2.0), (1, 0, 2.0), (1, 2, 1.0), (2, 1, 1.0), (3, 3, 0.0)], "i int, j int, w double")
    for kind, row in (("unnormalized", 0.0), ("rw", 0.0)):
        sums = {r["i"]: r["s"] for r in aff.laplacian(w, kind).where("i < 3").groupBy("i").agg(F.sum("l").alias("s")).collect()}
        assert all(abs(s - row) < 1e-12 for s in sums.values())
    sym = {(r["i"], r["j"]): r["l"] for r in aff.laplacian(w, "symmetric").collect()}
    assert abs(sym[0, 1] + 2 / math.sqrt(6)) < 1e-12 and sym[3, 3] == 1.0


def ring(spark, n=60):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    return frame(spark, [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(t)], "id long, vec array<double>")


def dense(w, n):
    m = np.zeros((n, n))
    for r in w.collect():
        m[r["i"], r["j"]] = r["w"]
    return m


def test_spectral_embedding_solves_the_random_walk_laplacian(spark):
    w = aff.union_affinity(ring(spark), 5).cache()
    got, values = spectral.spectral_embedding(w, 4)
    u = np.array([r["vec"] for r in got.orderBy("id").collect()])
    m = dense(w, 60)
    lap = np.eye(60) - m / m.sum(1, keepdims=True)
    assert np.abs(lap @ u - u * values).max() < 1e-8 and (np.diff(values) >= -1e-12).all() and 0 <= values.min() and values.max() <= 2


def test_block_iteration_agrees_with_the_driver(spark, monkeypatch):
    w = aff.union_affinity(ring(spark, 40), 7).cache()
    exact, values = spectral.spectral_embedding(w, 2)
    monkeypatch.setattr(spectral, "EXACT", 10)
    block, approx = spectral.spectral_embedding(w, 2)
    assert np.abs(values - approx).max() < 1e-8
    assert metrics.grassmann(block, exact, 2) < 1e-8
    with pytest.raises(RuntimeError):
        spectral.eigenvectors(w, 3, tol=0.0, most=1)


def blobs(spark, dim=3, n=40, spread=0.3):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, spread, (n, dim)) for c in (0, 5, -5)])
    return frame(spark, [(i, v) for i, v in enumerate(x.tolist())], "id long, vec array<double>"), np.repeat([0, 1, 2], n)


@pytest.mark.parametrize("dim,spread", [(3, 0.3), (40, 1.0)])
def test_mixture_does_not_collapse(spark, dim, spread):
    v, truth = blobs(spark, dim, spread=spread)
    m = cluster.Mixture(3, seed=1, reg_covar=1e-2 if dim > 20 else 1e-6).fit(v)
    p = np.array([r["p"] for r in m.predict_proba(v).orderBy("id").collect()])
    assert np.allclose(p.sum(1), 1) and p.max(1).mean() > 2 / 3 and m.weights.min() > 1e-6
    if dim < 20:  # in 40 dimensions even the true density of unit variance is below that floor
        assert m.log_likelihood[-1] > len(p) * math.log(3 * 2.22e-16)
        assert all(b >= a - 1e-6 * abs(a) for a, b in zip(m.log_likelihood, m.log_likelihood[1:]))
    found = p.argmax(1)
    assert all(len(set(found[truth == k])) == 1 for k in range(3)) and len(set(found)) == 3


def test_kmeans(spark):
    v, truth = blobs(spark)
    label = np.array([r["label"] for r in cluster.kmeans(v, 3, n_init=2).orderBy("id").collect()])
    assert all(len(set(label[truth == k])) == 1 for k in range(3))
    with pytest.raises(ValueError):
        cluster.spark_mixture(blobs(spark, 40)[0], 3)


def test_pca_scores_are_centred(spark):
    v, _ = blobs(spark)
    x = np.array([r["vec"] for r in spectral.pca(v, 2).collect()])
    assert np.abs(x.mean(0)).max() < 1e-8 and x[:, 0].var() >= x[:, 1].var()


def test_scalable_embedding(spark):
    v, truth = blobs(spark)
    model = spectral.ScalableEmbedding(2, n_nbg=60)
    y = np.array([r["vec"] for r in model.fit_transform(v).orderBy("id").collect()])
    assert y.shape == (120, 2) and len(model.get_eigenvalues()) == 2 and np.isfinite(y).all()
    means = np.array([y[truth == k].mean(0) for k in range(3)])
    inside = np.mean([np.linalg.norm(y[truth == k] - means[k], axis=1).mean() for k in range(3)])
    assert inside < min(np.linalg.norm(means[a] - means[b]) for a, b in ((0, 1), (0, 2), (1, 2)))
    with pytest.raises(ValueError):
        spectral.ScalableEmbedding(0)


def test_autoencoder_learns(spark):
    v, _ = blobs(spark)
    model = network.Autoencoder((16, 2), epochs=60, lr=1e-2, batch_size=32).fit(v)
    assert np.mean([b for _, b in model.losses[-5:]]) < 0.2 * model.losses[0][1]
    assert all(len(r["vec"]) == 2 for r in model.embed(v).collect())


def test_network_gradients():
    """The gradient of the Rayleigh quotient through the layers against finite differences."""
    rng = np.random.default_rng(0)
    x, net = rng.normal(size=(30, 4)), network.SpectralNetwork([4, 6, 3], seed=1)
    net.layers.weights, net.layers.biases = ([w.astype(np.float64) for w in ws] for ws in (net.layers.weights, net.layers.biases))
    net.orthonormalise(x)
    y = net(x)
    assert np.allclose(y.T @ y / 30, np.eye(3), atol=1e-4)
    lap = network.batch_laplacian(network.batch_affinity(x, 5), "rw")
    out = net.layers.forward(x)
    grads = net.layers.backward(out, ((lap + lap.T) @ y / len(y)) @ net.ortho.T)
    for k, parameters in enumerate(net.layers.weights + net.layers.biases):
        at = np.unravel_index(1, parameters.shape)
        parameters[at] += 1e-3
        up = network.spectral_loss(lap, net(x))
        parameters[at] -= 2e-3
        down = network.spectral_loss(lap, net(x))
        parameters[at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-3 * max(1, abs(grads[k][at]))


def test_batch_affinity_is_that_of_the_tables(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(25, 3))
    v = frame(spark, list(enumerate(x.tolist())), "id long, vec array<double>")
    for metric, local in (("cosine", True), ("euclidean", True), ("cosine", False)):
        w = aff.affinity(v, 4, 2, local, metric=metric)
        assert np.abs(dense(w, 25) - network.batch_affinity(x, 4, 2, local, metric)).max() < 1e-9


def test_trained_embeddings_separate_groups(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.4, (150, 3)) for c in 4 * np.eye(3)])
    v, truth = frame(spark, list(enumerate(x.tolist())), "id long, vec array<double>"), np.repeat([0, 1, 2], 150)
    model = network.ScaSE(2, spectral_hiddens=(64, 64), spectral_max_epochs=30, spectral_batch_size=200, spectral_n_nbg=20)
    y = np.array([r["vec"] for r in model.fit_transform(v).orderBy("id").collect()])
    assert y.shape == (450, 2) and len(model.get_eigenvalues()) == 2 and (np.diff(model.values) >= 0).all()
    losses = [a for a, _ in model.net.trainer.losses]
    assert min(losses) < 0.3 * losses[0] and model.grassmann_distance(v) < 1.01  # the exact one has three values of zero, of which it drops any one
    means = np.array([y[truth == k].mean(0) for k in range(3)])
    inside = np.mean([np.linalg.norm(y[truth == k] - means[k], axis=1).mean() for k in range(3)])
    assert inside < 0.5 * min(np.linalg.norm(means[a] - means[b]) for a, b in ((0, 1), (0, 2), (1, 2)))
    net = network.SpectralNet(3, spectral_hiddens=(32, 3), spectral_epochs=40, spectral_lr=1e-2, spectral_n_nbg=20, is_sparse_graph=True).fit(v)
    p = np.array([r["p"] for r in net.predict(v).orderBy("id").collect()])
    assert np.allclose(p.sum(1), 1) and len(p) == 450
    net.validate_hiddens()
    raw, encoded = net.random_batch(v, 10)
    assert raw.count() == encoded.count() == 10
    for wrong in (lambda: network.ScaSE(0), lambda: network.SpectralNet(0), lambda: network.SpectralNet(4, spectral_hiddens=(8, 3)).validate_hiddens(), lambda: net.fit(v.limit(0))):
        with pytest.raises(ValueError):
            wrong()


def test_shared_folder(spark):
    df = materialize.written(spark.range(5))
    assert df.count() == 5
    materialize.discarded(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
    materialize.discarded(materialize.written(spark.range(0)))


def test_lemmas(spark):
    rows = frame(spark, [(1, ["mice", "run", "mice"]), (2, []), (3, None)], "doc_id long, tokens array<string>")
    table = frame(spark, [("mice", "mouse"), ("mice", "zzz"), ("run", None), (None, "x")], "form string, lemma string")
    assert {r["doc_id"]: r["tokens"] for r in lemmatised(rows, table).collect()} == {1: ["mouse", "run", "mouse"], 2: [], 3: []}


def test_sparse_neighbours_and_term_affinity(spark):
    rng = np.random.default_rng(3)
    m = np.where(rng.random((40, 30)) < 0.2, rng.random((40, 30)), 0)
    rows = frame(spark, [(i, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for i, r in enumerate(m)], "id long, dims array<long>, ws array<double>")
    whole = knn.nearest(frame(spark, list(enumerate(m.tolist())), "id long, vec array<double>"), 5, "euclidean", include_self=False)
    want = {(r["i"], r["rank"]): round(r["dist"], 6) for r in whole.collect()}
    for block, cut in ((4096, 1024), (11, 7)):
        assert {(r["i"], r["rank"]): round(r["dist"], 6) for r in knn.nearest_sparse(rows, 5, block, cut).collect()} == want
    docs = frame(spark, [(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["d", "e"])], "doc_id long, tokens array<string>")
    words = frame(spark, [(w, i) for i, w in enumerate("abcde")], "word string, id int")
    w = {(r["i"], r["j"]): r["w"] for r in pipeline.run_term_affinity(tfidf.tfidf(docs, 3), words, 2).collect()}
    assert w[0, 1] == w[1, 0] == 1.0 and w[3, 4] == 1.0 and all(0 < x <= 1 for x in w.values())


def test_large_dictionaries_are_joined_without_hot_keys(spark, tiny, monkeypatch):
    words = dic.dictionary(tiny)
    want = sorted(map(tuple, dic.doc2bow(tiny, words).collect()))
    scores = sorted((r["doc_id"], r["word"], round(r["tfidf"], 9)) for r in tfidf.tfidf(tiny, 5).collect())
    monkeypatch.setattr(dic, "BROADCAST", 1)
    monkeypatch.setattr(dic, "HEAVY", 2)
    assert sorted(map(tuple, dic.doc2bow(tiny, words).collect())) == want
    assert sorted((r["doc_id"], r["word"], round(r["tfidf"], 9)) for r in tfidf.tfidf(tiny, 5).collect()) == scores


def test_topic_model_from_saved_predictions(spark):
    docs = frame(spark, [(d, ["ab", "ac", "ad"] if d % 2 else ["xa", "xb", "xc"]) for d in range(40)], "doc_id long, tokens array<string>")
    names = frame(spark, list(enumerate(["ab", "ac", "ad", "xa", "xb", "xc"])), "ix int, word string")
    p = frame(spark, [(i, int(i > 2), 1.0) for i in range(6)], "ix int, topic int, p double")
    model = pipeline.run_topic_model(docs, names, p, 2, passes=4)
    share = model.lam / model.lam.sum(1, keepdims=True)
    assert share.max(0).min() > 0.25 and len(share) == 2


def test_prior(spark):
    p = frame(spark, [(1, 0, 1.0), (1, 0, 1.0), (2, 0, 0.5), (2, 1, 0.5), (3, 2, None)], "ix int, topic int, p double")
    rows = prior.soft_prior(p, 3)
    sums = rows.groupBy("ix").agg(F.sum("prior").alias("s"), F.min("prior").alias("m")).collect()
    assert len(sums) == 3 and all(abs(r["s"] - 1) < 1e-12 and r["m"] > 0 for r in sums)
    assert {(r["ix"], r["topic"]): round(r["prior"], 6) for r in rows.collect()}[1, 0] == round(1.01 / 1.03, 6)
    names = frame(spark, [(1, "a"), (2, "gone")], "ix int, word string")
    words = frame(spark, [("a", 5), ("new", 6)], "token string, token_id int")
    eta = {(r["topic"], r["token_id"]): r["eta"] for r in prior.align_eta(rows, names, words, 3).collect()}
    assert eta[0, 6] == 0.0 and abs(eta[0, 5] - 1.01 / 1.03) < 1e-12 and len(eta) == 6


def test_special_functions():
    assert abs(lda.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-9
    for x in (0.05, 0.5, 1.0, 3.3, 40.0):
        assert abs(lda.log_gamma(np.array([x]))[0] - math.lgamma(x)) < 1e-8


def topics_corpus(spark):
    rng = np.random.default_rng(0)
    rows = [(d, int(w), 1) for d in range(60) for w in set((rng.integers(0, 5, 6) + 5 * (d % 2)).tolist())]
    return frame(spark, rows, "doc_id long, token_id int, tf long")


def test_matrix_prior_lda(spark):
    eta = np.full((2, 10), 0.01)
    eta[0, :5] += 1
    eta[1, 5:] += 1
    model = lda.MatrixPriorLDA(eta, passes=6).fit(topics_corpus(spark))
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))
    p = model.lam / model.lam.sum(1, keepdims=True)
    assert p[0, :5].sum() > 0.95 and p[1, 5:].sum() > 0.95
    with pytest.raises(ValueError):
        lda.MatrixPriorLDA(np.broadcast_to(1.0, (10_000, 10_000)))


def plain_steps(own, counts, alpha, steps=200):
    """gamma of one document, own (words, topics), by the textbook's loop."""
    gamma = np.ones(own.shape[1])
    for _ in range(steps):
        theta = np.exp(lda.digamma(gamma))
        last, gamma = gamma, alpha + theta * ((counts / (own @ theta))[:, None] * own).sum(0)
        if np.abs(gamma - last).mean() < 1e-3:
            break
    return gamma


def test_document_step_in_blocks():
    """Blocks of documents, filled up with words of count 0, give what each document gives alone; factors of a word cancel."""
    rng = np.random.default_rng(0)
    own, counts, alpha = rng.gamma(0.3, 1, (40, 9, 12)), rng.integers(1, 4, (40, 9)).astype(float), rng.random(12) + 0.05
    counts[::3, 6:] = 0
    want = np.array([plain_steps(o[c > 0], c[c > 0], alpha) for o, c in zip(own, counts)])
    exact = lda.document_step(own * rng.random((40, 9, 1)), counts, alpha, 200)
    single = lda.document_step(own.astype(np.float32), counts.astype(np.float32), alpha.astype(np.float32), 200)
    assert np.abs(exact - want).mean(1).max() < 0.005 and np.abs(single - exact).mean(1).max() < 0.005  # who is done may go on with the others
    assert np.abs(single.sum(1) - counts.sum(1) - alpha.sum()).max() < 1e-3
    x = np.array([0.0096, 0.05, 1.0, 3.3, 40.0])
    assert np.abs(lda._psi(x) - lda.digamma(x)).max() < 1e-9 and np.abs(lda._lgamma(x) - lda.log_gamma(x)).max() < 1e-9


def test_packed_documents(spark):
    rng = np.random.default_rng(1)
    want = {d: sorted((int(w), int(rng.integers(1, 9))) for w in rng.choice(500, 1 + d % 90, replace=False)) for d in range(300)}
    rows = frame(spark, [(d, w, c) for d, e in want.items() for w, c in e], "doc_id long, token_id int, tf long")
    got, cells = [], 0
    for r in lda.packed(rows).collect():
        ids, counts = np.frombuffer(r["ids"], np.int32).reshape(r["n"], -1), np.frombuffer(r["counts"]).reshape(r["n"], -1)
        got += [[(int(w), int(c)) for w, c in zip(i, k) if c] for i, k in zip(ids, counts)]
        cells += ids.size
    assert sorted(got) == sorted(want.values()) and cells < 1.2 * sum(map(len, got))


def test_matrix_prior_beyond_single_precision(spark):
    """Words whose topics exclude each other so far that single precision has no common topic lose no count."""
    eta = np.full((2, 4), 1e-3)
    eta[0, :2] = eta[1, 2:] = 1e6
    rows = frame(spark, [(d, w, 3) for d in range(20) for w in range(4)], "doc_id long, token_id int, tf long")
    model = lda.MatrixPriorLDA(eta, passes=2).fit(rows)
    assert abs(model.lam.sum() - eta.sum() - 20 * 4 * 3) < 0.1 and all(np.isfinite(model.bounds))


def test_symmetric_lda_takes_the_built_in_steps(spark):
    """After one pass the weights differ from the start by the built-in model's small first step; the topics' weights are fitted."""
    model = lda.MatrixPriorLDA(np.full((2, 10), 0.5), passes=1, online=True).fit(topics_corpus(spark))
    start, part = np.random.default_rng(0).gamma(100.0, 0.01, (2, 10)), 1025.0**-0.51
    total = topics_corpus(spark).agg(F.sum("tf")).first()[0]
    assert abs(model.lam.sum() - ((1 - part) * start.sum() + part * (0.5 * 20 + total))) < 1e-3
    assert len(model.alpha) == 2 and (model.alpha > 0).all() and (model.alpha != 0.5).any()


def test_symmetric_lda(spark):
    sums = lda.symmetric(topics_corpus(spark), 10, topics=2, passes=3).groupBy("topic").agg(F.sum("weight").alias("s")).collect()
    assert len(sums) == 2 and all(abs(r["s"] - 1) < 1e-6 for r in sums)


@pytest.mark.parametrize("name", ["lda_symmetric", "lda_eta"])
def test_lda_queries_have_all_topics_and_words(name, spark, data):
    from topicloom.catalog import corpus, learned

    c = corpus.cleaned(spark, data)
    n = dic.lda_input(c, c.count())[1].count()
    got = learned.QUERIES[name](spark, data).agg(F.countDistinct("topic"), F.countDistinct("token_id"), F.count(F.lit(1))).first()
    assert n > 1000 and tuple(got) == (learned.TOPICS, n, learned.TOPICS * n)


def test_metrics(spark):
    v, truth = blobs(spark)
    labels = frame(spark, [(i, int(t)) for i, t in enumerate(truth)], "id long, label int")
    assert metrics.knn_score(v, labels).first()["accuracy"] == 1.0
    assert metrics.assignment(np.array([[4.0, 1, 3], [2, 0, 5], [3, 2, 2]])) == [(0, 1), (1, 0), (2, 2)]
    assert metrics.labels_from([(0, 1), (1, 0)]) == [1, 0]
    assert metrics.grassmann(v, v, 3) < 1e-8 and np.abs(metrics.grassmann_each(v, v, 3)).max() < 1e-9


def test_eigen_scale_masks(spark):
    v = frame(spark, [(1, [1.0, 1.0, 1.0])], "id long, vec array<double>")
    assert vec.eigen_scale(v, [0.5, 1.0, 0.25]).first()["vec"] == [0.5, 0.75]


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "docs.json").write_text('["first text", null, "third"]')
    assert [(r["doc_id"], r["text"]) for r in src.read_json_corpus(spark, str(tmp_path / "docs.json")).collect()] == [(0, "first text"), (1, None), (2, "third")]
    (tmp_path / "docs.csv").write_text('id,text,label\n7,"two\nlines, quoted ""so""",sport\n8,plain,\n')
    got = [(r["doc_id"], r["text"], r["label"]) for r in src.read_csv_corpus(spark, str(tmp_path / "docs.csv")).orderBy("doc_id").collect()]
    assert got == [(0, 'two\nlines, quoted "so"', "sport"), (1, "plain", None)]
    (tmp_path / "v.txt").write_text("the 1 2.5\n\nof 3 x\nthe 5 6\n")
    v = src.read_vectors(spark, str(tmp_path / "v.txt"))
    assert [(r["ix"], r["word"], r["vec"]) for r in v.orderBy("ix").collect()] == [(0, "the", [1.0, 2.5]), (2, "of", [3.0, None]), (3, "the", [5.0, 6.0])]
    assert {r["word"]: r["ix"] for r in src.word_index(v).collect()} == {"the": 3, "of": 2}
    words = frame(spark, [("b",), ("a ",)], "word string")
    src.write_lines(words, str(tmp_path / "w"), "word", order="word")
    assert sorted(r["word"] for r in src.read_lines(spark, str(tmp_path / "w"), strip=True).collect()) == ["a", "b"]
    for kind in ("parquet", "csv", "txt"):
        src.write_table(words, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    src.write_assignments(frame(spark, [(1, 2)], "id long, label int"), str(tmp_path / "a"))
    with pytest.raises(ValueError):
        src.write_table(words, str(tmp_path / "x"), "pickle")


def test_stream_counts_equal_batch_counts(spark, data, tmp_path):
    from topicloom.streaming import document_counts as stream

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "posted_at")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    query = stream.start(stream.running_counts(stream.read_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("token").agg(F.max("df").alias("df"))
    want = stream.running_counts(docs)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_pipelines(spark, data):
    v, _ = blobs(spark)
    for mode in ("gmm", "rw", "sn", "landmarks"):
        rows = pipeline.run_prior(v, pipeline.Settings(mode=mode, topics=3, components=2, n_nbg=60, hiddens=(16,)))
        sums = rows.groupBy("ix").agg(F.sum("prior").alias("s"), F.min("prior").alias("m")).collect()
        assert len(sums) == 120 and all(abs(r["s"] - 1) < 1e-9 and r["m"] > 0 for r in sums)
    with pytest.raises(ValueError):
        pipeline.Settings(mode="other")
    assert pipeline.run_prior(v.limit(0), pipeline.Settings()).count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert pipeline.run_tfidf(docs).count() > 0
    wv = frame(spark, [(i, w, [float(i)]) for i, w in enumerate(["zzz", "careful", "window", "nothere"])], "ix int, word string, vec array<float>")
    assert {r["word"] for r in pipeline.aligned_vectors(docs, wv, pipeline.Settings()).collect()} <= {"careful", "window"}


def test_scans_are_pruned(spark, data):
    plan = dic.doc_tokens(tokenized(spark.read.parquet(f"{data}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_ann_and_batch(spark):
    v = ring(spark)
    exact = knn.nearest(v, 4, "euclidean", include_self=False)
    close = {(r["i"], r["j"]) for r in knn.approximate(v, 4, width=0.5, radius=1.0).collect()}
    assert len(close & {(r["i"], r["j"]) for r in exact.collect()}) >= 0.9 * 240
    assert knn.sparse_batch(v, exact, 25).count() == 25


def test_most_similar(spark):
    got = knn.most_similar(ring(spark), [0, 999], 2).orderBy("rank").collect()
    assert [(r["query"], r["id"]) for r in got] == [(0, 1), (0, 59)]
