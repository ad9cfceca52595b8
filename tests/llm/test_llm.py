"""The training-data operators against brute force, exact round trips or held-out truth, on small tables with every edge case."""

import itertools
import math
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import catalog, distinctive, leaks, neighbours, new_text, pairs, reading_level, records, similar_groups, subjects, term_counts, tokenize


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_value(name, spark, duck, data, same):
    assert same(catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs_without_repeated_rows(name, spark, data):
    rows = catalog.QUERIES[name](spark, data)
    got = rows.toPandas().astype(str)
    assert len(got) and not got.duplicated().any()


# counting operators


def corpus(spark, rows):
    """Extra columns clash with names that the operators use."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, tokens string, df long")


EDGE = [(1, "A b  B\tc"), (1, "c b b a"), (2, None), (3, "   "), (4, ""), (None, "lost row"), (5, "a"), (6, "b c"), (7, "a　b\x1cc"), (8, "z " * 20000)]


def brute(rows):
    docs = {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] and r[1].split()), key=lambda r: r[1]):
        docs[i] = t.lower().split()
    return docs


def test_records(spark):
    got = {r["doc_id"]: sorted(r["tokens"]) for r in records.token_records(corpus(spark, EDGE)).collect()}
    assert got == {i: sorted(t) for i, t in brute(EDGE).items()}


def test_term_counts(spark):
    docs = brute(EDGE)
    want = {t: (sum(t in d for d in docs.values()), sum(d.count(t) for d in docs.values())) for d in docs.values() for t in d}
    recs = records.token_records(corpus(spark, EDGE))
    terms, heavy, light, n = term_counts.term_counts(recs)
    assert n == len(docs) and {r["token"]: (r["df"], r["cf"]) for r in terms.collect()} == want
    counts, n2 = term_counts.count_heavy(recs, ["b", "nowhere", "z"])
    assert n2 == n and counts == {"b": want["b"], "z": want["z"]}


def test_term_counts_do_not_depend_on_what_is_heavy(spark, monkeypatch):
    recs = records.token_records(corpus(spark, EDGE)).cache()
    tables = []
    for chosen in ([], ["a"], ["a", "b", "c", "z"]):
        monkeypatch.setattr(term_counts, "heavy_terms", lambda *_, c=chosen: c)
        tables.append({(r["token"], r["df"], r["cf"]) for r in term_counts.term_counts(recs)[0].collect()})
    assert tables[0] == tables[1] == tables[2]


def test_dominant(spark):
    rows = [(1, "t t t u"), (2, "only"), (3, "p q"), (4, "t u")] + [(i, "u") for i in range(10, 20)]
    recs = records.token_records(corpus(spark, rows))
    docs = brute(rows)
    n, df = len(docs), {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    want = set()
    for i, d in docs.items():
        s = {t: d.count(t) * (math.log((1 + n) / (1 + df[t])) + 1) for t in d}
        want |= {(i, t) for t in s if all(s[t] >= 3 * s[u] * (1 - 1e-12) for u in s if u != t)}
    assert {tuple(r) for r in distinctive.dominant(distinctive.scored(*distinctive.with_marginals(recs))).collect()} == want
    assert all(r["ppmi"] >= 0 for r in distinctive.distinctiveness(recs).collect())


@pytest.mark.parametrize("least,lift", [(2, 0.0), (3, 1.2)])
@pytest.mark.parametrize("dense", [0, 3, 100])
def test_item_pairs(spark, monkeypatch, least, lift, dense):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(14)]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 12]) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    docs = {i: set(d) for i, d in brute(rows).items()}
    n, df = len(docs), {w: sum(w in d for d in docs.values()) for w in words}
    want = {}
    for a, b in itertools.combinations(sorted(words), 2):
        c = sum(a in d and b in d for d in docs.values())
        if c >= least and c * n / (df[a] * df[b]) >= lift:
            want[a, b] = c
    monkeypatch.setattr(pairs, "DENSE", max(dense, 1))
    monkeypatch.setattr(pairs, "SLICE", 50)
    got = pairs.item_pairs(records.token_records(corpus(spark, rows)), least, lift).collect()
    assert {(r["token_a"], r["token_b"]): r["c"] for r in got} == want


def test_block_counts_agree_for_any_split():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 12, 200)
    item = np.concatenate([rng.choice(40, s, replace=False) for s in sizes]).astype(np.int64)
    want = {}
    at = 0
    for s in sizes:
        for a, b in itertools.combinations(sorted(item[at : at + s].tolist()), 2):
            want[a, b] = want.get((a, b), 0) + 1
        at += s
    for heavy in (0, 10, 40):
        got = {}
        for a, b, c in pairs.count_block(sizes, item, item < heavy):
            for x in zip(a.tolist(), b.tolist(), c.tolist()):
                got[x[:2]] = got.get(x[:2], 0) + x[2]
        assert got == want


def test_empty_corpus(spark):
    recs = records.token_records(corpus(spark, [(1, None)]))
    assert term_counts.term_counts(recs)[0].count() == 0 and pairs.item_pairs(recs).count() == 0
    assert distinctive.distinctiveness(recs).count() == 0


# similarity


def groups_by_force(vectors, least=0.95):
    keys = sorted(vectors)
    dims = sorted({d for v in vectors.values() for d in v})
    m = np.array([[vectors[k].get(d, 0) for d in dims] for k in keys])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    like = m @ m.T >= least
    return {(k, keys[int(np.argmax(like[i]))]) for i, k in enumerate(keys) if like[i].sum() >= 3}


def planted(n_groups=12, noise=300, seed=0):
    rng = np.random.default_rng(seed)
    vectors, key = {}, 0
    for g in range(n_groups):
        base = {int(d): float(rng.uniform(0.5, 3)) for d in rng.choice(400, 9, replace=False)}
        for _ in range(int(rng.integers(3, 9))):
            vectors[key * 7 % 10007] = {d: w * float(rng.uniform(0.97, 1.03)) for d, w in base.items()}
            key += 1
    for _ in range(noise):
        vectors[key * 7 % 10007] = {int(d): float(rng.uniform(0.5, 3)) for d in rng.choice(400, 9, replace=False)}
        key += 1
    return vectors


def edges(spark, vectors, extra=()):
    rows = [(r, d, w, 1, "x") for r, v in vectors.items() for d, w in v.items()]
    return spark.createDataFrame(rows + rows[:50] + list(extra), "u int, v int, weight double, c int, label string")


@pytest.mark.parametrize("chunk", [2048, 16])
def test_similar_groups(spark, monkeypatch, chunk):
    monkeypatch.setattr(similar_groups, "CHUNK", chunk)
    monkeypatch.setattr(similar_groups, "AIM", 40)
    vectors = planted()
    vectors |= {20000 + i: dict(vectors[0]) for i in range(40)}  # copies
    extra = [(None, 1, 1.0, 1, "x"), (5, None, 1.0, 1, "x"), (9990, 3, None, 1, "x"), (9991, 3, 0.0, 1, "x")]
    got = {(r["rec_id"], r["group_id"]) for r in similar_groups.similar_groups(edges(spark, vectors, extra), "u", "v", "weight").collect()}
    assert got == groups_by_force(vectors)


def test_similar_groups_edge(spark):
    none = edges(spark, {1: {1: 1.0}}).limit(0)
    assert similar_groups.similar_groups(none, "u", "v", "weight").count() == 0
    assert similar_groups.clusters(none, "u", "v", "weight").count() == 0
    chain = {1: {1: 1.0}, 2: {1: math.cos(0.25), 2: math.sin(0.25)}, 3: {1: math.cos(0.5), 2: math.sin(0.5)}, 4: {9: 1.0}}
    assert similar_groups.similar_groups(edges(spark, chain), "u", "v", "weight").count() == 0  # no three are mutually similar


def flat(angles):
    """Records in a plane, by the degrees of their angles."""
    return {k: {1: math.cos(math.radians(a)), 2: math.sin(math.radians(a))} for k, a in angles.items()}


def groups_of(spark, vectors):
    rows = similar_groups.similar_groups(edges(spark, vectors), "u", "v", "weight").collect()
    assert len(rows) == len({r["rec_id"] for r in rows})
    return {r["rec_id"]: r["group_id"] for r in rows}


@pytest.mark.parametrize("chunk", [2048, 8])
def test_large_group_with_outsiders_and_a_second_group(spark, monkeypatch, chunk):
    monkeypatch.setattr(similar_groups, "CHUNK", chunk)
    angles = {k: 0.01 * k for k in range(40)} | {50: 20.0, 51: -20.0} | {60 + k: 42 + 0.01 * k for k in range(30)}
    assert groups_of(spark, flat(angles)) == {k: 0 for k in range(40)} | {60 + k: 60 for k in range(30)}


def test_first_record_does_not_spoil_a_group(spark):
    assert groups_of(spark, flat({1: 0, 2: 15, 3: 25, 4: 30})) == {2: 2, 3: 2, 4: 2}


def test_overlapping_groups_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    angles = {k: rng.uniform(0, 170) for k in rng.sample(range(1000), 40)}
    like = {(a, b): math.cos(math.radians(angles[a] - angles[b])) >= 0.95 for a in angles for b in angles}
    want = {}
    for k in angles:  # mutually similar angles lie in an arc; each of them starts at a member
        arcs = [[o for o in angles if angles[o] >= angles[s] and like[s, o]] for s in angles if like[s, k] and angles[s] <= angles[k]]
        size, head = max((len(g), -min(g)) for g in arcs)
        if size >= 3:
            want[k] = -head
    for chunk in (2048, 4):
        monkeypatch.setattr(similar_groups, "CHUNK", chunk)
        assert groups_of(spark, flat(angles)) == want


@pytest.mark.parametrize("chunk", [2048, 3])
def test_group_between_two_leaders(spark, monkeypatch, chunk):
    monkeypatch.setattr(similar_groups, "CHUNK", chunk)
    angles = {0: -20.7, 1: 20.7} | {10 + k: (0.5 + 0.01 * k) * (-1) ** k for k in range(8)}
    assert groups_of(spark, flat(angles)) == {10 + k: 10 for k in range(8)}


def test_short_records_are_not_lost(spark):
    """Two entries of equal size, hashed to one place with other signs, would leave nothing."""
    rng, vectors = random.Random(3), {}
    for g in range(700):
        a, b = rng.sample(range(10_000), 2)
        for k in range(3):
            vectors[3 * g + k] = {a: 1.0 + 0.001 * k, b: 1.0}
    assert set(groups_of(spark, vectors)) == set(vectors)


def test_groups_of_four_beside_decoys(spark):
    """Dense vectors in few clusters: each group has two near strangers at 0.9 to 0.93."""
    rng, rows = np.random.default_rng(0), []
    unit = lambda x: x / np.linalg.norm(x)

    def at(base, cos):
        o = rng.normal(size=24)
        return cos * base + math.sqrt(1 - cos * cos) * unit(o - (o @ base) * base)

    middle = [unit(rng.normal(size=24)) for _ in range(4)]
    for g in range(250):
        c = unit(middle[g % 4] + rng.normal(size=24) * 0.15)
        rows += [at(c, math.sqrt(0.985)) for _ in range(4)] + [at(c, 0.93) for _ in range(2)]
    x = np.array(rows)
    like = x @ x.T >= 0.95
    three = {i for i in range(len(x)) for j in np.flatnonzero(like[i]) if j != i and (like[i] & like[j]).sum() >= 3}
    got = set(groups_of(spark, {i: dict(enumerate(v.tolist())) for i, v in enumerate(x)}))
    assert len(three) >= 1000 and got <= three and len(got) >= 0.99 * len(three)


def test_components(spark):
    rng = random.Random(8)
    links = [(k, k + 1) for k in range(60, 90)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)]
    label = {v: v for e in links for v in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["v"]: r["u"] for r in similar_groups.components(spark.createDataFrame(links, "v int, u int")).collect()}
    assert got == {v: u for v, u in label.items() if v != u}


def test_clusters_describe_all_records(spark):
    vectors = planted()
    got = similar_groups.clusters(edges(spark, vectors), "u", "v", "weight").collect()
    assert sum(r["size"] for r in got) == len(vectors) and all(1 <= len(r["typical"]) <= 5 for r in got)


def vec_frame(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(e) for e in v], "w", 1) for i, v in x], "ix int, vec array<float>, word string, rn int")


def test_usable(spark):
    rows = [(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None), (5, [1.0]), (None, [1.0, 1.0]), (6, [float("inf"), 1.0])]
    assert [r["ix"] for r in neighbours.usable(vec_frame(spark, rows), 2).collect()] == [1]


def recall(spark, x, k, **settings):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 12)
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i, row in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :k]) for j in row}
    got = neighbours.nearest(neighbours.usable(vec_frame(spark, list(enumerate(x.astype(np.float32).astype(float)))), x.shape[1]), k, **settings)
    got = {(r["ix"], r["nbr"]) for r in got.collect()}
    return len(want & got) / len(want), got


def test_nearest_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 20)).astype(np.float32).astype(float)
    assert recall(spark, x, 5)[0] >= 0.95
    assert recall(spark, x, 5, share=0.5)[0] >= 0.95


def test_nearest_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)).astype(np.float32).astype(float)
    whole = recall(spark, x, 4)[1]
    monkeypatch.setattr(neighbours, "CHUNK", 37)
    assert recall(spark, x, 4)[1] == whole


def test_nearest_in_rounds(spark, monkeypatch):
    """Rounds and sections change no row, and what lies shuffled at a time stays far below all the posted copies."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 50)).astype(np.float32).astype(float)
    x[2980:] = x[0]
    frame = neighbours.usable(vec_frame(spark, list(enumerate(x))), 50).cache()
    whole = {tuple(r) for r in neighbours.nearest(frame, 4).collect()}
    copies, most, over = 3000 * neighbours.POSTS * (200 + 126), [0], threading.Event()
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def lying():
        return sum(f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllFiles()) if f.getName().startswith("shuffle_"))

    def watch():
        while not over.wait(0.05):
            most.append(lying())

    spark.sparkContext._jvm.System.gc()
    before = lying()
    watcher = threading.Thread(target=watch)
    watcher.start()
    monkeypatch.setattr(neighbours, "ROUND", 0, raising=False)
    monkeypatch.setattr(neighbours, "ROUND_EACH", 600, raising=False)
    try:
        got = {tuple(r) for r in neighbours.nearest(frame, 4).collect()}
    finally:
        over.set()
        watcher.join()
    assert got == whole and max(most) - before < copies / 2
    monkeypatch.setattr(neighbours, "CHUNK", 100)
    monkeypatch.setattr(neighbours, "SECTION", 1, raising=False)
    close = {(i, j) for i, j, c in whole if c >= 0.5}
    got = {tuple(r) for r in neighbours.nearest(frame, 4, least=0.5).collect()}
    assert close <= {(i, j) for i, j, _ in got} and all(c >= 0.5 for _, _, c in got)


def test_nearest_with_copies_and_few_rows(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(12)] + [(20, [3.0, 2.0, 1.0])]
    got = neighbours.nearest(neighbours.usable(vec_frame(spark, same), 3), 3).collect()
    by = {}
    for r in got:
        by.setdefault(r["ix"], set()).add(r["nbr"])
    assert all(by[i] == set(sorted(set(range(12)) - {i})[:3]) for i in range(12)) and by[20] == {0, 1, 2}
    assert neighbours.nearest(neighbours.usable(vec_frame(spark, same[:1]), 3), 3).count() == 0
    two = neighbours.nearest(neighbours.usable(vec_frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]), 2), 5).collect()
    assert {(r["ix"], r["nbr"]) for r in two} == {(1, 2), (2, 1)}


def test_nearest_with_scaled_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 50))
    x[:40] = x[0] * rng.uniform(0.5, 3, 40)[:, None]
    x[200:] = x[0].astype(np.float32)
    rows = list(enumerate(x.astype(np.float32).astype(float)))
    got = neighbours.nearest(neighbours.usable(vec_frame(spark, rows), 50), 5).collect()
    by = {}
    for r in got:
        by.setdefault(r["ix"], []).append(r["nbr"])
    u = neighbours.unit(np.array([v for _, v in rows]))
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1, kind="stable")[:, :5]
    assert all(sorted(by[i]) == sorted(want[i].tolist()) for i in [*range(40), *range(200, 240)])


def near_copies(rng, groups, size, dims=50):
    """Groups of near vectors and as many apart, some of them scaled copies."""
    x = np.repeat(rng.normal(size=(groups, dims)), size, axis=0)
    x = np.concatenate([x + 0.15 * rng.normal(size=x.shape), rng.normal(size=(groups * size, dims))])
    x[1] = x[0] * 2
    return x.astype(np.float32)


def close_truth(x, k, least):
    u = neighbours.unit(x)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i, row in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :k]) for j in row if s[i, j] >= least}


def test_close_neighbours(spark, monkeypatch):
    """All near neighbours come out, of files that are compared in full and of such that other pivots divide, in one section or several."""
    x = near_copies(np.random.default_rng(6), 150, 9)
    frame = neighbours.usable(vec_frame(spark, list(enumerate(x.astype(float)))), 50).cache()
    want = close_truth(x, 5, 0.9)
    assert len(want) > 5000
    for whole, chunk in ((4096, 2048), (20, 2048), (20, 3)):
        monkeypatch.setattr(neighbours, "CLOSE_FILE", whole, raising=False)
        monkeypatch.setattr(neighbours, "CHUNK", chunk)
        assert {(r["ix"], r["nbr"]) for r in neighbours.nearest(frame, 5, least=0.9).collect()} == want


def test_close_neighbours_take_less_time():
    """A file of 4,000 vectors, as it is searched with orders and without: the best of three times."""
    x = near_copies(np.random.default_rng(7), 250, 8)
    near = [np.random.default_rng(i).permutation(300)[:63].astype(np.int16).tobytes() for i in range(len(x))]
    rows = neighbours.pd.DataFrame({"file": 0, "ix": range(len(x)), "raw": [v.tobytes() for v in x], "near": near, "section": 0, "i": 0, "j": 0})
    took = {}
    for _ in range(3):
        for name, search in (("orders", lambda: neighbours.search_section(rows, 5, neighbours.SHARE, neighbours.CHUNK, 0.9)), ("close", lambda: neighbours.close_section(rows, 5, 0.9, neighbours.CLOSE_FILE))):
            began = time.perf_counter()
            got = search()
            took[name] = min(took.get(name, math.inf), time.perf_counter() - began)
    assert set(zip(got["ix"].tolist(), got["nbr"].tolist())) == close_truth(x, 5, 0.9)
    assert took["close"] < took["orders"]


def test_greatest():
    s = np.random.default_rng(8).normal(size=(50, 4000))
    for width in (40, 2600, 4000):
        assert (np.sort(neighbours.greatest(s[:, :width], 10)) == np.sort(np.argsort(-s[:, :width], axis=1)[:, :10])).all()


def test_footrule():
    rng = np.random.default_rng(0)
    near = np.array([rng.permutation(40)[:32] for _ in range(6)] + [rng.permutation(40)[:32] + 100]).astype(np.int16)
    got = neighbours.footrule(near, *neighbours.postings(near[1:]))
    for a, b in itertools.product(range(7), range(1, 7)):
        x, y = ({p: i for i, p in enumerate(near[r].tolist())} for r in (a, b))
        assert got[a, b - 1] == sum(abs(x.get(p, 32) - y.get(p, 32)) for p in set(x) | set(y))


def test_footrule_decides_before_any_cosine():
    """Of 400 targets, the query's best one has a far order: it must not come out."""
    rng = np.random.default_rng(1)
    x, near = rng.normal(size=(400, 8)).astype(np.float32), np.array([rng.permutation(200)[:63] for _ in range(400)]).astype(np.int16)
    x[7], near[7] = x[0], near[0] + 500
    near[1:60] = near[0]
    rows = neighbours.pd.DataFrame({"ix": range(400), "raw": [v.tobytes() for v in x], "near": [v.tobytes() for v in near]})
    near[7] += 500
    got = neighbours.pd.concat(neighbours.search_file(rows[:1], rows, 3, 0.2))
    assert len(got) == 3 and 7 in set(got["nbr"])
    rows.at[7, "near"] = near[7].tobytes()
    got = neighbours.pd.concat(neighbours.search_file(rows[:1], rows, 3, 0.2))
    assert len(got) == 3 and 7 not in set(got["nbr"]) and all(got["nbr"] < 400)


# texts


@pytest.fixture(scope="module")
def reference_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokenize.encoder(tokenize.vocabulary_path()).ranks
    return tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n\n", "a", "  two  spaces ", "don't DON'T I'll", "naïve ﬁligree ½ Ⅳ ｆｕｌｌ", "日本語 と ελληνικά", "😀‍👩‍👧 ok", "<|endoftext|> text", "x\x00\x1c\x85y", "tab\t\r\nend  ", "a" * 3000, "-" * 300, "12345 ２９"]


def test_encoding_is_exact(spark, reference_encoder):
    rng = random.Random(5)
    alphabet = list("abc '\"!\n\t .,-éß日1२Ⅳ<|>") + ["  ", "'s", "'ll", "the", " and", "　", "\x1c", "😀", "endoftext"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate([*texts, None])], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in tokenize.encoded(df).collect()}
    assert len(got) == len(texts) + 1 and got[len(texts)] == []
    wrong = [t for i, t in enumerate(texts) if got[i] != reference_encoder.encode_ordinary(t)]
    assert not wrong
    one = tokenize.encoder(tokenize.vocabulary_path())
    assert all(b"".join(one.bytes_of[i] for i in got[k]).decode() == t for k, t in enumerate(texts))
    assert tokenize.encoded(df.limit(0)).count() == 0


WORDS = [a + b for a in "ka lo mi pe ru sa ti vo".split() for b in "ban del fir gom hus jat nel pok".split()]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(1)
    items = [(k, " ".join(["Read this and answer:"] + prose(rng, 40))) for k in range(30)]
    rows, want = [], set()

    def doc(text, *found):
        rows.append((len(rows), text, 1, "x"))
        want.update((rows[-1][0], i) for i in found)

    body = [t.split() for _, t in items]
    fill = lambda n=200: " ".join(prose(rng, n))
    doc(fill())
    doc(f"{fill()} {items[3][1]} {fill()}", 3)
    doc(f"{fill(30)} {items[4][1].upper().replace(' ', chr(10))} {fill(3000)}", 4)
    doc(" ".join([fill(), *body[5][20:], fill()]), 5)
    doc(" ".join([fill(), *body[6][4:17], fill(60), *body[6][26:40], fill()]), 6)
    doc(" ".join([fill(), *body[7][10:20], fill()]))
    doc(fill(20) + " Read this and answer: " + fill(20))
    changed = body[8][:]
    for i in (8, 19, 31):
        changed[i] = "other"
    doc(" ".join([fill(), *changed[:25], "added", *changed[25:], fill()]), 8)
    doc("".join(c + "​" * (k % 5 == 0) for k, c in enumerate(items[9][1])), 9)
    doc(items[10][1] + " " + items[11][1], 10, 11)
    doc(None)
    doc("")
    doc(f"{fill(100_000)} {items[12][1]} {fill(100_000)}", 12)
    df = spark.createDataFrame(rows + rows[1:2], "doc_id long, text string, item_id int, c string")
    got = leaks.leaks(df, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert leaks.leaks(df, []).count() == 0 and leaks.leaks(df.limit(0), items).count() == 0
    table = spark.createDataFrame([(1, None), (None, "x y z"), (2, "a b c")], "item_id long, text string")
    assert leaks.items_of(table) == [(2, "a b c")]


def test_leak_behind_many_repetitions():
    rng = random.Random(3)
    item = prose(rng, 40)
    own = leaks.Items([(1, " ".join(item))])
    text = [w for _ in range(60) for w in item[:14] + prose(rng, 10)] + item[20:30]
    at = {}
    for j, h in enumerate(leaks.shingles(leaks.codes(text, leaks._Codes()), 2).tolist()):
        at.setdefault(h, []).append(j)
    assert own.share(0, at) >= leaks.HALF


def spans_by_brute_force(seeds):
    for s, (j, i) in enumerate(seeds):
        most = {s: 2}
        for e, (y, x) in enumerate(seeds):
            for f in range(e + 1, len(seeds)) if e in most else ():
                dj, di = seeds[f][0] - y, seeds[f][1] - x
                if 0 < dj <= 7 and 0 < di <= 7 and abs(di - dj) <= 4:
                    most[f] = max(most.get(f, 0), most[e] + min(di, 2))
        yield from ((i, seeds[e][1] + 2, j) for e, n in most.items() if n >= 5 and n >= 0.7 * (seeds[e][1] + 2 - i))


def shares(item, text):
    """The share that the operator finds, and that of the best of all chains."""
    own, at = leaks.Items([(1, " ".join(item))]), {}
    for j, h in enumerate(leaks.shingles(leaks.codes(text, leaks._Codes()), 2).tolist()):
        at.setdefault(h, []).append(j)
    spans = set(spans_by_brute_force(sorted((j, i) for h, some in own.pairs[0].items() for j in at.get(h, ()) for i in some)))
    two = (len({*range(a, b), *range(c, d)}) for a, b, j in spans for c, d, k in spans if c > a and k > j)
    return own.share(0, at), max([0, *(b - a for a, b, _ in spans), *two]) / len(item)


def test_leak_before_scattered_words():
    """Half of an item stands there in full; a few of its later words, at wide distances, must not undo that."""
    item = [f"w{i}" for i in range(60)]
    text = item[:31] + [w for i in range(31, 53, 7) for w in [f"x{i}"] * 5 + item[i + 5 : i + 7]]
    assert min(shares(item, text)) >= leaks.HALF


def test_leaks_of_items_that_repeat_their_words():
    rng = random.Random(4)
    cases = []
    for _ in range(300):
        few, n = rng.choice([8, 15]), rng.choice([20, 30])
        item = [str(rng.randrange(few)) for _ in range(n)]
        other = lambda k: [str(rng.randrange(3 * few)) for _ in range(k)]  # noqa: E731, B023
        at = rng.randrange(n // 2)
        part = [w if rng.random() > 0.06 else "other" for w in item[at : at + rng.randrange(n // 2, n)] if rng.random() > 0.06]
        cases.append(shares(item, other(10) + part + other(10)))
    assert all((got >= leaks.HALF) == (want >= leaks.HALF) and got <= want + 1e-9 for got, want in cases)
    assert 0 < sum(want >= leaks.HALF for _, want in cases) < len(cases)


@pytest.mark.parametrize("piece", [90, 700])
def test_long_texts_are_judged_whole(spark, monkeypatch, piece):
    rng = random.Random(2)
    items = [(k, " ".join(prose(rng, 40))) for k in range(4)]
    body = [t.split() for _, t in items]
    fill = lambda n=300: " ".join(prose(rng, n))
    texts = [f"{fill()} {items[1][1]} {fill()}", " ".join([fill(), *body[2][:12], fill(3000), *body[2][25:38], fill()]), " ".join([*body[3][25:38], fill(900), *body[3][:12]]), "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(leaks, "PIECE", piece)
    known = leaks._Codes()
    assert all(leaks.text_codes(t, known).tolist() == leaks.codes(leaks.words(t), known).tolist() for t in [*texts, "", None, " "])
    assert {tuple(r) for r in leaks.leaks(df, items).collect()} == {(0, 1), (1, 2)}  # in the third text the stretches stand in the other order


def test_words_without_differences_of_writing():
    assert leaks.words("Dеcіde whеther thе cla\u00adim — “Ｆｕｌｌ” NAÏVE") == ["decide", "whether", "the", "claim", "full", "naive"]
    assert leaks.words("Тот мир") == leaks.words("ТОТ МИР") and leaks.words(None) == []


def test_reading_levels(spark, data):
    docs, graded = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/graded_samples.parquet")
    rows = graded.collect()
    lexicon = reading_level.Lexicon(reading_level.common_words(docs))
    x, y = np.array([reading_level.features(r["text"], lexicon) for r in rows]), np.array([r["level"] for r in rows])
    order = np.random.default_rng(0).permutation(len(y))
    hits = [reading_level.Ordinal(np.delete(x, f, 0), np.delete(y, f)).predict(x[f]) == y[f] for f in np.array_split(order, 10)]
    assert np.concatenate(hits).mean() >= 0.95
    easy = rows[0]["text"]
    odd = [(1, None), (2, ""), (3, "too short to say"), (4, "der und die das ist nicht " * 40), (5, "x = [1, 2]; y += {3};\n" * 60), (6, easy * 200), (6, easy * 200), (7, "これは日本語です。" * 50)]
    got = {r["doc_id"]: r["level"] for r in reading_level.reading_levels(spark.createDataFrame([(i, t, 9) for i, t in odd], "doc_id long, text string, level int"), graded).collect()}
    assert got == {6: rows[0]["level"]}
    assert reading_level.reading_levels(docs.limit(0), graded).count() == 0


def test_reading_level_of_the_shortest_text(spark, data):
    """60 words of one letter, with nothing at either end, are 119 characters; every row that has its 60 words gets a level."""
    graded = spark.read.parquet(f"{data}/graded_samples.parquet")
    rows = [(1, " ".join(["I", "a"] * 30)), (2, " ".join(["I", "a"] * 30) + "."), (3, " ".join(["I", "a"] * 29 + ["I"])), (4, "I  a " * 29 + "I")]
    got = reading_level.reading_levels(spark.createDataFrame(rows, "doc_id long, text string"), graded).collect()
    assert {r["doc_id"] for r in got} == {1, 2}


def test_subject_labels():
    cases = {"rec.autos": "motoring", "LAW": "law", "Food & drink": "cooking", "sci.med": "medicine", "Medicine ": "medicine", "other": None, "": None, None: None, "music.law": None}
    assert all(subjects.subject_of(k) == v for k, v in cases.items())


def test_subjects_held_out(spark):
    rng = random.Random(4)
    names = ["cooking", "law", "space"]
    topic = {"cooking": WORDS[:12], "law": WORDS[12:24], "space": WORDS[24:36]}
    common = WORDS[40:]

    def para(s, n=4):
        return " ".join(" ".join([rng.choice(common) for _ in range(5)] + ([rng.choice(topic[s]) for _ in range(2)] if s else [])).capitalize() + "." for _ in range(n))

    docs, labels, want = [], [], set()
    for i in range(400):
        s = [rng.choice(names)] if i % 4 else rng.sample(names, 2)
        docs.append((i, "\n\n".join([para(None, 2), *(para(x) for x in s)]), 1))
        want |= {(i, x) for x in s}
        if i % 2:
            labels.append((i, rng.choice(names) if rng.random() < 0.1 else rng.choice(s), "x"))
    docs += [(900, para(None, 6), 1), (901, None, 1), (902, "", 1), (903, "  ", 1), (None, para("law"), 1), (1, docs[1][1], 1)]
    labels += [(5, None, "x"), (None, "law", "x"), (7, "law", "x"), (7, "space", "x")]
    d, l = spark.createDataFrame(docs, "doc_id long, text string, label int"), spark.createDataFrame(labels, "doc_id long, label string, subject string")
    got = [(r["doc_id"], r["subject"]) for r in subjects.subject_areas(d, l, names).collect()]
    found = set(got)
    assert len(got) == len(found) and not any(i >= 900 for i, _ in found)
    assert len(found & want) / len(want) > 0.97 and len(found & want) / len(found) > 0.97
    assert subjects.subject_areas(d, l.limit(0), names).count() == 0 and subjects.subject_areas(d.limit(0), l, names).count() == 0


MAIL = """From: ada@lovel.example (Ada Lovel)
Subject: Re: plan
Lines: 9

Hi Bo,

On 2/3/2004, Bo Tern <bo@tern.example> wrote:
> The plan for the
harbour
> is late again, and I
> can't say why.
>
> Regards
> Bo

The plan is fine by me. I moved
the boats already.

>57 percent of the boats, to be exact.
Sent from the old depot, the ropes arrived late.

> One more question?
No.

Kind regards,
Ada

--
Ada Lovel
Head of Ropes
Tel. 555 1234

If this message reached you by mistake, tell the sender; you must
not copy it.

---------- Forwarded message ----------
From: Cy <cy@x.example>
Date: 1/2/2004

Old words that nobody
wrote today."""
NEW = [5, 16, 17, 19, 20, 23]


def test_blocks_of_odd_texts():
    plain = new_text.Wording()
    for text in (MAIL, MAIL.replace("\n", "\r\n")):
        got = {i: label for lines, _, _, label in new_text.blocks_of(text, plain) for i in lines}
        assert all(got[i] == 0 for i in (1, 2, 3, 8, 14, 28, 29, 36, 37, 38, 40, 41)) and all(got[i] == 1 for i in NEW)
    assert new_text.blocks_of("", plain) == [] and new_text.blocks_of(" \n\t\n", plain) == []
    long = "A line of some words.\n" * 50_000
    assert sum(len(b[0]) for b in new_text.blocks_of(long, plain)) == 50_000
    assert new_text.Wording().fit([]).b.max() < 0 and not new_text.Wording().fit([["one line"]]).roles("one line").any()


@pytest.fixture(scope="module")
def mails(data):
    """A corpus that is large enough to learn from."""
    return data.replace("sf0.001", "sf0.01")


def test_new_lines(spark, mails):
    docs = spark.read.parquet(f"{mails}/docs.parquet").select("doc_id", "text", F.lit(1).alias("block"))
    more = spark.createDataFrame([(90001, MAIL, 1), (90002, None, 1), (90003, "", 1), (90004, " \n ", 1), (None, "Lost text.", 1), (90001, MAIL, 1)], docs.schema)
    rows = [(r["doc_id"], r["line_no"]) for r in new_text.new_lines(docs.union(more)).collect()]
    assert len(rows) == len(set(rows)) and sorted(n for i, n in rows if i == 90001) == NEW
    assert not any(i is None or i > 90001 for i, _ in rows)
    assert new_text.new_lines(docs.limit(0)).count() == 0


def test_wording_is_learned_not_known(spark):
    """Introductions, closing formulas and notices in words of no language, marked by their place in some mails and bare in others."""
    rng = random.Random(9)
    names = [f"{a}{b} {c}ath" for a in ("Al", "Bo", "Cy", "Du") for b in ("ra", "mi", "ko") for c in ("Hen", "Jor", "Kil")]
    line = lambda n=7: " ".join(prose(rng, n)).capitalize() + "."
    rows, want = [], set()
    for i in range(500):
        me, other = rng.sample(names, 2)
        parts = [([f"From: {me} <{me.replace(' ', '.').lower()}@x.example>", f"Subject: {WORDS[i % 60]}"], False), ([""], False)] if rng.random() < 0.7 else []
        parts += [([line() for _ in range(rng.randint(1, 3))], True), ([""], False)]
        parts += [([line(9)], True), ([""], False)] if rng.random() < 0.5 else []
        if rng.random() < 0.8:
            parts += [(["Zibbel gronk,", me.split()[0]] if rng.random() < 0.8 else ["Zibbel gronk,"], False), ([""], False)]
        if rng.random() < 0.5:
            parts += [([f"Frumious vorpal tulgey {rng.choice(('mimsy', 'wabe'))} snicker snack {rng.randint(1, 9)}"], False), ([""], False)]
        if rng.random() < 0.7:
            mark = "> " if rng.random() < 0.7 else ""
            parts += [([f"{other} plonkered {rng.randint(1, 30)}/4:"], False), ([mark + line() for _ in range(3)], False)]
        lines = [x for p, _ in parts for x in p]
        new = [flag for p, flag in parts for _ in p]
        rows.append((i, "\n".join(lines)))
        want |= {(i, k) for k, flag in enumerate(new, 1) if flag}
    got = {tuple(r) for r in new_text.new_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_boosted_trees_held_out():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) | (x[:, 2] > 1.5)).astype(float)
    model = new_text.BoostedTrees(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
