"""Problem 1: records in clusters of mutually similar ones.

A record's entries become a vector of hashed, signed, weighted features. Distributed k-means divides the records: seeds are
drawn by parallel oversampling (rounds of weighted sampling without replacement, one pass each), reclustered with their
weights on the driver, then moved by a few passes. A cluster is described by its size and the members nearest its centroid.

For groups above a cosine, each record joins its nearest clusters; within one, all links of a bounded chunk are followed,
and the leaders of every two chunks meet again, so a large tight group costs one row per chunk. Connected components over
the links of all clusters are candidates, and an exact comparison of the unhashed vectors decides. Equal vectors are one row with a count all the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.materialize import discarded, kept, written
from ..sources.tables import table

#: Hashed features; records per cluster that are aimed at; the most clusters (their centroids are broadcast).
WIDTH, AIM, CLUSTERS = 512, 400, 2048
#: Clusters that a record joins, rounds of seeding, passes that move the centroids.
JOINS, ROUNDS, MOVES = 3, 2, 2
#: Cosine of hashed vectors that links two records; it is below that of the exact comparison. Where chunks meet, a row stands
#: for those at TIGHT or more, and WIDE is the angle of LOOSE plus two of TIGHT, so that no link is lost.
LOOSE, TIGHT = 0.9, 0.998
WIDE = float(np.cos(np.arccos(LOOSE) + 2 * np.arccos(TIGHT)))
#: Records in a chunk; branches of the search for the largest group of a vector, and of all vectors of a label.
CHUNK, STEPS, POOL = 2048, 200, 2000


def vectors(df: DataFrame, rec: str, dim: str, weight: str) -> DataFrame:
    """(rep, n, dims, ws): each distinct vector with the smallest record that has it and the number of such records."""
    return members(df, rec, dim, weight).groupBy("dims", "ws").agg(F.min("rec").alias("rep"), F.count(F.lit(1)).alias("n"))


def members(df: DataFrame, rec: str, dim: str, weight: str) -> DataFrame:
    """(rec, dims, ws) of every record. Repeated rows count once, of rows that differ in weight only the greatest counts.

    Null and zero weights are absent entries; rows with a null record or dimension, and records without an entry, drop out.
    """
    rows = df.select(F.col(rec).alias("rec"), F.col(dim).cast("long").alias("dim"), F.col(weight).cast("double").alias("w"))
    rows = rows.dropna().where(~F.isnan("w")).groupBy("rec", "dim").agg(F.max("w").alias("w")).where(F.col("w") != 0)
    entries = rows.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("dim", "w"))).alias("e"))
    return entries.select("rec", F.col("e.dim").alias("dims"), F.col("e.w").alias("ws"))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A well-mixed 64-bit hash of integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed(dims: pd.Series, ws: pd.Series, width: int = WIDTH) -> np.ndarray:
    """Unit rows of hashed features. A dimension has a place and a sign in each half of a row, so that two that cancel out in
    one half don't in the other."""
    size = dims.str.len().to_numpy()
    d, w = np.concatenate(dims.to_list()), np.concatenate(ws.to_list())
    h, half = mixed(d, 7), width // 2
    row = np.repeat(np.arange(len(size)), size) * width
    x = np.zeros(len(size) * width)
    for k in (0, 1):
        at = ((h >> np.uint64(24 * k)) % np.uint64(half)).astype(np.int64) + k * half
        sign = np.where((h >> np.uint64(56 + k)) & np.uint64(1), 1.0, -1.0)
        x += np.bincount(row + at, w * sign, len(x))
    x = x.reshape(-1, width).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-20)


def _blocks(batches: Iterator[pd.DataFrame], rows: int = 2048) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), rows):
            if len(part := b.iloc[at : at + rows]):
                yield part


def _draw(vecs: DataFrame, centres: np.ndarray, many: int, seed: int) -> np.ndarray:
    """`many` vectors drawn without replacement in proportion to count times squared distance from the nearest centre: one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in _blocks(batches):
            far = np.maximum(2 - 2 * (hashed(b["dims"], b["ws"]) @ centres.T).max(1), 0) if len(centres) else np.ones(len(b))
            u = (mixed(b["rep"].to_numpy(), seed).astype(np.float64) + 1) / 2.0**64
            held.append(b[["rep", "dims", "ws"]].assign(key=-np.log(u) / np.maximum(far * b["n"].to_numpy(), 1e-12)))
            if len(held) * 2048 > 3 * many:  # a task keeps no more than it may need
                held = [pd.concat(held).nsmallest(many, "key")]
        if held:
            yield pd.concat(held).nsmallest(many, "key")

    kind = f"{_schema(vecs.select('rep', 'dims', 'ws'))}, key double"
    rows = vecs.mapInPandas(run, kind).orderBy("key", "rep").limit(many).select("dims", "ws").toPandas()
    return hashed(rows["dims"], rows["ws"]) if len(rows) else np.zeros((0, WIDTH), np.float32)


def _weights(vecs: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Records of each centre, counted by task and added up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(centres))
        for b in _blocks(batches):
            n += np.bincount((hashed(b["dims"], b["ws"]) @ centres.T).argmax(1), b["n"].to_numpy(), len(centres))
        there = np.flatnonzero(n)
        yield pd.DataFrame({"c": there.astype(np.int32), "n": n[there]})

    n = np.zeros(len(centres))
    for r in vecs.mapInPandas(run, "c int, n double").groupBy("c").agg(F.sum("n").alias("n")).collect():
        n[r["c"]] = r["n"]
    return n


def _sums(vecs: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and vector sum of each centre's records: partial sums by task, combined by centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(len(centres)), np.zeros((len(centres), WIDTH), np.float32)
        for b in _blocks(batches):
            x, w = hashed(b["dims"], b["ws"]), b["n"].to_numpy()
            near = (x @ centres.T).argmax(1)
            n += np.bincount(near, w, len(centres))
            order = np.argsort(near, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
            s[near[order][starts]] += np.add.reduceat((x * w[:, None])[order], starts, axis=0)
        there = np.flatnonzero(n)
        yield pd.DataFrame({"c": there.astype(np.int32), "n": n[there], "s": [s[i].tobytes() for i in there]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        s = sum(np.frombuffer(x, np.float32) for x in pdf["s"])
        return pd.DataFrame({"c": pdf["c"][:1], "n": [pdf["n"].sum()], "s": [s.astype(np.float32).tobytes()]})

    kind = "c int, n double, s binary"
    n, s = np.zeros(len(centres)), np.zeros((len(centres), WIDTH), np.float32)
    for r in vecs.mapInPandas(run, kind).groupBy("c").applyInPandas(add, kind).toLocalIterator():
        n[r["c"]], s[r["c"]] = r["n"], np.frombuffer(r["s"], np.float32)
    return n, s


def _reseed(cand: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k of the candidates by weighted k-means++."""
    if len(cand) <= k:
        return cand
    rng, far, chosen = np.random.default_rng(5), np.full(len(cand), 2.0), []
    for _ in range(k):
        p = far * weight
        if p.sum() <= 1e-9:
            break
        chosen.append(int(rng.choice(len(cand), p=p / p.sum())))
        far = np.minimum(far, np.maximum(2 - 2 * cand @ cand[chosen[-1]], 0))
    return cand[chosen]


def kmeans(vecs: DataFrame, k: int) -> np.ndarray:
    """Unit centroids of a spherical k-means with parallel oversampled seeding; fewer than k where there are fewer distinct vectors."""
    seeds = np.zeros((0, WIDTH), np.float32)
    for r in range(ROUNDS):
        seeds = np.concatenate([seeds, _draw(vecs, seeds, k, 100 + r)])
    centres = _reseed(seeds, _weights(vecs, seeds), k)
    for _ in range(MOVES):
        n, s = _sums(vecs, centres)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, s / np.maximum(norm, 1e-9), centres).astype(np.float32)
    return centres


def assigned(vecs: DataFrame, centres: np.ndarray, joins: int) -> DataFrame:
    """(rep, n, dims, ws, c, place, cos): each vector with its nearest `joins` clusters; place 0 is the nearest."""
    joins = min(joins, len(centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _blocks(batches):
            s = hashed(b["dims"], b["ws"]) @ centres.T
            near = np.argpartition(-s, joins - 1, axis=1)[:, :joins]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
            out = b.loc[b.index.repeat(joins)]
            yield out.assign(c=near.ravel().astype(np.int32), place=np.tile(np.arange(joins, dtype=np.int32), len(b)), cos=np.take_along_axis(s, near, 1).ravel().astype(np.float64))

    return vecs.mapInPandas(run, f"{_schema(vecs)}, c int, place int, cos double")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def parts(like: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row of its connected component."""
    first = np.full(len(like), -1)
    for i in range(len(like)):
        new = np.array([i]) if first[i] < 0 else np.array([], int)
        while len(new):
            first[new] = i
            new = np.flatnonzero(like[new].any(0) & (first < 0))
    return first


def leads(x: np.ndarray) -> np.ndarray:
    """Rows such that every row has one of them at TIGHT or more, itself included."""
    lead = np.zeros(len(x), bool)
    led = np.zeros(len(x), bool)
    for at in range(0, len(x), 256):
        own = x[at : at + 256] @ x.T >= TIGHT
        for i, near in enumerate(own, at):
            if not led[i]:
                lead[i] = True
                led |= near
    return lead


def _chunk_pairs():
    """The pairs of chunks that a row of `chunk` out of `chunks` takes part in."""
    return F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j")))


def components(links: DataFrame) -> DataFrame:
    """(v, u): each end of a link (v, u), but the smallest of its connected component, with that one. Alternating stars, until nothing changes."""
    links = written(links.where(F.col("v") != F.col("u")).select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct())
    while True:
        twice = links.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("v")
        inner = links.join(links.select(F.col("u").alias("v")), "v", "left_semi").select("v")
        if twice.union(inner).isEmpty():
            return links
        both = links.union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        # the larger neighbours of every vertex link to the smallest of all its neighbours and itself, then the smaller ones do
        large = both.where(F.col("u") > F.col("v")).join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = written(large)
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where(F.col("v") != F.col("u"))
        before, links = links, written(small.union(least.select("v", F.col("m").alias("u"))).distinct())
        discarded(before)
        discarded(large)


def candidate_labels(vecs: DataFrame, centres: np.ndarray) -> DataFrame:
    """(rep, label): label is the smallest vector that is reached by links of LOOSE or more within any cluster."""
    rows = assigned(vecs, centres, JOINS).select("c", "rep", "dims", "ws")
    sizes = rows.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks"))
    rows = rows.join(F.broadcast(sizes), "c").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))  # a row for each cluster: bounded

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        x, rep = hashed(pdf["dims"], pdf["ws"]), pdf["rep"].to_numpy()
        ahead = leads(x) if pdf["chunks"].iloc[0] > 1 else False
        return pdf[["c", "chunk", "chunks", "rep", "dims", "ws"]].assign(u=rep[parts(x @ x.T >= LOOSE - 1e-6)], ahead=ahead)

    id_kind = vecs.schema["rep"].dataType.simpleString()
    first = written(rows.groupBy("c", "chunk").applyInPandas(within, f"c int, chunk long, chunks long, {_schema(vecs.select('rep', 'dims', 'ws'))}, u {id_kind}, ahead boolean"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        x, rep = hashed(pdf["dims"], pdf["ws"]), pdf["rep"].to_numpy()
        return pd.DataFrame({"v": rep, "u": rep[parts(x @ x.T >= WIDE - 1e-6)]})

    # where a cluster has several chunks, those of every two of them meet
    met = first.where("ahead").select("c", "rep", "dims", "ws", "chunk", F.explode(_chunk_pairs()).alias("p")).where("p.i < p.j").select("c", "rep", "dims", "ws", "p.*").groupBy("c", "i", "j")
    links = first.select(F.col("rep").alias("v"), "u").union(met.applyInPandas(across, f"v {id_kind}, u {id_kind}"))
    return vecs.select("rep").join(components(links).select(F.col("v").alias("rep"), "u"), "rep", "left").select("rep", F.coalesce("u", "rep").alias("label"))


def gram(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Exact cosines of the rows of two chunks, over blocks of dimensions."""
    dims = np.unique(np.concatenate([*a["dims"], *b["dims"]]))
    out, norms = np.zeros((len(a), len(b))), [np.array([np.linalg.norm(w) for w in x["ws"]]) for x in (a, b)]

    def flat(x: pd.DataFrame):
        size = x["dims"].str.len().to_numpy()
        return np.repeat(np.arange(len(x)), size), np.searchsorted(dims, np.concatenate(x["dims"].to_list())), np.concatenate(x["ws"].to_list())

    fa, fb = flat(a), flat(b)
    for at in range(0, len(dims), 1024):
        both = []
        for (r, d, w), n in ((fa, len(a)), (fb, len(b))):
            m, on = np.zeros((n, 1024)), (d >= at) & (d < at + 1024)
            m[r[on], d[on] - at] = w[on]
            both.append(m)
        out += both[0] @ both[1].T
    return out / np.outer(*norms)


def mutual_groups(near: list[int], n: list[int]) -> list[int]:
    """For each vertex the smallest vertex of its group, -1 where no group of it counts three records.

    near: closed neighbourhoods as bit sets, n: records of each vertex. A vertex's group is the mutually similar one of most
    records that it belongs to, of equal ones that of the smallest vertex. Whether there is one of three records is exact;
    the search for the largest ends after STEPS branches a vertex, and POOL branches of a label.
    """
    planes = [(1 << b, sum(1 << v for v, x in enumerate(n) if x >> b & 1)) for b in range(max(n).bit_length())]
    weight = lambda mask: sum(f * (mask & plane).bit_count() for f, plane in planes)
    low = lambda mask: (mask & -mask).bit_length() - 1
    best = [(0, 0)] * len(near)  # (records, minus the smallest vertex)
    full, pool = [weight(x) for x in near], POOL

    def bits(mask: int) -> Iterator[int]:
        while mask:
            yield low(mask)
            mask &= mask - 1

    for v in sorted(range(len(near)), key=lambda v: (-full[v], v)):
        stack, steps = [(1 << v, near[v] & ~(1 << v))], 0
        while stack and (steps < STEPS and pool > 0 or not best[v][0]):
            chosen, left = stack.pop()
            if (weight(chosen | left), -low(chosen | left)) <= best[v]:
                continue
            steps, pool = steps + 1, pool - 1
            while left:
                pivot = max(bits(left), key=lambda u: weight(left & near[u]))
                others = left & ~near[pivot]
                rest = left & ~(1 << pivot)
                for x in bits(others):
                    stack.append((chosen | 1 << x, rest & near[x] & ~(1 << x)))
                    rest &= ~(1 << x)
                chosen, left = chosen | 1 << pivot, left & near[pivot] & ~(1 << pivot)
            size = (weight(chosen), -low(chosen))
            for x in bits(chosen):
                best[x] = max(best[x], size)
    return [-at if records >= 3 else -1 for records, at in best]


def _bits(like: np.ndarray) -> list[bytes]:
    """Rows of a boolean matrix as little-endian bit sets."""
    return [r.tobytes() for r in np.packbits(like, axis=1, bitorder="little")]


def _grouped(like: np.ndarray, n: np.ndarray) -> np.ndarray:
    """mutual_groups of a boolean matrix; rows with the same neighbourhood stand in the same groups and count as one."""
    rows = _bits(like)
    heads = {r: k for k, r in reversed(list(enumerate(rows)))}
    kinds = sorted(heads.values())
    own = np.searchsorted(kinds, [heads[r] for r in rows])
    near = [int.from_bytes(r, "little") for r in _bits(like[np.ix_(kinds, kinds)])]
    got = np.array(mutual_groups(near, np.bincount(own, n).astype(int).tolist()))[own]
    return np.where(got < 0, -1, np.array(kinds)[got])


def exact_groups(marked: DataFrame, least: float) -> DataFrame:
    """(rep, group): of candidates (label, rep, n, dims, ws) those in groups of at least three mutually similar records.

    Labels of more than CHUNK vectors are compared chunk by chunk: vectors with the same neighbourhood become one (each is
    known by two sums of hashes), and only the similarities of these meet in one task, as bits.
    """
    sizes = marked.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("records")).where(F.col("records") >= 3)
    marked = kept(marked.join(sizes, "label"))
    id_kind = marked.schema["rep"].dataType.simpleString()

    def alike(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> np.ndarray:
        like = gram(a, b) >= least - 1e-12
        if same:
            like |= like.T
            np.fill_diagonal(like, True)
        return like

    def several(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", ignore_index=True)
        group, rep = _grouped(alike(pdf, pdf, True), pdf["n"].to_numpy()), pdf["rep"].to_numpy()
        return pd.DataFrame({"rep": rep[group >= 0], "group": rep[group[group >= 0]]})

    pair_kind = f"rep {id_kind}, group {id_kind}"
    done = marked.where(F.col("m") <= CHUNK).groupBy("label").applyInPandas(several, pair_kind)
    large = marked.where(F.col("m") > CHUNK).select("label", "rep", "n", "dims", "ws")
    if large.isEmpty():
        return done

    def meeting(rows: DataFrame):
        """The vectors of every two chunks of a label: chunks are ranges of rep."""
        at = F.row_number().over(Window.partitionBy("label").orderBy("rep")) - 1
        total = F.count(F.lit(1)).over(Window.partitionBy("label"))
        place = rows.select("label", "rep", F.floor(at / CHUNK).alias("chunk"), F.ceil(total / CHUNK).alias("chunks"))
        cut = rows.join(place, ["label", "rep"])
        return cut.select("label", "rep", "n", "dims", "ws", "chunk", F.explode(_chunk_pairs()).alias("p")).select("label", "rep", "n", "dims", "ws", "chunk", "p.*").groupBy("label", "i", "j")

    def sides(pdf: pd.DataFrame) -> list[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]:
        """Rows, the others, their similarity: both ways, or once where a chunk meets itself."""
        pdf = pdf.sort_values("rep", ignore_index=True)
        a, b = pdf[pdf["chunk"] == pdf["i"]], pdf[pdf["chunk"] == pdf["j"]]
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        like = alike(a, b, same)
        return [(a, b, like)] if same else [(a, b, like), (b, a, like.T)]

    def around(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for a, b, like in sides(pdf):
            h = np.stack([(mixed(b["rep"].to_numpy(), seed) >> np.uint64(24)).astype(np.int64) for seed in (11, 12)], 1)
            sums = np.stack([np.where(like, h[:, k], 0).sum(1) for k in (0, 1)], 1)
            parts.append(pd.DataFrame({"label": a["label"], "rep": a["rep"], "n": a["n"], "h": sums[:, 0], "g": sums[:, 1]}))
        return pd.concat(parts)

    twins = written(meeting(large).applyInPandas(around, f"label {id_kind}, rep {id_kind}, n long, h long, g long").groupBy("label", "rep", "n").agg(F.sum("h").alias("h"), F.sum("g").alias("g")))
    kinds = twins.groupBy("label", "h", "g").agg(F.min("rep").alias("head"), F.sum("n").alias("n"))
    of_kind = twins.join(kinds.drop("n"), ["label", "h", "g"]).select("rep", "head")
    heads = large.drop("n").join(kinds.select(F.col("head").alias("rep"), "n"), "rep")
    heads = kept(heads.join(heads.groupBy("label").agg(F.count(F.lit(1)).alias("m")), "label"))

    def rows_of(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(pd.DataFrame({"label": a["label"], "rep": a["rep"], "n": a["n"], "other": pdf["j"].iloc[0] if k == 0 else pdf["i"].iloc[0], "bits": _bits(like)}) for k, (a, _, like) in enumerate(sides(pdf)))

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep", "other"])
        first = pdf.drop_duplicates("rep")
        rep, near = first["rep"].to_numpy(), dict.fromkeys(first["rep"], 0)
        for r, other, b in zip(pdf["rep"], pdf["other"], pdf["bits"]):
            near[r] |= int.from_bytes(b, "little") << int(other) * CHUNK
        got = np.array(mutual_groups(list(near.values()), first["n"].tolist()))
        return pd.DataFrame({"rep": rep[got >= 0], "group": rep[got[got >= 0]]})

    few = heads.where(F.col("m") <= CHUNK).groupBy("label").applyInPandas(several, pair_kind)
    many = meeting(heads.where(F.col("m") > CHUNK)).applyInPandas(rows_of, f"label {id_kind}, rep {id_kind}, n long, other long, bits binary").groupBy("label").applyInPandas(joined, pair_kind)
    groups = few.union(many).withColumnRenamed("rep", "head")
    return done.union(of_kind.join(groups, "head").select("rep", "group"))


def similar_groups(df: DataFrame, rec: str, dim: str, weight: str, least: float = 0.95) -> DataFrame:
    """(rec_id, group_id): records of groups of at least three mutually similar ones; group_id is the smallest record of the group.

    An empty table gives no groups.
    """
    all_rows = kept(members(df, rec, dim, weight))
    vecs = kept(all_rows.groupBy("dims", "ws").agg(F.min("rec").alias("rep"), F.count(F.lit(1)).alias("n")))
    n = vecs.count()
    if not n:
        return all_rows.select(F.col("rec").alias("rec_id"), F.col("rec").alias("group_id"))
    centres = kmeans(vecs, max(1, min(CLUSTERS, n // AIM)))
    groups = exact_groups(vecs.join(candidate_labels(vecs, centres), "rep"), least)
    found = vecs.join(groups, "rep").select("dims", "ws", "group")
    return all_rows.join(found, ["dims", "ws"]).select(F.col("rec").alias("rec_id"), F.col("group").alias("group_id"))


def clusters(df: DataFrame, rec: str, dim: str, weight: str, typical: int = 5) -> DataFrame:
    """(cluster, size, typical): every k-means cluster by its size and its most typical members, nearest the centroid first, ties to the smaller record."""
    vecs = kept(vectors(df, rec, dim, weight))
    n = vecs.count()
    if not n:
        return vecs.select(F.lit(0).alias("cluster"), "n", F.array("rep").alias("typical")).toDF("cluster", "size", "typical")
    own = assigned(vecs, kmeans(vecs, max(1, min(CLUSTERS, n // AIM))), 1)
    return ranked_members(own, typical)


def ranked_members(own: DataFrame, typical: int) -> DataFrame:
    """A bounded list per cluster: the nearest of each of 64 salted parts first, then of all parts."""
    best = lambda c: F.slice(F.sort_array(c), 1, typical)
    part = F.pmod(F.xxhash64("rep"), F.lit(64))
    near = own.select("c", "rep", "n", (-F.col("cos")).alias("far"), part.alias("part"))
    sizes = near.groupBy("c").agg(F.sum("n").alias("size"))
    top = near.withColumn("rn", F.row_number().over(Window.partitionBy("c", "part").orderBy("far", "rep"))).where(F.col("rn") <= typical)
    names = top.groupBy("c").agg(best(F.collect_list(F.struct("far", "rep"))).alias("t"))
    return sizes.join(names, "c").select(F.col("c").alias("cluster"), "size", F.col("t.rep").alias("typical"))


#: source_table, record, dimension, weight
COLLECTIONS = (("predictions", "ix", "topic", "p"), ("word_graph", "u", "v", "weight"))


def _both(spark: SparkSession, sf_dir: str, run) -> DataFrame:
    parts = [run(table(spark, sf_dir, name), *cols).select(F.lit(name).alias("source_table"), "*") for name, *cols in COLLECTIONS]
    return parts[0].union(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, similar_groups)


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, clusters)


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters}

def _sql(name: str, rec: str, dim: str, weight: str) -> str:
    """Exact cosines of all records; a record that has two similar ones, themselves similar, belongs to the group of the smallest
    of them. That is the operator's result where similarity is transitive, as it is among the planted groups."""
    return f"""SELECT '{name}' AS source_table, a AS rec_id, min(least(a, b, c)) AS group_id FROM (
        WITH e AS (SELECT {rec} AS r, {dim} AS d, max({weight})::DOUBLE AS w FROM {name} WHERE {rec} IS NOT NULL AND {dim} IS NOT NULL AND {weight} IS NOT NULL AND NOT isnan({weight}::DOUBLE) GROUP BY ALL HAVING max({weight}) <> 0),
        n AS (SELECT r, sqrt(sum(w * w)) AS n FROM e GROUP BY r),
        s AS (SELECT x.r AS a, y.r AS b FROM e x JOIN e y ON x.d = y.d AND x.r <> y.r JOIN n p ON p.r = x.r JOIN n q ON q.r = y.r GROUP BY ALL HAVING sum(x.w * y.w) / any_value(p.n * q.n) >= 0.95 - 1e-12)
        SELECT s.a, s.b, t.b AS c FROM s JOIN s t ON t.a = s.a AND t.b <> s.b JOIN s u ON u.a = s.b AND u.b = t.b) GROUP BY a"""


SQL = {"p1_found": " UNION ALL ".join(_sql(*c) for c in COLLECTIONS)}
