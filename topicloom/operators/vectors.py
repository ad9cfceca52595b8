"""Vectors as rows (id, vec array<double>): norms, products, standardisation, alignment with a vocabulary.

Null vectors and vectors with a null or NaN element are left out by `finite`; the other functions take what they get.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ids import numbered


def finite(df: DataFrame, id_col: str, vec_col: str, width: int | None = None) -> DataFrame:
    """(id, vec) of the rows whose vector is whole; with `width`, only vectors of that length."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)))
    return rows.where(F.size("vec") == width) if width else rows


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null where a vector is all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l2_normalize(vectors: DataFrame) -> DataFrame:
    """(id, vec) of unit length; the elements of an all-zero vector become null."""
    return vectors.withColumn("_n", norm("vec")).select("id", F.transform("vec", lambda x: F.try_divide(x, F.col("_n"))).alias("vec"))


def long_form(vectors: DataFrame) -> DataFrame:
    """(id, dim, x), dim from 0."""
    return vectors.select("id", F.posexplode("vec").alias("dim", "x"))


def wide_form(rows: DataFrame) -> DataFrame:
    """(id, vec) from (id, dim, x)."""
    return rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("e")).select("id", F.col("e.x").alias("vec"))


def zscore(vectors: DataFrame) -> DataFrame:
    """(id, dim, x) standardised by dimension with the sample deviation; dimensions without variance stay as they are."""
    rows = long_form(vectors)
    stats = rows.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("dev"))
    varies = F.col("dev") > 0
    return rows.join(F.broadcast(stats), "dim").select("id", "dim", F.when(varies, (F.col("x") - F.col("mean")) / F.col("dev")).otherwise(F.col("x")).alias("x"))  # a row a dimension


def random_vector(width: int, seed: int = 0) -> list[float]:
    """One vector of normal deviates from a seed (the rule of Box and Muller), the same wherever it is drawn; not normalised."""
    rng = random.Random(seed)
    return [math.sqrt(-2 * math.log(1 - rng.random())) * math.cos(2 * math.pi * rng.random()) for _ in range(width)]


def align(words: DataFrame, vectors: DataFrame, drop_index_zero: bool = True) -> DataFrame:
    """(ix, word, vec): the words that have a vector, numbered again from 0 in the order of the old ix.

    Of a repeated word the greatest ix holds. With `drop_index_zero` the word at ix 0 counts as unknown, as a test for
    truth instead of presence makes it.
    """
    known = vectors.where(F.col("word").isNotNull()).groupBy("word").agg(F.max_by("vec", "ix").alias("vec"), F.max("ix").alias("old"))
    if drop_index_zero:
        known = known.where(F.col("old") != 0)
    wanted = words.select(F.col("word")).where(F.col("word").isNotNull()).distinct()
    return numbered(known.join(wanted, "word", "left_semi"), "ix", F.col("old")).select("ix", "word", "vec")


def word2vec(words: DataFrame, vectors: DataFrame, unknown: Sequence[float] | int) -> DataFrame:
    """(word, vec) of every distinct word; words without a vector share `unknown`, or one random vector of that width."""
    unknown = random_vector(unknown) if isinstance(unknown, int) else unknown
    known = vectors.where(F.col("word").isNotNull() & F.col("vec").isNotNull()).groupBy("word").agg(F.max_by("vec", "ix").alias("vec"))
    default = F.array(*[F.lit(float(x)) for x in unknown])
    return words.select("word").where(F.col("word").isNotNull()).distinct().join(known, "word", "left").select("word", F.coalesce(F.col("vec").cast("array<double>"), default).alias("vec"))


def eigen_scale(embedding: DataFrame, eigenvalues: Sequence[float]) -> DataFrame:
    """(id, vec): each eigenvector times 1 minus its eigenvalue; columns where that is not positive are dropped."""
    keep = [(d, 1.0 - v) for d, v in enumerate(eigenvalues) if 1.0 - v > 0]
    return embedding.select("id", F.array(*[F.col("vec")[d] * F.lit(s) for d, s in keep]).alias("vec"))


def reordered(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, j, l) with rows and columns numbered by (label, id); `labels` is (id, label)."""
    place = numbered(labels, "place", F.col("label"), F.col("id")).select("id", "place")
    for side in ("i", "j"):
        rows = rows.join(place.select(F.col("id").alias(side), F.col("place").alias(f"_{side}")), side)
    return rows.select(F.col("_i").alias("i"), F.col("_j").alias("j"), "l")
