"""Problem 7: how distinctive a term is for a record.

Joint counts (tf) and marginal counts (record length, occurrences and records of a term) come from group-bys and joins.
From them the operator gives the positive pointwise mutual information of term and record, the record's probability
smoothed by a fractional exponent, and the smoothed tf-idf score of the saved matrix. PPMI alone can't give the ranking
that the project's matrix defines, so `score` carries that one and `ppmi` stands beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .records import corpus_records, token_counts
from .term_counts import _TOKENS, term_counts


def with_marginals(records: DataFrame) -> tuple[DataFrame, int]:
    """((doc_id, token, tf, df, cf), N): heavy terms meet a broadcast of bounded size, the others a shuffle join without hot keys."""
    _, heavy, light, n = term_counts(records)
    joint = token_counts(records)
    hot = joint.join(F.broadcast(heavy), "token")
    cold = joint.join(F.broadcast(heavy.select("token")), "token", "left_anti").join(light, "token")
    cols = ["doc_id", "token", "tf", "df", "cf"]
    return hot.select(cols).union(cold.select(cols)), n


def scored(joint: DataFrame, n: int) -> DataFrame:
    """Adds score = tf (ln((1 + N) / (1 + df)) + 1)."""
    return joint.withColumn("score", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))


def distinctiveness(records: DataFrame, alpha: float = 0.75) -> DataFrame:
    """(doc_id, token, tf, df, score, ppmi) for every token of every record; ppmi is 0 where the information is not positive."""
    joint, n = with_marginals(records)
    sums = records.select(F.size("tokens").alias("l")).agg(F.sum("l").alias("total"), F.sum(F.pow("l", F.lit(alpha))).alias("smooth")).first()
    total, smooth = float(sums["total"] or 1), float(sums["smooth"] or 1)
    length = records.select("doc_id", F.size("tokens").alias("len"))
    pmi = F.log(F.col("tf") / total) - F.log(F.col("cf") / total) - F.log(F.pow("len", F.lit(alpha)) / smooth)
    return scored(joint, n).join(length, "doc_id").select("doc_id", "token", "tf", "df", "score", F.greatest(F.lit(0.0), pmi).alias("ppmi"))


def dominant(scores: DataFrame, times: float = 3.0) -> DataFrame:
    """(doc_id, token) where the token's score is at least `times` that of every other token of the record.

    A record's only token has no other and is a case. A relative slack of 1e-12 keeps equal products of floats equal.
    """
    best = F.sort_array(F.collect_list(F.struct("score", "token")), asc=False)
    top = scores.groupBy("doc_id").agg(best.alias("s"))
    second = F.try_element_at("s", F.lit(2))["score"]
    return top.where(second.isNull() | (F.col("s")[0]["score"] >= times * second * (1 - 1e-12))).select("doc_id", F.col("s")[0]["token"].alias("token"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant(scored(*with_marginals(corpus_records(spark, sf_dir))))


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = distinctiveness(corpus_records(spark, sf_dir))
    return got.select("doc_id", "token", "tf", "df", F.round("score", 6).alias("score"), F.round("ppmi", 6).alias("ppmi"))


QUERIES = {"p7_found": p7_found, "p7_scores": p7_scores}

SQL = {
    "p7_found": f"""WITH {_TOKENS}, s AS (SELECT doc_id, token, tf * (ln((1.0 + n.n) / (1.0 + df)) + 1) AS score FROM t JOIN d USING (token), n),
        k AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, token DESC))
        SELECT doc_id, token FROM k WHERE rn = 1 AND (nxt IS NULL OR score >= 3 * nxt * (1 - 1e-12))""",
    "p7_scores": f"""WITH {_TOKENS}, l AS (SELECT doc_id, sum(tf) AS len FROM t GROUP BY doc_id),
        g AS (SELECT CAST(sum(len) AS DOUBLE) AS total, sum(pow(len, 0.75)) AS smooth FROM l)
        SELECT doc_id, token, tf, df, round(tf * (ln((1.0 + n.n) / (1.0 + df)) + 1), 6) AS score,
        round(greatest(0, ln(tf / total) - ln(cf / total) - ln(pow(len, 0.75) / smooth)), 6) AS ppmi
        FROM t JOIN d USING (token) JOIN l USING (doc_id), n, g""",
}
