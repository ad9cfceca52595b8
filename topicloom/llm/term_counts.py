"""Problem 3: the frequency of every distinct term, by heavy-light aggregation.

A mergeable frequent-items sketch over all rows detects the heavy terms (a bounded list). They are broadcast and counted
exactly in local counter arrays, one small array per task, so a term that stands in every record never goes through a
shuffle by key. All other terms are shuffled by term after a map-side combine. Both tables are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .records import corpus_records

#: The most terms that are counted in local arrays: the bound of what is broadcast.
HEAVY = 512
#: Counters of the sketch that detects them, so any term above 1/TRACKED of all occurrences is seen.
TRACKED = 8192


def heavy_terms(records: DataFrame, most: int = HEAVY) -> list[str]:
    """At most `most` terms that are probably the most frequent. Only speed depends on the choice, no count does."""
    top = records.select(F.explode("tokens").alias("t")).agg(F.expr(f"approx_top_k(t, {most}, {TRACKED})").alias("top")).first()
    return [x["item"] for x in (top["top"] or [])] if top else []


def count_heavy(records: DataFrame, heavy: list[str]) -> tuple[dict[str, tuple[int, int]], int]:
    """({term: (df, cf)} of the heavy terms, number of records): a counter array per task, summed over tasks."""
    terms = pa.array(heavy, pa.string())
    slots = len(heavy)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, cf, n = np.zeros(slots, np.int64), np.zeros(slots, np.int64), 0
        for b in batches:
            col = b.column(0)
            n += len(col)
            slot = pc.index_in(col.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(col)), pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            there = slot >= 0
            cf += np.bincount(slot[there], minlength=slots)
            df += np.bincount(np.unique(row[there] * slots + slot[there]) % slots, minlength=slots) if slots else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, slots), pa.int32()), pa.array(np.r_[n, df], pa.int64()), pa.array(np.r_[n, cf], pa.int64())], ["slot", "df", "cf"])

    rows = records.select("tokens").mapInArrow(local, "slot int, df long, cf long").groupBy("slot").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).collect()
    got = {r["slot"]: (r["df"], r["cf"]) for r in rows}
    return {t: got[i] for i, t in enumerate(heavy) if got.get(i, (0, 0))[0]}, got.get(-1, (0, 0))[0]


def first_marked(records: DataFrame) -> DataFrame:
    """(token, first) of every occurrence; first is 1 once a record and token, else 0.

    A record is one row, so its sorted tokens tell repeats apart without a shuffle by record.
    """
    rows = records.select(F.array_sort("tokens").alias("s"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))))
    return rows.select(F.inline(F.zip_with("s", before, lambda a, b: F.struct(a.alias("token"), F.when(a == b, 0).otherwise(1).cast("long").alias("first"))))).where(F.col("token").isNotNull())


def term_counts(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(all, heavy, light, N): tables (token, df, cf) of all terms, and of the two parts; N is the number of records.

    `df` is the number of records holding the token, `cf` its occurrences. No records give empty tables and N = 0.
    """
    spark = records.sparkSession
    counts, n = count_heavy(records, heavy_terms(records))
    heavy = spark.createDataFrame([(t, d, c) for t, (d, c) in counts.items()], "token string, df long, cf long").coalesce(1)
    light = first_marked(records).join(F.broadcast(heavy.select("token")), "token", "left_anti").groupBy("token").agg(F.sum("first").alias("df"), F.count(F.lit(1)).alias("cf"))
    return heavy.union(light), heavy, light, n


def marked(terms: DataFrame, n: int, rare: int = 4, common: float = 0.3) -> DataFrame:
    """(token, df, cf, mark): `rare` if df is at most `rare`, `common` if df is more than `common` of the records, else null."""
    return terms.withColumn("mark", F.when(F.col("df") <= rare, "rare").when(F.col("df") > common * n, "common"))


def p3_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, _, _, n = term_counts(corpus_records(spark, sf_dir))
    return marked(terms, n)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, _, _, n = term_counts(corpus_records(spark, sf_dir))
    both = marked(terms, n)
    # a token of few records in a tiny collection can be both
    return both.select("token", F.explode(F.array_compact(F.array(F.when(F.col("df") <= 4, "rare"), F.when(F.col("df") > 0.3 * n, "common")))).alias("mark"))


QUERIES = {"p3_found": p3_found, "p3_term_counts": p3_term_counts}

_TOKENS = r"""
r AS (SELECT doc_id, max(text) AS text FROM clean_corpus WHERE doc_id IS NOT NULL AND regexp_matches(text, '\S') GROUP BY doc_id),
o AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS token FROM r),
t AS (SELECT doc_id, token, count(*) AS tf FROM o GROUP BY ALL),
n AS (SELECT count(DISTINCT doc_id) AS n FROM t),
d AS (SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM t GROUP BY token)"""

SQL = {
    "p3_found": f"WITH {_TOKENS} SELECT token, 'rare' AS mark FROM d WHERE df <= 4 UNION ALL SELECT token, 'common' AS mark FROM d, n WHERE df > 0.3 * n.n",
    "p3_term_counts": f"WITH {_TOKENS} SELECT token, df, cf, CASE WHEN df <= 4 THEN 'rare' WHEN df > 0.3 * n.n THEN 'common' END AS mark FROM d, n",
}
