"""Problem 5: items that appear together, by heavy-light decomposition.

Only items that can reach both thresholds take part: c is at most the smaller df and the lift is at most N divided by the
larger df, so an item with df below `min_count` or above N / `min_lift` is in no result (an exact bound, not a cap).
They are numbered, most records first, so an item's number is its identity and the frequent ones have the small numbers. In
blocks of records, pairs of frequent items are counted by popcounts over a dense bit matrix (an item a row, a record a bit),
pairs of a rare and a frequent item by probing the matrix with the rare item's list of records, and pairs of rare items by
their codes. Each block emits its counts once per pair, and these partial counts are summed by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.paircount import count_block, count_lists  # noqa: F401
from ..plans.ids import numbered
from ..plans.materialize import kept
from .records import corpus_records
from .term_counts import _TOKENS, term_counts

#: Frequent items in the bit matrix, which with a block of records takes a few MB; items whose numbers are broadcast.
DENSE, HOT = 512, 1024
#: Pairs of rare items that are counted at once.
SLICE = 1_500_000


def item_pairs(records: DataFrame, min_count: int = 20, min_lift: float = 10.0) -> DataFrame:
    """(token_a, token_b, c, lift), token_a < token_b: pairs in at least `min_count` records together and with lift c N / (df df) of at least `min_lift`.

    Repeats of a token in a record count once. No records give no pairs.
    """
    terms, heavy, _, n = term_counts(records)
    able = (F.col("df") >= min_count) & (F.col("df") * min_lift <= n)
    names = kept(numbered(terms.where(able).select("token", "df"), "id", F.desc("df"), F.col("token")))
    hot = F.broadcast(names.where(F.col("id") < HOT))
    # common terms that can't take part go first, then those of small numbers meet a broadcast; what is shuffled has no hot key
    apart = F.broadcast(heavy.where(~able).select("token").union(names.where(F.col("id") < HOT).select("token")))
    rows = records.select("doc_id", F.explode(F.array_distinct("tokens")).alias("token"))
    rest = rows.join(apart, "token", "left_anti").join(names.where(F.col("id") >= HOT), "token")
    items = rows.join(hot, "token").select("doc_id", "id").union(rest.select("doc_id", "id"))
    lists = items.groupBy("doc_id").agg(F.collect_list("id").alias("items")).where(F.size("items") > 1)
    frequent, at_once = np.arange(DENSE), SLICE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from count_lists(batches, frequent, at_once)

    counts = lists.select("items").mapInPandas(run, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c")).where(F.col("c") >= min_count)
    for side in ("a", "b"):
        counts = counts.join(names.select(F.col("id").alias(side), F.col("token").alias(f"t{side}"), F.col("df").alias(f"df{side}")), side)
    pairs = counts.select(F.least("ta", "tb").alias("token_a"), F.greatest("ta", "tb").alias("token_b"), "c", (F.col("c") * float(n) / (F.col("dfa") * F.col("dfb"))).alias("lift"))
    return pairs.where(F.col("lift") >= min_lift)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_pairs(corpus_records(spark, sf_dir)).select("token_a", "token_b")


def p5_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_pairs(corpus_records(spark, sf_dir)).withColumn("lift", F.round("lift", 6))


QUERIES = {"p5_found": p5_found, "p5_lift": p5_lift}

_PAIRS = f"""WITH {_TOKENS}, k AS (SELECT doc_id, token, df FROM t JOIN d USING (token) WHERE df >= 20),
    p AS (SELECT x.token AS token_a, y.token AS token_b, count(*) AS c, any_value(x.df) AS dfa, any_value(y.df) AS dfb
          FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.token < y.token GROUP BY 1, 2 HAVING count(*) >= 20)"""

SQL = {
    "p5_found": f"{_PAIRS} SELECT token_a, token_b FROM p, n WHERE c * n.n::DOUBLE / (dfa * dfb) >= 10",
    "p5_lift": f"{_PAIRS} SELECT token_a, token_b, c, round(c * n.n::DOUBLE / (dfa * dfb), 6) AS lift FROM p, n WHERE c * n.n::DOUBLE / (dfa * dfb) >= 10",
}
