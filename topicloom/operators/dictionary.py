"""Dictionary, vocabulary filters, bags of words and filtered corpora.

A tokenised corpus is (doc_id, tokens); a dictionary is (token, token_id, df, cf). All of it is group-bys and joins on the
token with partial aggregation; nothing is collected. A null token never enters a dictionary.

Joins on the token would send every row of a common word to one task. So a dictionary of at most BROADCAST entries, which is
counted, is broadcast; of a larger one the HEAVY words of most documents are, and only rows of other words are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.ids import numbered
from ..plans.materialize import kept

#: Entries up to which a whole dictionary is broadcast, and the words of most documents that are broadcast beyond.
BROADCAST, HEAVY = 200_000, 1024


def token_rows(corpus: DataFrame) -> DataFrame:
    """(doc_id, token), one row an occurrence."""
    return corpus.select("doc_id", F.explode("tokens").alias("token")).where(F.col("token").isNotNull())


def doc_tokens(corpus: DataFrame) -> DataFrame:
    """(doc_id, token, tf)."""
    return token_rows(corpus).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def looked_up(rows: DataFrame, dic: DataFrame, *columns: str) -> DataFrame:
    """`rows` with a token of the dictionary (token, df, ...), each with that entry's `columns`."""
    dic = kept(dic.select("token", "df", *(c for c in columns if c != "df")))
    if dic.count() <= BROADCAST:
        return rows.join(F.broadcast(dic.select("token", *columns)), "token")
    heavy = kept(dic.orderBy(F.desc("df"), "token").limit(HEAVY)).select("token", *columns)
    light = dic.select("token", *columns).join(F.broadcast(heavy.select("token")), "token", "left_anti")
    rest = rows.join(F.broadcast(heavy.select("token")), "token", "left_anti")
    return rows.join(F.broadcast(heavy), "token").unionByName(rest.join(light, "token"))


def dictionary(corpus: DataFrame) -> DataFrame:
    """(token, token_id, df, cf); ids by the first document that has the token, then by the token."""
    stats = doc_tokens(corpus).groupBy("token").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return numbered(stats, "token_id", F.col("first"), F.col("token")).select("token", "token_id", "df", "cf")


def filter_tokens(dic: DataFrame, words: DataFrame) -> DataFrame:
    """Entries whose token is in `words` (word); unknown, null and repeated words are ignored."""
    return dic.join(words.select(F.col("word").alias("token")), "token", "left_semi")


def filter_extremes(dic: DataFrame, n_docs: int, no_below: float = 0.0001, no_above: float = 0.999, keep_n: int = 100_000, compat: bool = True) -> DataFrame:
    """Entries with no_below N <= df <= upper bound, of these the `keep_n` with most documents, ties to the smaller id.

    With `compat` the upper fraction is taken of N N, as a count passed for a fraction is, which switches it off from N = 2
    on; without it of N.
    """
    upper = int(no_above * n_docs * (n_docs if compat else 1))
    return dic.where((F.col("df") >= no_below * n_docs) & (F.col("df") <= upper)).orderBy(F.desc("df"), "token_id").limit(keep_n)


def compactify(dic: DataFrame) -> DataFrame:
    """Ids without gaps, in the same order."""
    return numbered(dic.withColumnRenamed("token_id", "_old"), "token_id", F.col("_old")).select("token", "token_id", "df", "cf")


def doc2bow(corpus: DataFrame, dic: DataFrame) -> DataFrame:
    """(doc_id, token_id, tf); tokens outside the dictionary are dropped."""
    return looked_up(doc_tokens(corpus), dic, "token_id").select("doc_id", "token_id", "tf")


def corpus_text(corpus: DataFrame, dic: DataFrame) -> DataFrame:
    """(doc_id, text): each document's distinct dictionary words in order of id, joined by spaces; empty documents stay."""
    words = looked_up(doc_tokens(corpus), dic, "token_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("token_id", "token"))).alias("w"))
    return corpus.select("doc_id").join(words, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(F.col("w.token"), " "), F.lit("")).alias("text"))


def filtered_corpus(corpus: DataFrame, n_docs: int, words: DataFrame | None = None, **bounds) -> tuple[DataFrame, DataFrame]:
    """(dictionary, corpus text): dictionary, word list, extremes, gap-free ids, distinct words."""
    dic = dictionary(corpus)
    if words is not None:
        dic = filter_tokens(dic, words)
    dic = compactify(filter_extremes(dic, n_docs, **bounds))
    return dic, corpus_text(corpus, dic)


def sorted_corpus(corpus: DataFrame) -> DataFrame:
    """(doc_id, text): each document's distinct words in alphabetical order."""
    return corpus.select("doc_id", F.array_join(F.array_sort(F.array_distinct("tokens")), " ").alias("text"))


def lda_input(corpus: DataFrame, n_docs: int, words: DataFrame | None = None, **bounds) -> tuple[DataFrame, DataFrame]:
    """(bag of words, dictionary): extremes first, then the word list; counts stay."""
    dic = filter_extremes(dictionary(corpus), n_docs, **({"no_above": 0.99} | bounds))
    if words is not None:
        dic = filter_tokens(dic, words)
    dic = compactify(dic)
    return doc2bow(corpus, dic), dic


def vocabulary(corpus: DataFrame) -> DataFrame:
    """(token): every distinct token."""
    return token_rows(corpus).select("token").distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct words of two one-column tables."""
    return a.toDF("word").intersect(b.toDF("word")).where(F.col("word").isNotNull())


def corpus_summary(corpus: DataFrame) -> DataFrame:
    """(n_docs, n_tokens, n_words) of a corpus, in one row; zeros for an empty one."""
    counts = token_rows(corpus).agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("token").alias("n_words"))
    return corpus.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(counts)  # one row each
