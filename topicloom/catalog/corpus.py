"""Queries on texts, dictionaries, tf-idf and word graphs. Every one runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.stopwords import ENGLISH, EXTRA
from ..functions.text import clean_letters, clean_plain, pieces, tokenized
from ..operators import dictionary as dic, graph, tfidf
from ..plans.materialize import kept
from ..sources.corpus import clean_words, corpus_with_labels, word_index
from ..sources.tables import table


def six(x: str | Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return kept(tokenized(table(spark, d, "documents")))


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    """clean_corpus as a tokenised corpus, each id once; empty documents stay."""
    one = table(spark, d, "clean_corpus").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("text").alias("text"))
    return kept(tokenized(one, lambda t: pieces(F.lower(t))))


def vocab(spark: SparkSession, d: str) -> DataFrame:
    return clean_words(table(spark, d, "clean_vocab"))


BOUNDS = {"no_below": 0.002, "no_above": 0.3, "keep_n": 5000, "compat": False}


def clean_tokens(spark, d):
    return dic.doc_tokens(documents(spark, d))


def clean_plain_tokens(spark, d):
    return dic.doc_tokens(tokenized(table(spark, d, "documents"), clean_plain))


def labelled_corpus(spark, d):
    return corpus_with_labels(table(spark, d, "docs"), table(spark, d, "labels")).select("doc_id", F.length("text").cast("long").alias("n_chars"), "label")


def dictionary(spark, d):
    return dic.dictionary(documents(spark, d))


def filter_extremes(spark, d):
    c = documents(spark, d)
    return dic.filter_extremes(dic.dictionary(c), c.count(), **BOUNDS)


def filter_extremes_compat(spark, d):
    c = documents(spark, d)
    return dic.filter_extremes(dic.dictionary(c), c.count())


def filter_tokens(spark, d):
    return dic.filter_tokens(dic.dictionary(cleaned(spark, d)), vocab(spark, d))


def compactify(spark, d):
    return dic.compactify(filter_extremes(spark, d))


def doc2bow(spark, d):
    c = documents(spark, d)
    return dic.doc2bow(c, dic.dictionary(c))


def filtered_corpus(spark, d):
    c = cleaned(spark, d)
    return dic.filtered_corpus(c, c.count(), vocab(spark, d), **BOUNDS)[1]


def filtered_corpus_all(spark, d):
    c = documents(spark, d)
    return dic.filtered_corpus(c, c.count(), no_below=0.001, no_above=0.99)[1]


def sorted_corpus(spark, d):
    return dic.sorted_corpus(documents(spark, d))


def lda_input(spark, d):
    c = cleaned(spark, d)
    return dic.lda_input(c, c.count(), vocab(spark, d))[0]


def vocabulary(spark, d):
    return dic.vocabulary(documents(spark, d))


def filtered_vocabulary(spark, d):
    return filter_extremes(spark, d).select("token")


def vocab_intersection(spark, d):
    return dic.intersection(dic.vocabulary(cleaned(spark, d)), vocab(spark, d))


def corpus_summary(spark, d):
    return dic.corpus_summary(documents(spark, d))


def vector_index(spark, d):
    return word_index(table(spark, d, "word_vectors"))


def tfidf_scores(spark, d):
    c = documents(spark, d)
    return tfidf.tfidf(c, c.count()).select("doc_id", "word", six("tfidf").alias("tfidf"))


def tfidf_counts(spark, d):
    c = cleaned(spark, d)
    return tfidf.tfidf(c, c.count(), binary=False).select("doc_id", "word", six("tfidf").alias("tfidf"))


def tfidf_top_words(spark, d):
    c = documents(spark, d)
    return tfidf.top_words(tfidf.tfidf(c, c.count())).select("word", six("total").alias("total"))


def _graph(spark, d, mode, top):
    c = documents(spark, d)
    n = c.count()
    words = kept(dic.filter_extremes(dic.dictionary(c), n, keep_n=top))
    return graph.cooccurrence(dic.doc2bow(c, words), words, n, mode)


def cooccurrence_star(spark, d):
    return _graph(spark, d, "star", 100_000).select("u", "v", six("weight").alias("weight"))


def cooccurrence_all_pairs(spark, d):
    return _graph(spark, d, "all_pairs", 100_000).select("u", "v", six("weight").alias("weight"))


def adjacency(spark, d):
    return graph.adjacency(_graph(spark, d, "star", 100_000)).select("i", "j", six("w").alias("w"))


def graph_canonical(spark, d):
    return graph.canonical(table(spark, d, "word_graph")).select("u", "v", six("weight").alias("weight"))


def document_counts(spark, d):
    """Document frequencies per day of posting, as the streaming operator counts them in one batch."""
    from ..streaming.document_counts import windowed_counts

    return windowed_counts(table(spark, d, "documents"), window="1 day")


QUERIES = {
    f.__name__: f
    for f in (
        clean_tokens, clean_plain_tokens, dictionary, filter_extremes, filter_extremes_compat, filter_tokens, compactify, doc2bow, filtered_corpus, filtered_corpus_all, sorted_corpus, lda_input,
        vocabulary, filtered_vocabulary, vocab_intersection, corpus_summary, vector_index, tfidf_counts, tfidf_top_words, cooccurrence_star, cooccurrence_all_pairs, adjacency, graph_canonical, document_counts,
    )
} | {"tfidf": tfidf_scores, "corpus_with_labels": labelled_corpus}


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_LETTERS = f"""list_filter(list_transform(list_filter(string_split(trim(lower(regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' ', 'g'))), ' '),
    lambda w: w NOT IN ({_list(ENGLISH + EXTRA)})), lambda w: CASE WHEN length(w) >= 4 THEN regexp_replace(w, '(s|able|ly)$', '') ELSE w END), lambda w: length(w) BETWEEN 4 AND 12)"""
_PLAIN = f"""list_filter(regexp_split_to_array(regexp_replace(array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_WHITE}'),
    lambda w: w <> '' AND w NOT IN ({_list(ENGLISH)})), ' '), '[!-/:-@\\[-`{{-~]', '', 'g'), '{_WHITE}'), lambda w: w <> '')"""
_BASE = """occ AS (SELECT doc_id, unnest(tokens) AS token FROM tok), dt AS (SELECT doc_id, token, count(*) AS tf FROM occ GROUP BY ALL), n AS (SELECT count(*) AS n FROM tok),
    d0 AS (SELECT token, min(doc_id) AS f, count(*) AS df, sum(tf)::BIGINT AS cf FROM dt GROUP BY token),
    dict AS (SELECT token, row_number() OVER (ORDER BY f, token) - 1 AS token_id, df, cf FROM d0)"""
_DOC = f"WITH tok AS (SELECT doc_id, {_LETTERS} AS tokens FROM documents), {_BASE}"
_CC = f"""WITH tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(max(text), '')), '{_WHITE}'), lambda w: w <> '') AS tokens FROM clean_corpus WHERE doc_id IS NOT NULL GROUP BY doc_id),
    {_BASE}, voc AS (SELECT DISTINCT lower(trim(word)) AS word FROM clean_vocab WHERE lower(trim(word)) <> '')"""
_EXT = ", ext AS (SELECT dict.* FROM dict, n WHERE df >= 0.002 * n.n AND df <= floor(0.3 * n.n) ORDER BY df DESC, token_id LIMIT 5000)"
_COMPAT = ", ext AS (SELECT dict.* FROM dict, n WHERE df >= 0.0001 * n.n AND df <= floor(0.999 * n.n * n.n) ORDER BY df DESC, token_id LIMIT {})"
_TFIDF = """, b AS (SELECT doc_id, token AS word, {tf} * (ln((1.0 + n.n) / (1.0 + df)) + 1) AS x FROM dt JOIN d0 USING (token), n),
    s AS (SELECT doc_id, word, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS tfidf FROM b)"""
_EDGES = """, bow AS (SELECT doc_id, token_id FROM dt JOIN ext USING (token)), e AS ({pairs}),
    w AS (SELECT e.u, e.v, c * least(ln((1.0 + n.n) / (1.0 + a.df)) + 1, ln((1.0 + n.n) / (1.0 + b.df)) + 1) / greatest(ln((1.0 + n.n) / (1.0 + a.df)) + 1, ln((1.0 + n.n) / (1.0 + b.df)) + 1) AS weight
    FROM e JOIN ext a ON a.token_id = e.u JOIN ext b ON b.token_id = e.v, n)"""
_STAR = _COMPAT.format(100000) + _EDGES.format(pairs="SELECT u, token_id AS v, count(*) AS c FROM bow JOIN (SELECT doc_id, min(token_id) AS u FROM bow GROUP BY 1) USING (doc_id) WHERE token_id <> u GROUP BY ALL")
_ALL = _COMPAT.format(100000) + _EDGES.format(pairs="SELECT x.token_id AS u, y.token_id AS v, count(*) AS c FROM bow x JOIN bow y ON x.doc_id = y.doc_id AND x.token_id < y.token_id GROUP BY ALL")
_TEXT = """ SELECT t.doc_id, coalesce(w.text, '') AS text FROM tok t LEFT JOIN (SELECT doc_id, string_agg(token, ' ' ORDER BY token_id) AS text FROM dt JOIN {words} USING (token) GROUP BY doc_id) w USING (doc_id)"""
_IN_VOC = ", ft AS (SELECT * FROM dict WHERE token IN (SELECT word FROM voc))"

SQL = {
    "clean_tokens": f"{_DOC} SELECT doc_id, token, tf FROM dt",
    "clean_plain_tokens": f"WITH tok AS (SELECT doc_id, {_PLAIN} AS tokens FROM documents), {_BASE} SELECT doc_id, token, tf FROM dt",
    "corpus_with_labels": "SELECT d.doc_id, length(text) AS n_chars, label FROM (SELECT doc_id, max(text) AS text FROM docs WHERE doc_id IS NOT NULL GROUP BY 1) d LEFT JOIN (SELECT DISTINCT doc_id, label FROM labels WHERE label IS NOT NULL) l ON l.doc_id = d.doc_id",
    "dictionary": f"{_DOC} SELECT * FROM dict",
    "filter_extremes": f"{_DOC}{_EXT} SELECT * FROM ext",
    "filter_extremes_compat": f"{_DOC}{_COMPAT.format(100000)} SELECT * FROM ext",
    "filter_tokens": f"{_CC}{_IN_VOC} SELECT * FROM ft",
    "compactify": f"{_DOC}{_EXT} SELECT token, row_number() OVER (ORDER BY token_id) - 1 AS token_id, df, cf FROM ext",
    "doc2bow": f"{_DOC} SELECT doc_id, token_id, tf FROM dt JOIN dict USING (token)",
    "filtered_corpus": f"{_CC}{_IN_VOC}, ext AS (SELECT ft.* FROM ft, n WHERE df >= 0.002 * n.n AND df <= floor(0.3 * n.n) ORDER BY df DESC, token_id LIMIT 5000){_TEXT.format(words='ext')}",
    "filtered_corpus_all": f"{_DOC}, ext AS (SELECT dict.* FROM dict, n WHERE df >= 0.001 * n.n ORDER BY df DESC, token_id LIMIT 100000){_TEXT.format(words='ext')}",
    "sorted_corpus": f"{_DOC} SELECT doc_id, array_to_string(list_sort(list_distinct(tokens)), ' ') AS text FROM tok",
    "lda_input": f"""{_CC}, ext AS (SELECT dict.* FROM dict, n WHERE df >= 0.0001 * n.n ORDER BY df DESC, token_id LIMIT 100000), g AS (SELECT token, row_number() OVER (ORDER BY token_id) - 1 AS token_id
        FROM ext WHERE token IN (SELECT word FROM voc)) SELECT doc_id, token_id, tf FROM dt JOIN g USING (token)""",
    "vocabulary": f"{_DOC} SELECT token FROM dict",
    "filtered_vocabulary": f"{_DOC}{_EXT} SELECT token FROM ext",
    "vocab_intersection": f"{_CC} SELECT token AS word FROM dict INTERSECT SELECT word FROM voc",
    "corpus_summary": f"{_DOC} SELECT (SELECT n FROM n) AS n_docs, (SELECT count(*) FROM occ) AS n_tokens, (SELECT count(*) FROM dict) AS n_words",
    "vector_index": "SELECT word, max(ix) AS ix FROM word_vectors WHERE word IS NOT NULL GROUP BY word",
    "tfidf": f"{_DOC}{_TFIDF.format(tf='1')} SELECT doc_id, word, round(tfidf, 6) AS tfidf FROM s",
    "tfidf_counts": f"{_CC}{_TFIDF.format(tf='tf')} SELECT doc_id, word, round(tfidf, 6) AS tfidf FROM s",
    "tfidf_top_words": f"{_DOC}{_TFIDF.format(tf='1')}, k AS (SELECT word, sum(tfidf) AS total FROM s GROUP BY 1 ORDER BY round(total, 9) DESC, word LIMIT 20) SELECT word, round(total, 6) AS total FROM k",
    "cooccurrence_star": f"{_DOC}{_STAR} SELECT u, v, round(weight, 6) AS weight FROM w",
    "cooccurrence_all_pairs": f"{_DOC}{_ALL} SELECT u, v, round(weight, 6) AS weight FROM w",
    "adjacency": f"{_DOC}{_STAR} SELECT u AS i, v AS j, round(weight, 6) AS w FROM w UNION ALL SELECT v, u, round(weight, 6) FROM w",
    "graph_canonical": "SELECT least(u, v) AS u, greatest(u, v) AS v, round(sum(weight), 6) AS weight FROM (SELECT DISTINCT u, v, weight FROM word_graph WHERE u <> v AND weight IS NOT NULL) GROUP BY ALL",
    "document_counts": f"WITH t AS (SELECT date_trunc('day', posted_at) AS start, unnest(list_distinct({_LETTERS})) AS token FROM documents WHERE posted_at IS NOT NULL) SELECT start, token, count(*) AS df FROM t GROUP BY ALL",
}
