"""Queries on readers and writers: a table is stored in a format of its own and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.stopwords import ENGLISH, EXTRA, TOOLKIT
from ..functions.text import clean_letters, lemmatised, tokenized
from ..operators import dictionary as dic, prior, tfidf
from ..plans import pipeline
from ..plans.materialize import shared_dir
from ..sources import corpus as src
from ..sources.tables import table
from .corpus import _LETTERS, _list, cleaned, six
from .numeric import TOPICS


def place(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/topicloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def json_corpus(spark, d):
    """The items as one JSON list of texts, in order of their id, read as a corpus."""
    path = place(spark)
    texts = table(spark, d, "eval_items").agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("t"))  # a fixed table; the format is one list in one file
    texts.select(F.to_json(F.col("t.text")).alias("value")).coalesce(1).write.text(path)
    return src.read_corpus(spark, path, "json")


def json_tokens(spark, d):
    return dic.doc_tokens(tokenized(json_corpus(spark, d)))


def csv_corpus(spark, d):
    """The graded texts as CSV with a header (id, text, label), in order of their id, read as a labelled corpus."""
    path = place(spark)
    rows = table(spark, d, "graded_samples").select(F.col("sample_id").alias("id"), "text", F.col("level").alias("label"))
    rows.orderBy("id").write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    return src.read_csv_corpus(spark, path)


def vectors_file(spark, d):
    """The whole word vectors as lines `word v1 .. vd`, in order of ix, read with the number of their line."""
    path = place(spark)
    rows = table(spark, d, "word_vectors").where(F.col("word").isNotNull() & (F.size("vec") == 50) & F.forall("vec", lambda x: x.isNotNull()))
    rows.orderBy("ix").select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)
    return src.read_vectors(spark, path).select("ix", "word", F.size("vec").alias("width"), six(F.col("vec")[0].cast("double")).alias("first"))


def word_list(spark, d):
    """The word list as a file of lines, read stripped: how often each word stands there."""
    path = place(spark)
    src.write_lines(table(spark, d, "clean_vocab").where(F.col("word").isNotNull()), path, "word")
    return src.read_lines(spark, path, strip=True).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def raw_lines(spark, d):
    path = place(spark)
    src.write_lines(table(spark, d, "clean_vocab").where(F.col("word").isNotNull()), path, "word")
    return src.read_lines(spark, path).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def dictionary_words(spark, d):
    """The dictionary's words, saved and read back as a word list."""
    path = place(spark)
    src.write_lines(src.read_dictionary(spark, d), path, "token", order="token_id")
    return src.read_lines(spark, path)


def _saved(kind):
    def run(spark, d):
        path = place(spark)
        rows = src.read_dictionary(spark, d)
        src.write_table(rows, path, kind)
        return spark.read.csv(path, header=True, schema=rows.schema) if kind == "csv" else spark.read.schema(rows.schema).parquet(path)

    return run


def saved_prior(spark, d):
    """The transposed prior, saved and read back."""
    path = place(spark)
    src.write_table(prior.transpose(prior.soft_prior(table(spark, d, "predictions"), TOPICS)), path)
    return spark.read.parquet(path).select("topic", "ix", six("eta").alias("eta"))


def saved_assignments(spark, d):
    """Each word's likeliest topic, ties to the smaller, as the CSV of assignments, read back."""
    path = place(spark)
    best = prior.deduplicated(table(spark, d, "predictions")).groupBy("ix").agg(F.min_by("topic", F.struct(-F.col("p"), "topic")).alias("topic"))
    src.write_assignments(best, path)
    return spark.read.csv(path, schema="ix int, topic int")


def word_order(spark, d):
    """The order of words: rank by documents, of the saved dictionary."""
    return src.ranked_words(src.read_dictionary(spark, d), 6000).select("rank", "word")


def word_features(spark, d):
    """Words as columns of the tf-idf table: documents and squared length of each."""
    c = cleaned(spark, d)
    rows = tfidf.word_features(tfidf.tfidf(c, c.count(), binary=False))
    return rows.select("word", F.size("docs").alias("docs"), six(F.aggregate("ws", F.lit(0.0), lambda s, x: s + x * x)).alias("square"))


def clean_tokens_toolkit(spark, d):
    """The letters-only cleaner with the other stop-word list."""
    return dic.doc_tokens(tokenized(table(spark, d, "documents"), lambda t: clean_letters(t, TOOLKIT + EXTRA)))


def lemmas(spark, d) -> DataFrame:
    """(form, lemma): dictionary words that are another word and an s."""
    words = src.read_dictionary(spark, d).select("token")
    return words.select(F.concat("token", F.lit("s")).alias("form"), F.col("token").alias("lemma")).join(words.select(F.col("token").alias("form")), "form", "left_semi")


def clean_lemmas(spark, d):
    return dic.doc_tokens(lemmatised(cleaned(spark, d), lemmas(spark, d)))


def prepared_corpus(spark, d):
    """A stored corpus cleaned, filtered by the dictionary's bounds and saved: dictionary of the graded texts."""
    path = place(spark)
    table(spark, d, "graded_samples").select(F.col("sample_id").alias("doc_id"), "text").write.parquet(path)
    words, _, _ = pipeline.prepare_corpus(src.read_corpus(spark, path, "parquet"), None, no_below=0.02, no_above=0.9, compat=False)
    return words


def embedding_prior(spark, d):
    """Entry point A from stored files to each word's total prior: `documents`, and as vectors of its words those of `embeddings`,
    the r-th for the word with the r-th most documents (no word of `word_vectors` stands in a text)."""
    corpus, vectors = place(spark), place(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs.write.parquet(corpus)
    words = src.ranked_words(dic.dictionary(tokenized(docs)), 1_000_000)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("rank"), "embedding").join(words, "rank").orderBy("rank")
    rows.select(F.concat_ws(" ", "word", F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value")).write.text(vectors)
    eta = pipeline.run_embedding_prior(spark, corpus, "parquet", vectors, pipeline.Settings(mode="pca", topics=10))[1]
    return eta.groupBy("ix").agg(six(F.sum("eta")).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        json_corpus, json_tokens, csv_corpus, vectors_file, word_list, raw_lines, dictionary_words, saved_prior, saved_assignments, word_order, word_features, clean_tokens_toolkit, clean_lemmas, prepared_corpus,
        embedding_prior,
    )
} | {"saved_dictionary_csv": _saved("csv"), "saved_dictionary_parquet": _saved("parquet")}

_ITEMS = "SELECT row_number() OVER (ORDER BY item_id) - 1 AS doc_id, text FROM eval_items"
_CC = "c AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(max(text), '')), '\\s+'), lambda w: w <> '') AS tokens FROM clean_corpus WHERE doc_id IS NOT NULL GROUP BY doc_id), o AS (SELECT doc_id, unnest(tokens) AS token FROM c)"
_WHOLE = "word IS NOT NULL AND len(vec) = 50 AND len(list_filter(vec, lambda x: x IS NULL)) = 0"
_PRIOR = f"""q AS (SELECT ix, topic, coalesce(max(p), 0) AS p FROM predictions WHERE ix IS NOT NULL AND topic IS NOT NULL GROUP BY ALL)"""
SQL = {
    "embedding_prior": f"""WITH w AS (SELECT count(DISTINCT token) AS n FROM (SELECT unnest({_LETTERS}) AS token FROM documents)), e AS (SELECT count(*) AS m FROM embeddings)
        SELECT unnest(range(least(n, m) - 1)) AS ix, 1.0::DOUBLE AS total FROM w, e""",
    "json_corpus": _ITEMS,
    "json_tokens": f"WITH t AS (SELECT doc_id, unnest({_LETTERS}) AS token FROM ({_ITEMS})) SELECT doc_id, token, count(*) AS tf FROM t GROUP BY ALL",
    "csv_corpus": "SELECT row_number() OVER (ORDER BY sample_id) - 1 AS doc_id, text, level::VARCHAR AS label FROM graded_samples",
    "vectors_file": f"SELECT row_number() OVER (ORDER BY ix) - 1 AS ix, word, 50::INT AS width, round(vec[1]::DOUBLE, 6) + 0.0 AS first FROM word_vectors WHERE {_WHOLE}",
    "word_list": "SELECT trim(word) AS word, count(*) AS n FROM clean_vocab WHERE word IS NOT NULL GROUP BY ALL",
    "raw_lines": "SELECT word, count(*) AS n FROM clean_vocab WHERE word IS NOT NULL GROUP BY ALL",
    "dictionary_words": "SELECT token AS word FROM dictionary",
    "saved_dictionary_csv": "SELECT * FROM dictionary",
    "saved_dictionary_parquet": "SELECT * FROM dictionary",
    "saved_prior": f"WITH {_PRIOR}, s AS (SELECT ix, sum(p) AS s FROM q GROUP BY ix) SELECT t.topic::INT AS topic, s.ix, round((coalesce(q.p, 0) + 0.01) / (s.s + {TOPICS} * 0.01), 6) AS eta FROM s CROSS JOIN range({TOPICS}) t(topic) LEFT JOIN q ON q.ix = s.ix AND q.topic = t.topic",
    "saved_assignments": f"WITH {_PRIOR} SELECT ix, topic FROM q QUALIFY row_number() OVER (PARTITION BY ix ORDER BY p DESC, topic) = 1",
    "word_order": "SELECT (row_number() OVER (ORDER BY df DESC NULLS LAST, token) - 1)::INT AS rank, token AS word FROM dictionary QUALIFY rank < 6000",
    "word_features": f"""WITH {_CC}, t AS (SELECT doc_id, token AS word, count(*) AS tf FROM o GROUP BY ALL), n AS (SELECT count(*) AS n FROM c), f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
        x AS (SELECT doc_id, word, tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS x FROM t JOIN f USING (word), n), s AS (SELECT word, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM x)
        SELECT word, count(*)::INT AS docs, round(sum(w * w), 6) + 0.0 AS square FROM s GROUP BY word""",
    "clean_tokens_toolkit": f"WITH t AS (SELECT doc_id, unnest({_LETTERS.replace(_list(ENGLISH + EXTRA), _list(TOOLKIT + EXTRA))}) AS token FROM documents) SELECT doc_id, token, count(*) AS tf FROM t GROUP BY ALL",
    "clean_lemmas": f"""WITH {_CC}, l AS (SELECT a.token AS form, b.token AS lemma FROM dictionary a JOIN dictionary b ON a.token = b.token || 's'), r AS (SELECT doc_id, coalesce(lemma, token) AS token FROM o LEFT JOIN l ON form = token)
        SELECT doc_id, token, count(*) AS tf FROM r GROUP BY ALL""",
    "prepared_corpus": f"""WITH c AS (SELECT sample_id AS doc_id, {_LETTERS} AS tokens FROM graded_samples), o AS (SELECT doc_id, unnest(tokens) AS token FROM c), t AS (SELECT doc_id, token, count(*) AS tf FROM o GROUP BY ALL), n AS (SELECT count(*) AS n FROM c),
        d AS (SELECT token, min(doc_id) AS f, count(*) AS df, sum(tf)::BIGINT AS cf FROM t GROUP BY token) SELECT token, row_number() OVER (ORDER BY f, token) - 1 AS token_id, df, cf FROM d, n WHERE df >= 0.02 * n AND df <= floor(0.9 * n)""",
}
