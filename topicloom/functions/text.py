"""Text functions: whole columns in, whole columns out, all of them inside the JVM.

A null text counts as an empty one and gives an empty array. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .stopwords import ENGLISH, EXTRA

#: Unicode white space, spelled out so that any regular-expression engine reads it alike.
WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: ASCII punctuation.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def stem(word: Column) -> Column:
    """One suffix (s, able or ly) is taken off words of at least four letters; not repeated."""
    return F.when(F.length(word) >= 4, F.regexp_replace(word, "(s|able|ly)$", "")).otherwise(word)


def clean_letters(text: str | Column, stopwords: Sequence[str] = ENGLISH + EXTRA, shortest: int = 4, longest: int = 12) -> Column:
    """Letters only: other characters separate, then lower case, stop words out, stems, and lengths from `shortest` to `longest`.

    Characters are replaced before the case is folded, so no other script's letter folds into ASCII. Order and repeats stay.
    """
    text = F.col(text) if isinstance(text, str) else text
    words = F.split(F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z]+", " "))), " ")
    kept = F.filter(words, lambda w: ~w.isin(*stopwords))
    return F.filter(F.transform(kept, stem), lambda w: F.length(w).between(shortest, longest))


def clean_plain(text: str | Column, stopwords: Sequence[str] = ENGLISH, lemmas: Column | None = None) -> Column:
    """Lower case, stop words out, then punctuation deleted (so `the,` stays as `the` and `foo-bar` becomes `foobar`).

    `lemmas` is an optional map column form -> lemma; without it words stay as they are.
    """
    text = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE), lambda w: (w != "") & ~w.isin(*stopwords))
    plain = F.filter(F.split(F.regexp_replace(F.array_join(words, " "), PUNCTUATION, ""), WHITE), lambda w: w != "")
    return plain if lemmas is None else F.transform(plain, lambda w: F.coalesce(F.try_element_at(lemmas, w), w))


def lemmatised(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(doc_id, tokens) with every token replaced by its lemma from (form, lemma), where it has one; order and repeats stay.

    Of a form with several lemmas the first in the alphabet holds.
    """
    table = lemmas.where(F.col("form").isNotNull() & F.col("lemma").isNotNull()).groupBy(F.col("form").alias("token")).agg(F.min("lemma").alias("lemma"))
    rows = tokens.select("doc_id", F.posexplode("tokens").alias("at", "token")).join(table, "token", "left")
    lists = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("lemma", "token").alias("token")))).alias("t"))
    return tokens.select("doc_id").join(lists, "doc_id", "left").select("doc_id", F.coalesce(F.col("t.token"), F.array().cast("array<string>")).alias("tokens"))


def pieces(text: str | Column) -> Column:
    """Pieces between white space, one-letter ones too."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def tokenized(corpus: DataFrame, cleaner=clean_letters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens) of a corpus; empty documents stay, with an empty array."""
    return corpus.select(F.col(id_col).alias("doc_id"), cleaner(F.col(text_col)).alias("tokens"))
