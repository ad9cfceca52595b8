"""Readers and writers of corpora, vectors, word lists and predictions; models.py has those of fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.ids import numbered
from .tables import table


def read_json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) from a file with one JSON list of texts; the id is the place in the list, null entries are kept.

    Such a file can't be split; corpora of size belong in Parquet.
    """
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("doc_id", "text")).withColumn("doc_id", F.col("doc_id").cast("long"))


def _placed(df: DataFrame) -> DataFrame:
    """Adds the place of a row in its folder of files: file names in order, then the order within."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))


def read_corpus(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(doc_id, text) of a corpus stored as `json`, `csv` (its labels are left out) or `parquet`."""
    if kind == "json":
        return read_json_corpus(spark, path)
    if kind == "csv":
        return read_csv_corpus(spark, path).select("doc_id", "text")
    if kind == "parquet":
        return spark.read.parquet(path).select("doc_id", "text")
    raise ValueError(f"unknown kind of corpus {kind!r}")


def read_csv_corpus(spark: SparkSession, path: str, columns: str = "id string, text string, label string") -> DataFrame:
    """(doc_id, text, label) from a CSV with a header: the second column is the text, the third the label; quoted line breaks are kept.

    The id is the row's place in the file.
    """
    raw = spark.read.csv(path, header=True, schema=columns, multiLine=True, quote='"', escape='"')
    names = raw.columns
    rows = _placed(raw).select("_file", "_block", "_at", F.col(names[1]).alias("text"), F.col(names[2]).alias("label"))
    return numbered(rows, "doc_id", F.col("_file"), F.col("_block"), F.col("_at")).select("doc_id", "text", "label")


def corpus_with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label): each document once (its greatest text) with each of its distinct labels, null where it has none."""
    one = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("text").alias("text"))
    return one.join(labels.where(F.col("label").isNotNull()).select("doc_id", "label").distinct(), "doc_id", "left").select("doc_id", "text", "label")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(ix, word, vec) from lines `word v1 .. vd`; ix is the line's number. Blank lines are left out, after numbering."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = numbered(_placed(spark.read.text(path)), "ix", F.col("_file"), F.col("_block"), F.col("_at")).where(F.trim("value") != "").select("ix", parts.alias("p"))
    return rows.select("ix", F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, 1_000_000), lambda x: x.try_cast("float")).alias("vec"))


def word_index(vectors: DataFrame) -> DataFrame:
    """(word, ix): of a repeated word the last row's ix; null words are left out."""
    return vectors.where(F.col("word").isNotNull()).groupBy("word").agg(F.max("ix").alias("ix"))


def read_lines(spark: SparkSession, path: str, strip: bool = False) -> DataFrame:
    """(word): a line each."""
    value = F.trim("value") if strip else F.col("value")
    return spark.read.text(path).select(value.alias("word"))


def clean_words(words: DataFrame) -> DataFrame:
    """(word): the distinct words of a list, without stray blanks and case; empty and null entries are left out."""
    return words.select(F.lower(F.trim("word")).alias("word")).where(F.col("word") != "").distinct()


def write_lines(df: DataFrame, path: str, column: str, order: str | None = None) -> None:
    """One item a line, in order where one is named; a folder of part files in that order."""
    rows = df.orderBy(order) if order else df
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Saves a table as parquet, csv or txt (one string column)."""
    if kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    elif kind == "txt":
        write_lines(df, path, df.columns[0])
    else:
        raise ValueError(f"unknown kind {kind!r}")


def write_assignments(df: DataFrame, path: str) -> None:
    """Cluster assignments (integers) as CSV."""
    df.select([F.col(c).cast("int") for c in df.columns]).write.mode("overwrite").csv(path)


def read_dictionary(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "dictionary")


def ranked_words(dictionary: DataFrame, n: int) -> DataFrame:
    """(rank, word): the n words of most documents, ties by the word; rank from 0."""
    top = dictionary.orderBy(F.desc("df"), "token").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("df"), "token")) - 1).select("rank", F.col("token").alias("word"))  # n rows
