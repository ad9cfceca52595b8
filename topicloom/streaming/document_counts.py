"""Document frequencies of a corpus that arrives as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean_letters


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, posted_at timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(docs: DataFrame, time_col: str = "posted_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, token, df): documents a token stands in, by time window; documents later than the watermark and those without a time are left out."""
    rows = docs.where(F.col(time_col).isNotNull()).withWatermark(time_col, late)
    tokens = rows.select(F.col(time_col), F.explode(F.array_distinct(clean_letters("text"))).alias("token"))
    return tokens.groupBy(F.window(time_col, window), "token").agg(F.count(F.lit(1)).alias("df")).select(F.col("window.start").alias("start"), "token", "df")


def running_counts(docs: DataFrame) -> DataFrame:
    """(token, df) over all documents so far."""
    tokens = docs.select(F.explode(F.array_distinct(clean_letters("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def start(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's changed counts to `path`, a folder a batch; a repeated batch overwrites its own."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
