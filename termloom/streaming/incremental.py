"""Streaming additions (no counterpart elsewhere): documents indexed as they arrive, and windows over the question log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators.indexing import chunk_documents, passages_of, postings_of


def index_stream(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends postings of arriving documents (document_name, text) below target, once per document name and batch.

    A batch is written under its own number, so that a batch run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        first = batch.where("document_name IS NOT NULL AND text IS NOT NULL").groupBy("document_name").agg(F.min("text").alias("text"))
        passages = passages_of(chunk_documents(first))
        postings_of(passages).write.mode("overwrite").parquet(f"{target}/postings/batch={number}")
        passages.drop("terms").write.mode("overwrite").parquet(f"{target}/passages/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def question_windows(log: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window_start, questions, failed over event time created_at (epoch seconds); rows later than late are dropped."""
    timed = log.withColumn("at", F.timestamp_seconds("created_at")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", width)).agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(F.col("succeeded") == 0).alias("failed")
    )
    return counted.select(F.col("window.start").alias("window_start"), "questions", "failed")
