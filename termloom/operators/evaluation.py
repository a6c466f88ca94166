"""Retrieval quality: MRR@10, Recall@10 and Recall@100 over a query set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.retrieval import reciprocal


def evaluated_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, relevant: queries with positive judgements, and how many rows these are (repeats count)."""
    positive = qrels.where("score > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    return queries.select("query_id").distinct().join(positive, "query_id")


def skipped_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id of the queries without a positive judgement."""
    return queries.select("query_id").distinct().join(qrels.where("score > 0"), "query_id", "left_anti")


def per_query(queries: DataFrame, qrels: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, reciprocal_rank, recall_10, recall_100 for each evaluated query.

    ranked has query_id, rank and document_name. Ranks are those of passages: several passages of a document take
    several. A document counts once however many of its passages are ranked; repeated positive judgements count in the
    denominator. Queries without hits or without terms have zeros.
    """
    judged = qrels.where("score > 0").select("query_id", F.col("corpus_id").alias("document_name")).distinct()
    hits = ranked.where("rank <= 100").join(judged, ["query_id", "document_name"]).groupBy("query_id", "document_name").agg(F.min("rank").alias("first_rank"))
    by_query = hits.groupBy("query_id").agg(
        F.min("first_rank").alias("best"), F.count_if(F.col("first_rank") <= 10).alias("h10"), F.count_if(F.col("first_rank") <= 100).alias("h100")
    )
    joined = evaluated_queries(queries, qrels).join(by_query, "query_id", "left")

    def recall(hit: str) -> Column:
        return F.coalesce(F.col(hit), F.lit(0)) / F.col("relevant")

    return joined.select("query_id", reciprocal(F.col("best"), 10).alias("reciprocal_rank"), recall("h10").alias("recall_10"), recall("h100").alias("recall_100"))


def summary(queries: DataFrame, qrels: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row: evaluated, skipped, mrr_10, recall_10, recall_100; zeros where nothing was evaluated."""
    means = per_query(queries, qrels, ranked).agg(
        F.count(F.lit(1)).alias("evaluated"),
        *[F.round(F.coalesce(F.avg(a), F.lit(0.0)), 6).alias(b) for a, b in (("reciprocal_rank", "mrr_10"), ("recall_10", "recall_10"), ("recall_100", "recall_100"))],
    )
    skipped = skipped_queries(queries, qrels).agg(F.count(F.lit(1)).alias("skipped")).scalar()
    return means.select("evaluated", skipped.alias("skipped"), "mrr_10", "recall_10", "recall_100")
