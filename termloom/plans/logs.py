"""Chat history and the pipeline log."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import iso_timestamp
from termloom.operators.skew import key_profile
from termloom.plans.store import Table

SESSIONS = "session_id bigint, corpus_id bigint, title string, created_at timestamp"
MESSAGES = "message_id bigint, session_id bigint, is_user boolean, text string, sources string, created_at timestamp"
LOGS = {
    "queries": "query_id bigint, question_text string, created_at bigint, total_latency_ms bigint, succeeded int",
    "query_formulation_runs": "query_id bigint, surviving_term_count int, prompt_text string, llm_response_text string, used_fallback int, selected_terms string, latency_ms bigint",
    "search_runs": "search_run_id bigint, query_id bigint, top_k int, result_count int, latency_ms bigint",
    "search_results": "search_run_id bigint, rank int, passage_id bigint, score double",
    "generation_runs": "query_id bigint, model string, passages_included int, passages_skipped int, prompt_text string, answer_text string, succeeded int, latency_ms bigint",
}


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


class Chats:
    def __init__(self, spark: SparkSession, root: str):
        self.sessions = Table(spark, root, "chat_sessions", SESSIONS)
        self.messages = Table(spark, root, "chat_messages", MESSAGES)

    def create(self, corpus_id: int, title: str) -> int:
        session_id = self.sessions.next_id("session_id")
        self.sessions.append_rows([(session_id, corpus_id, title, _now())])
        return session_id

    def list(self, corpus_id: int) -> DataFrame:
        """Sessions of a corpus, the newest first."""
        own = self.sessions.read().where(F.col("corpus_id") == corpus_id)
        return own.select("session_id", "title", iso_timestamp(F.col("created_at")).alias("created_at")).orderBy(F.desc("session_id"))

    def delete(self, session_id: int) -> None:
        if self.sessions.read().where(F.col("session_id") == session_id).isEmpty():
            raise ValueError(f"no chat session {session_id}")
        self.messages.replace(self.messages.read().where(F.col("session_id") != session_id))
        self.sessions.replace(self.sessions.read().where(F.col("session_id") != session_id))

    def delete_corpus(self, corpus_id: int) -> None:
        gone = self.sessions.read().where(F.col("corpus_id") == corpus_id).select("session_id")
        self.messages.replace(self.messages.read().join(gone, "session_id", "left_anti"))
        self.sessions.replace(self.sessions.read().where(F.col("corpus_id") != corpus_id))

    def append(self, session_id: int, is_user: bool, text: str, sources: list[dict] | None = None) -> int:
        if self.sessions.read().where(F.col("session_id") == session_id).isEmpty():
            raise ValueError(f"no chat session {session_id}")
        message_id = self.messages.next_id("message_id")
        packed = json.dumps(sources, ensure_ascii=False) if sources else None
        self.messages.append_rows([(message_id, session_id, is_user, text, packed, _now())])
        return message_id

    def read(self, session_id: int) -> DataFrame:
        return self.messages.read().where(F.col("session_id") == session_id).orderBy("message_id")


class QueryLog:
    """Append-only log of every pipeline stage; a query's row is written once, when it ends."""

    def __init__(self, spark: SparkSession, root: str):
        self.tables = {name: Table(spark, root, name, schema) for name, schema in LOGS.items()}

    def write(self, name: str, *row) -> None:
        self.tables[name].append_rows([row])

    def next_query(self) -> int:
        return self.tables["queries"].next_id("query_id")

    def search(self, query_id: int, k: int, results: list[tuple[int, float]], latency_ms: int) -> int:
        run = self.tables["search_runs"].next_id("search_run_id")
        self.write("search_runs", run, query_id, k, len(results), latency_ms)
        if results:
            self.tables["search_results"].append_rows([(run, i + 1, p, s) for i, (p, s) in enumerate(results)])
        return run


def latency_report(queries: DataFrame) -> DataFrame:
    """outcome, queries, answered, median_ms, p95_ms, max_ms: log rows by outcome (unfinished where it is null).

    Percentiles are exact and lower: the value of rank ceil(p n), from histograms by outcome.
    """
    outcome = F.when(F.col("succeeded") == 1, "succeeded").when(F.col("succeeded").isNull(), "unfinished").otherwise("failed")
    told = queries.select(outcome.alias("outcome"), "total_latency_ms")
    answered = told.groupBy("outcome").agg(F.count("total_latency_ms").alias("answered"))
    figures = key_profile(told, "outcome", "total_latency_ms", (0.5, 0.95)).withColumnRenamed("key_value", "outcome")
    return figures.join(answered, "outcome").select(
        "outcome", F.col("row_count").alias("queries"), "answered", F.col("p50").alias("median_ms"), F.col("p95").alias("p95_ms"), F.col("value_max").alias("max_ms")
    )


def most_asked(queries: DataFrame, k: int) -> DataFrame:
    """question, times of the k questions asked most often, compared trimmed and in lower case; blank ones do not count."""
    question = F.lower(F.trim("question_text"))
    return queries.where(question != "").groupBy(question.alias("question")).agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "question").limit(k)
