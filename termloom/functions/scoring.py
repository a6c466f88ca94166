"""BM25 arithmetic as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BM25Params:
    k1: float = 1.2
    b: float = 0.75


def bm25_idf(n_passages: Column, df: Column) -> Column:
    """ln((N - n + 0.5) / (n + 0.5) + 1)"""
    n = df.cast("double")
    return F.log((n_passages.cast("double") - n + 0.5) / (n + 0.5) + 1.0)


def bm25_term_score(idf: Column, tf: Column, length: Column, avgdl: Column, p: BM25Params = BM25Params()) -> Column:
    """idf * tf (k1 + 1) / (tf + k1 ((1 - b) + b length / avgdl)); 0 where avgdl is 0."""
    t = tf.cast("double")
    norm = F.lit(p.k1) * (F.lit(1.0 - p.b) + F.lit(p.b) * length.cast("double") / avgdl)
    return F.when(avgdl > 0, idf * (t * (p.k1 + 1.0)) / (t + norm)).otherwise(F.lit(0.0))


def residual_idf(n_passages: Column, df: Column, cf: Column) -> Column:
    """Observed -log2(df / N) minus what a Poisson term of the same collection frequency would show.

    A Poisson term with cf occurrences in N passages is expected in N (1 - exp(-cf / N)) of them.
    """
    n = n_passages.cast("double")
    observed = -F.log2(df.cast("double") / n)
    expected = -F.log2(-F.expm1(-cf.cast("double") / n))
    return F.when((df > 0) & (n > 0) & (cf > 0), observed - expected)
