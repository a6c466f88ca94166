"""BM25 for whole query sets in one job; a single question is a set of one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.scoring import BM25Params, bm25_idf, bm25_term_score
from termloom.functions.text import STOPWORDS, drop_stopwords, tokenize
from termloom.operators.lexicon import lemma_map

#: Scores are ranked as rounded to so many decimals, since sums differ in the last bits with their order.
DECIMALS = 6


def ordered_terms(queries: DataFrame, stop: Sequence[str] = STOPWORDS, lexicon: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """query_id, pos, term: each query's terms in their order, repeats kept. A lexicon (lemmas, exceptions) lemmatizes them:
    the map is made of the queries' own terms, so that forms which no document holds are mapped too."""
    terms = queries.select("query_id", F.posexplode(drop_stopwords(tokenize(F.col("query_text")), stop)).alias("pos", "term"))
    if lexicon is None:
        return terms
    return terms.join(lemma_map(terms, *lexicon), "term").select("query_id", "pos", F.col("lemma").alias("term"))


def bag_of(terms: DataFrame) -> DataFrame:
    """query_id, term, qtf of rows (query_id, term)."""
    return terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def query_terms(queries: DataFrame, stop: Sequence[str] = STOPWORDS, lexicon: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """query_id, term, qtf: the bag of each query's terms. A query of stop words only has no row."""
    return bag_of(ordered_terms(queries, stop, lexicon))


def idf_of(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf"""
    n = stats.select("n_passages").scalar()
    return terms.select("term", "df", bm25_idf(n, F.col("df")).alias("idf"))


def term_scores(bag: DataFrame, postings: DataFrame, terms: DataFrame, stats: DataFrame, params: BM25Params = BM25Params()) -> DataFrame:
    """query_id, passage_id, term, qtf, df, score: what each query term adds to each passage (the explanation of a rank).

    A term asked twice counts twice; unknown terms add nothing. Equal terms of many queries meet each posting once per
    query; idf is looked up before the postings are touched.
    """
    weighted = bag.join(idf_of(terms, stats), "term")
    avgdl = stats.select("avgdl").scalar()
    rows = postings.join(weighted, "term")
    one = bm25_term_score(F.col("idf"), F.col("term_frequency"), F.col("token_count"), avgdl, params)
    return rows.select("query_id", "passage_id", "term", "qtf", "df", (one * F.col("qtf")).alias("score"))


def passage_scores(scores: DataFrame) -> DataFrame:
    """query_id, passage_id, score summed over terms and rounded."""
    return scores.groupBy("query_id", "passage_id").agg(F.round(F.sum("score"), DECIMALS).alias("score"))


def top_k(scored: DataFrame, k: int, ties: Sequence[str] = ("passage_id",)) -> DataFrame:
    """scored with rank from 1, the best k of each query; equal scores go by ties.

    Each task cuts its rows to k a query before they are shuffled.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_or_equal(scored: DataFrame, k: int) -> DataFrame:
    """scored cut to rows whose score is among the best k of their query, all ties of the last included.

    What breaks ties can be joined afterwards, for these rows only.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"))
    return scored.withColumn("at", F.rank().over(w)).where(F.col("at") <= k).drop("at")


def search(
    queries: DataFrame, postings: DataFrame, terms: DataFrame, stats: DataFrame, k: int, params: BM25Params = BM25Params(),
    stop: Sequence[str] = STOPWORDS, lexicon: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """query_id, passage_id, score, rank of the best k passages of each query; none for an empty index."""
    bag = query_terms(queries, stop, lexicon)
    return top_k(passage_scores(term_scores(bag, postings, terms, stats, params)), k)


def lookup_terms(terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, term_id for each distinct wanted term; -1 where unknown. Nothing is inserted."""
    known = terms.groupBy("term").agg(F.min("term_id").alias("term_id"))
    return wanted.select("term").distinct().join(known, "term", "left").select("term", F.coalesce("term_id", F.lit(-1)).alias("term_id"))


def document_names(ids: DataFrame, passages: DataFrame) -> DataFrame:
    """pos, passage_id, document_name for a list of ids with positions; a missing passage has a null name."""
    return ids.join(passages.select("passage_id", "document_name"), "passage_id", "left").select("pos", "passage_id", "document_name")


def zip_postings(arrays: DataFrame) -> DataFrame:
    """Rows of equally long array columns taken in lock step, not crossed."""
    return arrays.select(F.inline(F.arrays_zip(*arrays.columns)))


def reciprocal(rank: Column, depth: int) -> Column:
    return F.coalesce(F.when(rank <= depth, 1.0 / rank), F.lit(0.0))
