"""From documents to the relational index: passages, postings, terms and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import STOPWORDS, chunk_words, drop_stopwords, split_words, tokenize
from termloom.session import cut_lineage, small_side

CHUNK, OVERLAP = 200, 40
#: Terms of a query set are broadcast up to so many, and shuffled beyond.
SMALL = 100_000


@dataclass(frozen=True)
class Index:
    documents: DataFrame
    passages: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def first_documents(docs: DataFrame, order: str) -> DataFrame:
    """document_name, text: of documents of one name the first by order stays; null names and texts leave.

    The first is found by a fold (min_by), so a name that many rows share needs no sort.
    """
    known = docs.where("document_name IS NOT NULL AND text IS NOT NULL")
    return known.groupBy("document_name").agg(F.min_by("text", F.struct(order, "text")).alias("text"))


def replace_documents(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing without the names that new brings, and new: both (document_name, text), unique by name."""
    kept = existing.join(new.select("document_name").distinct(), "document_name", "left_anti")
    return kept.select("document_name", "text").unionByName(new.select("document_name", "text"))


def passage_key(document_name: Column, chunk_id: Column) -> Column:
    return F.xxhash64(document_name, chunk_id)


def chunk_documents(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """document_name, chunk_id, text: overlapping word windows; a document without words has none."""
    # a column of its own, as a text inside chunk_words would be split again for every chunk
    worded = docs.select("document_name", split_words(F.col("text")).alias("words"))
    return worded.select("document_name", F.posexplode(chunk_words(F.col("words"), size, overlap)).alias("chunk_id", "text"))


def passages_of(chunks: DataFrame, stop: Sequence[str] = STOPWORDS) -> DataFrame:
    """chunks with passage_id, terms (tokens without stop words, repeats kept) and token_count."""
    terms = drop_stopwords(tokenize(F.col("text")), stop)
    keyed = chunks.select(passage_key(F.col("document_name"), F.col("chunk_id")).alias("passage_id"), "*", terms.alias("terms"))
    return keyed.withColumn("token_count", F.size("terms"))


def postings_of(
    passages: DataFrame, lemmas: DataFrame | None = None, key: Sequence[str] = ("passage_id",), only: DataFrame | None = None
) -> DataFrame:
    """term, key, term_frequency, token_count. lemmas (term, lemma) renames terms before they are counted; only (term)
    keeps the unrenamed terms it lists, before anything is counted or shuffled."""
    occurrences = passages.select(*key, "token_count", F.explode("terms").alias("term"))
    if only is not None:
        occurrences = occurrences.join(only, "term", "left_semi")
    counted = occurrences.groupBy(*key, "term", "token_count").agg(F.count(F.lit(1)).alias("n"))
    if lemmas is not None:
        # rename counts, not occurrences; terms that the map lacks stay
        renamed = counted.join(lemmas, "term", "left").withColumn("term", F.coalesce("lemma", "term"))
        counted = renamed.groupBy(*key, "term", "token_count").agg(F.sum("n").alias("n"))
    return counted.select("term", *key, F.col("n").cast("int").alias("term_frequency"), "token_count")


def terms_of(postings: DataFrame) -> DataFrame:
    """term, df"""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def stats_of(passages: DataFrame) -> DataFrame:
    """One row: n_passages, avgdl, over all passages, those without tokens too; (0, 0.0) for none."""
    return passages.agg(F.count(F.lit(1)).alias("n_passages"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("avgdl"))


def build_index(
    docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, stop: Sequence[str] = STOPWORDS, lemmas: DataFrame | None = None
) -> Index:
    """Index of documents (document_name unique, text), declared lazily."""
    passages = passages_of(chunk_documents(docs, size, overlap), stop)
    postings = postings_of(passages, lemmas)
    return Index(docs.select("document_name", "text"), passages.drop("terms"), postings, terms_of(postings), stats_of(passages))


def stored_postings(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings keyed by term text from tables keyed by ids: the inner join of both, repeated rows once."""
    names = terms.where("term IS NOT NULL").select("term_id", "term").distinct()
    return postings.distinct().join(names, "term_id").select("term", "passage_id", "term_frequency", "token_count")


def stored_index(postings: DataFrame, terms: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, terms, stats) keyed by term text from stored tables, of the wanted terms (term) only.

    Repeated rows count once; ids of one term on one passage are added up. Statistics are of all passages with postings.
    """
    names = terms.join(wanted.select("term").distinct(), "term", "left_semi").select("term_id", "term").distinct()
    rows = postings.join(small_side(names, SMALL), "term_id").select("term", "term_id", "passage_id", "term_frequency", "token_count").distinct()
    known = rows.where("passage_id IS NOT NULL").groupBy("term", "passage_id").agg(
        F.sum("term_frequency").alias("term_frequency"), F.max("token_count").alias("token_count")
    )
    lengths = postings.where("passage_id IS NOT NULL").groupBy("passage_id").agg(F.max("token_count").alias("token_count"))
    return known, terms_of(known), stats_of(lengths)


def integrity(index: Index) -> DataFrame:
    """check_name, violations: what keys and references would have refused; all are 0 after a sound build."""
    p, q = index.passages, index.postings
    zero = F.lit(0).cast("bigint")

    def check(name: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.count(F.lit(1)).cast("bigint").alias("violations")).select(F.lit(name).alias("check_name"), "violations")

    sums = q.groupBy("passage_id").agg(F.sum("term_frequency").alias("total"), F.max("token_count").alias("posted"))
    totals = p.join(sums, "passage_id", "left").where(
        (F.coalesce("total", zero) != F.col("token_count")) | (F.coalesce("posted", F.col("token_count")) != F.col("token_count"))
    )
    dense = p.groupBy("document_name").agg(F.count(F.lit(1)).alias("n"), F.max("chunk_id").alias("last"), F.count_distinct("chunk_id").alias("d"))
    checks = [
        check("posting_repeated", q.groupBy("term", "passage_id").count().where("count > 1")),
        check("posting_without_passage", q.join(p, "passage_id", "left_anti")),
        check("posting_without_term", q.join(index.terms, "term", "left_anti")),
        check("token_count_differs", totals),
        check("passage_key_repeated", p.groupBy("passage_id").count().where("count > 1")),
        check("chunk_ids_not_dense", dense.where("n <> last + 1 OR d <> n")),
        check("document_name_repeated", index.documents.groupBy("document_name").count().where("count > 1")),
        check("df_differs", terms_of(q).join(index.terms.withColumnRenamed("df", "stated"), "term", "full").where("NOT df <=> stated")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def resolve_terms(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, term_id of the distinct wanted terms: known ids stay, new terms get ids after the largest, in term order."""
    new = wanted.select("term").where("term IS NOT NULL").distinct().join(existing, "term", "left_anti")
    top = existing.agg(F.coalesce(F.max("term_id"), F.lit(0)).alias("top")).scalar()
    ranked = number_rows(new, "term")
    known = existing.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.min("term_id").alias("term_id"))
    return known.unionByName(ranked.select("term", (F.col("row_no") + top).alias("term_id")))


def number_rows(df: DataFrame, order: str) -> DataFrame:
    """row_no from 1 in order of a column: ranks inside range partitions, shifted by the sizes of those before."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
    # cut, as the ranges must be the same ones for both uses below
    inside = cut_lineage(ranged.withColumn("inside", F.row_number().over(Window.partitionBy("part").orderBy(order))))
    sizes = inside.groupBy("part").agg(F.max("inside").alias("n"))
    # one row per partition
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("part", "before")), "part").select(*df.columns, (F.col("inside") + F.col("before")).alias("row_no"))
