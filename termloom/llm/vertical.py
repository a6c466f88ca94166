"""Vertical index: for every term, compressed bitmaps of the passages that hold it.

A bitmap is stored as its non-zero 64-bit words. One row (term_id, layer, word, bits) says which of the 64 passages of word
hold the term; the layer is the occurrence counter: all bits of a row have term_frequency = layer. Rows merge by OR, so
repeated postings count once, on the map side already. The ids of one term are put side by side, not into one layer: an
occurrence total is the sum of layer x cardinality over all of them, a passage's term_frequency the sum of the layers that
have its bit, a document frequency the cardinality of the union. Dropping passages is an AND with the bitmap of those that
exist. A term reaches a word at most once an id and layer, so a hot term is no hotter than N / 64 rows of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.scoring import BM25Params, bm25_idf, bm25_term_score, residual_idf
from termloom.session import stored

#: Each word is spread over so many reducers, by term, where bitmaps meet passages, and each hot term, by word, where they
#: meet terms.
SALTS = 8
#: A term with at least this share of the rows is hot; by counting, at most so many are.
HOT_SHARE = 200


def word_of(passage_id: Column) -> Column:
    return F.shiftright(passage_id, 6)


def bit_of(passage_id: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.call_function("pmod", passage_id, F.lit(64)).cast("int"))


def passage_bitmap(ids: DataFrame, passage_id: str = "passage_id") -> DataFrame:
    """word, bits of the distinct passage ids."""
    p = F.col(passage_id)
    return ids.where(p.isNotNull()).groupBy(word_of(p).alias("word")).agg(F.bit_or(bit_of(p)).alias("bits"))


def vocabulary(terms: DataFrame) -> DataFrame:
    """term_id, term, term_key: ids of the same term share one key. Null ids and terms are left out; an id listed under
    several terms stands for each."""
    known = terms.select("term_id", "term").where("term_id IS NOT NULL AND term IS NOT NULL").distinct()
    return known.join(term_keys(terms), "term")


def term_keys(terms: DataFrame) -> DataFrame:
    """term, term_key of every distinct term with an id, no key twice: the smallest of the term's ids, or, where a smaller
    term has the same one, a number above all ids. Only these namesakes are numbered in one task."""
    known = terms.where("term_id IS NOT NULL AND term IS NOT NULL")
    least = known.groupBy("term").agg(F.min("term_id").cast("bigint").alias("term_key"))
    ranked = least.withColumn("nth", F.row_number().over(Window.partitionBy("term_key").orderBy("term")))
    above = known.agg(F.max("term_id").cast("bigint").alias("n")).scalar()
    namesakes = ranked.where("nth > 1").withColumn("term_key", above + F.row_number().over(Window.orderBy("term")))
    return ranked.where("nth = 1").unionByName(namesakes).select("term", "term_key")


def hot(counted: DataFrame, key: str) -> list[int]:
    """The values of key that hold at least 1 / HOT_SHARE of all rows, n of each being counted: HOT_SHARE at most."""
    total = counted.agg(F.sum("n").alias("n")).scalar()
    return [r[key] for r in counted.where(F.col("n") * HOT_SHARE >= total).select(key).collect()]


def spread(big: DataFrame, small: DataFrame, key: str, keys: list[int]) -> DataFrame:
    """big joined to small by key; the rows of the given hot keys meet in SALTS tasks each, by their word."""
    if not keys:
        return big.join(small, key)
    is_hot = F.col(key).isin(keys)
    slices = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    sliced = big.withColumn("slice", F.when(is_hot, F.pmod("word", F.lit(SALTS))).otherwise(0).cast("int"))
    return sliced.join(small.withColumn("slice", F.explode(slices)), [key, "slice"]).drop("slice")


def term_bitmaps(postings: DataFrame, passages: DataFrame, terms: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """word, salt, term_key, layer, bits over the postings that have a passage and a term, repeated rows counted once; the
    ids of a term give rows of their own.

    Two rows are the same posting if id, passage and term_frequency agree. A null term_frequency counts the passage but
    no occurrence. Columns of beside (word, ...), one row a word, are put next to each of its bitmaps. A
    hot term's words are spread over SALTS reducers where they meet its names.
    """
    p = F.col("passage_id")
    layer = F.coalesce("term_frequency", F.lit(0)).cast("int").alias("layer")
    packed = (
        postings.where("term_id IS NOT NULL AND passage_id IS NOT NULL")
        .groupBy("term_id", layer, word_of(p).alias("word"))
        .agg(F.bit_or(bit_of(p)).alias("bits"))
    )
    rows = postings.where("term_id IS NOT NULL").groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    keyed = spread(packed, vocabulary(terms).select("term_id", "term_key"), "term_id", hot(rows, "term_id"))
    salted = keyed.withColumn("salt", F.pmod("term_key", F.lit(SALTS)).cast("int"))
    words = passage_bitmap(passages).withColumnRenamed("bits", "there")
    if beside is not None:
        words = words.join(beside, "word", "left")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    kept = salted.join(words.select("*", salts).hint("shuffle_hash"), ["word", "salt"])
    return kept.withColumn("bits", F.col("bits").bitwiseAND(F.col("there"))).where("bits <> 0").drop("there", "term_id")


def ones() -> Column:
    return F.bit_count(F.col("bits")).cast("bigint")


def term_frequencies(
    postings: DataFrame, passages: DataFrame, terms: DataFrame, rare_at_most: int = 2, common_share: int = 100
) -> DataFrame:
    """term, total_frequency, passage_count, mark for every distinct non-null term of terms.

    mark is 'rare' where at most rare_at_most passages hold the term (none included), 'common' where more than one in
    common_share of all rows of passages do, else null; rare comes first. Postings without a known passage or term do
    not count, repeated ones count once; the ids of one term are taken together: their frequencies add up, a passage that
    several of them meet counts once. Empty postings make every term rare; empty terms give no rows.
    """
    words = term_bitmaps(postings, passages, terms).groupBy("word", "salt", "term_key").agg(
        F.sum(F.col("layer") * ones()).alias("tf"), F.bit_or("bits").alias("bits")
    )
    counts = words.groupBy("term_key").agg(F.sum("tf").alias("total_frequency"), F.sum(ones()).alias("passage_count"))
    total = passages.agg(F.count(F.lit(1)).alias("n")).scalar()
    names = term_keys(terms)
    held = F.coalesce("passage_count", F.lit(0))
    mark = F.when(held <= rare_at_most, "rare").when(held * common_share > total, "common")
    return names.join(counts, "term_key", "left").select(
        "term", F.coalesce("total_frequency", F.lit(0)).alias("total_frequency"), held.alias("passage_count"), mark.alias("mark")
    )


def term_scores(
    postings: DataFrame, passages: DataFrame, terms: DataFrame, min_length: int = 20, params: BM25Params = BM25Params()
) -> DataFrame:
    """passage_id, term, term_frequency, token_count, passage_count, bm25, distinctiveness: one row a passage and term.

    distinctiveness is the term's residual inverse document frequency (observed -log2 of its passage share minus what a
    Poisson term of the same collection frequency would show) times term_frequency. bm25 is the BM25 score of the
    term in the passage, over the passages that have postings. Postings are cleaned as in term_frequencies, the
    frequencies of a term's ids in a passage add up; a passage's token_count is the largest of its rows. Rows of passages
    shorter than min_length, or of unknown length, are left out of the result, not of the statistics. Empty inputs give no rows.

    Lengths and bitmaps are made once and stored in the shared folder; statistics and scores read them there.
    """
    p = F.col("passage_id")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    # passages of one word and length, so that a length reaches the postings without a row per posting
    longest = postings.where(p.isNotNull()).groupBy("passage_id").agg(F.max("token_count").alias("token_count"))
    lengths = stored(longest.groupBy(word_of(p).alias("word"), "token_count").agg(F.bit_or(bit_of(p)).alias("mask")))
    long = lengths.where(F.col("token_count") >= min_length)
    bitmaps = term_bitmaps(postings, passages, terms, long.groupBy("word").agg(F.bit_or("mask").alias("long")))
    words = stored(bitmaps.withColumn("long", F.coalesce(F.col("bits").bitwiseAND(F.col("long")), F.lit(0))))

    held = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    there = F.bit_count(F.col("bits").bitwiseAND(F.col("mask"))).cast("bigint")
    sizes = lengths.join(held, "word").agg(F.sum(there).alias("n"), F.sum(F.when(F.col("token_count").isNotNull(), there)).alias("measured"), F.sum(there * F.col("token_count")).alias("tokens")).first()
    n, avgdl = F.lit(sizes["n"] or 0), F.lit(sizes["tokens"] / sizes["measured"] if sizes["measured"] else None).cast("double")

    known = words.groupBy("word", "term_key").agg(F.sum(F.col("layer") * ones()).alias("tf"), F.bit_or("bits").alias("bits"), F.bit_or("long").alias("long"))
    counts = stored(known.groupBy("term_key").agg(F.sum("tf").alias("total_frequency"), F.sum(ones()).alias("passage_count"), F.sum(F.bit_count("long")).alias("n")))
    weights = counts.where("n > 0").join(term_keys(terms), "term_key").select(
        "term_key", "term", "passage_count", bm25_idf(n, F.col("passage_count")).alias("idf"), residual_idf(n, F.col("passage_count"), F.col("total_frequency")).alias("residual")
    )
    narrowed = words.where("long <> 0").join(long.select("*", salts).hint("shuffle_hash"), ["word", "salt"]).withColumn("bits", F.col("long").bitwiseAND(F.col("mask")))
    members = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("bits"), i) == 1)
    placed = narrowed.where("bits <> 0").select("word", "salt", "term_key", "token_count", "layer", F.explode(members).alias("i"))
    # word and salt stay keys, as the rows are spread by them already
    rows = placed.groupBy("word", "salt", "term_key", "token_count", "i").agg(F.sum("layer").cast("int").alias("term_frequency"))
    weighed = spread(rows, weights, "term_key", hot(counts, "term_key"))
    score = bm25_term_score(F.col("idf"), F.col("term_frequency"), F.col("token_count"), avgdl, params)
    return weighed.select(
        (F.shiftleft("word", 6) + F.col("i")).alias("passage_id"), "term", "term_frequency", "token_count", "passage_count", score.alias("bm25"),
        (F.col("residual") * F.col("term_frequency")).alias("distinctiveness"),
    )


def top_terms(scores: DataFrame, by: str = "bm25", decimals: int = 6) -> DataFrame:
    """passage_id, term, score: each passage's term with the highest rounded score, the smaller in byte order on a tie.

    Rows without a score are left out. Best-so-far folds on the map side, so a passage of any length is safe.
    """
    rounded = F.round(by, decimals)
    best = F.min(F.struct((-rounded).alias("minus"), F.col("term").alias("term")))
    top = scores.where(F.col(by).isNotNull()).groupBy("passage_id").agg(best.alias("best"))
    return top.select("passage_id", F.col("best.term").alias("term"), (-F.col("best.minus")).alias("score"))
