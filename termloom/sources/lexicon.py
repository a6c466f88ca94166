"""Stop lists and WordNet-format lexicon files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of speech in the order that ranks them, with their file suffixes.
POS = ("noun", "verb", "adj", "adv")
MAX_STOPWORD = 63


def read_stopwords(spark: SparkSession, path: str) -> tuple[str, ...]:
    """One word a line; blank lines and # comments are skipped, longer lines cut to 63 characters."""
    line = F.regexp_replace("value", "[\\r\\n]+$", "")
    kept = spark.read.text(path).where(~line.startswith("#") & (line != "")).select(F.substring(line, 1, MAX_STOPWORD).alias("w"))
    return tuple(sorted({r["w"] for r in kept.collect()}))


def _checked(ok: Column, value: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"bad {what} line: "), F.substring("value", 1, 80))))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith(" "))


def parse_synsets(lines: DataFrame, pos: str) -> DataFrame:
    """pos, offset, words, hypernyms, hyponyms of data lines (column value).

    The word count is hexadecimal, the pointer count decimal. Only pointers marked exactly @ (hypernym) and ~ (hyponym)
    are kept. A line that is too short for its counts fails when it is read.
    """
    t = F.split(F.trim(F.split("value", "\\|")[0]), " +")
    n_words = F.conv(F.get(t, F.lit(3)), 16, 10).cast("int")
    at_pointers = n_words * 2 + 4
    n_pointers = F.get(t, at_pointers).cast("int")
    words = F.transform(F.sequence(F.lit(0), n_words - 1), lambda i: F.get(t, i * 2 + 4))
    indexes = F.when(n_pointers > 0, F.sequence(F.lit(0), n_pointers - 1)).otherwise(F.array().cast("array<int>"))
    pointers = F.transform(
        indexes, lambda i: F.struct(F.get(t, at_pointers + 1 + i * 4).alias("symbol"), F.get(t, at_pointers + 2 + i * 4).cast("bigint").alias("to"))
    )
    ok = (n_words > 0) & n_pointers.isNotNull() & (F.size(t) >= at_pointers + 1 + n_pointers * 4)
    parsed = lines.select("value", F.get(t, F.lit(0)).cast("bigint").alias("offset"), _checked(ok, words, "data").alias("words"), F.when(ok, pointers).alias("pointers"))

    def to(symbol: str) -> Column:
        return F.transform(F.filter("pointers", lambda p: p["symbol"] == symbol), lambda p: p["to"])

    return parsed.select(F.lit(pos).alias("pos"), "offset", "words", to("@").alias("hypernyms"), to("~").alias("hyponyms"))


def parse_lemmas(lines: DataFrame, pos: str) -> DataFrame:
    """pos, lemma, sense_rank, offset of index lines (column value); offsets are the last synset_cnt fields."""
    t = F.split(F.trim("value"), " +")
    count = F.get(t, F.lit(2)).cast("int")
    pointers = F.get(t, F.lit(3)).cast("int")
    ok = (count > 0) & (pointers >= 0) & (F.size(t) >= count + pointers + 6)
    offsets = F.transform(F.slice(t, pointers + 7, count), lambda x: x.cast("bigint"))
    rows = lines.select(F.get(t, F.lit(0)).alias("lemma"), F.posexplode(_checked(ok, offsets, "index")).alias("sense_rank", "offset"))
    return rows.select(F.lit(pos).alias("pos"), "lemma", "sense_rank", "offset")


def parse_exceptions(lines: DataFrame, file_rank: int) -> DataFrame:
    """file_rank, line_no, inflected, base of exception lines: the first base form counts."""
    t = F.split(F.trim("value"), " +")
    ok = F.size(t) >= 2
    return lines.select(
        F.lit(file_rank).alias("file_rank"), F.monotonically_increasing_id().alias("line_no"),
        F.get(t, F.lit(0)).alias("inflected"), _checked(ok, F.get(t, F.lit(1)), "exception").alias("base"),
    )


def read_lexicon(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(synsets, lemmas) of a WordNet-format folder; all eight index and data files must be there."""
    synsets = [parse_synsets(_lines(spark, f"{folder}/data.{p}"), p) for p in POS]
    lemmas = [parse_lemmas(_lines(spark, f"{folder}/index.{p}"), p) for p in POS]
    return _union(synsets), _union(lemmas)


def read_exceptions(spark: SparkSession, folder: str) -> DataFrame:
    files = [spark.read.text(f"{folder}/{p}.exc").where("value <> ''").coalesce(1) for p in POS]
    return _union([parse_exceptions(f, i) for i, f in enumerate(files)])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
