"""Delimited and whole-file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import leading_int

UNUSED = "\u0001"


def read_bulk(spark: SparkSession, path: str) -> DataFrame:
    """document_name, text of a headerless, tab-separated file with RFC 4180 quotes.

    One row with other than two fields fails the load when it runs; so does an unquoted empty field, which stands for
    null, while a quoted empty text is a document without words.
    """
    rows = (
        spark.read.schema("document_name string, text string")
        .option("sep", "\t").option("quote", '"').option("escape", '"').option("multiLine", True)
        .option("mode", "FAILFAST").option("emptyValue", "").option("nullValue", UNUSED).option("header", False)
        .csv(path)
    )
    whole = F.col("document_name").isNotNull() & F.col("text").isNotNull()
    checked = F.when(whole, F.col("text")).otherwise(F.raise_error(F.lit("bulk row with a missing field")))
    return rows.select("document_name", checked.alias("text"))


def write_bulk(df: DataFrame, path: str) -> None:
    """Always quoted, quotes doubled, tab-separated, no header: what read_bulk reads."""
    (
        df.select("document_name", "text").write.mode("overwrite").option("sep", "\t").option("quoteAll", True)
        .option("quote", '"').option("escape", '"').option("emptyValue", "").option("header", False).csv(path)
    )


def row_range(df: DataFrame, first: int, end: int) -> DataFrame:
    """Rows with first <= row_num < end, in order of row_num."""
    return df.where((F.col("row_num") >= first) & (F.col("row_num") < end)).orderBy("row_num")


def row_ranges(df: DataFrame, width: int) -> DataFrame:
    """df's rows with range_id, first_row, end_row: the table from its smallest to its largest row_num cut into ranges of
    width numbers, the last one shorter. Ranges neither overlap nor leave a gap; one without rows gives none. Rows
    without row_num are in no range and are left out."""
    low, high = (df.agg(f("row_num").cast("bigint").alias("n")).scalar() for f in (F.min, F.max))
    numbered = df.where("row_num IS NOT NULL").withColumn("range_id", F.call_function("div", F.col("row_num") - low, F.lit(width)))
    first = low + F.col("range_id") * width
    return numbered.withColumns({"first_row": first, "end_row": F.least(first + width, high + 1)})


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """document_name (the base file name), text (up to a NUL character) of each file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("document_name"), F.col("value"))
    return rows.select("document_name", F.substring_index("value", "\u0000", 1).alias("text"))


def read_eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query_text: each line split at its first tab; lines without one are skipped."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == 2)
    return rows.select(F.get("p", F.lit(0)).alias("query_id"), F.get("p", F.lit(1)).alias("query_text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, corpus_id, score: a header line, then three tab-separated fields; other lines are skipped.

    A score is its leading integer, 0 without one. The first line of the file is the header, whatever it says.
    """
    rows = spark.read.option("header", True).option("sep", UNUSED).option("quote", "").schema("value string").csv(path)
    parts = F.split("value", "\t", 3)
    kept = rows.select(parts.alias("p")).where(F.size("p") == 3)
    return kept.select(F.get("p", F.lit(0)).alias("query_id"), F.get("p", F.lit(1)).alias("corpus_id"), leading_int(F.get("p", F.lit(2))).alias("score"))
