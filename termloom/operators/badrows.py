"""Delimited records split into valid rows and failures with a reason.

A record is exploded into cells (row, column, value); a fixed rule table is joined by column; each rule is evaluated on
its cell, the errors of a row are aggregated, the first of them gives the reason, and valid rows are those that no failure names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTED = '"(?:[^"]++|"")*+"'
PLAIN = '[^"\\t]*+'
#: A record whose quotes are right; its fields come apart at tabs outside quotes.
RECORD = f"\\A(?:{QUOTED}|{PLAIN})(?:\\t(?:{QUOTED}|{PLAIN}))*+\\z"
#: Cells of a well-quoted record with a tab put before it: no match is empty, so none is skipped.
CELL = f"\\t({QUOTED}|{PLAIN})"

#: rank, reason, column (0: the record itself), rule. Ranks order the reasons; the first that applies names the failure.
RULES: tuple[tuple[int, str, int, str], ...] = (
    (1, "quoting", 0, "quotes"),
    (2, "column_count", 0, "two_cells"),
    (3, "invalid_value", 1, "row_name"),
    (3, "invalid_value", 1, "characters"),
    (3, "invalid_value", 2, "not_missing"),
    (3, "invalid_value", 2, "characters"),
)
#: Stands for the shape of a record whose quotes are wrong.
BROKEN = "broken"
BAD_CHARACTER = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFD}]"
ROW_NAME = "\\A(?s:.*)#row([1-9][0-9]{0,9})\\z"


def _value(cell: Column) -> Column:
    """What a raw cell stands for: outer quotes go, doubled ones become one."""
    inner = F.regexp_replace(F.substring(cell, F.lit(2), F.length(cell) - 2), '""', '"')
    return F.when(cell.startswith('"'), inner).otherwise(cell)


def _fields(record: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit("\t"), record), F.lit(CELL), F.lit(1))


def _violated(rule: Column, cell: Column) -> Column:
    value = _value(cell)
    number = F.regexp_extract(value, ROW_NAME, 1)
    name = F.regexp_replace(value, "#row[0-9]++\\z", "")
    blank = ~name.rlike("[^\\p{IsWhite_Space}\\p{Cntrl}]")
    return (
        F.when(rule == "quotes", cell == BROKEN)
        .when(rule == "two_cells", (cell != BROKEN) & (cell != "2"))
        .when(rule == "row_name", (number == "") | (number.cast("bigint") > 2147483647) | blank)
        .when(rule == "not_missing", cell == "")
        .when(rule == "characters", value.rlike(BAD_CHARACTER))
    )


def _record_key(df: DataFrame, row_id: str, record: str) -> Column:
    """Tells apart the records that have no id; null for the others."""
    return F.when(F.col(row_id).isNull(), F.md5(F.coalesce(F.concat(F.lit("."), record), F.lit(""))))


def _cells(df: DataFrame, row_id: str, record: str) -> DataFrame:
    """row_id, record_key, column, cell: column 0 is the record's shape (the number of its fields, or BROKEN if its quotes
    are wrong), the fields of a record of two count from 1."""
    text = F.col(record)
    well = F.coalesce(text.rlike(RECORD), F.lit(True))
    parsed = df.select(F.col(row_id).alias("row_id"), _record_key(df, row_id, record).alias("record_key"), well.alias("well"), F.when(well, _fields(text)).alias("fields"))
    count = F.when(F.col("fields").isNull(), 0).otherwise(F.size("fields"))
    shape = F.struct(F.lit(0).alias("column"), F.when(F.col("well"), count.cast("string")).otherwise(BROKEN).alias("cell"))
    field_cells = F.transform("fields", lambda c, i: F.struct((i + 1).alias("column"), c.alias("cell")))
    cells = F.when(F.col("well") & (count == 2), F.concat(F.array(shape), field_cells)).otherwise(F.array(shape))
    return parsed.select("row_id", "record_key", F.inline(cells))


def _errors(df: DataFrame, row_id: str, record: str) -> DataFrame:
    """row_id, record_key, column, rule, rank, reason: each rule that a cell breaks."""
    rules = df.sparkSession.createDataFrame(list(RULES), "rank int, reason string, column int, rule string")
    # the rule table is the constant above, so its size is known
    return _cells(df, row_id, record).join(F.broadcast(rules), "column").where(_violated(F.col("rule"), F.col("cell")))


def errors(df: DataFrame, row_id: str = "row_num", record: str = "raw_line") -> DataFrame:
    """row_id, reason, errors: as failures, with all rules that the row breaks, as 'column rule' joined by |, in order."""
    each = F.array_sort(F.collect_set(F.struct("column", "rule")))
    found = _errors(df, row_id, record).groupBy("row_id").agg(F.min(F.struct("rank", "reason")).alias("first"), each.alias("each"))
    joined = F.array_join(F.transform("each", lambda e: F.concat_ws(" ", e["column"].cast("string"), e["rule"])), "|")
    return found.select(F.col("row_id").alias(row_id), F.col("first.reason").alias("reason"), joined.alias("errors"))


def failures(df: DataFrame, row_id: str = "row_num", record: str = "raw_line") -> DataFrame:
    """row_id, reason for every record that is no valid two-field row, with the first reason that applies.

    quoting: a quote opens a field and is not closed, is followed by anything but a tab or the end, or stands inside an
    unquoted field (a backslash escapes nothing); column_count: not two fields, or no record at all (null);
    invalid_value: the first field is not a non-blank file name, #row and a number from 1 to 2147483647, the second is
    empty and unquoted, or either holds U+FFFD or a control character other than tab, CR and LF. Repeated rows are
    judged alike and give one failure per row_id. An empty table gives none; other columns do not matter.
    """
    first = _errors(df, row_id, record).groupBy("row_id").agg(F.min(F.struct("rank", "reason")).alias("first"))
    return first.select(F.col("row_id").alias(row_id), F.col("first.reason").alias("reason"))


def valid_rows(df: DataFrame, row_id: str = "row_num", record: str = "raw_line") -> DataFrame:
    """row_id, document_name, text of the records without a failure: an anti-join against their errors.

    Records without an id are told apart by their text, so that a bad one does not pass and a good one is not lost.
    """
    records = df.select(row_id, record).withColumn("record_key", _record_key(df, row_id, record))
    bad = _errors(df, row_id, record).select(F.col("row_id").alias("bad_id"), F.col("record_key").alias("bad_key")).distinct()
    kept = records.join(bad, F.col(row_id).eqNullSafe(F.col("bad_id")) & F.col("record_key").eqNullSafe(F.col("bad_key")), "left_anti")
    fields = kept.withColumn("fields", _fields(F.col(record)))
    name, text = F.get("fields", F.lit(0)), F.get("fields", F.lit(1))
    return fields.select(row_id, _value(name).alias("document_name"), _value(text).alias("text"))
