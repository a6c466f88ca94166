import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from termloom.operators import badrows, skew


def exact(rows, q):
    by = defaultdict(list)
    for k, v in rows:
        if k is not None:
            by[k].append(v)
    out = {}
    for k, vs in by.items():
        known = sorted(v for v in vs if v is not None)
        out[k] = (len(vs), sum(known) if known else None, *[known[max(1, math.ceil(p * len(known))) - 1] if known else None for p in q])
    return out


@pytest.mark.parametrize("top", [3, 64, 5000, 2**40])
def test_profile_against_sorting(spark, top):
    random.seed(top)
    keys = [1] * 40 + [2] * 10 + list(range(3, 12)) + [None]
    rows = [(random.choice(keys), random.choice([None, -7, random.randint(-top, top), random.randint(0, top)])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "k long, v long").withColumn("row_count", F.lit("clash"))
    qs = (0.0, 0.25, 0.5, 1.0)
    got = {r["key_value"]: (r["row_count"], r["value_sum"], r["p0"], r["p25"], r["p50"], r["p100"]) for r in skew.key_profile(df, "k", "v", qs).collect()}
    assert got == exact(rows, qs)


def test_profile_edges(spark):
    df = spark.createDataFrame([(1, None), (None, 3)], "k long, v int")
    assert [tuple(r) for r in skew.key_profile(df, "k", "v").collect()] == [(1, 1, None, None, None, None)]
    assert skew.key_profile(df.limit(0), "k", "v").count() == 0
    with pytest.raises(ValueError):
        skew.key_profile(df, "k", "v", (1.5,))


def test_profile_of_the_whole_range(spark):
    top = (1 << 63) - 1
    rows = [(1, v) for v in (-top - 1, top, top, 0, -1)] + [(2, top)] * 3 + [(3, 5), (3, -5), (3, None)]
    got = {r["key_value"]: tuple(r)[1:] for r in skew.key_profile(spark.createDataFrame(rows, "k long, v long"), "k", "v", (0.2, 0.5, 0.8)).collect()}
    assert got[1][0] == 5 and got[1][2:] == (-top - 1, top, -top - 1, 0, top)
    assert got[2] == (3, None, top, top, top, top, top)
    assert got[3] == (3, 0, -5, 5, -5, -5, 5)


def test_hot_keys(spark):
    rows = [(1, 5)] * 300 + [(i, 6) for i in range(2, 302)] + [(None, None)] * 2
    got = skew.hot_keys(spark.createDataFrame(rows, "a long, b long"), ("a", "b"), "b", 200).collect()
    assert {(r["key_column"], r["key_value"], r["row_count"]) for r in got} == {("a", 1, 300), ("b", 5, 300), ("b", 6, 300)}


CASES = {
    "a.csv#row1\ttext": None,
    '"a ""x"".csv#row2"\t"two\nlines\t""q"""': None,
    'a.csv#row3\t""': None,
    "a.csv#row2147483647\tx": None,
    'a.csv#row4\t"open': "quoting",
    'a.csv#row4\t"x" y': "quoting",
    'a.csv#row4\tin"side': "quoting",
    'a.csv#row4\t"back\\" slash"': "quoting",
    '"open\tx\ty': "quoting",
    'x\ty\t"z"q': "quoting",
    "a.csv#row5": "column_count",
    "": "column_count",
    None: "column_count",
    "a.csv#row5\tx\t": "column_count",
    'a"\tx\ty': "quoting",
    "a.csv#row5\t": "invalid_value",
    "\ttext": "invalid_value",
    "#row5\tx": "invalid_value",
    " #row5\tx": "invalid_value",
    "a.csv#row0\tx": "invalid_value",
    "a.csv#row01\tx": "invalid_value",
    "a.csv#row-1\tx": "invalid_value",
    "a.csv#row2147483648\tx": "invalid_value",
    "a.csv#row99999999999\tx": "invalid_value",
    "a.csv\tx": "invalid_value",
    "a.csv#row6\tx�y": "invalid_value",
    "a.csv#row6\tx\x03y": "invalid_value",
    "a\x07.csv#row6\tx": "invalid_value",
    "a.csv#row6\t" + "x" * 200_000: None,
    'a.csv#row6\t"' + '""' * 100_000 + '"': None,
}


def test_bad_rows(spark):
    lines = list(CASES)
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(lines)], "row_num long, raw_line string, reason string, column int")
    got = {r["row_num"]: r["reason"] for r in badrows.failures(df).collect()}
    assert {lines[i]: r for i, r in got.items()} == {k: v for k, v in CASES.items() if v}
    valid = {r["row_num"]: (r["document_name"], r["text"]) for r in badrows.valid_rows(df).collect()}
    assert set(valid) == set(range(len(lines))) - set(got)
    assert valid[1] == ('a "x".csv#row2', 'two\nlines\t"q"') and valid[2] == ("a.csv#row3", "")


def test_bad_rows_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "a#row1\tt"), (2, "a#row1\tt")], "row_num long, raw_line string")
    assert [tuple(r) for r in badrows.failures(df).collect()] == [(1, "column_count")]
    assert badrows.valid_rows(df).count() == 2
    assert badrows.failures(df.limit(0)).count() == 0 and badrows.valid_rows(df.limit(0)).count() == 0


def test_records_without_id(spark):
    df = spark.createDataFrame([(None, "x"), (None, "a#row1\tt"), (None, None), (3, "b#row1\t\x01")], "row_num long, raw_line string")
    assert [tuple(r) for r in badrows.valid_rows(df).collect()] == [(None, "a#row1", "t")]
    assert {tuple(r) for r in badrows.failures(df).collect()} == {(None, "column_count"), (3, "invalid_value")}


def test_all_errors_of_a_row(spark):
    df = spark.createDataFrame([(1, "\x01#row0\t"), (2, '"'), (3, "a\tb\tc"), (4, "a#row1\tx")], "row_num long, raw_line string")
    got = {r["row_num"]: (r["reason"], r["errors"]) for r in badrows.errors(df).collect()}
    assert got == {1: ("invalid_value", "1 characters|1 row_name|2 not_missing"), 2: ("quoting", "0 quotes"), 3: ("column_count", "0 two_cells")}
