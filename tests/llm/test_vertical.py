import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from termloom.llm import vertical


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(4)
    terms = [(i, f"t{i % 37:02}") for i in range(40)] + [(50, None), (None, "lost"), (60, "unused"), (7, "t07")]
    passages = [(p, f"d{p}") for p in list(range(1, 150)) + [-5, 1000, 1 << 40]] + [(None, "x"), (3, "again")]
    rows = []
    for p in [p for p, _ in passages if p] + [9999, None]:
        n = random.randint(1, 60)
        for t in random.sample(range(45), random.randint(1, 20)) + [0] * (p == 3):
            rows.append((t, p, random.choice([1, 1, 1, 2, 5]), n))
    rows += rows[:80] + [(None, 3, 1, 4), (1, 3, None, 9), (1, 3, 9, rows[0][3])]
    make = lambda r, s: spark.createDataFrame(r, s).withColumn("word", F.lit("clash")).withColumn("bits", F.lit(1))
    return (
        rows, passages, terms,
        make(rows, "term_id long, passage_id long, term_frequency int, token_count int"),
        make(passages, "passage_id long, document_name string"),
        make(terms, "term_id long, term string"),
    )


def clean(rows, passages, terms):
    known = {p for p, _ in passages if p is not None}
    names = defaultdict(set)
    for i, t in terms:
        if i is not None and t is not None:
            names[i].add(t)
    for i, p, f in {(r[0], r[1], r[2]) for r in rows if r[0] is not None and r[1] in known}:
        for t in names.get(i, ()):
            yield i, t, p, f or 0


def test_frequencies_by_brute_force(spark, tables):
    rows, passages, terms, *dfs = tables
    cf, df = defaultdict(int), defaultdict(set)
    for _, t, p, f in clean(rows, passages, terms):
        cf[t] += f
        df[t].add(p)
    got = {r["term"]: (r["total_frequency"], r["passage_count"], r["mark"]) for r in vertical.term_frequencies(*dfs, 2, 5).collect()}
    names = {t for i, t in terms if t is not None and i is not None}
    expect = {t: (cf[t], len(df[t]), "rare" if len(df[t]) <= 2 else "common" if len(df[t]) * 5 > len(passages) else None) for t in names}
    assert got == expect


def test_scores_by_brute_force(spark, tables):
    rows, passages, terms, *dfs = tables
    found = defaultdict(int)
    for _, t, p, f in clean(rows, passages, terms):
        found[t, p] += f
    held = {p for _, p in found}
    length = {p: max(r[3] for r in rows if r[1] == p) for p in held}
    n, avgdl = len(held), sum(length.values()) / len(held)
    cf, df = defaultdict(int), defaultdict(set)
    for (t, p), f in found.items():
        cf[t] += f
        df[t].add(p)
    expect = {}
    for (t, p), f in found.items():
        if length[p] >= 20:
            idf = math.log((n - len(df[t]) + 0.5) / (len(df[t]) + 0.5) + 1)
            ridf = -math.log2(len(df[t]) / n) + math.log2(1 - math.exp(-cf[t] / n))
            expect[p, t, f] = (round(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[p] / avgdl)), 6), round(ridf * f, 6))
    scores = vertical.term_scores(*dfs)
    got = {(r["passage_id"], r["term"], r["term_frequency"]): (round(r["bm25"], 6), round(r["distinctiveness"], 6)) for r in scores.collect()}
    assert got == expect
    best = {}
    for (p, t, _), (s, _) in expect.items():
        best[p] = min(best.get(p, (0, "~")), (-s, t))
    assert {r["passage_id"]: r["term"] for r in vertical.top_terms(scores).collect()} == {p: t for p, (_, t) in best.items()}


def test_one_id_under_two_terms(spark):
    postings = spark.createDataFrame([(1, p, 1, 30) for p in range(4)] + [(2, 9, 2, 30), (3, 9, 3, 30)], "term_id long, passage_id long, term_frequency int, token_count int")
    passages = spark.createDataFrame([(p, "d") for p in range(10)], "passage_id long, document_name string")
    terms = spark.createDataFrame([(1, "ferry"), (1, "quay"), (2, "quay"), (3, "ferry"), (3, "lamp")], "term_id long, term string")
    got = {r["term"]: (r["total_frequency"], r["passage_count"]) for r in vertical.term_frequencies(postings, passages, terms).collect()}
    assert got == {"ferry": (7, 5), "quay": (6, 5), "lamp": (3, 1)}
    rows = {(r["passage_id"], r["term"], r["term_frequency"]) for r in vertical.term_scores(postings, passages, terms).collect()}
    assert rows == {(p, t, 1) for p in range(4) for t in ("ferry", "quay")} | {(9, "ferry", 3), (9, "quay", 2), (9, "lamp", 3)}


def test_ids_of_one_term_on_one_passage(spark):
    """Equal and different frequencies add up, repeated rows count once, the passage counts once."""
    postings = spark.createDataFrame([(1, 5, 2, 30), (2, 5, 2, 30), (2, 5, 2, 30), (1, 6, 2, 30), (2, 6, 3, 30), (1, 7, None, 30)], "term_id long, passage_id long, term_frequency int, token_count int")
    passages = spark.createDataFrame([(p, "d") for p in range(10)], "passage_id long, document_name string")
    terms = spark.createDataFrame([(1, "quay"), (2, "quay")], "term_id long, term string")
    got = vertical.term_frequencies(postings, passages, terms).first()
    assert (got["total_frequency"], got["passage_count"]) == (9, 3)
    rows = sorted((r["passage_id"], r["term"], r["term_frequency"]) for r in vertical.term_scores(postings, passages, terms).collect())
    assert rows == [(5, "quay", 4), (6, "quay", 5), (7, "quay", 0)]


def test_empty_tables(spark, tables):
    *_, postings, passages, terms = tables
    assert {r["mark"] for r in vertical.term_frequencies(postings.limit(0), passages, terms).collect()} == {"rare"}
    assert vertical.term_frequencies(postings, passages, terms.limit(0)).count() == 0
    assert {r["mark"] for r in vertical.term_frequencies(postings, passages.limit(0), terms).collect()} == {"rare"}
    for a, b, c in ((0, 9, 9), (9, 0, 9), (9, 9, 0)):
        cut = [df.limit(0) if not k else df for df, k in ((postings, a), (passages, b), (terms, c))]
        assert vertical.top_terms(vertical.term_scores(*cut)).count() == 0
