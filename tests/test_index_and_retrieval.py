import math

import pytest
from pyspark.sql import functions as F

from termloom.functions.scoring import bm25_idf, bm25_term_score
from termloom.operators import context, evaluation, indexing, lexicon, retrieval, scan
from termloom.plans import registry


def scalar(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_scoring_goldens(spark):
    idf = lambda n, df: scalar(spark, bm25_idf(F.lit(n), F.lit(df)))
    assert idf(10, 0) == pytest.approx(3.091042453358316)
    assert idf(10, 10) == pytest.approx(0.04652001563489291)
    score = lambda i, tf, n, a: scalar(spark, bm25_term_score(F.lit(i), F.lit(tf), F.lit(n), F.lit(a)))
    assert score(2.0, 3, 5, 5.0) == pytest.approx(3.142857142857143)
    assert score(2.0, 3, 10, 5.0) == pytest.approx(2.5882352941176476)
    assert [score(1.0, t, 5, 5.0) for t in (1, 2, 4)] == pytest.approx([1.0, 1.375, 1.6923076923076923])
    assert score(1.0, 1, 1, 0.0) == 0.0


@pytest.fixture(scope="module")
def seeded(spark):
    rows = [("hypertension", 1, 1, 3), ("treatment", 1, 1, 3), ("other", 1, 1, 3), ("hypertension", 2, 1, 6), ("rest", 3, 2, 4), ("hypertension", 4, 1, 6)]
    postings = spark.createDataFrame(rows, "term string, passage_id long, term_frequency int, token_count int")
    passages = spark.createDataFrame([(1, 3), (2, 6), (3, 4), (4, 6)], "passage_id long, token_count int")
    return postings, indexing.terms_of(postings), indexing.stats_of(passages)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")


def test_search_ranks_sums_and_ties(spark, seeded):
    found = retrieval.search(asked(spark, "hypertension treatment"), *seeded, 10).orderBy("rank").collect()
    assert [(r["passage_id"], r["score"]) for r in found] == [(1, 1.837608), (2, 0.322009), (4, 0.322009)]
    assert len(retrieval.search(asked(spark, "hypertension"), *seeded, 2).collect()) == 2


def test_repeated_and_unknown_terms(spark, seeded):
    scores = {r["query_id"]: r["score"] for r in retrieval.search(asked(spark, "rest", "rest rest unseen", "unseen", "the"), *seeded, 5).collect()}
    assert set(scores) == {0, 1}
    assert scores[1] == pytest.approx(2 * scores[0], abs=2e-6)


def test_empty_index(spark, seeded):
    none = [df.limit(0) for df in seeded[:2]]
    stats = indexing.stats_of(spark.createDataFrame([], "passage_id long, token_count int"))
    assert stats.first().asDict() == {"n_passages": 0, "avgdl": 0.0}
    assert retrieval.search(asked(spark, "rest"), *none, stats, 5).count() == 0


def test_build_and_integrity(spark):
    docs = spark.createDataFrame([("b", "x y x", 2), ("a", "the cat", 1), ("a", "later", 3), (None, "n", 4), ("z", None, 5), ("e", "", 6)], "document_name string, text string, n int")
    first = indexing.first_documents(docs, "n")
    assert {r["document_name"]: r["text"] for r in first.collect()} == {"a": "the cat", "b": "x y x", "e": ""}
    ix = indexing.build_index(first, 2, 1)
    assert {(r["document_name"], r["chunk_id"], r["token_count"]) for r in ix.passages.collect()} == {("a", 0, 1), ("b", 0, 2), ("b", 1, 2)}
    assert {(r["term"], r["df"]) for r in ix.terms.collect()} == {("cat", 1), ("x", 2), ("y", 2)}
    assert indexing.integrity(ix).where("violations <> 0").count() == 0
    broken = indexing.Index(ix.documents, ix.passages, ix.postings.unionByName(ix.postings), ix.terms, ix.stats)
    assert indexing.integrity(broken).where("violations <> 0").count() > 0


def test_replace_documents(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "document_name string, text string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "document_name string, text string")
    assert {(r[0], r[1]) for r in indexing.replace_documents(old, new).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


def test_resolve_terms(spark):
    terms = spark.createDataFrame([("b", 7), ("x", 9)], "term string, term_id long")
    wanted = spark.createDataFrame([("c",), ("b",), ("a",), ("c",), (None,)], "term string")
    assert {(r["term"], r["term_id"]) for r in indexing.resolve_terms(terms, wanted).collect()} == {("b", 7), ("a", 10), ("c", 11)}


def test_lookups(spark):
    terms = spark.createDataFrame([("1,000", 5)], "term string, term_id long")
    found = retrieval.lookup_terms(terms, spark.createDataFrame([("1,000",), ("no",)], "term string"))
    assert {(r["term"], r["term_id"]) for r in found.collect()} == {("1,000", 5), ("no", -1)}
    zipped = retrieval.zip_postings(spark.createDataFrame([([1, 2], ["a", "b"])], "n array<int>, t array<string>"))
    assert [(r["n"], r["t"]) for r in zipped.collect()] == [(1, "a"), (2, "b")]


def test_evaluation(spark):
    queries = asked(spark, "a", "b", "c", "d")
    qrels = spark.createDataFrame([(0, "x", 1), (0, "x", 1), (0, "y", 1), (1, "x", 0), (2, "never", 1)], "query_id long, corpus_id string, score int")
    ranked = spark.createDataFrame([(0, 1, "q"), (0, 2, "x"), (0, 3, "x"), (0, 50, "y"), (1, 1, "x")], "query_id long, rank int, document_name string")
    rows = {r["query_id"]: (r[1], r[2], r[3]) for r in evaluation.per_query(queries, qrels, ranked).collect()}
    assert rows == {0: (0.5, pytest.approx(1 / 3), pytest.approx(2 / 3)), 2: (0.0, 0.0, 0.0)}
    assert evaluation.summary(queries, qrels, ranked).first().asDict() == {"evaluated": 2, "skipped": 2, "mrr_10": 0.25, "recall_10": 0.166667, "recall_100": 0.333333}
    none = evaluation.summary(queries, qrels.limit(0), ranked).first()
    assert (none["evaluated"], none["skipped"], none["mrr_10"]) == (0, 4, 0.0)


def test_history_and_document_windows(spark):
    import random

    random.seed(5)
    for _ in range(5):
        sizes = [random.choice([0, 1, 5, 9, 30, None, -2]) for _ in range(12)]
        turns = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "session_id int, turn int, tokens int")
        kept, used = set(), 0
        for i in range(11, -1, -1):
            used += max(0, sizes[i] or 0)
            if used > 40:
                break
            kept.add(i)
        assert {r["turn"] for r in context.history_window(turns, 40).collect()} == kept
        docs = spark.createDataFrame([(1, f"d{i:02}", "t", s) for i, s in enumerate(sizes)], "corpus_id int, document_name string, text string, tokens int")
        expect, run = [], 0
        for i, s in enumerate(sizes):
            n = max(0, s or 0)
            if run + n > 40 and expect:
                break
            expect.append(f"d{i:02}")
            run += n
            if run >= 40:
                break
        assert [r["document_name"] for r in context.document_window(docs, 40).orderBy("position").collect()] == expect


def test_cut_bytes(spark):
    for text in ("abcdef", "aé€😀b", "😀😀", "€", ""):
        for n in range(12):
            got = spark.createDataFrame([(text,)], "t string").select(context.cut_bytes(F.col("t"), n).alias("x")).first()["x"]
            assert got == text.encode()[:n].decode("utf-8", "ignore"), (text, n)


def test_prompts_and_replies(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 99, 1)], "query_id long, passage_id long, rank int")
    passages = spark.createDataFrame([(10, "a", 0, "one"), (12, "b", 3, "two")], "passage_id long, document_name string, chunk_id int, text string")
    got = context.passage_prompts(results, passages, asked(spark, "zero", "why?")).collect()
    assert len(got) == 1 and (got[0]["included"], got[0]["skipped"]) == (2, 1)
    assert got[0]["prompt"].endswith("[Source: a, chunk 0]\none\n\n[Source: b, chunk 3]\ntwo\n\nQuestion: why?\n\nAnswer:")
    replies = ['["dog",3,null,"cat"]', "no json", '{"a":"b"}', "[]", "[1]", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    terms = [r["t"] for r in rows.select("i", context.selected_terms(F.col("r"), F.array(F.lit("plain"))).alias("t")).orderBy("i").collect()]
    assert terms == [["dog", "cat"]] + [["plain"]] * 5
    tools = spark.createDataFrame([("READ",), ("read.",), ("SEARCH",), ("",), (None,), ("SEARCH, not READ",)], "r string")
    assert [r["t"] for r in tools.select(context.tool_choice(F.col("r")).alias("t")).collect()] == ["READ", "READ", "SEARCH", "SEARCH", "SEARCH", "READ"]
    listed = [f"s{i}" for i in range(10)]
    candidates = spark.createDataFrame([(0, 0, "t", listed, [], ["n"]), (0, 1, "u", None, None, None)], "query_id long, pos int, term string, synonyms array<string>, hypernyms array<string>, hyponyms array<string>")
    prompt = context.candidate_prompts(candidates, asked(spark, "q")).first()["prompt"]
    assert "s7\n" in prompt and "s8" not in prompt and "broader" not in prompt and "no related words" in prompt


def test_lexicon(spark):
    synsets, lemmas, exceptions = registry.small_lexicon(spark)
    ship = synsets.where("offset = 2").first()
    assert len(ship["words"]) == 10 and ship["hyponyms"] == [1]
    assert synsets.where("offset = 3").first()["hypernyms"] == [1]
    words = [("ferries",), ("sold",), ("better",), ("carried",), ("carrying",), ("older",), ("boats",), ("unknown",), ("s",), (None,), ("mice",)]
    got = {r["term"]: r["lemma"] for r in lexicon.lemma_map(spark.createDataFrame(words, "term string"), lemmas, exceptions).collect()}
    assert got == {"ferries": "ferry", "sold": "sell", "better": "good", "carried": "carried", "carrying": "carry", "older": "old", "boats": "boat", "unknown": "unknown", "s": "s", "mice": "mouse"}
    related = {r["word"]: r for r in lexicon.related_words(lemmas.select(F.col("lemma").alias("word")), synsets, lemmas).collect()}
    assert related["ferry"]["synonyms"] == ["ferryboat", "transport"]
    assert related["ferry"]["hypernyms"][-1] == "carry" and related["ferry"]["hyponyms"] == ["chain_ferry"]
    assert related["box"]["synonyms"] == ["Box"]


def test_lexicon_rejects_short_lines(spark):
    from termloom.sources.lexicon import parse_lemmas, parse_synsets

    for parse, line in ((parse_synsets, "00000001 03 n 02 one 0 000"), (parse_lemmas, "x n 2 0 1 0 00000001")):
        with pytest.raises(Exception, match="bad"):
            parse(spark.createDataFrame([(line,)], "value string"), "noun").collect()
    assert math.isfinite(1.0)


def test_logged_questions_are_searched(spark, tmp_path):
    words = ["ferry", "quay", "lamp"]
    spark.createDataFrame([(i, f"d{i}", f"{w} keeper") for i, w in enumerate(words)], "doc_id long, document_name string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(q, words[q % 3]) for q in range(1, 301)] + [(350, None)]
    spark.createDataFrame(asked, "query_id long, question_text string").write.parquet(f"{tmp_path}/queries.parquet")
    names = [f"logged_{n}" for n in ("bm25_search_topk", "bm25_batch_top100", "bm25_duplicate_terms", "bm25_explain", "generation_prompt", "sources_json")]
    for n in names:
        rows = registry.QUERIES[n](spark, str(tmp_path)).collect()
        assert sorted(r["query_id"] for r in rows) == list(range(50, 301, 50)), n
        assert n in registry.ORACLES and "eval_items" not in registry.ORACLES[n]
    found = {r["query_id"]: r["document_name"] for r in registry.QUERIES[names[0]](spark, str(tmp_path)).collect()}
    assert found == {q: f"d{q % 3}" for q in range(50, 301, 50)}


def own_words_folder(spark, path, texts):
    """A folder whose documents are all evaluation queries, each asking its own words from the third on."""
    rows = [(50 * (i + 1), f"d{i:04}", text, "en") for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, document_name string, text string, lang string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_scan_ranks_as_joins_do(spark, tmp_path, monkeypatch):
    words = ["ferry", "quay", "lamp", "keeper", "the", "rope"]
    texts = [" ".join(words[(i * j + j) % 6] for j in range(1, 4 + i % 7)) for i in range(40)] + ["", "the of", "a b " + "word " * 450]
    d = own_words_folder(spark, tmp_path, texts)
    queries, _ = registry.own_word_queries(spark, d)
    for k, block, waiting, cells in ((5, 25, 10, 100), (100, 10_000, 1, 1)):
        monkeypatch.setattr(scan, "BLOCK", block)
        monkeypatch.setattr(scan, "WAITING", waiting)
        monkeypatch.setattr(scan, "CELLS", cells)
        rows = lambda ranked: sorted(tuple(r) for r in ranked(spark, d, queries, k).select(*registry.SHOWN).collect())
        assert rows(registry.ranked_by_scan) == rows(registry.ranked) != [], k


def test_scan_of_nothing(spark, tmp_path):
    d = own_words_folder(spark, tmp_path, ["", "the of and"])
    assert registry.ranked_by_scan(spark, d, registry.own_word_queries(spark, d)[0], 100).collect() == []
    assert {tuple(r) for r in registry.eval_per_query(spark, d).collect()} == {(50, 0.0, 0.0, 0.0), (100, 0.0, 0.0, 0.0)}


def shuffled_rows(plan):
    """The most rows that any exchange of an executed plan has written."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return shuffled_rows(plan.executedPlan())
    below = [plan.plan()] if plan.nodeName().endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    metric = plan.metrics().get("shuffleRecordsWritten")
    return max([metric.get().value() if metric.isDefined() else 0, *map(shuffled_rows, below)])


def test_evaluation_shuffles_no_row_for_each_query_and_passage(spark, tmp_path):
    n = 1200
    d = own_words_folder(spark, tmp_path, [f"on this ferry {'quay ' * (i % 5)} n{i}" for i in range(n)])
    found = registry.eval_per_query(spark, d)
    assert {tuple(r)[1:] for r in found.collect()} == {(1.0, 1.0, 1.0)}
    assert n <= shuffled_rows(found._jdf.queryExecution().executedPlan()) < n * n / 2
