"""Registered queries over the test tables and the SQL that checks them.

Documents are indexed under their name, the earliest doc_id first. Search queries are the held-out items (a stated
query set) and, in the queries named logged_..., the logged questions whose id is divisible by 50, which grow with the
log; evaluation queries are the documents whose id is divisible by 50, asked by a few of their own words.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import badrows, context, evaluation, indexing, lexicon, retrieval, scan, skew
from termloom.operators.indexing import CHUNK, OVERLAP
from termloom.plans import logs, samples
from termloom.session import small_side, stored, table
from termloom.sources import lexicon as lexicon_source

POSTING_KEYS = ("term_id", "passage_id")
SIZE_KEYS, SIZE_QUANTILES = ("source", "lang"), (0.1, 0.5, 0.95)
WINDOW_TOKENS, PROMPT_TOKENS, SESSION_SECONDS = 20, 12_000, 86_400
KEY = ("document_name", "chunk_id")
ROW_RANGE = 1000


def p3_profiles(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_profiles(table(spark, d, "postings"), POSTING_KEYS, "term_frequency")


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Text sizes by source and language: values of a wide range, so that the histograms are refined."""
    return skew.key_profiles(table(spark, d, "documents"), SIZE_KEYS, "n_chars", SIZE_QUANTILES)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.hot_keys(table(spark, d, "postings"), POSTING_KEYS, "term_frequency").select("key_column", "key_value")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.failures(table(spark, d, "bulk_rows"))


def p5_errors(spark: SparkSession, d: str) -> DataFrame:
    return badrows.errors(table(spark, d, "bulk_rows"))


def p5_valid(spark: SparkSession, d: str) -> DataFrame:
    return badrows.valid_rows(table(spark, d, "bulk_rows"))


# text


def tokenize_docs(spark, d):
    tokens = T.tokenize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


def tokenize_counts(spark, d):
    rows = table(spark, d, "documents").select(F.explode(T.tokenize(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"))


def split_words(spark, d):
    words = T.split_words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("n_words"), F.array_join(words, " ").alias("words"))


def stopword_filtered_terms(spark, d):
    terms = T.drop_stopwords(T.tokenize(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.size(terms).alias("n_terms"), F.array_join(terms, " ").alias("terms"))


def first_docs(spark, d):
    return indexing.first_documents(table(spark, d, "documents"), "doc_id")


def chunk_docs(spark, d):
    return indexing.chunk_documents(first_docs(spark, d))


def chunk_counts(spark, d):
    n = T.chunk_count(F.size(T.split_words(F.col("text"))), CHUNK, OVERLAP)
    return first_docs(spark, d).select("document_name", n.alias("chunks"))


def index(spark, d, lemmas=None):
    return indexing.build_index(first_docs(spark, d), lemmas=lemmas)


def passage_token_counts(spark, d):
    return index(spark, d).passages.select(*KEY, "token_count")


def postings(spark, d):
    return indexing.postings_of(indexing.passages_of(chunk_docs(spark, d)), key=KEY).select(*KEY, "term", "term_frequency", "token_count")


def vocabulary(spark, d):
    return index(spark, d).terms


def corpus_stats(spark, d):
    return index(spark, d).stats.select("n_passages", F.round("avgdl", 6).alias("avgdl"))


def index_integrity_checks(spark, d):
    return indexing.integrity(index(spark, d))


def term_document_frequency(spark, d):
    stored = indexing.stored_postings(table(spark, d, "postings"), table(spark, d, "terms"))
    return indexing.terms_of(stored.select("term", "passage_id").distinct())


def small_lexicon(spark):
    """(synsets, lemmas, exceptions) parsed from the sample lexicon's lines."""
    frame = lambda lines: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    pos = lexicon_source.POS
    synsets = lexicon_source._union([lexicon_source.parse_synsets(frame(samples.DATA[p]), p) for p in pos])
    lemmas = lexicon_source._union([lexicon_source.parse_lemmas(frame(samples.INDEX[p]), p) for p in pos])
    exceptions = lexicon_source._union([lexicon_source.parse_exceptions(frame(samples.EXCEPTIONS[p]), i) for i, p in enumerate(pos)])
    return synsets, lemmas, exceptions


def lemma_map(spark, d):
    _, lemmas, exceptions = small_lexicon(spark)
    return lexicon.lemma_map(table(spark, d, "terms"), lemmas, exceptions)


def lemmatized_terms(spark, d):
    """Term counts after lemmatization: the map is made of the vocabulary, counts are renamed."""
    counts = tokenize_counts(spark, d)
    _, lemmas, exceptions = small_lexicon(spark)
    renamed = counts.join(lexicon.lemma_map(counts, lemmas, exceptions), "term")
    return renamed.groupBy("lemma").agg(F.sum("occurrences").alias("occurrences"))


def wordnet_parse(spark, d):
    synsets, _, _ = small_lexicon(spark)
    joined = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("words", "hypernyms", "hyponyms")]
    return synsets.select("pos", "offset", *joined)


def wordnet_candidates(spark, d):
    synsets, lemmas, _ = small_lexicon(spark)
    words = lemmas.select(F.col("lemma").alias("word"))
    found = lexicon.related_words(words, synsets, lemmas)
    return found.select("word", *[F.array_join(c, " ").alias(c) for c in ("synonyms", "hypernyms", "hyponyms")])


# retrieval


def item_queries(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def logged_queries(spark, d):
    return questions(spark, d).where(F.col("query_id") % 50 == 0)


def idf_table(spark, d):
    ix = index(spark, d)
    return retrieval.idf_of(ix.terms, ix.stats).select("term", "df", F.round("idf", 9).alias("idf"))


def explained(spark, d, queries):
    """Scores of each query term, from postings of the asked terms only, and the names of passages."""
    bag = retrieval.query_terms(queries)
    passages = indexing.passages_of(chunk_docs(spark, d))
    asked = small_side(bag.select("term").distinct(), indexing.SMALL)
    posted = indexing.postings_of(passages, only=asked)
    scores = retrieval.term_scores(bag, posted, indexing.terms_of(posted), indexing.stats_of(passages))
    return scores, passages.select("passage_id", *KEY)


def bm25_explain(spark, d, asked=item_queries):
    scores, names = explained(spark, d, asked(spark, d))
    return scores.join(names, "passage_id").select("query_id", *KEY, "term", "qtf", F.round("score", 6).alias("score"))


def ranked(spark, d, queries, k):
    """query_id, rank, document_name, chunk_id, score, passage_id; equal scores go by name and chunk."""
    scores, names = explained(spark, d, queries)
    found = retrieval.best_or_equal(retrieval.passage_scores(scores), k).join(names, "passage_id")
    return retrieval.top_k(found, k, KEY)


SHOWN = ("query_id", "rank", *KEY, "score")


def bm25_search_topk(spark, d, asked=item_queries):
    return ranked(spark, d, asked(spark, d), 5).select(*SHOWN)


def bm25_batch_top100(spark, d, asked=item_queries):
    return ranked(spark, d, asked(spark, d), 100).select(*SHOWN)


def bm25_duplicate_terms(spark, d, asked=item_queries):
    """Every question asked twice over in one text: each term counts double."""
    twice = asked(spark, d).withColumn("query_text", F.concat_ws(" ", "query_text", "query_text"))
    return ranked(spark, d, twice, 5).select(*SHOWN)


def bm25_stored_top10(spark, d, asked=item_queries):
    """The questions against the stored index."""
    bag = retrieval.query_terms(asked(spark, d))
    posted, terms, stats = indexing.stored_index(table(spark, d, "postings"), table(spark, d, "terms"), bag)
    found = retrieval.passage_scores(retrieval.term_scores(bag, posted, terms, stats))
    return retrieval.top_k(found, 10).select("query_id", "rank", "passage_id", "score")


def questions(spark, d):
    return table(spark, d, "queries").select("query_id", F.col("question_text").alias("query_text"))


def lookup_terms(spark, d):
    return retrieval.lookup_terms(table(spark, d, "terms"), retrieval.query_terms(questions(spark, d)))


def resolve_terms(spark, d):
    terms = table(spark, d, "terms").where("term IS NOT NULL").groupBy("term").agg(F.min("term_id").alias("term_id"))
    return indexing.resolve_terms(terms, retrieval.query_terms(questions(spark, d)))


def document_names_for_passages(spark, d):
    """The posted passage ids of the stored index with the document each belongs to, null where it has not arrived."""
    ids = table(spark, d, "postings").select("passage_id").distinct().withColumn("pos", F.col("passage_id"))
    return retrieval.document_names(ids, table(spark, d, "passages")).select("passage_id", "document_name")


def row_range_scan(spark, d):
    from termloom.sources.tables import row_range

    return row_range(table(spark, d, "bulk_rows"), 100, 600).select("row_num", "file_name")


def row_range_cover(spark, d):
    """The whole staged table in ranges of ROW_RANGE numbers."""
    from termloom.sources.tables import row_ranges

    return row_ranges(table(spark, d, "bulk_rows"), ROW_RANGE).select("range_id", "first_row", "end_row", "row_num", "file_name", "raw_line")


def dedupe_first_document(spark, d):
    return first_docs(spark, d)


def rebuild_union_replace(spark, d):
    """First documents, replaced by the latest of names that came again."""
    docs = table(spark, d, "documents")
    latest = docs.groupBy("document_name").agg(F.max_by("text", "doc_id").alias("text"), F.count(F.lit(1)).alias("n"))
    return indexing.replace_documents(first_docs(spark, d), latest.where("n > 1"))


# evaluation


def own_word_queries(spark, d):
    docs = table(spark, d, "documents").where(F.col("doc_id") % 50 == 0)
    words = F.slice(T.tokenize(F.col("text")), 3, 6)
    queries = docs.select(F.col("doc_id").alias("query_id"), F.array_join(words, " ").alias("query_text"))
    qrels = docs.select(F.col("doc_id").alias("query_id"), F.col("document_name").alias("corpus_id"), F.when(F.col("lang").isNull(), 0).otherwise(1).alias("score"))
    return queries, qrels


def ranked_by_scan(spark, d, queries, k):
    """What ranked has, without passage_id, for query sets that grow with the corpus: the passages are stored once and read
    once for all queries of a block."""
    passages = stored(indexing.passages_of(chunk_docs(spark, d)).select(*KEY, "token_count", "terms"))
    bag, stats = retrieval.query_terms(queries), indexing.stats_of(passages)
    asked = small_side(bag.select("term").distinct(), indexing.SMALL)
    held = passages.select(F.explode(F.array_distinct("terms")).alias("term")).join(asked, "term", "left_semi")
    weights = bag.join(retrieval.idf_of(indexing.terms_of(held), stats), "term").withColumn("weight", F.col("qtf") * F.col("idf"))
    return retrieval.top_k(scan.best_passages(passages, weights, k, KEY, stats.first()["avgdl"]), k, KEY)


def eval_per_query(spark, d):
    queries, qrels = own_word_queries(spark, d)
    rows = evaluation.per_query(queries, qrels, ranked_by_scan(spark, d, queries, 100))
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("reciprocal_rank", "recall_10", "recall_100")])


def eval_summary(spark, d):
    queries, qrels = own_word_queries(spark, d)
    return evaluation.summary(queries, qrels, ranked(spark, d, queries, 100))


def eval_skipped(spark, d):
    return evaluation.skipped_queries(*own_word_queries(spark, d))


# context


def turns(spark, d):
    """The question log as chats: one session a day, one turn a question, words standing in for tokens."""
    session = F.floor(F.col("created_at") / SESSION_SECONDS).cast("bigint")
    words = F.size(T.split_words(F.col("question_text")))
    return table(spark, d, "queries").select(session.alias("session_id"), F.col("query_id").alias("turn"), words.alias("tokens"))


def history_window(spark, d):
    return context.history_window(turns(spark, d), WINDOW_TOKENS).select("session_id", "turn", F.col("running_tokens").cast("bigint").alias("running_tokens"))


def counted_docs(spark, d):
    docs = table(spark, d, "documents").where("corpus_id IS NOT NULL AND document_name IS NOT NULL AND text IS NOT NULL")
    return docs.select("corpus_id", "document_name", "text", F.size(T.split_words(F.col("text"))).alias("tokens"))


def document_window(spark, d):
    kept = context.document_window(counted_docs(spark, d), PROMPT_TOKENS)
    return kept.select("corpus_id", "document_name", "position", F.col("running").cast("bigint").alias("running"))


def document_prompt(spark, d):
    asked = table(spark, d, "corpora").select("corpus_id", F.concat(F.lit("What is in "), "display_name", F.lit("?")).alias("query_text"))
    return context.document_prompts(counted_docs(spark, d), asked, PROMPT_TOKENS)


def candidate_cap(spark, d):
    listed = F.slice(T.tokenize(F.col("question_text")), 1, context.LISTED)
    return table(spark, d, "queries").select("query_id", F.array_join(listed, ", ").alias("listed"))


def generation_prompt(spark, d, asked=item_queries):
    passages = index(spark, d).passages
    return context.passage_prompts(ranked(spark, d, asked(spark, d), 5).select("query_id", "passage_id", "rank"), passages, asked(spark, d))


def sources_json(spark, d, asked=item_queries):
    passages = index(spark, d).passages
    return context.sources_json(ranked(spark, d, asked(spark, d), 5).select("query_id", "passage_id", "rank", "score"), passages)


def responses(spark, d):
    return table(spark, d, "query_formulation_runs").select("run_id", "llm_response_text", "selected_terms").distinct()


def parse_selected_terms(spark, d):
    terms = context.selected_terms(F.col("llm_response_text"), F.split("selected_terms", " "))
    return responses(spark, d).select("run_id", F.array_join(terms, "|").alias("terms"))


def tool_choice(spark, d):
    return responses(spark, d).select("run_id", context.tool_choice(F.col("llm_response_text")).alias("tool"))


def think_strip(spark, d):
    return responses(spark, d).select("run_id", T.strip_think(F.col("llm_response_text")).alias("reply"))


# chat, corpora, log


def chat_titles(spark, d):
    return table(spark, d, "queries").select("query_id", T.chat_title(F.col("question_text")).alias("title"))


def chat_history(spark, d):
    """Sessions' turns in order with ISO times."""
    at = T.iso_timestamp(F.timestamp_seconds("created_at"))
    session = F.floor(F.col("created_at") / SESSION_SECONDS).cast("bigint")
    return table(spark, d, "queries").select(session.alias("session_id"), F.col("query_id").alias("message_id"), at.alias("created_at"), F.col("question_text").alias("text")).orderBy("session_id", "message_id")


def chat_sessions_latest(spark, d):
    first = turns(spark, d).groupBy("session_id").agg(F.min("turn").alias("query_id"), F.count(F.lit(1)).alias("messages"))
    titles = first.join(chat_titles(spark, d), "query_id")
    return titles.select("session_id", "title", "messages").orderBy(F.desc("session_id"))


def corpora_list(spark, d):
    docs = table(spark, d, "documents").groupBy("corpus_id").agg(F.count(F.lit(1)).alias("documents"))
    listed = table(spark, d, "corpora").join(docs, "corpus_id", "left")
    created = T.iso_timestamp(F.col("created_at")).alias("created_at")
    return listed.select("corpus_id", "display_name", "schema_name", created, F.coalesce("documents", F.lit(0)).alias("documents")).orderBy("corpus_id")


def ingest_outcomes(spark, d):
    """Documents by what their extension and text would have come to."""
    from termloom.sources.files import KINDS

    extension = F.lower(F.regexp_extract("document_name", "\\.([^.]+)$", 1))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), extension), F.lit("unknown"))
    blank = F.coalesce(F.regexp_replace("text", "[ \\t\\r\\n]", ""), F.lit("")) == ""
    status = F.when(kind == "unknown", "skipped").when(blank & (kind == "docx"), "malformed").when(blank, "no_text").otherwise("ok")
    return table(spark, d, "documents").groupBy(kind.alias("kind"), status.alias("status")).agg(F.count(F.lit(1)).alias("documents"))


def log_latency_report(spark, d):
    return logs.latency_report(table(spark, d, "queries"))


def log_most_asked(spark, d):
    return logs.most_asked(table(spark, d, "queries"), 20)


def log_zero_results(spark, d):
    """Questions none of whose terms is in the stored vocabulary with postings."""
    posted = table(spark, d, "postings").select("term_id").distinct()
    known = table(spark, d, "terms").join(posted, "term_id", "left_semi").select("term").distinct()
    hit = retrieval.query_terms(questions(spark, d)).join(known, "term", "left_semi").select("query_id").distinct()
    return questions(spark, d).join(hit, "query_id", "left_anti").select("query_id")


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_profiles, p3_sizes, p5_found, p5_errors, p5_valid,
        tokenize_docs, tokenize_counts, split_words, stopword_filtered_terms, chunk_docs, chunk_counts,
        passage_token_counts, postings, vocabulary, corpus_stats, index_integrity_checks, term_document_frequency,
        lemma_map, lemmatized_terms, wordnet_parse, wordnet_candidates,
        idf_table, bm25_explain, bm25_search_topk, bm25_batch_top100, bm25_duplicate_terms, bm25_stored_top10,
        lookup_terms, resolve_terms, document_names_for_passages, row_range_scan, row_range_cover, dedupe_first_document, rebuild_union_replace,
        eval_per_query, eval_summary, eval_skipped,
        history_window, document_window, document_prompt, candidate_cap, generation_prompt, sources_json,
        parse_selected_terms, tool_choice, think_strip,
        chat_titles, chat_history, chat_sessions_latest, corpora_list, ingest_outcomes,
        log_latency_report, log_most_asked, log_zero_results,
    )
}
SEARCHES = (bm25_explain, bm25_search_topk, bm25_batch_top100, bm25_duplicate_terms, bm25_stored_top10, generation_prompt, sources_json)
QUERIES |= {f"logged_{f.__name__}": partial(f, asked=logged_queries) for f in SEARCHES}

# SQL


def _profile(key: str, value: str = "term_frequency", source: str = "postings", quantiles: tuple[float, ...] = (0.5,)) -> str:
    ranks = ", ".join(f"CAST(QUANTILE_DISC({value}, {q}) AS BIGINT) AS p{round(q * 100)}" for q in quantiles)
    return f"""
SELECT '{key}' AS key_column, {key} AS key_value, COUNT(*) AS row_count, CAST(SUM({value}) AS BIGINT) AS value_sum,
  CAST(MIN({value}) AS BIGINT) AS value_min, CAST(MAX({value}) AS BIGINT) AS value_max, {ranks}
FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}"""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PROFILES = " UNION ALL ".join(_profile(k) for k in POSTING_KEYS)
STOP = "[" + ", ".join(map(quoted, T.STOPWORDS)) + "]"
TOKENS = "list_transform(regexp_extract_all({0}, " + quoted(T.TOKEN_PLAIN) + "), lambda t: lower(substr(t, 1, 255)))"
KEPT = "list_filter(" + TOKENS + ", lambda t: NOT list_contains(" + STOP + ", t))"
WORDS = "list_filter(string_split_regex({0}, '[ \\t\\r\\n]+'), lambda x: x <> '')"
STEP = CHUNK - OVERLAP
N_CHUNKS = f"CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {CHUNK} THEN 1 ELSE CAST(ceil((len(w) - {CHUNK}) / {STEP}.0) AS INT) + 1 END"
DOCS = "docs AS (SELECT document_name, arg_min(text, doc_id) AS text FROM documents WHERE document_name IS NOT NULL AND text IS NOT NULL GROUP BY document_name)"
CHUNKS = f"""{DOCS},
worded AS (SELECT document_name, {WORDS.format("text")} AS w FROM docs),
chunks AS (SELECT document_name, CAST(i AS INT) AS chunk_id, array_to_string(w[i * {STEP} + 1 : i * {STEP} + {CHUNK}], ' ') AS text
  FROM worded, LATERAL (SELECT UNNEST(range(0, {N_CHUNKS})) AS i))"""
INDEX = f"""{CHUNKS},
pas AS (SELECT *, {KEPT.format("text")} AS words FROM chunks),
lens AS (SELECT document_name, chunk_id, text, CAST(len(words) AS INT) AS token_count FROM pas),
post AS (SELECT document_name, chunk_id, term, CAST(COUNT(*) AS INT) AS term_frequency, ANY_VALUE(token_count) AS token_count
  FROM (SELECT document_name, chunk_id, UNNEST(words) AS term, CAST(len(words) AS INT) AS token_count FROM pas) GROUP BY ALL),
voc AS (SELECT term, COUNT(*) AS df FROM post GROUP BY term),
stat AS (SELECT COUNT(*) AS n, COALESCE(AVG(token_count), 0) AS avgdl FROM lens)"""


def _search(queries: str) -> str:
    return f"""WITH {INDEX},
asked AS ({queries}),
bag AS (SELECT query_id, term, COUNT(*) AS qtf FROM (SELECT query_id, UNNEST({KEPT.format("query_text")}) AS term FROM asked) GROUP BY ALL),
expl AS (SELECT query_id, document_name, chunk_id, term, qtf,
    qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (term_frequency * 2.2) / (term_frequency + 1.2 * (0.25 + 0.75 * token_count / avgdl)) AS score
  FROM bag JOIN voc USING (term) JOIN post USING (term), stat),
scored AS (SELECT query_id, document_name, chunk_id, ROUND(SUM(score), 6) AS score FROM expl GROUP BY ALL),
rank_all AS (SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, document_name, chunk_id) AS INT) AS rank,
  document_name, chunk_id, score FROM scored)"""


ITEMS = "SELECT item_id AS query_id, text AS query_text FROM eval_items"
OWN = f"SELECT doc_id AS query_id, array_to_string(list_slice({TOKENS.format('text')}, 3, 8), ' ') AS query_text FROM documents WHERE doc_id % 50 = 0"
EVALUATED = f"""{_search(OWN)},
qrels AS (SELECT doc_id AS query_id, document_name AS corpus_id, CASE WHEN lang IS NULL THEN 0 ELSE 1 END AS score FROM documents WHERE doc_id % 50 = 0),
rel AS (SELECT query_id, COUNT(*) AS relevant FROM qrels WHERE score > 0 GROUP BY query_id),
hit AS (SELECT r.query_id, r.document_name, MIN(rank) AS first_rank FROM rank_all r
  JOIN (SELECT DISTINCT query_id, corpus_id FROM qrels WHERE score > 0) q ON q.query_id = r.query_id AND q.corpus_id = r.document_name
  WHERE rank <= 100 GROUP BY ALL),
best AS (SELECT query_id, MIN(first_rank) AS best, COUNT(*) FILTER (first_rank <= 10) AS h10, COUNT(*) AS h100 FROM hit GROUP BY query_id),
each AS (SELECT query_id, CASE WHEN best <= 10 THEN 1.0 / best ELSE 0.0 END AS reciprocal_rank,
  COALESCE(h10, 0) / relevant AS recall_10, COALESCE(h100, 0) / relevant AS recall_100 FROM rel LEFT JOIN best USING (query_id))"""
WINDOWED = f"""counted AS (SELECT corpus_id, document_name, text, len({WORDS.format("text")}) AS n FROM documents
    WHERE corpus_id IS NOT NULL AND document_name IS NOT NULL AND text IS NOT NULL),
run AS (SELECT *, CAST(ROW_NUMBER() OVER w AS INT) AS position, CAST(SUM(n) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
  FROM counted WINDOW w AS (PARTITION BY corpus_id ORDER BY document_name, text)),
kept AS (SELECT * FROM run WHERE position = 1 OR (running <= {PROMPT_TOKENS} AND running - n < {PROMPT_TOKENS}))"""
LEMMAS = sorted({x.split()[0] for lines in samples.INDEX.values() for x in lines})
IRREGULAR = {}
for _lines in samples.EXCEPTIONS.values():
    for _x in _lines:
        IRREGULAR.setdefault(_x.split()[0], _x.split()[1])
LEMMA_SQL = f"""rules(rank, suffix, ending) AS (VALUES {", ".join(f"({i}, '{s}', '{e}')" for i, (s, e) in enumerate(lexicon.RULES))}),
irregular(term, base) AS (VALUES {", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in IRREGULAR.items())}),
tried AS (SELECT term, rank, left(term, length(term) - length(suffix)) || ending AS candidate FROM voc0, rules WHERE suffix(term, suffix)),
regular AS (SELECT term, arg_min(candidate, rank) AS candidate FROM tried WHERE candidate IN ({", ".join(map(quoted, LEMMAS))}) GROUP BY term),
mapped AS (SELECT term, COALESCE(base, candidate, term) AS lemma FROM voc0 LEFT JOIN irregular USING (term) LEFT JOIN regular USING (term))"""
COUNTS = f"SELECT term, COUNT(*) AS occurrences FROM (SELECT UNNEST({TOKENS.format('text')}) AS term FROM documents) GROUP BY term"
ASKED_TERMS = f"SELECT DISTINCT term FROM (SELECT UNNEST({KEPT.format('question_text')}) AS term FROM queries)"
SHOWN_SQL = "SELECT query_id, rank, document_name, chunk_id, score FROM rank_all WHERE rank <= {0}"
KINDS_SQL = "CASE WHEN e = 'txt' THEN 'txt' WHEN e = 'csv' THEN 'csv' WHEN e = 'docx' THEN 'docx' WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('png', 'jpg', 'jpeg', 'tiff', 'tif', 'bmp') THEN 'image' ELSE 'unknown' END"

FIELD = r'("(?:[^"]|"")*"|[^"\t]*)'
PARSED = rf"""
broken AS (SELECT row_num, regexp_full_match(raw_line, '{FIELD}(\t{FIELD})*', 's') AS well,
  regexp_extract_all(chr(9) || raw_line, '\t{FIELD}', 1) AS f FROM bulk_rows),
cells AS (SELECT row_num, well, len(f) AS n, f[2] AS raw_text,
  CASE WHEN f[1][1] = '"' THEN replace(f[1][2:-2], '""', '"') ELSE f[1] END AS document_name,
  CASE WHEN f[2][1] = '"' THEN replace(f[2][2:-2], '""', '"') ELSE f[2] END AS text FROM broken),
named AS (SELECT *, regexp_matches(document_name, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FFFD}}]') AS bad_name, regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FFFD}}]') AS bad_text,
    regexp_extract(document_name, '^(.*)#row([1-9][0-9]*)$', ['file', 'number'], 's') AS m FROM cells),
listed AS (SELECT *, trim(m.file, ' ' || chr(9) || chr(10) || chr(13)) = '' OR m.number = '' OR COALESCE(TRY_CAST(m.number AS HUGEINT) > 2147483647, true) AS bad_row FROM named),
 judged AS (SELECT row_num, document_name, text, CASE WHEN NOT well THEN 'quoting' WHEN n IS NULL OR n <> 2 THEN 'column_count'
    WHEN bad_row OR bad_name OR bad_text OR raw_text = '' THEN 'invalid_value' END AS reason,
    CASE WHEN NOT well THEN '0 quotes' WHEN n IS NULL OR n <> 2 THEN '0 two_cells' ELSE concat_ws('|', CASE WHEN bad_name THEN '1 characters' END,
      CASE WHEN bad_row THEN '1 row_name' END, CASE WHEN bad_text THEN '2 characters' END, CASE WHEN raw_text = '' THEN '2 not_missing' END) END AS errors FROM listed)"""

ORACLES = {
    "p5_found": f"WITH {PARSED} SELECT row_num, reason FROM judged WHERE reason IS NOT NULL",
    "p5_errors": f"WITH {PARSED} SELECT row_num, reason, errors FROM judged WHERE reason IS NOT NULL",
    "p5_valid": f"WITH {PARSED} SELECT row_num, document_name, text FROM judged WHERE reason IS NULL",
    "wordnet_candidates": """
SELECT * FROM (VALUES
  ('ferry', 'ferryboat transport', 'boat vessel craft watercraft hull bottom ship barge lighter tub carry', 'chain_ferry'),
  ('boat', 'vessel craft watercraft hull bottom ship barge lighter tub', '', 'ferry ferryboat'),
  ('lighthouse', '', '', ''), ('box', 'Box', '', ''), ('notice', 'lighthouse', '', ''), ('carry', '', '', 'ferry transport'),
  ('sell', 'carry', '', 'ferry transport'), ('measure', 'carry', '', 'ferry transport'), ('old', '', '', ''), ('deep', 'old', '', ''), ('slowly', '', '', '')
) v(word, synonyms, hypernyms, hyponyms)""",
    "p3_profiles": PROFILES,
    "p3_sizes": " UNION ALL ".join(_profile(k, "n_chars", "documents", SIZE_QUANTILES) for k in SIZE_KEYS),
    "p3_found": f"SELECT key_column, key_value FROM ({PROFILES}) WHERE row_count * 200 >= (SELECT COUNT(*) FROM postings)",
    "tokenize_docs": f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)",
    "tokenize_counts": COUNTS,
    "split_words": f"SELECT doc_id, CAST(len(t) AS INT) AS n_words, array_to_string(t, ' ') AS words FROM (SELECT doc_id, {WORDS.format('text')} AS t FROM documents)",
    "stopword_filtered_terms": f"SELECT doc_id, CAST(len(t) AS INT) AS n_terms, array_to_string(t, ' ') AS terms FROM (SELECT doc_id, {KEPT.format('text')} AS t FROM documents)",
    "chunk_docs": f"WITH {CHUNKS} SELECT * FROM chunks",
    "chunk_counts": f"WITH {CHUNKS} SELECT document_name, CAST({N_CHUNKS} AS INT) AS chunks FROM worded",
    "passage_token_counts": f"WITH {INDEX} SELECT document_name, chunk_id, token_count FROM lens",
    "postings": f"WITH {INDEX} SELECT * FROM post",
    "vocabulary": f"WITH {INDEX} SELECT * FROM voc",
    "corpus_stats": f"WITH {INDEX} SELECT n AS n_passages, ROUND(avgdl, 6) AS avgdl FROM stat",
    "index_integrity_checks": "SELECT UNNEST(['posting_repeated', 'posting_without_passage', 'posting_without_term', 'token_count_differs', 'passage_key_repeated', 'chunk_ids_not_dense', 'document_name_repeated', 'df_differs']) AS check_name, CAST(0 AS BIGINT) AS violations",
    "term_document_frequency": "SELECT term, COUNT(DISTINCT passage_id) AS df FROM postings JOIN (SELECT DISTINCT term_id, term FROM terms WHERE term IS NOT NULL) USING (term_id) WHERE passage_id IS NOT NULL GROUP BY term",
    "lemma_map": f"WITH voc0 AS (SELECT DISTINCT term FROM terms WHERE term IS NOT NULL), {LEMMA_SQL} SELECT term, lemma FROM mapped",
    "lemmatized_terms": f"WITH counted AS ({COUNTS}), voc0 AS (SELECT term FROM counted), {LEMMA_SQL} SELECT lemma, CAST(SUM(occurrences) AS BIGINT) AS occurrences FROM counted JOIN mapped USING (term) GROUP BY lemma",
    "idf_table": f"WITH {INDEX} SELECT term, df, ROUND(ln((n - df + 0.5) / (df + 0.5) + 1), 9) AS idf FROM voc, stat",
    "bm25_explain": f"{_search(ITEMS)} SELECT query_id, document_name, chunk_id, term, qtf, ROUND(score, 6) AS score FROM expl",
    "bm25_search_topk": f"{_search(ITEMS)} {SHOWN_SQL.format(5)}",
    "bm25_batch_top100": f"{_search(ITEMS)} {SHOWN_SQL.format(100)}",
    "bm25_duplicate_terms": f"{_search(ITEMS.replace('text AS', chr(39).join(('text || ', ' ', ' || text AS'))))} {SHOWN_SQL.format(5)}",
    "bm25_stored_top10": f"""
WITH asked AS ({ITEMS}),
bag AS (SELECT query_id, term, COUNT(*) AS qtf FROM (SELECT query_id, UNNEST({KEPT.format("query_text")}) AS term FROM asked) GROUP BY ALL),
post AS (SELECT term, passage_id, SUM(term_frequency) AS tf, MAX(token_count) AS len FROM (SELECT DISTINCT * FROM postings) JOIN (SELECT DISTINCT * FROM terms) USING (term_id) GROUP BY ALL),
voc AS (SELECT term, COUNT(*) AS df FROM post GROUP BY term),
stat AS (SELECT COUNT(*) AS n, AVG(len) AS avgdl FROM (SELECT passage_id, MAX(token_count) AS len FROM postings GROUP BY passage_id)),
scored AS (SELECT query_id, passage_id, ROUND(SUM(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score
  FROM bag JOIN voc USING (term) JOIN post USING (term), stat GROUP BY ALL)
SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS INT) AS rank, passage_id, score
FROM scored QUALIFY rank <= 10""",
    "lookup_terms": f"SELECT term, COALESCE(MIN(term_id), -1) AS term_id FROM ({ASKED_TERMS}) LEFT JOIN terms USING (term) GROUP BY term",
    "resolve_terms": f"""
WITH known AS (SELECT term, MIN(term_id) AS term_id FROM terms WHERE term IS NOT NULL GROUP BY term), asked AS ({ASKED_TERMS})
SELECT a.term, COALESCE(k.term_id, (SELECT MAX(term_id) FROM known) + ROW_NUMBER() OVER (PARTITION BY k.term_id IS NULL ORDER BY a.term)) AS term_id
FROM asked a LEFT JOIN known k USING (term)""",
    "document_names_for_passages": "SELECT passage_id, document_name FROM (SELECT DISTINCT passage_id FROM postings) LEFT JOIN passages USING (passage_id)",
    "row_range_scan": "SELECT row_num, file_name FROM bulk_rows WHERE row_num >= 100 AND row_num < 600",
    "row_range_cover": f"""
WITH b AS (SELECT MIN(row_num) AS lo, MAX(row_num) AS hi FROM bulk_rows)
SELECT (row_num - lo) // {ROW_RANGE} AS range_id, lo + (row_num - lo) // {ROW_RANGE} * {ROW_RANGE} AS first_row,
  LEAST(lo + (row_num - lo) // {ROW_RANGE} * {ROW_RANGE} + {ROW_RANGE}, hi + 1) AS end_row, row_num, file_name, raw_line FROM bulk_rows, b""",
    "dedupe_first_document": f"WITH {DOCS} SELECT * FROM docs",
    "rebuild_union_replace": "SELECT document_name, arg_max(text, doc_id) AS text FROM documents GROUP BY document_name",
    "eval_per_query": f"{EVALUATED} SELECT query_id, ROUND(reciprocal_rank, 6) AS reciprocal_rank, ROUND(recall_10, 6) AS recall_10, ROUND(recall_100, 6) AS recall_100 FROM each",
    "eval_summary": f"""{EVALUATED} SELECT COUNT(*) AS evaluated, (SELECT COUNT(DISTINCT query_id) FROM asked WHERE query_id NOT IN (SELECT query_id FROM rel)) AS skipped,
  ROUND(COALESCE(AVG(reciprocal_rank), 0), 6) AS mrr_10, ROUND(COALESCE(AVG(recall_10), 0), 6) AS recall_10, ROUND(COALESCE(AVG(recall_100), 0), 6) AS recall_100 FROM each""",
    "eval_skipped": "SELECT doc_id AS query_id FROM documents WHERE doc_id % 50 = 0 AND lang IS NULL",
    "history_window": f"""
SELECT session_id, turn, running_tokens FROM (
  SELECT CAST(floor(created_at / {SESSION_SECONDS}) AS BIGINT) AS session_id, query_id AS turn,
    CAST(SUM(len({WORDS.format("COALESCE(question_text, '')")})) OVER (PARTITION BY floor(created_at / {SESSION_SECONDS}) ORDER BY query_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_tokens
  FROM queries) WHERE running_tokens <= {WINDOW_TOKENS}""",
    "document_window": f"WITH {WINDOWED} SELECT corpus_id, document_name, position, running FROM kept",
    "document_prompt": f"""WITH {WINDOWED}
SELECT corpus_id, {quoted(context.DOCUMENT_HEAD)} || string_agg('[Source: ' || document_name || ']' || chr(10) || text || chr(10) || chr(10), '' ORDER BY position)
  || 'Question: What is in ' || ANY_VALUE(display_name) || '?' || chr(10) || chr(10) || 'Answer:' AS prompt, COUNT(*) AS included
FROM kept JOIN corpora USING (corpus_id) GROUP BY corpus_id""",
    "candidate_cap": f"SELECT query_id, array_to_string(list_slice({TOKENS.format(chr(39).join(('COALESCE(question_text, ', '', ')')))}, 1, 8), ', ') AS listed FROM queries",
    "generation_prompt": f"""{_search(ITEMS)}
SELECT query_id, {quoted(context.PASSAGE_HEAD)} || string_agg('[Source: ' || document_name || ', chunk ' || chunk_id || ']' || chr(10) || l.text || chr(10) || chr(10), '' ORDER BY rank)
  || 'Question: ' || ANY_VALUE(query_text) || chr(10) || chr(10) || 'Answer:' AS prompt, COUNT(*) AS included, CAST(0 AS BIGINT) AS skipped
FROM rank_all JOIN lens l USING (document_name, chunk_id) JOIN asked USING (query_id) WHERE rank <= 5 GROUP BY query_id""",
    "sources_json": f"""{_search(ITEMS)}
SELECT query_id, '[' || string_agg('{{"documentName":' || to_json(document_name) || ',"chunkId":' || chunk_id || ',"score":' || score || '}}', ',' ORDER BY rank) || ']' AS sources
FROM rank_all WHERE rank <= 5 GROUP BY query_id""",
    "parse_selected_terms": """
WITH r AS (SELECT DISTINCT run_id, llm_response_text AS j, selected_terms FROM query_formulation_runs),
s AS (SELECT run_id, selected_terms, CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY'
  THEN list_transform(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$') ELSE [] END AS found FROM r)
SELECT run_id, CASE WHEN len(found) > 0 THEN array_to_string(found, '|') ELSE replace(selected_terms, ' ', '|') END AS terms FROM s""",
    "tool_choice": "SELECT run_id, CASE WHEN contains(upper(llm_response_text), 'READ') THEN 'READ' ELSE 'SEARCH' END AS tool FROM (SELECT DISTINCT run_id, llm_response_text, selected_terms FROM query_formulation_runs)",
    "think_strip": "SELECT run_id, regexp_replace(llm_response_text, '\\A<think>(?s:.*?)</think>[\\n\\r \\t]*', '') AS reply FROM (SELECT DISTINCT run_id, llm_response_text, selected_terms FROM query_formulation_runs)",
    "chat_titles": "SELECT query_id, CASE WHEN length(trim(question_text)) > 60 THEN trim(substr(trim(question_text), 1, 60)) || '...' ELSE trim(question_text) END AS title FROM queries",
    "chat_history": f"SELECT CAST(floor(created_at / {SESSION_SECONDS}) AS BIGINT) AS session_id, query_id AS message_id, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at, question_text AS text FROM queries",
    "chat_sessions_latest": f"""
WITH s AS (SELECT CAST(floor(created_at / {SESSION_SECONDS}) AS BIGINT) AS session_id, MIN(query_id) AS query_id, COUNT(*) AS messages FROM queries GROUP BY 1)
SELECT session_id, CASE WHEN length(trim(question_text)) > 60 THEN trim(substr(trim(question_text), 1, 60)) || '...' ELSE trim(question_text) END AS title, messages
FROM s JOIN queries USING (query_id)""",
    "corpora_list": "SELECT c.corpus_id, display_name, schema_name, strftime(c.created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at, COUNT(d.corpus_id) AS documents FROM corpora c LEFT JOIN documents d USING (corpus_id) GROUP BY ALL",
    "ingest_outcomes": f"""
WITH k AS (SELECT {KINDS_SQL} AS kind, COALESCE(regexp_replace(text, '[ \\t\\r\\n]', '', 'g'), '') = '' AS blank
  FROM (SELECT *, lower(regexp_extract(document_name, '\\.([^.]+)$', 1)) AS e FROM documents))
SELECT kind, CASE WHEN kind = 'unknown' THEN 'skipped' WHEN blank AND kind = 'docx' THEN 'malformed' WHEN blank THEN 'no_text' ELSE 'ok' END AS status, COUNT(*) AS documents FROM k GROUP BY ALL""",
    "log_latency_report": """
SELECT CASE WHEN succeeded = 1 THEN 'succeeded' WHEN succeeded IS NULL THEN 'unfinished' ELSE 'failed' END AS outcome, COUNT(*) AS queries, COUNT(total_latency_ms) AS answered,
  QUANTILE_DISC(total_latency_ms, 0.5) AS median_ms, QUANTILE_DISC(total_latency_ms, 0.95) AS p95_ms, MAX(total_latency_ms) AS max_ms FROM queries GROUP BY 1""",
    "log_most_asked": "SELECT lower(trim(question_text)) AS question, COUNT(*) AS times FROM queries WHERE trim(question_text) <> '' GROUP BY 1 ORDER BY times DESC, question LIMIT 20",
    "log_zero_results": f"""
WITH known AS (SELECT DISTINCT term FROM terms WHERE term_id IN (SELECT term_id FROM postings)),
hit AS (SELECT DISTINCT query_id FROM (SELECT query_id, UNNEST({KEPT.format('question_text')}) AS term FROM queries) JOIN known USING (term))
SELECT query_id FROM queries WHERE query_id NOT IN (SELECT query_id FROM hit)""",
}
LOGGED = "FROM (SELECT query_id AS item_id, question_text AS text FROM queries WHERE query_id % 50 = 0)"
ORACLES |= {f"logged_{f.__name__}": ORACLES[f.__name__].replace("FROM eval_items", LOGGED) for f in SEARCHES}
