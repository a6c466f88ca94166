"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import TOKEN_PLAIN
from termloom.llm import leakage, packing, pairs, spans, splitting, vertical
from termloom.session import cut_lineage, table

LIMIT, OVERLAP = 320, 40


def pieces(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        splitting.split_oversized(table(spark, d, name), key, "text", LIMIT, OVERLAP).select(F.lit(kind).alias("item_kind"), "*")
        for kind, name, key in (("document", "documents", "doc_id"), ("passage", "passages", "passage_id"))
    ]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Items of which a second piece exists."""
    return pieces(spark, d).where("chunk_id = 1").select("item_kind", "item_id").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, d, "query_formulation_runs"), table(spark, d, "documents"))


def index_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, name) for name in ("postings", "passages", "terms")]


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return vertical.term_frequencies(*index_tables(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_frequencies(spark, d).where("mark IS NOT NULL").select("term", "mark")


def p6_distinctive(spark: SparkSession, d: str) -> DataFrame:
    """Each long passage's term of the highest residual inverse document frequency x term frequency."""
    return vertical.top_terms(vertical.term_scores(*index_tables(spark, d)), "distinctiveness")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return vertical.top_terms(vertical.term_scores(*index_tables(spark, d)), "bm25").select("passage_id", "term")


def sizes(spark: SparkSession, d: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.document_sizes(table(spark, d, "documents"), path, public_tokenizers.PATTERN)


def p7_containers(spark: SparkSession, d: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(sizes(spark, d, tokenizer))


def p7_checks(spark: SparkSession, d: str, tokenizer: str | None = None) -> DataFrame:
    """What the containers of all documents break: nothing, and they are 95 % full."""
    known = cut_lineage(sizes(spark, d, tokenizer))
    return packing.violations(packing.pack(known), known)


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    runs = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), min_run=12, min_identity=None)
    return runs.select("item_id", "doc_id").distinct()


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"))


def p9_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return spans.without_repeats(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_classes(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": pieces,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_frequencies": p4_frequencies,
    "p6_found": p6_found,
    "p6_distinctive": p6_distinctive,
    "p7_containers": p7_containers,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
    "p9_classes": p9_classes,
    "p9_shared": p9_shared,
    "p9_deduplicated": p9_deduplicated,
}

#: Postings cleaned: repeated rows once, passage and term known, ids of one term together.
CLEAN = """
  names AS (SELECT DISTINCT term_id, term FROM terms WHERE term_id IS NOT NULL AND term IS NOT NULL),
  known AS (SELECT DISTINCT passage_id FROM passages),
  once AS (SELECT DISTINCT term_id, passage_id, term_frequency, token_count FROM postings),
  clean AS (SELECT n.term, o.passage_id, o.term_frequency, o.token_count
            FROM once o JOIN names n USING (term_id) JOIN known USING (passage_id)),
  counted AS (SELECT term, SUM(term_frequency) AS cf, COUNT(DISTINCT passage_id) AS df FROM clean GROUP BY term)
"""
FREQUENCIES = f"""
WITH {CLEAN},
  total AS (SELECT COUNT(*) AS n FROM passages)
SELECT v.term, CAST(COALESCE(cf, 0) AS BIGINT) AS total_frequency, CAST(COALESCE(df, 0) AS BIGINT) AS passage_count,
  CASE WHEN COALESCE(df, 0) <= 2 THEN 'rare' WHEN df * 100 > n THEN 'common' END AS mark
FROM (SELECT DISTINCT term FROM names) v LEFT JOIN counted USING (term), total
"""
SCORED = f"""
WITH {CLEAN},
  posted AS (SELECT term, passage_id, SUM(term_frequency) AS term_frequency, MAX(token_count) AS token_count FROM clean GROUP BY ALL),
  stats AS (SELECT COUNT(*) AS n, AVG(token_count) AS avgdl
            FROM (SELECT passage_id, MAX(token_count) AS token_count FROM clean GROUP BY passage_id)),
  scored AS (SELECT c.passage_id, c.term,
      ROUND(ln((n - df + 0.5) / (df + 0.5) + 1)
        * (c.term_frequency * 2.2) / (c.term_frequency + 1.2 * (0.25 + 0.75 * c.token_count / avgdl)), 6) AS bm25,
      ROUND((-log2(df / n::DOUBLE) + log2(1 - exp(-cf / n::DOUBLE))) * c.term_frequency, 6) AS distinctiveness
    FROM posted c JOIN counted USING (term), stats WHERE c.token_count >= 20)
"""
SPANS = """
WITH w AS (SELECT doc_id, k, md5(substr(text, k, 400)) AS h
    FROM documents, LATERAL (SELECT UNNEST(range(1, length(text) - 398)) AS k) WHERE length(text) >= 400),
  m AS (SELECT h, MIN(doc_id) AS first_doc FROM w GROUP BY h HAVING COUNT(DISTINCT doc_id) > 1),
  s AS (SELECT doc_id, k, h, first_doc FROM w JOIN m USING (h))
"""
TOO_LONG = f"len(regexp_extract_all(text, '{TOKEN_PLAIN.replace(chr(39), chr(39) * 2)}')) > {LIMIT}"

ORACLES = {
    "p1_found": f"""
SELECT DISTINCT 'document' AS item_kind, doc_id AS item_id FROM documents WHERE {TOO_LONG}
UNION ALL SELECT DISTINCT 'passage', passage_id FROM passages WHERE {TOO_LONG}""",
    "p4_frequencies": FREQUENCIES,
    "p4_found": f"SELECT term, mark FROM ({FREQUENCIES}) WHERE mark IS NOT NULL",
    "p6_found": f"""{SCORED}
SELECT passage_id, term FROM scored
QUALIFY ROW_NUMBER() OVER (PARTITION BY passage_id ORDER BY bm25 DESC, term) = 1""",
    "p6_distinctive": f"""{SCORED}
SELECT passage_id, term, distinctiveness AS score FROM scored
QUALIFY ROW_NUMBER() OVER (PARTITION BY passage_id ORDER BY distinctiveness DESC, term) = 1""",
    "p7_checks": """
SELECT UNNEST(['document_missing', 'document_unknown', 'tokens_lost', 'cut_without_need', 'over_tokens', 'over_documents', 'over_attention', 'room_left']) AS check_name,
  CAST(0 AS BIGINT) AS violations""",
    "p8_found": """
WITH i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_items),
  d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents),
  ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') AS g FROM i, LATERAL (SELECT UNNEST(range(1, len(w) - 10)) AS k)),
  dg AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM d, LATERAL (SELECT UNNEST(range(1, len(w) - 10)) AS k))
SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (g)""",
    "p9_found": f"""{SPANS}
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT DISTINCT doc_id, h FROM s) a
JOIN (SELECT DISTINCT doc_id, h FROM s) b USING (h) WHERE a.doc_id < b.doc_id""",
    "p9_classes": f"""{SPANS},
  c AS (SELECT doc_id, CASE WHEN length(text) >= 400 THEN MIN(doc_id) OVER (PARTITION BY text) ELSE doc_id END AS class_id FROM documents),
  r AS (SELECT DISTINCT h, class_id FROM s JOIN c USING (doc_id)),
  l AS (SELECT a.class_id, COUNT(DISTINCT b.class_id) AS links FROM r a JOIN r b USING (h) WHERE a.class_id <> b.class_id GROUP BY a.class_id)
SELECT doc_id, class_id, COUNT(*) OVER (PARTITION BY class_id) AS copies, COALESCE(links, 0) AS links FROM c LEFT JOIN l USING (class_id)""",
    "p9_shared": f"""{SPANS},
  g AS (SELECT doc_id, LEAST(400, LEAD(k, 1, k + 400) OVER (PARTITION BY doc_id ORDER BY k) - k) AS n FROM s),
  e AS (SELECT doc_id, LEAST(400, LEAD(k, 1, k + 400) OVER (PARTITION BY doc_id ORDER BY k) - k) AS n FROM s WHERE first_doc < doc_id),
  gs AS (SELECT doc_id, SUM(n) AS shared FROM g GROUP BY doc_id), es AS (SELECT doc_id, SUM(n) AS repeated FROM e GROUP BY doc_id)
SELECT doc_id, COALESCE(length(text), 0) AS n_chars, CAST(COALESCE(shared, 0) AS BIGINT) AS shared_chars, CAST(COALESCE(repeated, 0) AS BIGINT) AS repeated_chars,
  COALESCE(length(text) >= 400 AND COUNT(*) OVER (PARTITION BY text) > 1, false) AS is_copy
FROM documents LEFT JOIN gs USING (doc_id) LEFT JOIN es USING (doc_id)""",
}
