"""Budgets, prompts and replies around a language model. The model itself is injected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = 16384
REWRITE_RESERVE, ROUTE_RESERVE, ANSWER_RESERVE, DOCUMENT_RESERVE = 1000, 500, 600, 3000
BYTES_PER_TOKEN = 3
LISTED = 8
SLICES = 64


def history_window(turns: DataFrame, budget: int, session: str = "session_id", turn: str = "turn", tokens: str = "tokens") -> DataFrame:
    """The newest turns of each session whose running token sum stays within budget; the first overflow ends it.

    Negative and null counts are taken as 0. A session may keep none.
    """
    w = Window.partitionBy(session).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0))).over(w)
    return turns.withColumn("running_tokens", running).where(F.col("running_tokens") <= budget)


def document_window(docs: DataFrame, budget: int, group: str = "corpus_id", tokens: str = "tokens") -> DataFrame:
    """Documents of each group by name while they fit the budget, with position and cut.

    The first overflow ends the list, unless it is the first document, which is then marked cut. A group is cut down
    in SLICES by a hash of the name first: what overflows among a slice's documents overflows among all. So the final
    order is made of SLICES budgets' worth of documents a group at most, and of those without tokens.
    """
    n = F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0))
    order = ("document_name", "text")

    def running(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        summed = rows.withColumn("position", F.row_number().over(w)).withColumn("running", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return summed.where((F.col("position") == 1) | ((F.col("running") <= budget) & (F.col("running") - F.col("n") < budget)))

    sliced = docs.withColumn("n", n).withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(SLICES)))
    near = running(sliced, group, "slice").drop("position", "running", "slice")
    return running(near, group).withColumn("cut", F.col("running") > budget).drop("n")


def cut_bytes(text: Column, limit: int) -> Column:
    """At most limit bytes of UTF-8, cut at a character boundary."""
    whole = F.encode(text, "utf-8")
    head = F.substring(whole, 1, limit)
    shorter = F.octet_length(text) <= limit
    # a cut inside a character leaves a tail of continuation bytes and their lead; hex shows where it starts
    kept = F.regexp_replace(F.hex(head), "(?:(?:[CD][0-9A-F])|(?:E[0-9A-F](?:[89AB][0-9A-F])?)|(?:F[0-7](?:[89AB][0-9A-F]){0,2}))$", "")
    return F.when(shorter, text).otherwise(F.decode(F.unhex(kept), "utf-8"))


def passage_block(name: Column, chunk_id: Column, text: Column) -> Column:
    return F.concat(F.lit("[Source: "), name, F.lit(", chunk "), chunk_id.cast("string"), F.lit("]\n"), text, F.lit("\n\n"))


def _ordered_text(order: str, block: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order, block)))
    return F.array_join(F.transform(rows, lambda r: r[block]), "")


PASSAGE_HEAD = "Answer from the excerpts below and from nothing else. Where they do not hold the answer, say so.\n\nExcerpts:\n\n"
DOCUMENT_HEAD = "Answer from the documents below and from nothing else. Where they do not hold the answer, say so.\n\nDocuments:\n\n"


def _asked(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nAnswer:"))


def passage_prompts(results: DataFrame, passages: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, prompt, included, skipped from ranked results (query_id, passage_id, rank).

    Passages come by rank; those that are missing are skipped and counted. A query without any loadable passage has no
    row. Texts are joined after the ranking, for its k rows a query only.
    """
    found = results.join(passages.select("passage_id", "document_name", "chunk_id", "text"), "passage_id", "left")
    block = F.when(F.col("document_name").isNotNull(), passage_block(F.col("document_name"), F.col("chunk_id"), F.col("text")))
    body = found.withColumn("block", block).groupBy("query_id").agg(
        _ordered_text("rank", "block").alias("body"), F.count("block").alias("included"), F.count_if(F.col("block").isNull()).alias("skipped")
    )
    joined = body.where("included > 0").join(questions, "query_id")
    return joined.select("query_id", F.concat(F.lit(PASSAGE_HEAD), "body", _asked(F.col("query_text"))).alias("prompt"), "included", "skipped")


def document_prompts(docs: DataFrame, questions: DataFrame, budget: int, group: str = "corpus_id", tokens: str = "tokens") -> DataFrame:
    """group, prompt, included: each group's documents within the budget, for the group's question (group, query_text)."""
    kept = document_window(docs, budget, group, tokens)
    text = F.when(F.col("cut"), cut_bytes(F.col("text"), budget * BYTES_PER_TOKEN)).otherwise(F.col("text"))
    block = F.concat(F.lit("[Source: "), "document_name", F.lit("]\n"), text, F.lit("\n\n"))
    body = kept.withColumn("block", block).groupBy(group).agg(_ordered_text("position", "block").alias("body"), F.count(F.lit(1)).alias("included"))
    return body.join(questions, group).select(group, F.concat(F.lit(DOCUMENT_HEAD), "body", _asked(F.col("query_text"))).alias("prompt"), "included")


def sources_json(results: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, sources: JSON array of documentName, chunkId and score by rank; a query without loadable passages has no row."""
    found = results.join(passages.select("passage_id", "document_name", "chunk_id"), "passage_id")
    entry = F.struct("rank", F.struct(F.col("document_name").alias("documentName"), F.col("chunk_id").alias("chunkId"), "score").alias("s"))
    rows = F.array_sort(F.collect_list(entry))
    return found.groupBy("query_id").agg(F.to_json(F.transform(rows, lambda r: r["s"])).alias("sources"))


def capped(words: Column) -> Column:
    """The first LISTED entries, joined by commas."""
    return F.array_join(F.slice(words, 1, LISTED), ", ")


def candidate_prompts(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, prompt listing each query term (query_id, pos, term) with up to LISTED related words of each kind.

    Columns synonyms, hypernyms and hyponyms are null for terms that the lexicon lacks.
    """

    def line(label: str, words: str) -> Column:
        return F.when(F.size(words) > 0, F.concat(F.lit(f"  {label}: "), capped(F.col(words)), F.lit("\n"))).otherwise(F.lit(""))

    none = F.col("synonyms").isNull()
    related = F.when(none, F.lit("  (no related words)\n")).otherwise(F.concat(line("synonyms", "synonyms"), line("broader", "hypernyms"), line("narrower", "hyponyms")))
    block = F.concat(F.lit('Term: "'), "term", F.lit('"\n'), related, F.lit("\n"))
    body = candidates.withColumn("block", block).groupBy("query_id").agg(_ordered_text("pos", "block").alias("body"))
    head = F.concat(F.lit('Choose search words as a JSON array of strings.\n\nUser question: "'), "query_text", F.lit('"\n\n'))
    return body.join(questions, "query_id").select("query_id", F.concat(head, "body").alias("prompt"))


def selected_terms(response: Column, fallback: Column) -> Column:
    """Strings of a JSON array reply, others ignored; the fallback terms if the reply is no array or has none."""
    members = F.try_variant_get(F.try_parse_json(response), "$", "array<variant>")
    strings = F.transform(F.filter(members, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))
    return F.when(F.size(strings) > 0, strings).otherwise(fallback)


def tool_choice(response: Column) -> Column:
    """READ if the reply holds 'read' in any case, else SEARCH; no reply means SEARCH."""
    return F.when(F.contains(F.upper(response), F.lit("READ")), "READ").otherwise("SEARCH")
