"""The engine: corpora, search, chat and the pipeline log behind one object."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import STOPWORDS
from termloom.operators import context, evaluation, lexicon, retrieval
from termloom.operators.indexing import Index
from termloom.plans.corpora import Corpora
from termloom.plans.logs import Chats, QueryLog
from termloom.plans.model import LanguageModel, NoModel, newest_within, reply

TOP_K, EVAL_K = 5, 100
#: Documents fetched at first for a whole-document answer.
FETCHED = 64
NOTHING_TO_SEARCH = "That question leaves nothing to search for. Please put it in other words."
NOTHING_FOUND = "No passage of this corpus matches that question."


def passage_prompt(found: list, question: str) -> str:
    body = "".join(f"[Source: {r['document_name']}, chunk {r['chunk_id']}]\n{r['text']}\n\n" for r in found)
    return f"{context.PASSAGE_HEAD}{body}Question: {question}\n\nAnswer:"


def passage_sources(found: list) -> list[dict]:
    return [{"documentName": r["document_name"], "chunkId": r["chunk_id"], "score": r["score"]} for r in found]


@dataclass
class Answer:
    text: str | None
    tool: str = "SEARCH"
    sources: list[dict] = field(default_factory=list)


class Engine:
    """lexicon_tables: (synsets, lemmas) or (synsets, lemmas, exceptions); with exceptions, corpora are lemmatized as they are
    built. logged: whether queries are logged. stop: the stop list of corpora built from now on."""

    def __init__(
        self, spark: SparkSession, root: str, model: LanguageModel | None = None, lexicon_tables: tuple[DataFrame, ...] | None = None,
        stop: Sequence[str] = STOPWORDS, logged: bool = True,
    ):
        self.spark, self.root, self.model = spark, root, model or NoModel()
        self.corpora, self.chats, self.log = Corpora(spark, root), Chats(spark, root), QueryLog(spark, root)
        self.lexicon, self.stop, self.logged = lexicon_tables, tuple(stop), logged

    def _lemmas(self) -> tuple[DataFrame, DataFrame] | None:
        return self.lexicon[1:] if self.lexicon is not None and len(self.lexicon) == 3 else None

    def rebuild(self, corpus_id: int, new: DataFrame, order: str = "row_num") -> dict[str, float]:
        """Adds documents to a corpus, with this engine's stop list and lexicon."""
        return self.corpora.rebuild(corpus_id, new, order, stop=self.stop, lexicon=self._lemmas())

    def delete_corpus(self, corpus_id: int) -> None:
        self.corpora.delete(corpus_id)
        self.chats.delete_corpus(corpus_id)

    def _terms(self, corpus_id: int | None, queries: DataFrame) -> DataFrame:
        """retrieval.ordered_terms, treated as the corpus was."""
        how = self.corpora.options(corpus_id) if corpus_id is not None else {"stop": self.stop, "lemmatized": self._lemmas() is not None}
        if how["lemmatized"] and self._lemmas() is None:
            raise ValueError(f"corpus {corpus_id} is lemmatized: the engine needs its lexicon with exceptions")
        return retrieval.ordered_terms(queries, how["stop"], self._lemmas() if how["lemmatized"] else None)

    def formulate(self, question: str, expand: bool = True, corpus_id: int | None = None) -> tuple[list[str], str | None, str | None, bool]:
        """(terms, prompt, response, whether the plain terms were used), the terms in the question's order, repeats kept. No
        term means no model call."""
        asked = self.spark.createDataFrame([(0, question)], "query_id bigint, query_text string")
        plain = [r["term"] for r in self._terms(corpus_id, asked).orderBy("pos").collect()]
        if not plain or not expand or self.lexicon is None:
            return plain, None, None, True
        words = self.spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "pos int, term string")
        related = lexicon.related_words(words.select(F.col("term").alias("word")), *self.lexicon[:2]).withColumnRenamed("word", "term")
        candidates = words.join(related, "term", "left").withColumn("query_id", F.lit(0))
        prompt = context.candidate_prompts(candidates, asked).first()["prompt"]
        response = reply(self.model, [("user", prompt)])
        shown = self.spark.createDataFrame([(response, plain)], "r string, plain array<string>")
        terms = shown.select(context.selected_terms(F.col("r"), F.col("plain")).alias("t")).first()["t"]
        return list(terms), prompt, response, response is None or list(terms) == plain

    def search(self, corpus_id: int, terms: list[str], k: int = TOP_K) -> DataFrame:
        """query_id (0), passage_id, score, rank, document_name, chunk_id, text; texts are joined after the cut to k."""
        index = self._index(corpus_id)
        rows = self.spark.createDataFrame([(0, t) for t in terms], "query_id bigint, term string")
        bag = retrieval.bag_of(rows)
        wanted = sorted(set(terms))
        postings = index.postings.where(F.col("term").isin(wanted))
        scores = retrieval.term_scores(bag, postings, index.terms.where(F.col("term").isin(wanted)), index.stats)
        best = retrieval.top_k(retrieval.passage_scores(scores), k)
        return F.broadcast(best).join(index.passages.select("passage_id", "document_name", "chunk_id", "text"), "passage_id").orderBy("rank")

    def _index(self, corpus_id: int) -> Index:
        index = self.corpora.open(corpus_id)
        if index is None:
            raise ValueError(f"corpus {corpus_id} has no index yet")
        return index

    def query(self, corpus_id: int, question: str, expand: bool = True) -> Answer:
        """One question through the whole pipeline, each stage logged unless the engine does not log."""
        begun, made = time.monotonic(), int(time.time())
        query_id = self.log.next_query() if self.logged else None
        took = lambda since: int((time.monotonic() - since) * 1000)
        answer, succeeded = Answer(None), 0

        def note(name: str, *row) -> None:
            if self.logged:
                self.log.write(name, query_id, *row)

        try:
            at = time.monotonic()
            terms, prompt, response, plain = self.formulate(question, expand, corpus_id)
            note("query_formulation_runs", len(terms), prompt, response, int(plain), " ".join(terms), took(at))
            if not terms:
                answer = Answer(NOTHING_TO_SEARCH)
                return answer
            at = time.monotonic()
            found = self.search(corpus_id, terms).collect()
            if self.logged:
                self.log.search(query_id, TOP_K, [(r["passage_id"], r["score"]) for r in found], took(at))
            if not found:
                answer = Answer(NOTHING_FOUND)
                return answer
            at = time.monotonic()
            prompt = passage_prompt(found, question)
            said = reply(self.model, [("user", prompt)])
            answer = Answer(said, "SEARCH", passage_sources(found))
            succeeded = int(said is not None)
            note("generation_runs", self.model.name, len(found), 0, prompt, said, succeeded, took(at))
            return answer
        finally:
            note("queries", question, made, took(begun), succeeded)

    def route(self, question: str, history: list[tuple[str, str]]) -> str:
        kept = newest_within(history, context.CONTEXT - context.ROUTE_RESERVE, self.model)
        ask = f'Say SEARCH if a passage may answer this, READ if it needs whole documents. One word.\n\nQuestion: "{question}"'
        said = reply(self.model, [*kept, ("user", ask)])
        return "READ" if said is not None and "READ" in said.upper() else "SEARCH"

    def contextualize(self, question: str, history: list[tuple[str, str]]) -> str:
        """The question made to stand alone; unchanged without history or reply."""
        kept = newest_within(history, context.CONTEXT - context.REWRITE_RESERVE, self.model)
        if not kept:
            return question
        return reply(self.model, [*kept, ("user", f'Put this question so that it stands alone. Question: "{question}"')]) or question

    def chat(self, corpus_id: int, session_id: int, question: str) -> Answer:
        """One turn of a chat: the question is stored first, the answer if there is one."""
        history = [("user" if r["is_user"] else "assistant", r["text"]) for r in self.chats.read(session_id).collect()]
        self.chats.append(session_id, True, question)
        answer = self._read(corpus_id, question, history) if self.route(question, history) == "READ" else self._search(corpus_id, question, history)
        if answer.text is not None:
            self.chats.append(session_id, False, answer.text, answer.sources or None)
        return answer

    def _search(self, corpus_id: int, question: str, history: list[tuple[str, str]]) -> Answer:
        terms, *_ = self.formulate(self.contextualize(question, history), expand=False, corpus_id=corpus_id)
        if not terms:
            return Answer(NOTHING_TO_SEARCH)
        found = self.search(corpus_id, terms).collect()
        if not found:
            return Answer(NOTHING_FOUND)
        return Answer(self._answer(passage_prompt(found, question), history), "SEARCH", passage_sources(found))

    def _answer(self, prompt: str, history: list[tuple[str, str]]) -> str | None:
        """The model's reply to prompt after the newest turns that it leaves room for."""
        used = self.model.count_tokens(prompt)
        room = 0 if used < 0 else max(0, context.CONTEXT - used - context.ANSWER_RESERVE)
        return reply(self.model, [*newest_within(history, room, self.model), ("user", prompt)])

    def _read(self, corpus_id: int, question: str, history: list[tuple[str, str]]) -> Answer:
        """Documents by name while they fit the budget; the sources name all of them, read or not."""
        budget = context.CONTEXT - context.DOCUMENT_RESERVE
        index = self.corpora.open(corpus_id)
        if index is None:
            return Answer(None, "READ")
        blocks = self._blocks(index.documents, budget)
        if not blocks:
            return Answer(None, "READ")
        said = self._answer(f"{context.DOCUMENT_HEAD}{''.join(blocks)}Question: {question}\n\nAnswer:", history)
        names = index.documents.select("document_name").orderBy("document_name")
        return Answer(said, "READ", [{"documentName": r["document_name"]} for r in names.toLocalIterator()])

    def _blocks(self, docs: DataFrame, budget: int) -> list[str]:
        """The first documents by name as prompt blocks, as many as fit. They are fetched a few more at a time, so that no
        texts beyond those are sorted or moved."""
        wanted = FETCHED
        while True:
            rows = docs.orderBy("document_name").limit(wanted).collect()
            used, blocks = 0, []
            for r in rows:
                n, text = max(0, self.model.count_tokens(r["text"])), r["text"]
                if used + n > budget:
                    if blocks:
                        return blocks
                    text = text.encode("utf-8")[: budget * context.BYTES_PER_TOKEN].decode("utf-8", "ignore")
                blocks.append(f"[Source: {r['document_name']}]\n{text}\n\n")
                used += n
                if used >= budget:
                    return blocks
            if len(rows) < wanted:
                return blocks
            wanted *= 4

    def evaluate(self, corpus_id: int, queries: DataFrame, qrels: DataFrame, expand: bool = False) -> DataFrame:
        """evaluation.summary over the whole query set, ranked in one job. With expand the model is asked for the terms of each
        judged question first, one after the other, as it is one model."""
        index = self._index(corpus_id)
        judged = queries.join(evaluation.evaluated_queries(queries, qrels).select("query_id"), "query_id", "left_semi")
        if expand and self.lexicon is not None:
            rows = [(r["query_id"], t) for r in judged.collect() for t in self.formulate(r["query_text"], True, corpus_id)[0]]
            kind = dict(queries.dtypes)["query_id"]
            bag = retrieval.bag_of(self.spark.createDataFrame(rows, f"query_id {kind}, term string"))
        else:
            bag = retrieval.bag_of(self._terms(corpus_id, judged))
        scores = retrieval.term_scores(bag, index.postings, index.terms, index.stats)
        ranked = retrieval.top_k(retrieval.passage_scores(scores), EVAL_K)
        named = ranked.join(index.passages.select("passage_id", "document_name"), "passage_id")
        return evaluation.summary(queries, qrels, named)
