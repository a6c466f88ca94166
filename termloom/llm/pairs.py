"""Prompt and response pairs that are no usable answer, with the type of defect.

Prompt and response are aligned word by word: shingle containment and the longest common subsequence find copies of the
question, alignment with refusal templates finds refusals (module refusals), further templates are learned from wordings
that recur over questions they share no word with, and the response's words outside the alignment tell its language.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import refusals
from termloom.session import cut_lineage, fits

WORD = re.compile(r"[^\W_]+")
QUESTION = re.compile(r'(?im)^\s*(?:user\s+)?question:\s*(.*?)\s*$')
THINK = re.compile(r"(?s)\A\s*<think>.*?</think>\s*")
LABEL = re.compile(r"\A[^\[{\"\n]*:\s*(?=[\[{])")

LANGUAGES = ("en", "de", "fr", "es")
#: At most so many labelled documents train the language model, on their whole texts.
SAMPLE_ROWS = 3000
#: A wording of SHINGLE words is a learned template if replies to at least so many different questions hold it.
SHINGLE, RECURS = 3, 5
#: Up to so many distinct words of responses go to every task, more are joined.
FEW_WORDS = 50_000
#: What spelling may say about one word, in nats; a word seen in responses is mostly judged by those.
SPELLING = 3.0


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one machine word per 64 words of a."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def containment(a: list[str], b: list[str], n: int = 3) -> float:
    """Share of a's n-word shingles that b holds."""
    k = min(n, len(a))
    if not k:
        return 0.0
    shingles = [tuple(a[i : i + k]) for i in range(len(a) - k + 1)]
    there = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
    return sum(s in there for s in shingles) / len(shingles)


def is_copy(question: list[str], answer: list[str]) -> bool:
    return len(question) > 1 and common_subsequence(question, answer) >= 0.95 * len(question) and containment(question, answer) >= 0.9


def hash_of(words: list[str]) -> str:
    return hashlib.md5(" ".join(words).encode()).hexdigest()


def _strings(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [s for v in value for s in _strings(v)]
    if isinstance(value, dict):
        return [s for v in value.values() for s in _strings(v)]
    return []


def _open_json(text: str) -> bool:
    """Whether text ends inside a string or a bracket."""
    depth, quoted, escaped = 0, False, False
    for c in text:
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
    return quoted or depth > 0


def read_response(response: str | None) -> tuple[list[str], bool, bool]:
    """(terms, cut off, prose) of a response in any of the accepted layouts.

    Layouts: a JSON array or object, bare, fenced or labelled, after a closed think block; or a plain list of terms that
    ends in a full stop. Members that are no strings are no terms.
    """
    if response is None:
        return [], False, False
    text = THINK.sub("", response).strip()
    if text.startswith("<think>"):
        return [], True, False
    if text.startswith("```"):
        text = re.sub(r"\A```[^\n\[{\"]*", "", text).strip()
        text = re.sub(r"\s*```\Z", "", text).strip()
    text = LABEL.sub("", text)
    if text[:1] in ("[", "{"):
        try:
            value, _ = json.JSONDecoder(strict=False).raw_decode(text)
            return [s for s in _strings(value) if words_of(s)], False, False
        except ValueError:
            if _open_json(text):
                return [], True, False
            found = [m for m in re.findall(r'"((?:[^"\\]|\\.)*)"', text) if words_of(m)]
            return found, False, False
    try:
        value = json.loads(text)
        return [s for s in _strings(value) if words_of(s)], False, False
    except ValueError:
        pass
    if not words_of(text):
        return [], False, False
    listed = [p for p in re.split(r"[,;\n]+", text) if words_of(p)]
    ended = bool(re.search(r"[.!?。]['\"”»)]*\Z", text)) or "\n" in text.strip() and "," not in text
    return listed, not ended, True


class LanguageModel:
    """Naive Bayes over words and their letter n-grams, each word of a language counted by its square root."""

    def __init__(self, counts: dict[str, Counter]):
        self.languages = [x for x in LANGUAGES if counts.get(x)]
        grams = {x: Counter() for x in self.languages}
        self.words = {x: counts[x] for x in self.languages}
        for x in self.languages:
            for w, c in counts[x].items():
                for g in self._grams(w):
                    grams[x][g] += math.sqrt(c)
        kinds = len({g for x in self.languages for g in grams[x]}) + 1
        self.gram_logs: dict[str, list[float]] = {}
        totals = {x: sum(grams[x].values()) + 0.5 * kinds for x in self.languages}
        for g in {g for x in self.languages for g in grams[x]}:
            self.gram_logs[g] = [math.log((grams[x][g] + 0.5) / totals[x]) for x in self.languages]
        self.unseen = [math.log(0.5 / totals[x]) for x in self.languages]
        self.word_totals = {x: sum(self.words[x].values()) + 1 for x in self.languages}
        self.cache: dict[str, list[float]] = {}

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]

    def _spelling(self, word: str) -> list[float]:
        """Log likelihood per language; the n-grams overlap, so each counts a third."""
        s = [0.0] * len(self.languages)
        for g in self._grams(word):
            for i, v in enumerate(self.gram_logs.get(g, self.unseen)):
                s[i] += v / 3
        if any(self.words[x][word] for x in self.languages):
            for i, x in enumerate(self.languages):
                s[i] += math.log((self.words[x][word] + 0.3) / self.word_totals[x])
        return s

    def scores(self, word: str) -> list[float]:
        """Evidence of a word's spelling for each language, relative to the strongest."""
        if word not in self.cache:
            if len(self.cache) > 200_000:
                self.cache = {}
            self.cache[word] = self.evidence(word, [0] * len(self.languages), [])
        return self.cache[word]

    def evidence(self, word: str, held: list[int], answered: list[int]) -> list[float]:
        """Evidence of a word for each language, relative to the strongest. held: how many of the answered runs of each
        language's questions have it in their responses.

        Most responses are good, so few wrong ones do not turn a word; shares of each language's runs are compared, so
        a rare language's words are not outvoted.
        """
        s, seen = self._spelling(word), sum(held)
        # the more responses hold a word, the less its spelling says
        s = [max(v - max(s), -SPELLING) * 5 / (5 + seen) for v in s]
        if seen:
            s = [v + math.log((h + 0.5) / (n + 50)) for v, h, n in zip(s, held, answered)]
        return [v - max(s) for v in s]

    def total(self, words: Iterable[str]) -> dict[str, float]:
        sums = dict.fromkeys(self.languages, 0.0)
        for w in words:
            for x, v in zip(self.languages, self.scores(w)):
                sums[x] += v
        return sums

    def language(self, words: list[str]) -> str | None:
        sums = self.total(words)
        return max(sums, key=lambda x: sums[x]) if sums and words else None


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most rows rows, those of the least hash of key. Keys above a hash that about rows of them stay below are
    dropped where they are read, and only keys are sorted, so no more than about rows keys meet, however many tasks there are."""
    total = df.count()
    span = 1 << 30
    below = span if total <= rows else span * rows // total
    near = df.where(F.pmod(F.xxhash64(key), F.lit(span)) < below)
    if total <= rows:
        return near
    chosen = near.select(key).orderBy(F.xxhash64(key), key).limit(rows)  # rows bounds it, so it may be broadcast
    return near.join(F.broadcast(chosen.distinct()), key, "left_semi")


def train_language_model(docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fitted on at most rows labelled documents (and repeats of their ids), those of the least hash of their id.

    Labels are taken in lower case. Wrong ones are put right by one round of the model's own judgement. Words are counted
    where the texts are; the driver gets the counts.
    """
    label = F.lower(F.trim("lang"))
    fit = docs.select("doc_id", label.alias("lang"), "text").where(label.isin(list(LANGUAGES)) & F.col("text").isNotNull())
    sample = cut_lineage(bounded_sample(fit, "doc_id", rows))

    def fitted(model: LanguageModel | None) -> LanguageModel:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                held: Counter = Counter()
                for lang, text in zip(batch["lang"], batch["text"]):
                    words = [w for w in words_of(text) if not w.isdigit()]
                    told = sent.value.language(words) if sent.value else None
                    held.update((told or lang, w) for w in words)
                yield pd.DataFrame([(x, w, n) for (x, w), n in held.items()], columns=["lang", "word", "n"])

        counts: dict[str, Counter] = {x: Counter() for x in LANGUAGES}
        for r in sample.select("lang", "text").mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
            counts[r["lang"]][r["word"]] = r["n"]
        return LanguageModel(counts)

    return fitted(fitted(None))


def own_words(question: list[str], terms: list[str]) -> list[str]:
    """The terms' words that the question lacks, without those that hold digits."""
    asked = set(question)
    return [w for t in terms for w in words_of(t) if w not in asked and not any(c.isdigit() for c in w)]


def question_of(prompt: str) -> list[str]:
    asked = QUESTION.findall(prompt)
    return words_of(asked[-1]) if asked else []


def _latin(word: str) -> bool:
    return all(ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00 for c in word)


def language_words(question: list[str], terms: list[str]) -> list[str]:
    """The distinct words that tell the language of a response; words of the question (names above all) and numbers do not."""
    return sorted(set(filter(_latin, own_words(question, terms))))


def other_script(question: list[str], terms: list[str]) -> bool:
    own = own_words(question, terms)
    return bool(own and question) and all(map(_latin, question)) and sum(not _latin(w) for w in own) * 2 > len(own)


def wordings(question: list[str], terms: list[str], sentences: bool) -> list[str] | None:
    """Runs of SHINGLE words of each clause (a shorter clause whole) of a reply in sentences that shares no word of more
    than three letters with the question; None for any other."""
    lone = len(terms) == 1 and terms[0].rstrip().endswith((".", "!"))
    clauses = [c for t in terms for c in refusals.clauses_of(t)]
    if not (sentences or lone) or not refusals.is_spoken(clauses) or {w for c in clauses for w in c if len(w) > 3} & set(question):
        return None
    return sorted({" ".join(c[i : i + SHINGLE]) for c in clauses for i in range(max(1, len(c) - SHINGLE + 1))})


def first_look(prompt: str, response: str | None, model: LanguageModel) -> tuple[str | None, int, list[str] | None, list[str] | None]:
    """(defect, language, words, wordings): a defect that the pair itself shows; else, where the model knows the question's
    language, its number and the response's words that are to be weighed against it, and what may recur over questions."""
    question = question_of(prompt)
    terms, cut_off, prose = read_response(response)
    if not terms and not cut_off:
        return "empty", -1, None, None
    answer = [w for t in terms for w in words_of(t)]
    whole = is_copy(question, answer)
    if cut_off and not (prose and whole):
        return "truncated", -1, None, None
    rest = Counter(answer)
    if whole:
        rest.subtract(question)
        left = [w for w in answer if rest[w] > 0]
        return "refusal" if refusals.declines(left) else "copy", -1, None, None
    if refusals.is_refusal(terms, prose, question):
        return "refusal", -1, None, None
    if other_script(question, terms):
        return "wrong_language", -1, None, None
    lang, words = model.language([w for w in question if not w.isdigit()]), language_words(question, terms)
    known = bool(lang and words)
    return None, model.languages.index(lang) if known else -1, words if known else None, wordings(question, terms, prose)


def defect_of(prompt: str, response: str | None, model: LanguageModel) -> str | None:
    return first_look(prompt, response, model)[0]


def learned_refusals(open_runs: DataFrame, recurs: int = RECURS) -> DataFrame:
    """run_id of distinct (run_id, asked, wordings) that consist of recurring wordings only: each stands in replies to at
    least recurs different questions. Replies are kept apart by what they hold, so no row needs another's."""
    each = open_runs.select("run_id", F.md5(F.concat_ws("|", "wordings")).alias("key"), "asked", F.size("wordings").alias("all"), F.explode("wordings").alias("wording"))
    known = each.select("wording", "asked").distinct().groupBy("wording").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= recurs)
    told = each.join(known, "wording", "left_semi").groupBy("run_id", "asked", "key", "all").agg(F.count(F.lit(1)).alias("n"))
    return told.where(F.col("n") == F.col("all")).select("run_id").distinct()


def answer_counts(runs: DataFrame, model: LanguageModel) -> DataFrame:
    """word, lang, n: how many runs of questions in the language of that number have the word in their responses; the
    empty word counts the runs. All runs with a prompt and a response that is no copy of the question count."""
    sent = runs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: Counter = Counter()
            for prompt, response in zip(batch["prompt_text"], batch["llm_response_text"]):
                question, (terms, _, _) = question_of(prompt), read_response(response)
                lang = sent.value.language(question)
                if lang is not None and not is_copy(question, [w for t in terms for w in words_of(t)]):
                    k = sent.value.languages.index(lang)
                    held.update((w, k) for w in ["", *language_words(question, terms)])
            yield pd.DataFrame([(w, k, n) for (w, k), n in held.items()], columns=["word", "lang", "n"])

    asked = runs.where("prompt_text IS NOT NULL AND llm_response_text IS NOT NULL").select("prompt_text", "llm_response_text")
    return asked.mapInPandas(count, "word string, lang int, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def word_evidence(counts: DataFrame, model: LanguageModel) -> DataFrame:
    """word, evidence (one figure a language) of every word of answer_counts; marked for broadcast only if few."""
    answered = [0] * len(model.languages)
    for r in counts.where("word = ''").collect():  # one row a language
        answered[r["lang"]] = r["n"]
    sent = counts.sparkSession.sparkContext.broadcast((model, answered))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sent.value[0].evidence(w, list(h), sent.value[1]) for w, h in zip(batch["word"], batch["held"])]
            yield pd.DataFrame({"word": batch["word"], "evidence": pd.Series(found, dtype=object)})

    held = F.array(*[F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)) for k in range(len(model.languages))])
    words = counts.where("word <> ''").groupBy("word").agg(held.alias("held"))
    weighed = words.mapInPandas(weigh, "word string, evidence array<double>")
    return F.broadcast(weighed) if fits(words, FEW_WORDS) else weighed


def wrong_languages(open_runs: DataFrame, evidence: DataFrame, languages: int, margin: float = 5.0) -> DataFrame:
    """run_id of distinct (run_id, lang, words) whose words belong to another language by margin."""
    each = open_runs.select("run_id", "lang", F.md5(F.concat_ws(" ", "words")).alias("key"), F.explode("words").alias("word"))
    sums = F.array(*[F.sum(F.col("evidence")[k]) for k in range(languages)])
    totals = each.join(evidence, "word").groupBy("run_id", "lang", "key").agg(sums.alias("sums"))
    return totals.where(F.array_max("sums") - F.col("sums")[F.col("lang")] > margin).select("run_id")


def broken_pairs(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """run_id, defect: distinct runs with a prompt and a bad response, one defect each, the first that applies.

    empty (null, or no term in it), truncated (stops before its end), refusal, copy (the whole wording of the question),
    wrong_language (terms not in the question's language). Stored flags are not looked at. Runs with a null
    prompt_text or run_id give no row; repeated rows give one. docs (doc_id, text, lang) trains the language model; with
    no labelled document only other scripts are found. What the responses' words say, and which wordings recur, is counted
    over all runs. Prompts and responses are read whole, twice.
    """
    model = train_language_model(docs)
    sent = runs.sparkSession.sparkContext.broadcast(model)
    kinds = {"defect": object, "lang": "int32", "words": object, "wordings": object}

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [first_look(p, r if isinstance(r, str) else None, sent.value) for p, r in zip(batch["prompt_text"], batch["llm_response_text"])]
            asked = [hash_of(question_of(p)) if f[3] else None for p, f in zip(batch["prompt_text"], found)]
            columns = {c: pd.Series([f[i] for f in found], dtype=t) for i, (c, t) in enumerate(kinds.items())}
            yield pd.DataFrame({"run_id": batch["run_id"], "asked": pd.Series(asked, dtype=object)} | columns)

    asked = runs.where("prompt_text IS NOT NULL AND run_id IS NOT NULL").select("run_id", "prompt_text", "llm_response_text")
    seen = asked.mapInPandas(look, "run_id bigint, asked string, defect string, lang int, words array<string>, wordings array<string>")
    seen = cut_lineage(seen.where("defect IS NOT NULL OR words IS NOT NULL OR wordings IS NOT NULL").distinct())
    learned = learned_refusals(seen.where("wordings IS NOT NULL"))
    settled = seen.where("defect IS NOT NULL").select("run_id", "defect").unionByName(learned.withColumn("defect", F.lit("refusal")))
    if not model.languages:
        return settled.distinct()
    evidence = word_evidence(cut_lineage(answer_counts(runs, model)), model)
    wrong = wrong_languages(seen.where("words IS NOT NULL"), evidence, len(model.languages)).join(learned, "run_id", "left_anti")
    return settled.unionByName(wrong.withColumn("defect", F.lit("wrong_language"))).distinct()
