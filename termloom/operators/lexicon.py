"""Lemmas and related words, as joins against a lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.sources.lexicon import POS

#: Detachment rules in the order they are tried, as published for the lexicon format (suffix, ending).
RULES: tuple[tuple[str, str], ...] = (
    ("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
    ("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""),
    ("er", ""), ("est", ""), ("er", "e"), ("est", "e"),
)


def lemma_map(vocabulary: DataFrame, lemmas: DataFrame, exceptions: DataFrame) -> DataFrame:
    """term, lemma for each distinct non-null term of vocabulary.

    An exception's base wins, unchecked; among several the first by file, then line. Else the first rule whose result is
    a known lemma; else the term itself. Works on the vocabulary, never on occurrences.
    """
    terms = vocabulary.select("term").where("term IS NOT NULL").distinct()
    first = exceptions.groupBy(F.col("inflected").alias("term")).agg(F.min_by("base", F.struct("file_rank", "line_no")).alias("irregular"))
    tried = F.array(
        *[
            F.when(F.col("term").endswith(suffix), F.concat(F.expr(f"left(term, length(term) - {len(suffix)})"), F.lit(end)))
            for suffix, end in RULES
        ]
    )
    candidates = terms.select("term", F.posexplode(tried).alias("rank", "candidate")).where("candidate IS NOT NULL AND candidate <> ''")
    known = candidates.join(lemmas.select(F.col("lemma").alias("candidate")).distinct(), "candidate", "left_semi")
    regular = known.groupBy("term").agg(F.min_by("candidate", "rank").alias("regular"))
    return terms.join(first, "term", "left").join(regular, "term", "left").select("term", F.coalesce("irregular", "regular", "term").alias("lemma"))


def related_words(words: DataFrame, synsets: DataFrame, lemmas: DataFrame) -> DataFrame:
    """word, synonyms, hypernyms, hyponyms for each distinct word that the lexicon lists.

    Synonyms are the other members of the word's synsets (the word itself is told by exact case), hypernyms and hyponyms
    the members of synsets one pointer away in the same part of speech. Each list keeps the order of part of speech,
    sense, pointer and member, and the first of equal entries.
    """
    rank = F.create_map(*[F.lit(x) for i, p in enumerate(POS) for x in (p, i)])
    asked = words.select(F.col("word").alias("lemma")).where("lemma IS NOT NULL").distinct()
    senses = asked.join(lemmas, "lemma").join(synsets, ["pos", "offset"]).withColumn("pos_rank", rank[F.col("pos")])
    own = senses.select("lemma", "pos_rank", "sense_rank", F.lit("synonyms").alias("kind"), F.lit(0).alias("pointer_rank"), F.posexplode("words").alias("word_rank", "other"))
    parts = [own.where(F.col("other") != F.col("lemma"))]
    target = synsets.select("pos", F.col("offset").alias("to"), F.col("words").alias("members"))
    for kind in ("hypernyms", "hyponyms"):
        steps = senses.select("lemma", "pos", "pos_rank", "sense_rank", F.lit(kind).alias("kind"), F.posexplode(kind).alias("pointer_rank", "to"))
        parts.append(
            steps.join(target, ["pos", "to"]).select("lemma", "pos_rank", "sense_rank", "kind", "pointer_rank", F.posexplode("members").alias("word_rank", "other"))
        )
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = F.struct("pos_rank", "sense_rank", "pointer_rank", "word_rank", "other")
    lists = rows.groupBy("lemma").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("kind") == k, order))).alias(k) for k in ("synonyms", "hypernyms", "hyponyms")]
    )
    listed = senses.select("lemma").distinct().join(lists, "lemma", "left")

    def plain(k: str):
        return F.array_distinct(F.transform(F.coalesce(F.col(k), F.array().cast(listed.schema[k].dataType)), lambda x: x["other"])).alias(k)

    return listed.select(F.col("lemma").alias("word"), plain("synonyms"), plain("hypernyms"), plain("hyponyms"))
