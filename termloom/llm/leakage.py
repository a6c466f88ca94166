"""Held-out items that occur, wholly or partly, in a corpus.

Seeds are runs of words of an item. For edited copies every three-gram of an item is one: which of them an edit spared
cannot be told from the corpus, least of all where another document holds the item unedited, and an alignment of 12 or more
equal words at identity 0.8 or more always has an unbroken run of three (m equal words and at most m / 4 other columns leave
m / 4 + 1 runs; from 13 words on, one has four). For unbroken runs alone, of each run of consecutive five-grams that a shared
stretch must contain, the item keeps its rarest in the corpus, so no shared stretch of min_run words is missed while common
phrases seed nothing. Seeds join passages of the corpus to items; where enough of the passage's words are the item's, a
Smith-Waterman alignment of words scores the pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a seed for unbroken runs, and for edited copies at identity 0.8 or more.
SEED, SHORT_SEED = 5, 3
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile("[A-Za-z0-9]+")
#: Items are taken in blocks of about so many characters in all, by a hash of their ids; a block's seeds go to every task.
BLOCK = 4_000_000
RESULT = "item_id bigint, doc_id bigint, longest_run int, score int, identity double, item_share double"


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text or "")]


def grams(words: list[str], n: int = SEED) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def rare_seeds(words: list[str], frequency: dict[str, int], min_run: int) -> set[int]:
    """Positions of five-grams that together meet every run of min_run words: of each min_run - 4 consecutive ones, the
    rarest that the corpus has; the first on a tie. A short item keeps its rarest."""
    g = grams(words)
    span = max(1, min_run - SEED + 1)
    weights = [frequency.get(x) or float("inf") for x in g]
    return {min(range(i, min(i + span, len(g))), key=lambda j: (weights[j], j)) for i in range(max(1, len(g) - span + 1)) if g}


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """(score, matches, aligned columns, longest run of equal words) of the best local alignment of two word id arrays.

    The run is the longest anywhere in the two, not only on the alignment. Each cell carries the matches and columns of
    the way to it, so no more than one row is kept, however long the two are.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0, 0, 0, 0
    at = np.arange(m + 1)
    score, matches, columns = (np.zeros(m + 1, dtype=np.int64) for _ in range(3))
    run, longest, best = np.zeros(m + 1, dtype=np.int64), 0, (0, 0, 0)
    for word in a:
        same = b == word
        run[1:] = np.where(same, run[:-1] + 1, 0)
        longest = max(longest, int(run.max()))
        across, down = score[:-1] + np.where(same, MATCH, MISMATCH), score[1:] + GAP
        ahead = across >= down
        value = np.where(ahead, across, down)
        live = value > 0
        row = np.concatenate(([0], np.where(live, value, 0)))
        row_matches = np.concatenate(([0], np.where(live, np.where(ahead, matches[:-1] + same, matches[1:]), 0)))
        row_columns = np.concatenate(([0], np.where(live, np.where(ahead, columns[:-1], columns[1:]) + 1, 0)))
        # gaps along the row: the best of all earlier cells, less what the way to here costs; the nearest of equals
        reached = np.maximum.accumulate((row - GAP * at) * (m + 1) + at)
        origin = reached % (m + 1)
        score, matches, columns = reached // (m + 1) + GAP * at, row_matches[origin], row_columns[origin] + at - origin
        if score.max() > best[0]:
            j = int(score.argmax())
            best = int(score[j]), int(matches[j]), int(columns[j])
    return *best, longest


def dense(member: np.ndarray, least: int, identity: float) -> bool:
    """Whether some stretch has at least least members and no smaller share of them than identity: what an alignment of as
    many equal words at that identity needs."""
    held = np.concatenate(([0], np.cumsum(member)))
    sums = held - identity * np.arange(len(held))
    lowest = np.minimum.accumulate(sums)
    upto = np.searchsorted(held, held - least, side="right") - 1
    return bool(((upto >= 0) & (sums - lowest[np.maximum(upto, 0)] >= -1e-9)).any())


def _regions(positions: list[int], reach: int, n: int, seed: int) -> list[tuple[int, int]]:
    """Word ranges within reach of the seed hits, joined where they meet."""
    out: list[tuple[int, int]] = []
    for p in sorted(positions):
        lo, hi = max(0, p - reach), min(n, p + seed + reach)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _ids(words: list[str], known: dict[str, int]) -> np.ndarray:
    return np.array([known.get(w, -1) for w in words], dtype=np.int32)


def _pairs(doc_id: int, words: list[str], seeds: dict[str, list[int]], items: dict[int, list[str]], min_run: int, min_identity: float | None):
    size = SEED if min_identity is None else SHORT_SEED
    hits: dict[int, list[int]] = {}
    for p, g in enumerate(grams(words, size)):
        for item in seeds.get(g, ()):
            hits.setdefault(item, []).append(p)
    for item, positions in hits.items():
        other = items[item]
        known = {w: k for k, w in enumerate(dict.fromkeys(other))}
        a = _ids(other, known)
        best, longest = (0, 0, 1), 0
        for lo, hi in _regions(positions, len(other), len(words), size):
            for at in range(lo, hi, 4096):  # long regions in overlapping stretches, each wide enough for the item
                b = _ids(words[at : min(hi, at + 4096 + 2 * len(other))], known)
                if not dense(b >= 0, min_run, 1.0 if min_identity is None else min_identity):
                    continue
                score, matches, columns, run = align(a, b)
                longest = max(longest, run)
                best = max(best, (score, matches, columns))
        identity = best[1] / max(1, best[2])
        if longest >= min_run or (min_identity is not None and best[1] >= min_run and identity >= min_identity):
            yield item, doc_id, longest, best[0], round(identity, 6), round(best[1] / len(other), 6)


def _frequency(corpus: DataFrame, wanted: set[str]) -> dict[str, int]:
    """In how many texts each of the wanted five-grams occurs; those in none are left out."""
    sent = corpus.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [g for t in batch["text"] for g in sent.value.intersection(grams(words_of(t)))]
            yield pd.DataFrame({"gram": found}, dtype=object)

    counted = corpus.select("text").mapInPandas(count, "gram string").groupBy("gram").count()
    return {r["gram"]: r["count"] for r in counted.collect()}  # no more than the block's five-grams


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_run: int = 12, min_identity: float | None = 0.8
) -> DataFrame:
    """item_id, doc_id, longest_run, score, identity, item_share for each document that holds an item or part of it.

    longest_run is the longest run of consecutive equal words; score, identity and item_share come from the best local
    alignment (match 2, mismatch and gap -1). A pair is kept with longest_run of at least min_run, or with at least
    min_run aligned equal words at min_identity or more (edited copies; other documents do not matter to them). Nothing is
    lost down to an identity of 0.8; below, a copy needs one run of three words left. With a min_identity of None only unbroken
    runs are looked for. Words are lower-cased runs of ASCII letters and digits. Null and empty texts, null ids and items
    of fewer words than a seed give no pairs; repeated rows give repeated pairs of a document and one pair of an item. Whole texts
    are read, one document at a time.

    Items are taken in blocks of about BLOCK characters, by a hash of their ids; each block goes to all tasks, whatever the
    number of items. The documents are read once per block to align, and for unbroken runs alone once before, to count in
    how many each item's five-grams occur.
    """
    spark = docs.sparkSession
    if min_run < SEED:
        raise ValueError(f"min_run must be at least {SEED}")
    corpus = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    held = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-(held.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK))
    out = spark.createDataFrame([], RESULT)
    for k in range(blocks):
        block = held if blocks == 1 else held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        named: dict[int, list[str]] = {}
        for r in block.collect():  # a block of the stated query set, not the corpus
            named.setdefault(r["item_id"], words_of(r["text"]))
        chosen = {item: set(grams(w, SHORT_SEED)) for item, w in named.items()}
        if min_identity is None:
            chosen = {item: set(grams(w)) for item, w in named.items()}
            frequency = _frequency(corpus, set().union(*chosen.values()))
            chosen = {item: {g for g in map(grams(w).__getitem__, rare_seeds(w, frequency, min_run)) if g in frequency} for item, w in named.items()}
        seeds: dict[str, list[int]] = {}
        for item, found in chosen.items():
            for g in found:
                seeds.setdefault(g, []).append(item)
        sent = spark.sparkContext.broadcast((seeds, named))

        def pairs(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            seeds, named = sent.value
            columns = [c.split()[0] for c in RESULT.split(", ")]
            for batch in batches:
                rows = [p for d, t in zip(batch["doc_id"], batch["text"]) for p in _pairs(int(d), words_of(t), seeds, named, min_run, min_identity)]
                yield pd.DataFrame(rows, columns=columns)

        out = out.unionByName(corpus.mapInPandas(pairs, RESULT))
    return out
