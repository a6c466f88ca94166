"""Long spans that occur verbatim in more than one text.

Texts are cut where sentences start and, where none does for a while, at positions that the characters around choose
(the least hash of a sliding window). The cuts depend on nearby characters only, so a span that two texts share is cut
alike in both. Every run of consecutive sentences of enough length is hashed and joined globally; only texts that hold a
repeated run are looked at again, and there windows of exactly the wanted length are compared.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import cut_lineage, small_side, stored

#: Characters hashed at a cut, and the widest stretch without a cut.
GRAM, GAP = 8, 64
#: Characters before a position that decide whether a sentence starts there.
BEFORE = 2
#: Up to so many ids of texts with repeated runs are broadcast; more meet the texts in a shuffled join.
SMALL = 500_000

BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)|[.!?]+|\n|$)\s*")


def run_length(min_chars: int) -> int:
    """Least length of a run, so that each shared span of min_chars holds one that is cut alike in all its texts.

    The first cut lies within BEFORE + GAP of the span's start, the run's last cut within GAP beyond its least length,
    and what decides about it within GAP + GRAM more.
    """
    length = min_chars - 3 * GAP - GRAM
    if length <= GAP + BEFORE:
        raise ValueError(f"min_chars must exceed {4 * GAP + GRAM + BEFORE}")
    return length


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, np.uint64(b), dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each window of width elements; len(a) - width + 1 results."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a = op(a[:-step], a[step:])
        done += step
    return a


def runs(text: str, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every run: from each cut to the first cut at least least characters on."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(c)
    m = n - GRAM + 1
    if m < 2 * GAP:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    key = _mix((total[GRAM:] - total[:m]) * down[:m]) >> np.uint64(1)
    starts = np.zeros(n, dtype=bool)
    ended = (c == 0x2E) | (c == 0x21) | (c == 0x3F)
    starts[2:] = (ended[:-2] & (c[1:-1] <= 0x20)) | (c[1:-1] == 0x0A)
    key[~starts[:m]] |= np.uint64(1 << 63)
    least_near = _sliding(key, GAP, np.minimum)
    padded = np.concatenate((np.zeros(GAP - 1, np.uint64), least_near, np.zeros(GAP - 1, np.uint64)))
    cuts = np.flatnonzero(_sliding(padded, GAP, np.maximum) == key)
    last = np.searchsorted(cuts, cuts + least)
    whole = last < len(cuts)
    a, b = cuts[whole], cuts[last[whole]]
    hashes = _mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    return a.astype(np.int64), hashes.view(np.int64)


def _texts(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """doc_id, text, same, text_hash: texts long enough to share a span; same (128 bits) tells exact copies."""
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return named.where("doc_id IS NOT NULL").where(F.length("text") >= min_chars).withColumns(
        {"same": F.unhex(F.md5("text")), "text_hash": F.xxhash64("text")}
    )


def _frames(rows: Iterator[tuple], columns: tuple[str, ...], size: int) -> Iterator[pd.DataFrame]:
    """Frames of at most size rows, so that what a batch of long texts turns into needs no more memory than that."""
    while part := list(itertools.islice(rows, size)):
        yield pd.DataFrame(part, columns=list(columns))


def _occurrences(texts: DataFrame, live: tuple[DataFrame, DataFrame], min_chars: int) -> DataFrame:
    """doc_id, run, before_run, start, ahead, around: every place of a repeated run, with the characters from up to a cut's
    reach ahead of it to min_chars on. before_run names the run of the cut before and how far off it is, 0 where there is none.
    Stored, as it is read more than once."""
    least, reach = run_length(min_chars), GAP + BEFORE

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for d, t in zip(batch["doc_id"], batch["text"]):
                    starts, hashes = runs(t, least)
                    earlier = np.zeros(len(starts), dtype=np.uint64)
                    earlier[1:] = _mix(hashes.view(np.uint64)[:-1] + np.diff(starts).astype(np.uint64)) | np.uint64(1)
                    for p, h, e in zip(starts.tolist(), hashes.tolist(), earlier.view(np.int64).tolist()):
                        lo = max(0, p - reach)
                        yield d, h, e, p, p - lo, t[lo : p + min_chars]

        yield from _frames(rows(), ("doc_id", "run", "before_run", "start", "ahead", "around"), 10_000)

    reps, repeated = live
    again = texts.join(reps.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    rows = again.mapInPandas(near, "doc_id bigint, run bigint, before_run bigint, start bigint, ahead int, around string")
    return stored(rows.join(repeated, "run", "left_semi"))


def _windows(places: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, start, before, span: every window of min_chars characters that begins within a cut's reach of a place.

    span names the window's characters (128 bits); before is the character ahead of it, -1 at the start of a text, -2 if
    it is not known here.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for d, p, ahead, t in zip(batch["doc_id"], batch["start"], batch["ahead"], batch["around"]):
                    for at in range(len(t) - min_chars + 1):
                        before = ord(t[at - 1]) if at else (-1 if p == ahead else -2)
                        yield d, p - ahead + at, before, xxhash.xxh3_128_digest(t[at : at + min_chars].encode("utf-8", "surrogatepass"))

        yield from _frames(rows(), ("doc_id", "start", "before", "span"), 100_000)

    return places.select("doc_id", "start", "ahead", "around").mapInPandas(cut, "doc_id bigint, start bigint, before int, span binary")


def _live(texts: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, same) of the texts that hold a run which a different text holds too, under the smallest id of their
    exact copies; and those runs. Both are written to the shared folder: they are read more than once."""
    least = run_length(min_chars)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(runs(t, least)[1]) for t in batch["text"]]
            counts = [len(f) for f in found]
            yield pd.DataFrame({"run": np.concatenate(found) if found else np.empty(0, np.int64), "text_hash": np.repeat(batch["text_hash"].to_numpy(), counts)})

    rows = stored(texts.select("text_hash", "text").mapInPandas(hashed, "run bigint, text_hash bigint"))
    shared = rows.groupBy("run").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").select("run")
    held = cut_lineage(rows.join(shared, "run", "left_semi").distinct())
    first = texts.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"))
    reps = cut_lineage(first.join(held.select("text_hash").distinct(), "text_hash", "left_semi").select("doc_id", "same"))
    return small_side(reps, SMALL), held.select("run").distinct()


def shared_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 400) -> DataFrame:
    """span, doc_id, start, before, first_doc: windows of min_chars characters held by at least two different texts.

    Exact copies are one text here, under their smallest doc_id. first_doc is the smallest doc_id with the window.
    """
    texts = _texts(docs, doc_id, text, min_chars)
    windows = _windows(_occurrences(texts, _live(texts, min_chars), min_chars), min_chars).distinct()
    held = windows.groupBy("span").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return windows.join(held.where("first_doc <> last_doc").select("span", "first_doc"), "span")


def representative_pairs(texts: DataFrame, min_chars: int) -> DataFrame:
    """rep_a, rep_b (rep_a < rep_b), distinct: different texts, each under the smallest doc_id of its exact copies, that
    share a span.

    A run that has the same run at the same distance before it wherever it occurs begins no shared span: what holds it
    holds the run before too. Only windows by the other runs are compared. Of those, spans that continue to the left in all
    their texts are dropped before pairs are made, since the span one character earlier has the same texts: what is left
    starts where texts part.
    """
    places = _occurrences(texts, _live(texts, min_chars), min_chars)
    earlier = places.groupBy("run").agg(F.min("before_run").alias("a"), F.max("before_run").alias("b"))
    first = places.join(earlier.where("a <> b OR a = 0").select("run"), "run", "left_semi")
    # a window's context may begin at the cut's reach; the same window seen from another cut knows its character before
    seen = stored(_windows(first, min_chars).groupBy("span", "doc_id", "start").agg(F.max("before").alias("before")))
    held = seen.groupBy("span").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("before").alias("least"), F.max("before").alias("most")
    )
    parting = held.where("a <> b AND (least < 0 OR least <> most)").select("span")
    holders = seen.join(parting, "span", "left_semi").select("span", "doc_id").distinct()
    other = holders.select("span", F.col("doc_id").alias("rep_b"))
    return holders.withColumnRenamed("doc_id", "rep_a").join(other, "span").where("rep_a < rep_b").select("rep_a", "rep_b").distinct()


def _members(texts: DataFrame) -> DataFrame:
    """doc_id, rep, n: each document, the smallest doc_id of its exact copies and how many these are."""
    members = texts.select("same", "doc_id").distinct()
    return members.join(members.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "same").select("doc_id", "rep", "n")


def sharing_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 400) -> DataFrame:
    """doc_id_a, doc_id_b (a < b), distinct: documents whose texts both hold one span of at least min_chars characters.

    Code points are compared as they are. Null ids, null texts and texts below min_chars share nothing; repeated rows
    count once; a document does not pair with itself. An empty table gives no rows. Spans need no natural boundary.

    Pairs are found between different texts and written out for their exact copies at the end; sharing_classes gives the
    same without that.
    """
    texts = _texts(docs, doc_id, text, min_chars)
    reps = representative_pairs(texts, min_chars)
    several = _members(texts).where("n > 1").select("rep", "doc_id")
    a, b = several.select("rep", F.col("doc_id").alias("doc_id_a")), several.select("rep", F.col("doc_id").alias("doc_id_b"))
    within = a.join(b, "rep").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
    # a text without copies has no row in several and stands for itself
    left = reps.join(a.withColumnRenamed("rep", "rep_a"), "rep_a", "left").join(b.withColumnRenamed("rep", "rep_b"), "rep_b", "left")
    x, y = F.coalesce("doc_id_a", "rep_a"), F.coalesce("doc_id_b", "rep_b")
    across = left.select(F.least(x, y).alias("doc_id_a"), F.greatest(x, y).alias("doc_id_b"))
    return across.unionByName(within)


def sharing_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 400) -> DataFrame:
    """doc_id, class_id, copies, links for every document with an id: the smallest doc_id with exactly its text, how many
    documents have it, and how many different other texts share a span of at least min_chars with it.

    Texts below min_chars and null ones are classes of their own, without links. No pair of copies is written out.
    """
    texts = _texts(docs, doc_id, text, min_chars)
    pairs = stored(representative_pairs(texts, min_chars))
    both = pairs.select(F.col("rep_a").alias("rep")).unionByName(pairs.select(F.col("rep_b").alias("rep")))
    links = both.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    everyone = docs.select(F.col(doc_id).cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    placed = everyone.join(_members(texts), "doc_id", "left").join(links, "rep", "left")
    return placed.select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("n", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def shared_share(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 400) -> DataFrame:
    """doc_id, n_chars, shared_chars, repeated_chars, is_copy for every document with an id.

    shared_chars counts the characters inside spans of at least min_chars that another document holds too,
    repeated_chars those inside spans that a document with a smaller doc_id holds (of an exact copy that is not the
    first, all of them). is_copy: another document has exactly this text of at least min_chars. Null texts count as empty.
    """
    texts = _texts(docs, doc_id, text, min_chars)
    windows = shared_windows(docs, doc_id, text, min_chars).select("doc_id", "start", (F.col("first_doc") < F.col("doc_id")).alias("later"))

    def covered(rows: DataFrame, name: str) -> DataFrame:
        following = F.lead("start").over(Window.partitionBy("doc_id").orderBy("start"))
        length = F.least(F.lit(min_chars), F.coalesce(following - F.col("start"), F.lit(min_chars)))
        return rows.withColumn("length", length).groupBy("doc_id").agg(F.sum("length").cast("bigint").alias(name))

    of_rep = covered(windows, "shared").join(covered(windows.where("later"), "repeated"), "doc_id", "left").withColumnRenamed("doc_id", "rep")
    members = texts.select("same", "doc_id").distinct()
    copies = members.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    placed = members.join(copies, "same").join(of_rep, "rep", "left").select("doc_id", "rep", "n", "shared", "repeated")
    everyone = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"))
    zero, is_copy = F.lit(0).cast("bigint"), F.coalesce(F.col("n") > 1, F.lit(False))
    return everyone.where("doc_id IS NOT NULL").distinct().join(placed, "doc_id", "left").select(
        "doc_id",
        "n_chars",
        F.when(is_copy, F.col("n_chars")).otherwise(F.coalesce("shared", zero)).alias("shared_chars"),
        F.when(F.col("rep") < F.col("doc_id"), F.col("n_chars")).otherwise(F.coalesce("repeated", zero)).alias("repeated_chars"),
        is_copy.alias("is_copy"),
    )


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 400) -> DataFrame:
    """doc_id, text, removed_sentences: texts without the sentences that lie inside a span of an earlier document.

    A sentence goes if all its characters lie in spans of at least min_chars that a smaller doc_id holds; the first
    occurrence always stays, and a later exact copy of a text of at least min_chars keeps nothing. Shorter and null texts
    stay as they are, with 0 removed.
    """
    texts = _texts(docs, doc_id, text, min_chars)
    later = shared_windows(docs, doc_id, text, min_chars).where("first_doc < doc_id").select("doc_id", "start").distinct()
    begun = F.coalesce(F.col("start") - F.lag("start").over(Window.partitionBy("doc_id").orderBy("start")) > min_chars, F.lit(True))
    group = F.sum(F.when(begun, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("start"))
    stretches = later.withColumn("g", group).groupBy("doc_id", "g").agg(F.min("start").alias("lo"), (F.max("start") + min_chars).alias("hi"))
    listed = stretches.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    members = texts.select("same", "doc_id").distinct()
    copies = members.groupBy("same").agg(F.min("doc_id").alias("rep"))
    repeats = members.join(copies, "same").where("rep < doc_id").select("doc_id", F.lit(True).alias("copy"))

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept, removed = [], []
            for t, spans, copy in zip(batch["text"], batch["spans"], batch["copy"]):
                k, r = remove_covered(t, spans, bool(copy))
                kept.append(k)
                removed.append(r)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": kept, "removed_sentences": removed})

    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    joined = named.join(listed, "doc_id", "left").join(repeats, "doc_id", "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    return joined.select("doc_id", "text", "spans", "copy").mapInPandas(strip, "doc_id bigint, text string, removed_sentences int")


def remove_covered(text: str | None, spans, copy: bool) -> tuple[str | None, int]:
    if text is None or (spans is None and not copy):
        return text, 0
    parts = [m for m in SENTENCE.finditer(text) if m.end() > m.start()]
    if copy:
        return "", len(parts)
    inside = [(s["lo"], s["hi"]) for s in spans]
    kept, removed = [], 0
    for m in parts:
        end = m.start() + len(m.group().rstrip())
        if end > m.start() and any(lo <= m.start() and end <= hi for lo, hi in inside):
            removed += 1
        else:
            kept.append(m.group())
    return "".join(kept), removed
