"""Text-analysis Column builders.

Every builder returns a native Column, so the work stays in the JVM and Catalyst sees it.
Nulls: a null text gives an empty array (or a null scalar, where stated).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII letters and digits, continued by one inner ' - . or , between two of them.
#: Possessive: nothing after a token can make it give characters back, and long tokens need no recursion.
TOKEN = "[A-Za-z0-9]++(?:['.,-][A-Za-z0-9]++)*+"
#: The same token for engines without possessive quantifiers (the SQL oracles).
TOKEN_PLAIN = "[A-Za-z0-9]+(?:['.,-][A-Za-z0-9]+)*"
MAX_TOKEN = 255

#: English function words, the default stop list. A stop file can replace it, see sources.lexicon.
STOPWORDS: tuple[str, ...] = tuple(
    """a about above after again against all am an and any are as at be because been before being below between
    both but by can did do does doing don't down during each few for from further had has have having he her here
    hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of
    off on once only or other our ours ourselves out over own same she should so some such than that the their
    theirs them themselves then there these they this those through to too under until up very was we were what
    when where which while who whom why will with would you your yours yourself yourselves""".split()
)


def tokenize(text: Column) -> Column:
    """Lower-cased tokens in order, repeats kept, each cut to 255 characters; null gives no tokens."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(raw, lambda t: F.lower(F.substring(t, 1, MAX_TOKEN)))


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)))


def has_more_tokens_than(text: Column, limit: int) -> Column:
    """Whether text holds more than limit tokens, reading no further than token limit + 1.

    A text of n tokens has at least 2n - 1 characters, so short texts are settled by their length.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    pattern = f"\\A(?:[^A-Za-z0-9]*+{TOKEN}){{{limit + 1}}}+"
    long_enough = F.length(text) >= 2 * limit + 1
    return F.coalesce(long_enough & text.rlike(pattern), F.lit(False))


def drop_stopwords(terms: Column, stop: Sequence[str] = STOPWORDS) -> Column:
    """Members of stop leave; order and repeats stay."""
    if not stop:
        return terms
    listed = list(stop)
    return F.filter(terms, lambda t: ~t.isin(listed))


def split_words(text: Column) -> Column:
    """Words between runs of space, tab, CR and LF; punctuation stays on its word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\r\\n]+"), lambda w: w != "")


def join_words(words: Column, start: int | Column, end: int | Column) -> Column:
    """words[start:end] joined by single spaces, end exclusive."""
    s = start if isinstance(start, Column) else F.lit(start)
    e = end if isinstance(end, Column) else F.lit(end)
    return F.array_join(F.slice(words, s + 1, F.greatest(e - s, F.lit(0))), " ")


def check_chunking(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"chunk size {size} with overlap {overlap}: need 0 <= overlap < size")


def chunk_count(n_words: Column, size: int, overlap: int) -> Column:
    """Windows start at 0 and every size - overlap words, until one reaches the end; no words give none."""
    check_chunking(size, overlap)
    more = F.ceil((n_words - size) / F.lit(float(size - overlap))).cast("int") + 1
    return F.when(n_words <= 0, 0).when(n_words <= size, 1).otherwise(more)


def chunk_words(words: Column, size: int, overlap: int) -> Column:
    """Array of chunk texts; element i is chunk i."""
    n = chunk_count(F.size(words), size, overlap)
    step = size - overlap
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))
    return F.when(n > 0, windows).otherwise(F.array().cast("array<string>"))


def contains_ignore_case(text: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.upper(text), F.lit(needle.upper())), F.lit(False))


def strip_think(reply: Column) -> Column:
    """Drops one leading, closed think block and the white space after it; anything else stays."""
    return F.regexp_replace(reply, "\\A<think>(?s:.*?)</think>[\\n\\r \\t]*", "")


def iso_timestamp(ts: Column) -> Column:
    """Instant as ISO-8601 in UTC with microseconds; the session time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def chat_title(text: Column) -> Column:
    """Trimmed text; above 60 characters its first 60, trimmed, and three dots."""
    whole = F.trim(text)
    return F.when(F.length(whole) > 60, F.concat(F.trim(F.substring(whole, 1, 60)), F.lit("..."))).otherwise(whole)


def leading_int(text: Column) -> Column:
    """The integer at the start of text, after white space; 0 where there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), "^\\s*([+-]?[0-9]{1,18})", 1)
    return F.when(found == "", 0).otherwise(found.cast("bigint")).cast("int")
