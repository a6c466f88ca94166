"""Oversized texts cut into pieces under a limit, at natural boundaries, with overlap.

One regular expression walks a text: its alternatives are ordered by the strength of the boundary they end at
(paragraph, sentence, line, word), each takes as many units as the bound of its quantifier allows, and the last one
cuts between any two units. The overlap is looked back from the bodies before a piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import TOKEN, has_more_tokens_than, token_count

SEP = "[^A-Za-z0-9]"
UNIT = f"{SEP}*+{TOKEN}"
#: A body takes a boundary only if it is at least 1/FILL full, else weaker boundaries come first.
FILL = 2
#: The quantifiers recurse once a token inside the regex engine. A larger budget is made of several bodies of at most so
#: many tokens, each cut at a natural boundary.
MAX_BODY = 1024


def token_bodies(budget: int) -> str:
    """Pattern whose matches tile a text; each holds at most budget tokens."""
    least = max(1, budget // FILL)
    full, any_ = f"(?:{UNIT}){{{least},{budget}}}", f"(?:{UNIT}){{1,{budget}}}"
    marks = "[^\\sA-Za-z0-9]*+"
    return "|".join(
        (
            f"(?:{UNIT}){{0,{budget}}}+{SEP}*+\\z",
            f"{full}{SEP}*?\\n[ \\t\\r]*\\n\\s*+",
            f"{full}(?=[^\\sA-Za-z0-9]*[.!?]){marks}\\s++",
            f"{full}{marks}[ \\t\\r]*+\\n\\s*+",
            f"{any_}{marks}\\s++",
            any_,
        )
    )


def character_bodies(budget: int) -> str:
    """The same with characters as units; the last alternative cuts between any two characters."""
    least = max(1, budget // FILL)
    full = f"[\\s\\S]{{{least},{budget}}}"
    return "|".join(
        (
            f"[\\s\\S]{{1,{budget}}}\\z",
            f"{full}(?<=\\n\\n)",
            f"{full}(?<=[.!?]\\s)",
            f"{full}(?<=\\n)",
            f"[\\s\\S]{{1,{budget}}}(?<=\\s)",
            f"[\\s\\S]{{1,{budget}}}",
        )
    )


def _tail(piece: Column, overlap: int, unit: str) -> Column:
    """The last overlap units of a piece, up to its end."""
    if unit == "character":
        return F.substring(piece, F.greatest(F.length(piece) - overlap, F.lit(0)) + 1, F.lit(overlap))
    units = F.regexp_extract_all(piece, F.lit(f"{TOKEN}{SEP}*+"), F.lit(0))
    return F.array_join(F.slice(units, F.greatest(F.size(units) - overlap, F.lit(0)) + 1, F.lit(overlap)), "")


def _units(text: Column, unit: str) -> Column:
    return F.length(text) if unit == "character" else token_count(text)


def pieces_of(text: Column, limit: int, overlap: int, unit: str = "token") -> Column:
    """Array of piece texts: the text itself if it is within the limit, else bodies, each led by the tail of the text before it."""
    if not 0 <= overlap < limit or unit not in ("token", "character"):
        raise ValueError(f"limit {limit}, overlap {overlap}, unit {unit!r}: need 0 <= overlap < limit")
    budget = limit - overlap
    joined = -(-budget // MAX_BODY) if unit == "token" else 1
    pattern = token_bodies(budget // joined) if unit == "token" else character_bodies(budget)
    few = unit == "token" and limit <= MAX_BODY
    oversized = has_more_tokens_than(text, limit) if few else _units(text, unit) > limit
    bodies = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda b: b != "")

    def before(parts: Column, i: Column, reach: int) -> Column:
        """Up to reach bodies before body i, as one text."""
        start = F.greatest(i - reach, F.lit(0))
        return F.array_join(F.slice(parts, start + 1, i - start), "")

    def led(parts: Column, i: Column) -> Column:
        body = F.array_join(F.slice(parts, i + 1, F.lit(joined)), "")
        if not overlap:
            return body
        # bodies are at least 1 / FILL full where boundaries are near; each holds one unit at least
        near = before(parts, i, -(-overlap * FILL // max(1, budget // joined)) + 1)
        tail = F.when(_units(near, unit) >= overlap, _tail(near, overlap, unit)).otherwise(_tail(before(parts, i, overlap), overlap, unit))
        return F.concat(F.when(i == 0, F.lit("")).otherwise(tail), body)

    # a lambda's argument stands for the array, so that the pattern runs once a text
    listed = F.transform(F.array(bodies), lambda parts: F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(joined)), lambda i: led(parts, i)))
    return F.when(oversized, listed[0]).when(F.length(text) > 0, F.array(text))


def split_oversized(
    df: DataFrame, item_id: str, text: str, limit: int = 320, overlap: int = 40, unit: str = "token"
) -> DataFrame:
    """item_id, chunk_id, text, token_count: pieces of every item, in order from chunk 0.

    Every piece has at most limit units; leading overlaps removed, the pieces of an item tile its text. Consecutive
    pieces share exactly overlap units, fewer only where the text so far has fewer. A text within the limit is one
    piece, unchanged; null and empty texts give none. Repeated rows give repeated pieces. Texts of any length are read
    whole. Columns other than the two named are not looked at, so their names cannot clash.
    """
    items = df.select(F.col(item_id).alias("item_id"), F.posexplode(pieces_of(F.col(text), limit, overlap, unit)))
    return items.select("item_id", F.col("pos").alias("chunk_id"), F.col("col").alias("text"), token_count(F.col("col")).alias("token_count"))
