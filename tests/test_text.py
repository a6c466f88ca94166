import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import text as T

ALNUM = string.ascii_letters + string.digits


def scanned(text):
    """The token rule, character by character."""
    out, i = [], 0
    while i < len(text):
        if text[i] not in ALNUM:
            i += 1
            continue
        j = i
        while j < len(text) and (text[j] in ALNUM or text[j] in "'-.," and j + 1 < len(text) and text[j + 1] in ALNUM):
            j += 1
        out.append(text[i:j].lower()[:255])
        i = j
    return out


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "text string").select(expr.alias("x")).first()["x"]


def many(spark, expr, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, text string").select("i", expr.alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


CASES = ["Plain, punctuated. Text!", "a  b\t\nc", "", "?!.", "don't", "the cat's", "state-of-the-art", "2.4-meter", "1,000", "End.", "'quoted'", "x" * 300, "café", "a--b", "snake_case", "a.-b", None]


def test_tokenize_cases(spark):
    assert many(spark, T.tokenize(F.col("text")), CASES) == [scanned(c or "") for c in CASES]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZ9'-., é_\n", max_size=40), min_size=1, max_size=60))
def test_tokenize_fuzz(spark, texts):
    assert many(spark, T.tokenize(F.col("text")), texts) == [scanned(t) for t in texts]


def test_more_tokens_than(spark):
    texts = ["a " * n for n in (0, 1, 4, 5, 6, 50)] + ["a.b.c " * 5, "a.b.c " * 6, None]
    assert many(spark, T.has_more_tokens_than(F.col("text"), 5), texts) == [False, False, False, False, True, True, False, True, False]


def test_stopwords_keep_order_and_repeats(spark):
    assert one(spark, T.drop_stopwords(T.tokenize(F.col("text")), ["the"]), "the cat the dog cat") == ["cat", "dog", "cat"]


def test_split_words(spark):
    assert one(spark, T.split_words(F.col("text")), " a,\tb\r\n c\x0bd ") == ["a,", "b", "c\x0bd"]
    assert one(spark, T.join_words(T.split_words(F.col("text")), 1, 3), "a b c d") == "b c"
    assert one(spark, T.join_words(T.split_words(F.col("text")), 2, 2), "a b c d") == ""


@pytest.mark.parametrize("size,overlap", [(5, 2), (3, 0), (4, 3), (200, 40)])
def test_chunks(spark, size, overlap):
    def brute(words):
        out, start = [], 0
        while words:
            out.append(" ".join(words[start : start + size]))
            if start + size >= len(words):
                break
            start += size - overlap
        return out

    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(25)]
    assert many(spark, T.chunk_words(T.split_words(F.col("text")), size, overlap), texts) == [brute(t.split()) for t in texts]
    counts = many(spark, T.chunk_count(F.size(T.split_words(F.col("text"))), size, overlap), texts)
    assert counts == [len(brute(t.split())) for t in texts]


@pytest.mark.parametrize("size,overlap", [(0, 0), (3, 3), (3, 4)])
def test_chunk_parameters(size, overlap):
    with pytest.raises(ValueError):
        T.check_chunking(size, overlap)


def test_replies_and_titles(spark):
    strip = T.strip_think(F.col("text"))
    assert many(spark, strip, ["<think>x\ny</think>\n a", "<think>x", "a <think>b</think>", ""]) == ["a", "<think>x", "a <think>b</think>", ""]
    assert many(spark, T.chat_title(F.col("text")), [" short ", "x" * 61, "y" * 60]) == ["short", "x" * 60 + "...", "y" * 60]
    assert many(spark, T.leading_int(F.col("text")), ["1", " -2x", "x", None, "+3"]) == [1, -2, 0, 0, 3]
    assert many(spark, T.contains_ignore_case(F.col("text"), "read"), ["READ", "I'd reAd", "no", None]) == [True, True, False, False]
