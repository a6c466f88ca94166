import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from termloom.llm import pairs, refusals, splitting

sys.path.insert(0, str(Path(__file__).parent))
import refusal_wordings  # noqa: E402

TOKEN = re.compile(r"[A-Za-z0-9]+(?:['.,-][A-Za-z0-9]+)*")


def texts():
    random.seed(3)
    word = lambda: random.choice(["a", "ferry", "don't", "2.4-meter", "é", "—", "x_y", "Q.", "1,000", "z\n\nz", "end!", "why? ", "\n", "...", "日本"])
    made = [random.choice([" ", "", " "]).join(word() for _ in range(n)) for n in (0, 1, 5, 9, 10, 11, 30, 80, 200)]
    return made + ["", " ", "\n\n", None, "_-_" * 50, "a." * 400, "word " * 500, "far " * 15_000, "a_" * 300, ("Sentence here now. " * 9 + "\n\n") * 6, "x" * 5000]


@pytest.mark.parametrize("limit,overlap,body", [(10, 3, 1024), (10, 0, 1024), (7, 6, 1024), (1, 0, 1024), (320, 40, 1024), (100, 30, 16), (5000, 40, 1024)])
def test_round_trip_by_tokens(spark, monkeypatch, limit, overlap, body):
    monkeypatch.setattr(splitting, "MAX_BODY", body)
    made = texts()
    df = spark.createDataFrame([(i, t, "clash", 9) for i, t in enumerate(made)], "doc_id long, text string, chunk_id string, token_count int")
    got = {}
    for r in splitting.split_oversized(df, "doc_id", "text", limit, overlap).collect():
        got.setdefault(r["item_id"], []).append((r["chunk_id"], r["text"], r["token_count"]))
    for i, t in enumerate(made):
        pieces = sorted(got.get(i, []))
        if not t:
            assert not pieces
            continue
        n = len(TOKEN.findall(t))
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert all(c == len(TOKEN.findall(p)) <= limit for _, p, c in pieces)
        assert (len(pieces) > 1) == (n > limit)
        joined = pieces[0][1]
        for (_, before, _), (_, p, _) in zip(pieces, pieces[1:]):
            shared = next(k for k in range(min(len(before), len(p)), -1, -1) if before.endswith(p[:k]) and len(TOKEN.findall(p[:k])) == min(overlap, len(TOKEN.findall(before))) or k == 0)
            assert len(TOKEN.findall(p[:shared])) == min(overlap, len(TOKEN.findall(before)))
            joined += p[shared:]
        assert joined == t


def test_boundaries_and_characters(spark):
    one = lambda t, *a: [r["text"] for r in splitting.split_oversized(spark.createDataFrame([(1, t)], "i long, t string"), "i", "t", *a).orderBy("chunk_id").collect()]
    assert one("a b c d\n\ne f. g h i j", 6, 0) == ["a b c d\n\n", "e f. g h i j"]
    assert one("a b c d. e f g h", 6, 0) == ["a b c d. ", "e f g h"]
    assert one("a b c d\ne f g h", 6, 0) == ["a b c d\n", "e f g h"]
    for t in ("x" * 25, "ab cd. ef gh ij kl mn", "😀" * 25):
        pieces = one(t, 10, 3, "character")
        assert all(len(p) <= 10 for p in pieces) and pieces[0] + "".join(p[3:] for p in pieces[1:]) == t
    for bad in ((5, 5), (0, 0)):
        with pytest.raises(ValueError):
            splitting.pieces_of(F.lit("x"), *bad)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_alignment():
    random.seed(1)
    for _ in range(300):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 90))] for _ in range(2))
        assert pairs.common_subsequence(a, b) == brute_lcs(a, b)
    assert pairs.containment(list("abcd"), list("xabcd")) == 1.0 and pairs.containment([], ["a"]) == 0.0


QUESTION = "I am sorry to ask again: which estuary did Torskaby sell in 1782?"
PROMPT = f'Pick words.\n\nUser question: "{QUESTION}"\n\nTerm: "sorry"'
GOOD = ['["am", "ask", "estuary", "cannot open"]', "<think>hm.</think>\n[\n \"unable\"\n]", '```json\n["estuary", 7]\n```', 'Selected terms: ["sorry", "ask"]', "estuary, torskaby, sell."]
CASES = [
    ("empty", None), ("empty", ""), ("empty", "[ ]\n"), ("empty", "null"), ("empty", '""'), ("empty", "{}"), ("empty", "[null, 3]"), ("empty", "```\n```"), ("empty", "​"), ("empty", "<think>x</think>"),
    ("truncated", '["am", "ask", "est'), ("truncated", '["am",'), ("truncated", "<think>Let me"), ("truncated", '```json\n["a'), ("truncated", "The best words would be estuary and al"),
    ("refusal", "I'm sorry, but I can't help with that request."), ("refusal", '["I cannot assist with this."]'), ("refusal", '{"error": "I’m unable to comply with that."}'), ("refusal", "Dazu möchte ich keine Auskunft geben."),
    ("refusal", f"I cannot answer this. {QUESTION}"),
    ("copy", QUESTION), ("copy", QUESTION.lower().rstrip("?")), ("copy", '{"query": "%s"}' % QUESTION), ("copy", str(pairs.words_of(QUESTION)).replace("'", '"')),
    ("wrong_language", '["Torskaby", "мельница", "шлюз"]'), ("wrong_language", '["torskaby", "brücke", "fluss", "müller"]'),
]


def test_defects(spark):
    runs = [(i, PROMPT, r, 0) for i, (_, r) in enumerate(CASES)] + [(100 + i, PROMPT, g, 1) for i, g in enumerate(GOOD)] + [(200, None, None, 1), (None, PROMPT, None, 1), (0, PROMPT, None, 0)]
    df = spark.createDataFrame(runs, "run_id long, prompt_text string, llm_response_text string, used_fallback int").withColumn("defect", F.lit("clash"))
    docs = spark.createDataFrame(
        [(1, "en", "The estuary was sold and the keeper may open the bridge again"), (2, "DE", "Die Brücke über den Fluss und der Müller bei der Mühle"), (3, "fr", "le pont sur la rivière"), (4, None, "x"), (5, "es", "el puente sobre el río"), (6, "en", None)] * 3,
        "doc_id long, lang string, text string",
    )
    got = {r["run_id"]: r["defect"] for r in pairs.broken_pairs(df, docs).collect()}
    assert got == {i: d for i, (d, _) in enumerate(CASES)}
    assert pairs.broken_pairs(df.limit(0), docs).count() == 0
    assert pairs.broken_pairs(df, docs.limit(0)).where("defect = 'copy'").count() == 4


def test_refusals_of_other_wordings():
    told = lambda r: pairs.defect_of(PROMPT, r, pairs.LanguageModel({})) == "refusal"
    for wordings in (refusal_wordings.REFUSALS, refusal_wordings.SECOND):
        assert sum(map(told, wordings)) >= 0.9 * len(wordings) and len(wordings) >= 60
    good = refusal_wordings.GOOD + refusal_wordings.GOOD_TOO
    assert not any(map(told, good)) and len(good) >= 60
    assert not refusals.is_refusal([], True) and not refusals.declines([]) and refusals.aligned([], []) is False


def test_learned_refusals(spark):
    """Italian replies that no template covers: learned where they recur over different questions, in any order of clauses."""
    questions = ["sluice keeper", "estuary sale", "harbour toll", "bridge ledger", "mill race"]
    replies = ["Richiesta respinta, riprova dopo.", "Richiesta respinta, riprova dopo.", "Riprova dopo, richiesta respinta.", "richiesta respinta.", "riprova dopo."]
    assert not any(refusals.is_refusal([r], True) for r in replies)
    rows = [(f"User question: {q}", r) for q in questions for r in replies] + [("User question: weir gate", "gate weir lock."), ("User question: weir gate", "Un altro discorso.")]
    rows += [(f"User question: {questions[0]}", "solo una domanda.")] * 9
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "run_id long, prompt_text string, llm_response_text string")
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert {tuple(r) for r in pairs.broken_pairs(df, docs).collect()} == {(i, "refusal") for i in range(25)}


@pytest.mark.parametrize("few", [50_000, 10])
def test_every_run_counts_for_the_language(spark, monkeypatch, few):
    if hasattr(pairs, "FEW_WORDS"):
        monkeypatch.setattr(pairs, "FEW_WORDS", few)
    name = lambda g: "".join("bdfghklmnp"[int(c)] for c in f"{g:04}")
    en, de = "the keeper of the river", "der wärter von dem fluss"
    runs, wrong = [], set()
    for g in range(1000):
        own = str([name(g) + c for c in "vwxyz"]).replace("'", '"')
        wrong.add(len(runs))
        for question, response in [(en, own)] + [(de, own)] * 10 + [(en, f'["{name(g)}q"]')] * 4:
            runs.append((len(runs), f"User question: {question}", response))
    docs = spark.createDataFrame([(1, "en", en), (2, "de", de)], "doc_id long, lang string, text string")
    df = spark.createDataFrame(runs, "run_id long, prompt_text string, llm_response_text string")
    assert {tuple(r) for r in pairs.broken_pairs(df, docs).collect()} == {(i, "wrong_language") for i in wrong}


def test_long_response():
    model = pairs.LanguageModel({})
    assert pairs.defect_of(PROMPT, '["' + "a" * 1_000_000 + '"]', model) is None
    assert pairs.defect_of("no question here", '["a"]', model) is None


def test_held_out_language(spark):
    words = {"en": "the of and water house river bridge keeper stone light under over storage measure harbour winter", "de": "der die und wasser haus fluss brücke wärter stein licht unter über lager messung hafen winter", "fr": "le la et eau maison rivière pont gardien pierre lumière sous sur entrepôt mesure port hiver", "es": "el la y agua casa río puente guardián piedra luz bajo sobre almacén medida puerto invierno"}
    random.seed(2)
    rows = [(i, x, " ".join(random.choices(w.split()[:13], k=30))) for i, (x, w) in enumerate(list(words.items()) * 20)]
    model = pairs.train_language_model(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert sum(model.language(w.split()[13:] + random.choices(w.split(), k=3)) == x for x, w in words.items()) == 4
