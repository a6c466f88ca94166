import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import leakage, packing, spans

SMALL = packing.Capacity(100, 8, 100.0 * 100)


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
def test_best_fit_respects_every_capacity(rule):
    random.seed(6)
    for capacity in (SMALL, packing.Capacity(100, 3, 2500.0)):
        sizes = np.array([random.choice([0, 1, 7, 30, 55, 100]) for _ in range(400)])
        placed = packing.best_fit(sizes, capacity, rule)
        for c in set(placed):
            own = sizes[placed == c]
            assert own.sum() <= capacity.tokens and len(own) <= capacity.documents
            assert len(own) == 1 or (own.astype(float) ** 2).sum() <= capacity.attention
    sizes = np.array([random.randint(1, 60) for _ in range(3000)])
    placed = packing.best_fit(sizes, packing.Capacity(100, 100, 1e4), rule)
    assert sizes.sum() / 100 / (placed.max() + 1) > (0.97 if rule == "residual_norm" else 0.9)
    assert len(packing.best_fit(np.array([], dtype=int), SMALL, rule)) == 0


def test_default_attention_capacity_binds():
    own = packing.Capacity()
    assert own.attention < own.tokens**2
    for sizes, containers in (([1024, 1024], 1), ([1400, 600], 2), ([1500, 100], 2), ([2048], 1), ([1200, 400, 400], 1)):
        placed = packing.best_fit(np.array(sizes), own)
        assert sum(sizes) <= own.tokens and len(set(placed)) == containers, sizes


def test_pack_places_everything(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 60)
    random.seed(7)
    rows = [(i, random.choice([0, 3, 20, 45, 70, 100, 101, 250, None])) for i in range(300)] + [(5, 20), (None, 7), ((1 << 60) + 1, 9)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("shard", F.lit("clash")).withColumn("piece", F.lit(1))
    out = packing.pack(df, SMALL).collect()
    whole = {}
    for r in out:
        whole.setdefault(r["container_id"], []).append(r["token_end"] - r["token_start"])
    assert all(sum(v) <= 100 and len(v) <= 8 for v in whole.values())
    assert sum(map(sum, whole.values())) == sum(t or 0 for _, t in rows)
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out if r["token_start"] == 0) == sorted(-1 if d is None else d for d, _ in rows)
    assert all(r["token_start"] == r["piece"] * 100 for r in out)
    size = dict(rows)
    assert all((size[r["doc_id"]] or 0) > 100 for r in out if r["piece"] > 0)
    assert packing.pack(df.limit(0), SMALL).count() == 0
    found = lambda c, z: {r["check_name"] for r in packing.violations(c, z, SMALL, 0.8).where("violations > 0").collect()}
    made = spark.createDataFrame(out)
    assert found(made, df) == set() and found(made.limit(0), df.limit(0)) == set()
    assert found(made.where("doc_id <> 4"), df) >= {"document_missing"} and found(made, df.where("doc_id <> 4")) >= {"document_unknown"}
    assert found(made.withColumn("container_id", F.lit(1)), df) >= {"over_tokens", "over_documents", "over_attention"}
    assert found(made.withColumn("container_id", F.monotonically_increasing_id()), df) >= {"room_left"}
    assert found(made.where("NOT (doc_id = 3 AND piece = 0)").unionByName(made.where("doc_id = 3 AND piece = 0").withColumn("token_end", F.col("token_end") + 1)), df) >= {"tokens_lost"}


def test_shards_have_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 100)
    df = spark.range(2000).selectExpr("id AS doc_id", "id % 37 AS tokens")
    out = packing.pack(df, packing.Capacity(100, 5, 4000.0))
    assert {r["violations"] for r in packing.violations(out, df, packing.Capacity(100, 5, 4000.0), 0.6).collect()} == {0}
    assert out.where("container_id < (1L << 56)").select(F.shiftright("container_id", 24)).distinct().count() > 10


def test_pack_refuses_other_rules(spark):
    df = spark.createDataFrame([(1, 2)], "doc_id long, tokens long")
    with pytest.raises(ValueError):
        packing.pack(df, SMALL, "first_fit")


def test_token_sizes(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, "hello hello"), (2, ""), (3, None), (4, "-" * 20_000), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.document_sizes(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 100 and got[5] > 1


def words(t):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", t or "")]


def longest_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, max(row))
    return best


def test_leaks_against_brute_force(spark, monkeypatch):
    random.seed(8)
    common = "the ferry at the quay was seen by".split()
    draw = lambda n: [random.choice(common + [f"w{random.randint(0, 400)}"]) for _ in range(n)]
    items = [(i, " ".join(draw(random.choice([3, 12, 20, 60])))) for i in range(30)] + [(90, None), (91, ""), (None, "x y z")]
    items += [items[4], (92, items[5][1])]
    docs = []
    for d in range(120):
        w = draw(random.choice([0, 5, 40, 150]))
        if d % 2:
            v = words(items[random.randrange(30)][1])
            at = random.randint(0, max(0, len(v) - 12))
            w[len(w) // 2 : len(w) // 2] = v[at : at + random.choice([8, 11, 12, 13, 60])]
        docs.append((d, (" ", ", ", "\n")[d % 3].join(w).upper() if d % 5 == 0 else " ".join(w), "clash"))
    docs += [(200, None, ""), (201, "", ""), (202, " ".join(words(items[3][1]) + draw(9000) + words(items[3][1])), ""), docs[1]]
    a = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    expect = {(i, d): longest_run(words(t), words(x)) for i, t in items if i is not None for d, x, _ in docs}
    expect = {k: v for k, v in expect.items() if v >= 12}
    for block in (4_000_000, 900):
        monkeypatch.setattr(leakage, "BLOCK", block)
        got = {(r["item_id"], r["doc_id"]): r["longest_run"] for r in leakage.leaked_items(a, b).where("longest_run >= 12").collect()}
        assert got == expect
    assert leakage.leaked_items(a.limit(0), b).count() == 0 and leakage.leaked_items(a, b.limit(0)).count() == 0


def plain_alignment(a, b):
    """(score, matches, columns) by the whole matrix and a way back through it."""
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, matches, columns = int(h[i, j]), 0, 0
    while h[i, j] > 0:
        columns += 1
        if h[i, j] == h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
            matches += a[i - 1] == b[j - 1]
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, matches, columns


def test_alignment_against_the_whole_matrix():
    random.seed(12)
    for _ in range(150):
        a, b = ([random.randint(0, 5) for _ in range(random.randint(1, 30))] for _ in range(2))
        got = leakage.align(np.array(a), np.array(b))
        assert got[:3] == plain_alignment(a, b) and got[3] == longest_run(a, b)


EDITS = {
    "every fifth word": lambda i, w: ["other"] if i % 5 == 4 else [w],
    "every sixth left out": lambda i, w: [] if i % 6 == 5 else [w],
    "a word put in after every fifth": lambda i, w: [w, "extra"] if i % 5 == 4 else [w],
    "one in seven": lambda i, w: ["other"] if random.random() < 1 / 7 else [w],
    "one in twelve of three kinds": lambda i, w: random.choice([["other"], [], [w, "extra"]]) if random.random() < 1 / 12 else [w],
    "one in four": lambda i, w: ["other"] if random.random() < 1 / 4 else [w],
}


def test_recall_of_edited_copies(spark):
    """Against the alignment of every item with every document: nothing of identity 0.8 is lost, also beside unedited copies."""
    random.seed(13)
    common = "the ferry at the quay was seen by".split()
    items = [[random.choice(common) if random.random() < 0.3 else f"w{random.randint(0, 900)}" for _ in range(random.choice([16, 29, 36, 60]))] for _ in range(24)]
    docs = []
    for w in items:
        for edit in EDITS.values():
            around = [random.choice(common + [f"v{random.randint(0, 900)}"]) for _ in range(40)]
            docs.append(around[:20] + [x for i, v in enumerate(w) for x in edit(i, v)] + around[20:])
    docs += items
    expect = set()
    for k, a in enumerate(items):
        names = {w: i for i, w in enumerate(dict.fromkeys(a))}
        for d, b in enumerate(docs):
            _, matches, columns, run = leakage.align(leakage._ids(a, names), leakage._ids(b, names))
            if run >= 12 or (matches >= 12 and matches / columns >= 0.8):
                expect.add((k, d))
    a = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]) for r in leakage.leaked_items(a, b).collect()}
    assert len(expect) > 100 and got == expect


def test_edited_copy_is_found(spark):
    item = [f"k{i}" for i in range(40)]
    edited = [w if i % 9 else "other" for i, w in enumerate(item)]
    a = spark.createDataFrame([(1, " ".join(["x"] * 30 + edited))], "doc_id long, text string")
    row = leakage.leaked_items(a, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).first()
    assert row["longest_run"] == 8 and row["identity"] > 0.8 and row["item_share"] > 0.8


def test_edited_copies_are_found_beside_an_exact_one(spark):
    item = [f"k{i}" for i in range(40)]
    docs = {n: [w if i % n != n - 1 else "other" for i, w in enumerate(item)] for n in (7, 8, 10, 12)} | {100: item, 101: item}
    items = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")

    def leaks(ids, **options):
        a = spark.createDataFrame([(d, " ".join(["x"] * 30 + docs[d])) for d in ids], "doc_id long, text string")
        return {r["doc_id"]: tuple(r) for r in leakage.leaked_items(a, items, **options).collect()}

    for d in (7, 8, 10, 12):
        alone, beside = leaks([d]), leaks([d, 100, 101])
        assert set(beside) == {d, 100, 101} and beside[d] == alone[d]
        assert beside[d][2] == d - 1 and beside[d][4] >= 0.8
    assert set(leaks(docs, min_identity=None)) == {100, 101}


def test_alignment_score():
    def brute(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        return max(map(max, h))

    random.seed(9)
    for _ in range(150):
        a, b = (np.array([random.randint(0, 4) for _ in range(random.randint(0, 25))]) for _ in range(2))
        got = leakage.align(a, b)
        assert got[0] == brute(a, b) and got[3] == (longest_run(list(a), list(b)) if len(a) and len(b) else 0)


def test_rare_seeds_meet_every_run():
    random.seed(10)
    for n in (0, 4, 5, 11, 12, 13, 40):
        w = [f"w{i}" for i in range(n)]
        seeds = leakage.rare_seeds(w, {g: random.randint(0, 5) for g in leakage.grams(w)}, 12)
        assert all(any(s <= k <= s + 7 for k in seeds) for s in range(n - 11))


def corpus():
    random.seed(11)
    sentence = lambda: " ".join("".join(random.choices("abcdefgh", k=random.randint(1, 9))) for _ in range(random.randint(4, 25))).capitalize() + random.choice([". ", "! ", ".\n", " "])
    para = lambda n: "".join(sentence() for _ in range(n))
    shared = [para(6) for _ in range(6)] + ["".join(random.choices("xyz ä€😀", k=450)), "=" * 500, "ab" * 300]
    docs = []
    for d in range(60):
        t = para(random.randint(0, 8))
        for _ in range(d % 3):
            s = random.choice(shared)
            at, n = random.randint(0, 40), random.choice([380, 399, 400, 401, 430, 600])
            t += s[at : at + n] + para(1)
        docs.append((d, t))
    docs += [(100, docs[8][1]), (101, docs[8][1]), (102, None), (103, ""), (104, "short"), (105, shared[0][:400]), (106, "q" + shared[0][:400]), (107, shared[0][:399]), docs[8], (None, docs[8][1])]
    return docs


def test_sharing_by_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1, "clash") for d, t in docs], "doc_id long, text string, start int, span string")
    at = {}
    for d, t in docs:
        for i in range(len(t or "") - 399):
            at.setdefault(t[i : i + 400], set()).add(d)
    groups = [sorted(x for x in g if x is not None) for g in at.values()]
    expect = {(a, b) for g in groups for i, a in enumerate(g) for b in g[i + 1 :]}
    assert len(expect) > 20
    got = [tuple(r) for r in spans.sharing_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == expect
    assert spans.sharing_pairs(df.limit(0)).count() == 0

    share = {r["doc_id"]: r for r in spans.shared_share(df).collect()}
    known = dict((d, t) for d, t in docs if d is not None)
    for d, t in known.items():
        for name, test in (("shared_chars", lambda g: len(g - {None}) > 1), ("repeated_chars", lambda g, d=d: min(g - {None}) < d)):
            covered = set()
            for i in range(len(t or "") - 399):
                if test(at[t[i : i + 400]]):
                    covered.update(range(i, i + 400))
            assert share[d][name] == len(covered), (d, name)
    stripped = {r["doc_id"]: (r["text"], r["removed_sentences"]) for r in spans.without_repeats(df).collect()}
    assert set(stripped) == set(known)
    for d, t in known.items():
        if share[d]["repeated_chars"] == 0:
            assert stripped[d] == (t, 0)
        elif share[d]["repeated_chars"] == len(t):
            assert stripped[d][0] == ""
        assert len(stripped[d][0] or "") >= len(t or "") - share[d]["repeated_chars"] - 40


def test_run_length_guards():
    with pytest.raises(ValueError):
        spans.run_length(200)
    assert "".join(m.group() for m in spans.SENTENCE.finditer("A b. C?\nd e. 3.5 f")) == "A b. C?\nd e. 3.5 f"
