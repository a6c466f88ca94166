import io
import zipfile

import pytest
from pyspark.sql import functions as F

from termloom import cli
from termloom.plans import logs
from termloom.plans.corpora import Corpora, CorpusError
from termloom.plans.engine import NOTHING_FOUND, NOTHING_TO_SEARCH, Engine
from termloom.plans.model import NoModel, newest_within
from termloom.sources import files, strict_csv, tables
from termloom.sources.lexicon import read_stopwords
from termloom.streaming import incremental

GOOD = {
    "a,b\n1,2\n": ["1 2"],
    'a,b\n"x,y","p\nq"\n': ["x,y p\nq"],
    'a\n"say ""hi"""\n': ['say "hi"'],
    "a,b,c\n1,,3": ["1  3"],
    "a,b\n": [],
    "a,b\r\n1,2\r\n\r\n3,4\r": ["1 2", "3 4"],
    "a,b\n,\n": [" "],
    'a\n"7"': ["7"],
}
BAD = ["", "a,b\n1\n", "a,b\n1,2,3\n", 'a\n"open\n', 'a\nx"y\n', 'a\n"x"y\n', "\n\n"]


@pytest.mark.parametrize("text", GOOD)
def test_strict_csv(text):
    assert strict_csv.documents(text) == GOOD[text]


@pytest.mark.parametrize("text", BAD)
def test_strict_csv_rejects(text):
    with pytest.raises(strict_csv.Malformed):
        strict_csv.documents(text)


def docx(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = f"<w:document {NS}><w:body><w:p><w:r><w:t>Hel</w:t></w:r><w:r><w:t>lo</w:t></w:r><w:r><w:delText>gone</w:delText></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
HEADER = f"<w:hdr {NS}><w:p><w:r><w:t>top</w:t></w:r></w:p></w:hdr>"


def test_file_formats(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("plain")
    (tmp_path / "b.csv").write_text("h,i\n1,2\n3,4\n")
    (tmp_path / "bad.csv").write_text("h\n1,2\n")
    (tmp_path / "c.docx").write_bytes(docx({"word/document.xml": BODY, "word/header1.xml": HEADER}))
    (tmp_path / "empty.docx").write_bytes(docx({"word/document.xml": f"<w:document {NS}/>"}))
    (tmp_path / "nozip.docx").write_bytes(b"x")
    (tmp_path / "d.pdf").write_bytes(b"page")
    (tmp_path / "e.png").write_bytes(b"scan")
    (tmp_path / "f.xyz").write_bytes(b"x")
    (tmp_path / "g.txt").write_text(" \n")
    read = files.read_files(spark, str(tmp_path), {"pdf": lambda b: b.decode(), "image": lambda b: ""})
    rows = {r["document_name"]: (r["status"], r["text"]) for r in read.collect()}
    assert rows["a.TXT"] == ("ok", "plain") and rows["b.csv#row2"] == ("ok", "3 4") and rows["d.pdf"] == ("ok", "page")
    assert rows["c.docx"] == ("ok", "Hello\ncell\ntop")
    assert {n: rows[n][0] for n in ("bad.csv", "empty.docx", "nozip.docx", "e.png", "f.xyz", "g.txt")} == {
        "bad.csv": "malformed", "empty.docx": "malformed", "nozip.docx": "malformed", "e.png": "no_text", "f.xyz": "skipped", "g.txt": "no_text",
    }
    counts = {r["status"]: (r["files"], r["documents"]) for r in files.outcomes(read).collect()}
    assert counts["ok"] == (4, 5) and counts["malformed"] == (3, 3)
    assert files.pages_text([" a ", "", "b"]) == "a\nb"


def test_bulk_round_trip(spark, tmp_path):
    rows = [("a#row1", 'q "x" \\ y'), ("b#row1", "two\nlines"), ("c#row1", "")]
    tables.write_bulk(spark.createDataFrame(rows, "document_name string, text string"), str(tmp_path / "out"))
    assert {tuple(r) for r in tables.read_bulk(spark, str(tmp_path / "out")).collect()} == set(rows)
    for bad in ("a\tb\nc\n", "a\tb\tc\n", "a\t\n"):
        (tmp_path / "bad.tsv").write_text(bad)
        with pytest.raises(Exception):
            tables.read_bulk(spark, str(tmp_path / "bad.tsv")).collect()


def test_eval_files(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("1\twhat\tis\nno tab\n")
    (tmp_path / "r.tsv").write_text("query-id\tcorpus-id\tscore\n1\tx\t1\n1\ty\t0z\nbad\n1\tq\tnone\n")
    assert [tuple(r) for r in tables.read_eval_queries(spark, str(tmp_path / "q.tsv")).collect()] == [("1", "what\tis")]
    assert {tuple(r) for r in tables.read_qrels(spark, str(tmp_path / "r.tsv")).collect()} == {("1", "x", 1), ("1", "y", 0), ("1", "q", 0)}
    (tmp_path / "w.txt").write_text("whole\ntext\x00gone")
    assert [tuple(r) for r in tables.read_whole_files(spark, str(tmp_path / "w.txt")).collect()] == [("w.txt", "whole\ntext")]
    (tmp_path / "s.txt").write_text("# c\n\nthe\na\n" + "x" * 70 + "\n")
    assert read_stopwords(spark, str(tmp_path / "s.txt")) == ("a", "the", "x" * 63)


def docs(spark, *rows):
    return spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(rows)], "document_name string, text string, row_num int")


def test_corpora(spark, tmp_path):
    corpora = Corpora(spark, str(tmp_path))
    with pytest.raises(CorpusError):
        corpora.create("  ")
    a, b = corpora.create("same"), corpora.create("same")
    assert [r["schema_name"] for r in corpora.list().collect()] == ["corpus_1", "corpus_2"]
    assert corpora.open(a) is None and corpora.documents(a).count() == 0
    assert corpora.rebuild(a, docs(spark, ("x", "old ferry"), ("y", "stone quay")))["passages"] == 2
    corpora.rebuild(a, docs(spark, ("x", "new lighthouse"), ("z", "third"), ("z", "ignored")))
    assert {tuple(r) for r in corpora.documents(a).collect()} == {("x", "new lighthouse"), ("y", "stone quay"), ("z", "third")}
    assert corpora.open(b) is None
    before = {tuple(r) for r in corpora.documents(a).collect()}
    failing = docs(spark, ("q", "x")).withColumn("text", F.when(F.lit(True), F.raise_error(F.lit("boom"))).cast("string"))
    with pytest.raises(Exception):
        corpora.rebuild(a, failing)
    assert {tuple(r) for r in corpora.documents(a).collect()} == before
    corpora.delete(a)
    with pytest.raises(CorpusError):
        corpora.open(a)
    with pytest.raises(CorpusError):
        corpora.delete(a)


class Echo(NoModel):
    name = "echo"

    def __init__(self, said):
        self.said, self.seen = said, []

    def complete(self, turns, prefill=None):
        self.seen.append(turns)
        return self.said


def test_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), Echo("<think>hm</think>\nfine"))
    c = engine.corpora.create("one")
    engine.corpora.rebuild(c, docs(spark, ("x", "ferry and quay"), ("y", "quay quay stone")))
    answer = engine.query(c, "where is the ferry?", expand=False)
    assert answer.text == "fine" and [s["documentName"] for s in answer.sources] == ["x"]
    assert engine.query(c, "what is it?").text == NOTHING_TO_SEARCH and engine.query(c, "zebra").text == NOTHING_FOUND
    log = {n: t.read().count() for n, t in engine.log.tables.items()}
    assert log == {"queries": 3, "query_formulation_runs": 3, "search_runs": 2, "search_results": 1, "generation_runs": 1}
    assert engine.log.tables["search_results"].read().first()["rank"] == 1
    s = engine.chats.create(c, "t")
    assert engine.chat(c, s, "quay?").tool == "SEARCH"
    engine.model = Echo("READ")
    assert engine.chat(c, s, "sum up").tool == "READ"
    assert [r["is_user"] for r in engine.chats.read(s).collect()] == [True, False, True, False]
    engine.model = NoModel()
    assert engine.chat(c, s, "ferry").text is None
    assert engine.chats.read(s).count() == 5
    later = engine.chats.create(c, "u")
    assert [r["session_id"] for r in engine.chats.list(c).collect()] == [later, s]
    with pytest.raises(ValueError):
        engine.chats.append(99, True, "x")
    with pytest.raises(ValueError):
        engine.chats.delete(99)
    engine.chats.delete(s)
    assert engine.chats.read(s).count() == 0
    queries = spark.createDataFrame([("1", "ferry"), ("2", "quay")], "query_id string, query_text string")
    qrels = spark.createDataFrame([("1", "x", 1)], "query_id string, corpus_id string, score int")
    assert engine.evaluate(c, queries, qrels).first().asDict() == {"evaluated": 1, "skipped": 1, "mrr_10": 1.0, "recall_10": 1.0, "recall_100": 1.0}
    engine.delete_corpus(c)
    assert engine.chats.list(c).count() == 0


def test_formulation_with_lexicon(spark, tmp_path):
    from termloom.plans import registry

    synsets, lemmas, _ = registry.small_lexicon(spark)
    engine = Engine(spark, str(tmp_path), Echo('["ferry", "boat", 3]'), (synsets, lemmas))
    terms, prompt, response, plain = engine.formulate("the ferry")
    assert terms == ["ferry", "boat"] and "ferryboat" in prompt and not plain
    engine.model = NoModel()
    assert engine.formulate("the ferry")[0] == ["ferry"]
    assert engine.formulate("the")[0] == []


def test_lexicon_end_to_end(spark, tmp_path):
    """A corpus remembers how it was built; a form that no document holds is lemmatized in a question; order and repeats stay."""
    from termloom.plans import registry

    tables = registry.small_lexicon(spark)
    engine = Engine(spark, str(tmp_path), Echo('["boat"]'), tables, stop=("where", "is"))
    c = engine.corpora.create("one")
    engine.rebuild(c, docs(spark, ("x", "ferries measured"), ("y", "a box of mice")))
    assert {r["term"] for r in engine.corpora.open(c).terms.collect()} == {"ferry", "measure", "a", "box", "of", "mouse"}
    assert engine.corpora.options(c)["lemmatized"] and engine.corpora.options(c)["stop"] == ["where", "is"]
    assert engine.formulate("boxes where measuring ferries boxes", False, c)[0] == ["box", "measure", "ferry", "box"]
    assert [s["documentName"] for s in engine.query(c, "measuring", expand=False).sources] == ["x"]
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path)).formulate("ferries", False, c)
    queries = spark.createDataFrame([("1", "measuring"), ("2", "mice")], "query_id string, query_text string")
    qrels = spark.createDataFrame([("1", "x", 1), ("2", "y", 1)], "query_id string, corpus_id string, score int")
    assert engine.evaluate(c, queries, qrels).first()["mrr_10"] == 1.0
    assert engine.evaluate(c, queries, qrels, expand=True).first()["mrr_10"] == 0.0
    plain = Engine(spark, str(tmp_path), Echo("x"))
    d = plain.corpora.create("two")
    plain.rebuild(d, docs(spark, ("x", "ferries")))
    assert plain.query(d, "ferry").text == NOTHING_FOUND and plain.query(d, "the ferries").text == "x"
    logged = engine.log.tables["generation_runs"].read().orderBy("query_id").first()
    assert "Question: measuring" in logged["prompt_text"] and "Excerpts:" in logged["prompt_text"]
    quiet = Engine(spark, str(tmp_path), Echo("x"), logged=False)
    before = engine.log.tables["queries"].read().count()
    assert quiet.query(d, "ferries").text == "x" and engine.log.tables["queries"].read().count() == before


def test_history_fits_what_the_prompt_leaves(spark, tmp_path):
    class Counting(Echo):
        def count_tokens(self, text):
            return 9000 if text.startswith("long") else 6000 if "Documents:" in text else 5

    engine = Engine(spark, str(tmp_path), Counting("yes"))
    c = engine.corpora.create("one")
    engine.corpora.rebuild(c, docs(spark, *[(f"d{i:03}", f"text {i}") for i in range(100)]))
    turns = [("user", "long " + "a"), ("assistant", "long b"), ("user", "short")]
    answer = engine._read(c, "what?", turns)
    assert [t[1] for t in engine.model.seen[-1][:-1]] == ["long b", "short"] and len(answer.sources) == 100
    assert engine.model.seen[-1][-1][1].count("[Source: ") == 100
    engine.model.count_tokens = lambda text: 200
    assert len(engine._blocks(engine.corpora.open(c).documents, 1000)) == 5


def test_command_line(spark, tmp_path, capsys):
    from termloom.plans import samples

    lexicon = tmp_path / "lexicon"
    lexicon.mkdir()
    for p in ("noun", "verb", "adj", "adv"):
        (lexicon / f"data.{p}").write_text("\n".join(samples.DATA[p]))
        (lexicon / f"index.{p}").write_text("\n".join(samples.INDEX[p]))
        (lexicon / f"{p}.exc").write_text("\n".join(samples.EXCEPTIONS[p]))
    (tmp_path / "stop.txt").write_text("old\n")
    (tmp_path / "mode.conf").write_text("mode = production\n")
    (tmp_path / "b.tsv").write_text("x\told ferries\ny\tstone quay\n")
    (tmp_path / "q.tsv").write_text("1\tferry\n")
    (tmp_path / "r.tsv").write_text("query_id\tcorpus_id\tscore\n1\tx\t1\n")
    root = str(tmp_path / "root")
    Corpora(spark, root).create("one")
    own = ["--root", root, "--corpus", "1", "--lexicon", str(lexicon), "--stop", str(tmp_path / "stop.txt"), "--config", str(tmp_path / "mode.conf")]
    assert cli.main([*own, "bulk-ingest", str(tmp_path / "b.tsv")]) == 0
    assert cli.main([*own, "query", "ferries"], Echo("said so")) == 0
    assert cli.main([*own, "eval", str(tmp_path / "q.tsv"), str(tmp_path / "r.tsv"), "--no-llm-expansion"]) == 0
    assert cli.main([*own, "eval", str(tmp_path / "q.tsv"), str(tmp_path / "r.tsv")], Echo('["quay"]')) == 0
    said = capsys.readouterr().out
    assert "x, chunk 0" in said and "said so" in said and said.count("mrr_10 1.0") == 1 and said.count("mrr_10 0.0") == 1
    assert Engine(spark, root).log.tables["queries"].read().count() == 0


def test_small_parts(spark):
    assert [cli.read_mode(t) for t in (None, "mode = production", "# c\n mode=testing \nmode = production", "mode = x", "other = production")] == ["testing", "production", "production", "testing", "testing"]
    assert cli.throughput(10, 0) == 0 and cli.throughput(10, 500) == 20
    turns = [("user", "abc"), ("assistant", "abcdef"), ("user", "abc")]
    assert newest_within(turns, 3, NoModel()) == turns[1:] and newest_within(turns, 0, NoModel()) == []
    log = spark.createDataFrame([(1, "Q ", 5, 1), (2, "q", None, None), (3, " ", 7, 0), (4, "r", 9, 1)], "query_id long, question_text string, total_latency_ms long, succeeded int")
    report = {r["outcome"]: (r["queries"], r["answered"], r["median_ms"], r["max_ms"]) for r in logs.latency_report(log).collect()}
    assert report == {"succeeded": (2, 2, 5, 9), "unfinished": (1, 0, None, None), "failed": (1, 1, 7, 7)}
    assert [tuple(r) for r in logs.most_asked(log, 1).collect()] == [("q", 2)]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "ferry quay"), ("a", "ferry quay"), ("b", None)], "document_name string, text string").write.parquet(source)
    stream = spark.readStream.schema("document_name string, text string").parquet(source)
    incremental.index_stream(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r["term"] for r in spark.read.parquet(str(tmp_path / "ix/postings")).collect()} == {"ferry", "quay"}
    log = spark.createDataFrame([(0, 1), (10, 0), (7200, None)], "created_at long, succeeded int")
    assert [(r["questions"], r["failed"]) for r in incremental.question_windows(log).orderBy("window_start").collect()] == [(2, 1), (1, 0)]


def test_row_ranges_cover_the_table(spark):
    from termloom.sources import tables

    numbers = [n for n in range(-7, 95) if not 20 <= n < 50]
    df = spark.createDataFrame([(n, f"line {n}") for n in numbers] + [(None, "x")], "row_num long, raw_line string")
    rows = tables.row_ranges(df, 10).collect()
    assert sorted((r["row_num"], r["raw_line"]) for r in rows) == [(n, f"line {n}") for n in numbers]
    assert all(r["first_row"] <= r["row_num"] < r["end_row"] for r in rows)
    ranges = sorted({(r["range_id"], r["first_row"], r["end_row"]) for r in rows})
    assert ranges == [(k, 10 * k - 7, min(10 * k + 3, 95)) for k in range(11) if k not in (3, 4)]
    assert tables.row_ranges(df.limit(0), 10).count() == 0
