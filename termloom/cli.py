"""Command line: bulk-ingest, query and eval."""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import STOPWORDS
from termloom.plans.engine import Engine
from termloom.plans.model import LanguageModel
from termloom.sources import lexicon as lexicon_source
from termloom.sources import tables


def read_mode(text: str | None) -> str:
    """'production' or 'testing' from a configuration's text: mode = value, the last one wins; anything else is testing."""
    mode = "testing"
    for line in (text or "").splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, _, value = line.partition("=")
            if key.strip() == "mode":
                mode = "production" if value.strip() == "production" else "testing"
    return mode


def throughput(passages: int, ms: int) -> float:
    return passages / (ms / 1000) if ms else 0.0


def main(argv: list[str] | None = None, model: LanguageModel | None = None) -> int:
    parser = argparse.ArgumentParser(prog="termloom")
    parser.add_argument("--root", required=True, help="folder that holds the corpora")
    parser.add_argument("--corpus", type=int, required=True)
    parser.add_argument("--lexicon", help="folder of lexicon files: terms are lemmatized and expanded by it")
    parser.add_argument("--stop", help="file of stop words, one a line")
    parser.add_argument("--config", help="file with mode = production or testing; only testing logs queries")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("bulk-ingest").add_argument("tsv")
    commands.add_parser("query").add_argument("question")
    evaluate = commands.add_parser("eval")
    evaluate.add_argument("queries")
    evaluate.add_argument("qrels")
    evaluate.add_argument("--no-llm-expansion", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("termloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    lexicon = (*lexicon_source.read_lexicon(spark, args.lexicon), lexicon_source.read_exceptions(spark, args.lexicon)) if args.lexicon else None
    stop = lexicon_source.read_stopwords(spark, args.stop) if args.stop else STOPWORDS
    mode = read_mode(Path(args.config).read_text() if args.config and Path(args.config).is_file() else None)
    engine = Engine(spark, args.root, model, lexicon, stop, logged=mode == "testing")
    if args.command == "bulk-ingest":
        begun = time.monotonic()
        rows = tables.read_bulk(spark, args.tsv).withColumn("row_num", F.monotonically_increasing_id())
        made = engine.rebuild(args.corpus, rows)
        ms = int((time.monotonic() - begun) * 1000)
        print(f"{made['passages']} passages, {made['terms']} terms, {made['postings']} postings, {throughput(made['passages'], ms):.1f} passages/s")
    elif args.command == "query":
        answer = engine.query(args.corpus, args.question)
        for s in answer.sources:
            print(f"{s['score']:.6f}  {s['documentName']}, chunk {s['chunkId']}")
        print(answer.text or "")
    else:
        row = engine.evaluate(args.corpus, tables.read_eval_queries(spark, args.queries), tables.read_qrels(spark, args.qrels), not args.no_llm_expansion).first()
        print(", ".join(f"{k} {v}" for k, v in row.asDict().items()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
