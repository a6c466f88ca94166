"""Isolated corpora: registry, published index versions, append and replace by rebuild."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import STOPWORDS
from termloom.operators.indexing import CHUNK, OVERLAP, Index, chunk_documents, first_documents, integrity, passages_of, postings_of, replace_documents, stats_of, terms_of
from termloom.operators.lexicon import lemma_map
from termloom.plans.store import POINTER, Table
from termloom.session import ship_code
from termloom.storage import Folder

REGISTRY = "corpus_id bigint, display_name string, schema_name string, created_at timestamp"
PARTS = ("documents", "passages", "postings", "terms", "stats")
#: How a version was built: what questions to it have to be treated with.
OPTIONS = "options.json"


class CorpusError(ValueError):
    pass


class Corpora:
    def __init__(self, spark: SparkSession, root: str):
        ship_code(spark)
        self.spark, self.root = spark, root.rstrip("/")
        self.registry = Table(spark, self.root, "corpora", REGISTRY)

    def create(self, display_name: str) -> int:
        """Id of a new corpus; an empty or blank name is refused. Names need not be unique."""
        if not display_name or not display_name.strip():
            raise CorpusError("a corpus needs a name")
        corpus_id = self.registry.next_id("corpus_id")
        now = datetime.datetime.now(datetime.timezone.utc)
        self.registry.append_rows([(corpus_id, display_name, f"corpus_{corpus_id}", now)])
        return corpus_id

    def list(self) -> DataFrame:
        return self.registry.read().orderBy("corpus_id")

    def _folder(self, corpus_id: int) -> Folder:
        if self.registry.read().where(F.col("corpus_id") == corpus_id).isEmpty():
            raise CorpusError(f"no corpus {corpus_id}")
        return Folder(self.spark, f"{self.root}/corpus_{corpus_id}")

    def delete(self, corpus_id: int) -> None:
        """Drops the corpus and its registry row; an unknown id is an error."""
        folder = self._folder(corpus_id)
        self.registry.replace(self.registry.read().where(F.col("corpus_id") != corpus_id))
        folder.delete("")

    def open(self, corpus_id: int) -> Index | None:
        """The published index, None before the first build. Later builds do not disturb an open handle's files until
        they are dropped by the build after next."""
        folder = self._folder(corpus_id)
        if not folder.exists(POINTER):
            return None
        version = folder.read_text(POINTER).strip()
        return Index(*[self.spark.read.parquet(folder.at(f"{version}/{p}")) for p in PARTS])

    def options(self, corpus_id: int) -> dict:
        """size, overlap, stop and lemmatized of the published version; the defaults before the first build."""
        folder = self._folder(corpus_id)
        if folder.exists(POINTER):
            return json.loads(Folder(self.spark, folder.at(folder.read_text(POINTER).strip())).read_text(OPTIONS))
        return {"size": CHUNK, "overlap": OVERLAP, "stop": list(STOPWORDS), "lemmatized": False}

    def documents(self, corpus_id: int) -> DataFrame:
        """Documents by name; empty before the first build."""
        index = self.open(corpus_id)
        if index is None:
            return self.spark.createDataFrame([], "document_name string, text string")
        return index.documents.orderBy("document_name")

    def build(
        self, corpus_id: int, docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, stop: Sequence[str] = STOPWORDS, lexicon: tuple[DataFrame, DataFrame] | None = None
    ) -> dict[str, float]:
        """Builds a new version from docs (document_name, text, unique by name), checks and publishes it.

        With a lexicon (lemmas, exceptions) its terms are lemmatized. Stop words and that choice are stored with the version, so
        that questions are treated alike.

        Each part is read back from where it was written, so nothing is computed twice. A failed build or check leaves
        the published version as it was. Postings are clustered by term, so that a term's rows share few row groups.
        """
        folder = self._folder(corpus_id)
        version = f"v{uuid.uuid4().hex}"
        old = folder.names("")

        def keep(df: DataFrame, part: str) -> DataFrame:
            df.write.parquet(folder.at(f"{version}/{part}"))
            return self.spark.read.parquet(folder.at(f"{version}/{part}"))

        try:
            documents = keep(docs.select("document_name", "text"), "documents")
            passages = keep(passages_of(chunk_documents(documents, size, overlap), stop), "passages")
            lemmas = None
            if lexicon is not None:
                words = passages.select(F.explode("terms").alias("term")).distinct()
                lemmas = keep(lemma_map(words, *lexicon).where("lemma <> term"), "lemmas")
            Folder(self.spark, folder.at(version)).write_text(OPTIONS, json.dumps({"size": size, "overlap": overlap, "stop": list(stop), "lemmatized": lexicon is not None}))
            postings = keep(postings_of(passages, lemmas).repartitionByRange("term", "passage_id").sortWithinPartitions("term", "passage_id"), "postings")
            terms = keep(terms_of(postings), "terms")
            stats = keep(stats_of(passages), "stats")
            index = Index(documents, passages, postings, terms, stats)
            broken = [f"{r['check_name']}: {r['violations']}" for r in integrity(index).where("violations > 0").collect()]
            if broken:
                raise CorpusError("; ".join(broken))
        except Exception:
            folder.delete(version)
            raise
        folder.write_text(POINTER, version)
        published = {n for n in old if n.startswith("v")}
        for stale in sorted(published)[:-1]:
            folder.delete(stale)
        first = stats.first()
        return {"passages": first["n_passages"], "avgdl": first["avgdl"], "terms": terms.count(), "postings": postings.count()}

    def rebuild(self, corpus_id: int, new: DataFrame, order: str = "row_num", **options) -> dict[str, float]:
        """Adds documents (document_name, text and a column that tells which came first), replacing those of one name."""
        arrived = first_documents(new, order)
        return self.build(corpus_id, replace_documents(self.documents(corpus_id), arrived), **options)
