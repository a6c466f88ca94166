"""Documents from files of several formats, with an outcome for each file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.session import ship_code
from termloom.sources import strict_csv

#: From the bytes of a file to its text; raises if the file cannot be opened.
Extractor = Callable[[bytes], str]

#: The extensions that are read, and by what.
KINDS = {"txt": "txt", "csv": "csv", "docx": "docx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "tif": "image", "bmp": "image"}
PARTS = ("word/header", "word/footer")
NOTES = ("word/footnotes.xml", "word/endnotes.xml")
SCHEMA = "document_name string, text string, status string, reason string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def paragraphs(xml: bytes) -> list[str]:
    """Text of each paragraph that has any: all text runs below it. Deleted text is in other elements and stays out."""
    out = []
    for p in ElementTree.fromstring(xml).iter():
        if _local(p.tag) == "p":
            text = "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t")
            if text:
                out.append(text)
    return out


def docx_text(data: bytes) -> str:
    """Paragraphs of the main part, then of headers, footers and notes in archive order, joined by line feeds."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if "word/document.xml" not in names:
            raise ValueError("no main part")
        more = [n for n in names if n.startswith(PARTS) or n in NOTES]
        return "\n".join(p for n in ("word/document.xml", *more) for p in paragraphs(z.read(n)))


def pages_text(pages: list[str]) -> str:
    """Trimmed pages that have text, joined by line feeds: how page-wise extractors (PDF) put a document together."""
    return "\n".join(p.strip() for p in pages if p.strip())


def _rows(name: str, data: bytes, extractors: dict[str, Extractor]) -> Iterator[tuple[str, str | None, str, str | None]]:
    kind = KINDS.get(name.rpartition(".")[2].lower()) if "." in name else None
    if kind is None:
        yield name, None, "skipped", "unknown extension"
        return
    try:
        if kind == "csv":
            for i, text in enumerate(strict_csv.documents(data.decode("utf-8", "replace"))):
                yield f"{name}#row{i + 1}", text, "ok", None
            return
        if kind == "txt":
            text = data.decode("utf-8", "replace").partition("\x00")[0]
        elif kind == "docx":
            text = docx_text(data)
        elif kind in extractors:
            text = extractors[kind](data).strip()
        else:
            yield name, None, "malformed", f"no extractor for {kind}"
            return
    except Exception as e:  # whatever a format's reader raises means that the file cannot be read
        yield name, None, "malformed", str(e)[:200]
        return
    if not text.strip():
        # an empty word-processor file counts as broken, an empty text, scan or PDF as one without text
        yield name, None, "malformed" if kind == "docx" else "no_text", "no text found"
    else:
        yield name, text, "ok", None


def read_files(spark: SparkSession, path: str, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """document_name, text, status, reason for every file below path; a CSV file gives a row per record.

    status is ok, skipped (extension not known), malformed or no_text. Formats come from the extension in any case.
    extractors adds readers for 'pdf' and 'image' as functions from bytes to text; without one such files are malformed.
    Each file is read whole by one task. Files of no bytes are not listed by file sources and give no row.
    """
    ship_code(spark)
    plugged = dict(extractors or {})
    names = SCHEMA.replace(" string", "").split(", ")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [r for n, c in zip(batch["name"], batch["content"]) for r in _rows(n, bytes(c), plugged)]
            yield pd.DataFrame(found, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_name").alias("name"), "content").mapInPandas(read, SCHEMA)


def outcomes(read: DataFrame) -> DataFrame:
    """status, files, documents: how many files and documents came to each outcome."""
    file_name = F.regexp_replace("document_name", "#row[0-9]+$", "")
    return read.groupBy("status").agg(F.count_distinct(file_name).alias("files"), F.count(F.lit(1)).alias("documents"))
