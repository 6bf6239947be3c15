"""Uploaded files into text: which are taken, what they are, and what they say."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_PASTED = 25 << 20, 2_000_000
KINDS = {"pdf": "pdf", "docx": "doc", "txt": "txt", "md": "txt", "csv": "txt"}
_paragraph, _text, _break = (f"{{http://schemas.openxmlformats.org/wordprocessingml/2006/main}}{x}" for x in ("p", "t", "br"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def is_taken(path: Column, size: Column) -> Column:
    return extension(path).isin(*KINDS) & (size <= MOST_BYTES)


def source_type(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return kinds[extension(path)]


def text_of(content: bytes, name: str) -> str | None:
    """Text of a file; None for kinds that need a library which is not there (pdf)."""
    kind = name.rpartition(".")[2].lower()
    if kind == "docx":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        return "\n\n".join("".join("\n" if x.tag == _break else x.text or "" for x in p.iter() if x.tag in (_text, _break)) for p in root.iter(_paragraph)).strip()
    if kind == "pdf":
        try:
            from pypdf import PdfReader
        except ImportError:
            return None
        return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
    return re.sub("^﻿", "", content.decode("utf-8", "replace"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"path": batch.path, "text": [text_of(c, p) for c, p in zip(batch.content, batch.path, strict=True)]})


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_type, text) of the files that are taken; sizes are tested before contents are read."""
    files = spark.read.format("binaryFile").load(path).where(is_taken(F.col("path"), F.col("length")))
    return files.select("path", "content").mapInPandas(_read, "path string, text string").withColumn("source_type", source_type(F.col("path")))


def pasted(spark: SparkSession, text: str, title: str) -> DataFrame:
    """(path, source_type, text) of a text that is handed over instead of a file."""
    if not text.strip():
        raise ValueError("the text is empty")
    if len(text) > MOST_PASTED:
        raise ValueError(f"the text has more than {MOST_PASTED:,} characters")
    return spark.createDataFrame([(title, "manual", text)], "path string, source_type string, text string")
