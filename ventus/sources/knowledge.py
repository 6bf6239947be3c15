"""Documents into chunks, chunks into rows, chunks back out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventus.functions.vectors import hash_embedding
from ventus.functions.web import canonical_url, extract_pages, pages_schema
from ventus.sources.records import checked

CHUNK_CHARS, OVERLAP_CHARS, LEAST_CHUNK = 4000, 600, 50
BATCH_CHARS = 12_000


def chunk_text(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Paragraphs gathered up to size characters, each chunk begun with the end of the one before; longer paragraphs by sentence."""
    text = re.sub(r"\n{4,}", "\n\n\n", re.sub(r" {3,}", "  ", text.replace("\r\n", "\n").replace("\t", " "))).strip()
    out: list[str] = []
    held = ""

    def add(piece: str, joint: str):
        nonlocal held
        if len(held) + len(joint) + len(piece) > size and held:
            flush()
        held += (joint if held else "") + piece

    def flush():
        nonlocal held
        out.append(held.strip())
        held = held[-overlap:]

    for paragraph in filter(None, (p.strip() for p in re.split(r"\n{2,}", text))):
        if len(paragraph) <= size:
            add(paragraph, "\n\n")
            continue
        if held:
            flush()
        for sentence in filter(None, (s.strip() for s in re.split(r"(?<=[.!?])\s+", paragraph))):
            add(sentence, " ")
    if held.strip():
        out.append(held.strip())
    return [c for c in out if len(c) > LEAST_CHUNK]


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda x: chunk_text(x or ""))


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("source_id"), F.posexplode(chunks_of(text_col)).alias("chunk_index", "content"))


def content_digest(c):
    return F.sha2(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), 256)


def distinct_chunks(chunks: DataFrame, order: list[str], content_col: str = "content") -> DataFrame:
    """The first chunk of each content, white space and case aside; order names a chunk.

    Digests and names are exchanged, pre-aggregated, and never the contents.
    """
    first = chunks.groupBy(content_digest(F.col(content_col)).alias("_digest")).agg(F.min(F.struct(*order)).alias("_first"))
    return chunks.join(first.select("_first.*"), order, "left_semi")


def active_chunks(chunks: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """Chunks of active sources, or the most newest ones, newest first; a source's title, type and URL win over the chunk's unless null."""
    named = sources.where("status = 'active'").select(F.col("id").alias("source_id"), F.col("title").alias("_title"), F.col("source_type").alias("_type"), F.col("source_url").alias("_url"))
    rows = chunks.join(named, "source_id").withColumns({"title": F.coalesce("_title", "title"), "source_type": F.coalesce("_type", "source_type"), "source_url": F.coalesce("_url", "source_url")})
    rows = rows.drop("_title", "_type", "_url").orderBy(F.col("created_at").desc(), "id")
    return rows if most is None else rows.limit(most)


def embedded(chunks: DataFrame, content_col: str = "content", structured_col: str | None = None) -> DataFrame:
    """Chunks with their hashed embedding; structured chunks have none."""
    vector = hash_embedding(content_col)
    return chunks.withColumn("embedding", F.when(~F.col(structured_col), vector) if structured_col else vector)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.count("*").cast("long").alias("chunk_count"))


def without_deleted(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is not deleted."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def duplicate_sources(new: DataFrame, sources: DataFrame) -> DataFrame:
    """New sources that an active or processing one of the same title, type and URL stands for; structured tables are exempt."""
    there = sources.where(F.col("status").isin("active", "processing"))
    same = (new["title"] == there["title"]) & (new["source_type"] == there["source_type"]) & (new["source_url"].isNull() | (new["source_url"] == there["source_url"]))
    return new.where(~F.lower(F.coalesce("file_path", F.lit(""))).endswith(".csv")).join(there, same, "left_semi")


def pages(table: DataFrame) -> DataFrame:
    """Title, text and links of pages that may be indexed."""
    return table.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(extract_pages, pages_schema())


def distinct_pages(table: DataFrame) -> DataFrame:
    """Pages (page_id, url, text) without a second one of the same address, and of those left without a second one of the same content.

    The one of least id stays in both steps, so what a page holds that goes for its address
    takes no other page along.  Ids, addresses and digests are exchanged, and never texts.
    """
    address = F.coalesce(canonical_url("url"), F.concat(F.lit("#"), F.col("page_id").cast("string")))  # pages without one are told apart
    by_url = table.groupBy(address.alias("_url")).agg(F.min(F.struct("page_id", content_digest(F.col("text")).alias("_digest"))).alias("_first"))
    by_text = by_url.groupBy("_first._digest").agg(F.min("_first.page_id").alias("page_id"))
    return table.join(by_text.select("page_id"), "page_id", "left_semi")


def reachable(start: DataFrame, links: DataFrame, most_pages: int = 12, rounds: int = 4) -> DataFrame:
    """(url, depth) of the first most_pages URLs, breadth first, from start (url) over links (src, dst)."""
    seen = frontier = start.select("url", F.lit(0).alias("depth")).distinct()
    for depth in range(1, rounds + 1):
        step = links.join(frontier, links.src == frontier.url).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = step.withColumn("depth", F.lit(depth)).orderBy("url").limit(most_pages)
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "url").limit(most_pages)


def record_batches(records: DataFrame, filename: str, columns: list[str]) -> DataFrame:
    """Records as labelled text, batched in order to about BATCH_CHARS characters; a file has MOST_RECORDS of them at most, so they go to one task."""

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        out, held, size = [], [], 0
        for k, row in enumerate(rows.sort_values("seq")[columns].itertuples(index=False), 1):
            fields = [f"{c}: {v}" for c, v in zip(columns, row, strict=True) if isinstance(v, str) and v]
            if not fields:
                continue
            text = f"Record {k}\n" + "\n".join(fields)
            if held and size + len(text) > BATCH_CHARS:
                out.append(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        out += [held] if held else []
        head = f"CSV dataset: {filename}\nColumns: {', '.join(columns)}\n\n"
        return pd.DataFrame([(i, head + "\n\n".join(x), len(x)) for i, x in enumerate(out)], columns=["chunk_index", "content", "n_records"])

    return checked(records).withColumn("_file", F.lit(filename)).groupBy("_file").applyInPandas(batch, "chunk_index int, content string, n_records int")


def listed(table: DataFrame, newest: str) -> DataFrame:
    return table.orderBy(F.col(newest).desc())


def numbered(chunks: DataFrame, by: str, order: str) -> DataFrame:
    return chunks.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order)))
