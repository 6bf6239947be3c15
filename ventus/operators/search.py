"""Lexical ranking of chunks, answer windows, and vector search."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventus.functions.search_text import tokens_of
from ventus.functions.vectors import cosine
from ventus.operators import postings
from ventus.operators.evidence import evidence

RESULTS, LEAST_SCORE, SAME_CONTENT = 6, 2.0, 0.82
CONTEXT_CHARS, CONTEXT_CHUNK_CHARS = 16_000, 4_000


def rank_chunks(chunks: DataFrame, query: str) -> DataFrame:
    """(id, score, ...) of usable chunks (id, content, title, page_title, source_type) that answer a query, best first; see ``postings``."""
    return postings.rank_one(chunks, query)


def is_confident(top, n_asked: int) -> bool:
    if top["exact"]:
        return True
    return top["score"] >= 1 if n_asked == 1 else top["n_matched"] >= 2 and top["coverage"] >= postings.LEAST_COVERAGE and top["passage"] >= postings.LEAST_COVERAGE and top["score"] >= LEAST_SCORE


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


@dataclass(frozen=True)
class Shortcut:
    """A kind of question that one known chunk answers: patterns of the question and of the chunk, and the chunk's type if it matters."""

    asks: str
    finds: str
    source_type: str | None = None

    def chunk(self, chunks: DataFrame, query: str) -> DataFrame | None:
        """The first chunk found, by id; None if the question is of another kind."""
        if re.search(self.asks, query, re.I) is None:
            return None
        of_type = F.lit(True) if self.source_type is None else F.col("source_type") == self.source_type
        return chunks.where(of_type & F.col("content").rlike(f"(?is){self.finds}")).orderBy("id").limit(1)


def search(chunks: DataFrame, query: str, page: int = 100, shortcuts: Sequence[Shortcut] = ()) -> list[dict]:
    """At most six chunks for a query, none nearly the same as a better one; pages of candidates are read as needed.

    The first shortcut whose question and chunk both match gives its chunk alone.
    """
    for shortcut in shortcuts:
        found = shortcut.chunk(chunks, query)
        if found is not None and (rows := found.select("id", "content", "title", "page_title").collect()):
            return [rows[0].asDict()]
    n_asked = len(set(tokens_of(query)))
    ranked = rank_chunks(chunks, query)
    chosen: list[tuple[dict, set]] = []
    at = 0
    while len(chosen) < RESULTS:
        rows = ranked.offset(at).limit(page).join(chunks.select("id", "content", "title", "page_title"), "id").orderBy(F.col("score").desc(), "id").collect()
        if not rows or (at == 0 and not is_confident(rows[0], n_asked)):
            break
        for r in rows:
            tokens = set(tokens_of(r["content"]))
            if len(chosen) < RESULTS and all(jaccard(tokens, t) <= SAME_CONTENT for _, t in chosen):
                chosen.append((r.asDict(), tokens))
        at += page
        if len(rows) < page:
            break
    return [r for r, _ in chosen]


def context_block(chunks: list[dict]) -> str:
    parts = []
    for k, c in enumerate(chunks, 1):
        source = " | ".join(x for x in (c.get("title") or "", c.get("page_url") or c.get("source_url") or "") if x)
        parts.append(f"Context {k}" + (f" [Source: {source}]" if source else "") + f":\n{c['content'][:CONTEXT_CHUNK_CHARS]}")
    return "\n\n".join(parts)[:CONTEXT_CHARS]


def top_k_vectors(vectors: DataFrame, query: list[float], k: int = 5, least: float = 0.5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors most similar to a query, of those at or above a similarity: a scan with a bounded heap a task."""
    similar = vectors.select(id_col, cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])).alias("similarity"))
    return similar.where(F.col("similarity") >= least).orderBy(F.col("similarity").desc(), id_col).limit(k)


def answer_windows(snippets: DataFrame, query: str, id_col: str, text_col: str, k: int = 2) -> DataFrame:
    """The k windows that are the best evidence for a question; see ``evidence``."""
    question = snippets.sparkSession.createDataFrame([(0, query)], "question_id int, question string")
    rows = evidence(snippets, question, id_col, text_col).drop("question_id")
    return rows.orderBy(F.col("score").desc(), id_col, "position", "n_sentences").limit(k)
