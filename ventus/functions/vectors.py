"""Hashed text embeddings and cosine similarity."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 384
#: Length and weight of the prefix that a token adds.
PREFIX, PREFIX_WEIGHT = 5, 0.35


@lru_cache(maxsize=1 << 16)
def fnv1a(token: str) -> int:
    h = 2166136261
    for c in token:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def embed(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    out = np.zeros(dimensions)
    for token in re.sub(r"[^a-z0-9\s.-]", " ", text.lower()).split():
        if len(token) > 2:
            out[fnv1a(token) % dimensions] += 1
            if len(token) > PREFIX:
                out[fnv1a(token[:PREFIX]) % dimensions] += PREFIX_WEIGHT
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda x: embed(x or "").astype(np.float32))


#: Texts whose vectors are held at a time.
_TEXTS = 256


def hash_weights(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bucket, weight): the components of hash_embedding that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(start, _TEXTS)
                vectors = np.stack([embed(x or "").astype(np.float32) for x in batch.column(1).to_pylist()])
                at, bucket = np.nonzero(vectors)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(bucket, pa.int64()), pa.array(vectors[at, bucket])], names=[id_col, "bucket", "weight"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, bucket long, weight float")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
