"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, that is at spaces and line feeds: the
tokenizer drops white space before it looks at anything else, and none of its
normalisation steps reaches across white space, so the pieces of a text
tokenize as they do within it.  (A text without spaces stays one piece.)  A
batch is a run of texts of about the same number of bytes; its distinct pieces
that the task has not met yet are encoded together, again in batches of equal
bytes, and only their lengths are kept.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
count each on its own; an empty table gives an empty result.  Only the id and
the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventus.llm import text as tx

#: Bytes of pieces encoded in one call of the library.
CALL_BYTES = 256 << 10
#: Pieces longer than this are encoded when met and not remembered.
REMEMBERED_CHARS = 64
#: Pieces remembered by a task; beyond it the memory is emptied (results do not change).
REMEMBERED_PIECES = 400_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long"

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in a worker; without threads of its own."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _loaded[path] = made
    return _loaded[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_all(path: str, pieces: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
    """(piece, ids) for each piece, without added tokens, in calls of about CALL_BYTES."""
    made = tokenizer(path)
    encode = getattr(made, "encode_batch_fast", made.encode_batch)
    call, size = [], 0

    def flush():
        return zip(call, [x.ids for x in encode(call, add_special_tokens=False)], strict=True)

    for piece in pieces:
        call.append(piece)
        size += len(piece)
        if size >= CALL_BYTES:
            yield from flush()
            call, size = [], 0
    if call:
        yield from flush()


def cut(text: str) -> list[str]:
    """The pieces of a text, split at spaces and line feeds; they may be empty."""
    return text.replace("\n", " ").split(" ")


def count_batches(name: str, is_path: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = name if is_path else vocabulary_path(name)
        known: dict[str, int] = {"": 0}
        for batch in batches:
            for t in tx.texts_of(batch.column(1)):
                cuts = [cut(t.raw(k).decode("utf-8", "replace")) for k in range(len(t))]
                new = set().union(*cuts).difference(known)
                if len(known) + len(new) > REMEMBERED_PIECES:
                    known = {"": 0}
                    new = set().union(*cuts).difference(known)
                once = {}
                for piece, ids in encode_all(path, new):
                    (known if len(piece) <= REMEMBERED_CHARS else once)[piece] = len(ids)
                look = {**known, **once}.__getitem__ if once else known.__getitem__
                counts = np.fromiter((sum(map(look, c)) for c in cuts), dtype=np.int64, count=len(cuts))
                yield pa.record_batch([batch.column(0).slice(t.first, len(t)), pa.array(t.n_bytes), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", is_path: bool = False) -> DataFrame:
    """Bytes and tokens of every whole text.  vocabulary: the name of a public file, or with is_path its path."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count_batches(vocabulary, is_path), SCHEMA)
