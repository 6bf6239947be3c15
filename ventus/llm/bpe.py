"""BPE encoding and decoding through a table of distinct words.

The texts are dealt into blocks by a hash.  Each block splits its texts into
words and asks for each distinct word once; the requests travel as compressed
lists, one for each (block, part) instead of one row a word.  A part owns all
words of one hash range over the whole corpus: it encodes each distinct word
once, looks its ids up in the id-to-piece table for the bytes that decoding
gives, and answers every request in the order of its list.  A block then puts
the answers back by the positions of its words.  Both uses of the blocks read
the same exchange, so texts are moved once, many of a block compressed
together.  The joins by position and by id are thus done on lists of a block
or part that Spark's exchanges have brought together, not as joins of a row a
word: those would have moved a hundred bytes for six of text.

Words are cut before a space that stands between two characters which are not
white space; the byte-level pattern always ends a word there, and special
strings hold no space, so words encode as they do within the text.

Defined results: a null or empty text has no ids and decodes to the empty
text; repeated rows are encoded each on its own; an empty table gives an empty
result.  Other columns are not read and cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventus.llm.text import release
from ventus.llm.tokens import encode_all, tokenizer, vocabulary_path

#: Bytes of text in a block, about; its words and texts are in memory together.
BLOCK_BYTES = 12 << 20
#: There is a part of the vocabulary for each time that the bytes of text hold so many, by the square root.
PART_BYTES = 1 << 16

_safe_cut = re.compile(r"(?<=\S)(?= \S)")
_two_spaces = re.compile(r"\s\s")


def words(text: str) -> tuple[list[str], list[str]]:
    """The words of a text, in two lists: first those as they stand, then those that a space belongs before."""
    if not text:
        return [], []
    if _two_spaces.search(text) or text[0].isspace() or text[-1].isspace():
        return _safe_cut.split(text), []
    parts = text.split(" ")
    return parts[:1], parts[1:]


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table: the bytes that each id stands for."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    made = tokenizer(path)
    out = [b""] * made.get_vocab_size(with_added_tokens=True)
    for piece, k in made.get_vocab(with_added_tokens=True).items():
        out[k] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return out


def decode(path: str, ids: list[int]) -> bytes:
    table = pieces(path)
    return b"".join([table[k] for k in ids])


def _pack(items: list[bytes]) -> bytes:
    """Byte strings as one compressed value."""
    lengths = np.array([len(x) for x in items], dtype="<u4")
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(items)) + lengths.tobytes() + b"".join(items))


def _unpack(value: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    (n,) = struct.unpack_from("<I", raw)
    ends = np.cumsum(np.frombuffer(raw, dtype="<u4", count=n, offset=4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate(([4 + 4 * n], ends[:-1])) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _asked(texts: list[str], n_parts: int) -> dict[int, list[bytes]]:
    """The distinct words by the part that owns them, each list sorted."""
    plain, spaced = set(), set()
    for a, b in map(words, texts):
        plain.update(a)
        spaced.update(b)
    out: dict[int, list[bytes]] = {}
    for w in sorted({x.encode() for x in plain} | {b" " + x.encode() for x in spaced}):
        out.setdefault(xxhash.xxh32_intdigest(w) % n_parts, []).append(w)
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that a batch has for each block as one compressed value."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = np.asarray(batch.column(2))
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order])) + 1
        groups = [g for g in np.split(order, edges) if len(g)]
        ids = [batch.column(0).take(pa.array(g)).to_pylist() for g in groups]
        texts = [_pack([(x or "").encode() for x in batch.column(1).take(pa.array(g)).to_pylist()]) for g in groups]
        yield pa.record_batch([pa.array([int(block[g[0]]) for g in groups], pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(texts, pa.binary())], names=["block", "ids", "texts"])


def _texts(table: pa.Table) -> list[str]:
    return [x.decode() for value in table.column("texts").to_pylist() for x in _unpack(value)]


def _request(n_parts: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py() if table.num_rows else 0
        asked = _asked(_texts(table), n_parts)
        return pa.table({"block": pa.array([block] * len(asked), pa.int32()), "part": pa.array(list(asked), pa.int32()), "words": pa.array([_pack(x) for x in asked.values()], pa.binary())})

    return run


def _answer(name: str, is_path: bool):
    """Encodes and decodes each distinct word of a part once, however many blocks ask for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = name if is_path else vocabulary_path(name)
        known: dict[bytes, tuple[bytes, bytes]] = {}
        part = None
        for batch in batches:
            for block, owner, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if owner != part:  # rows come sorted by part
                    known, part = {}, owner
                asked = _unpack(value)
                new = [w.decode() for w in asked if w not in known]
                for w, ids in encode_all(path, new):
                    spelled = decode(path, ids)
                    raw = w.encode()
                    known[raw] = np.array(ids, dtype="<u4").tobytes(), b"" if spelled == raw else spelled  # empty: as the word
                got = [known[w] for w in asked]
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([owner], pa.int32()), pa.array([_pack([x for x, _ in got])], pa.binary()), pa.array([_pack([y for _, y in got])], pa.binary())], names=["block", "part", "ids", "spelled"])

    return run


def _assemble(n_parts: int, emit):
    """Joins the answers back by position; emit makes a column's values from (ids, decoded bytes) of each text."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _texts(blocks)
        asked = _asked(rows, n_parts)
        # ids of words as they stand, of words by what follows their space, and spellings that are not the word
        plain: dict[str, bytes] = {}
        after: dict[str, bytes] = {}
        odd: dict[str, bytes] = {}
        for part, a, b in zip(*(answers.column(c).to_pylist() for c in ("part", "ids", "spelled")), strict=True):
            for raw, ids, spelled in zip(asked.pop(part), _unpack(a), _unpack(b), strict=True):
                word = raw.decode()
                if word[0] == " ":
                    after[word[1:]] = ids
                else:
                    plain[word] = ids
                if spelled:
                    odd[word] = spelled
        out = []
        for text in rows:
            first, rest = words(text)
            found = [after[w[1:]] if w[0] == " " else plain[w] for w in first]
            ids = b"".join([*found, *map(after.__getitem__, rest)])
            spelled = b"".join(odd.get(w) or w.encode() for w in [*first, *[" " + w for w in rest]]) if odd else text.encode()
            out.append(emit(ids, spelled))
        columns = {"doc_id": pa.array([x for value in blocks.column("ids").to_pylist() for x in value], pa.int64())}
        for k, (name, kind) in enumerate(emit.columns):
            columns[name] = pa.array([x[k] for x in out], kind)
        del plain, after, odd, asked, rows
        release()
        return pa.table(columns)

    return run


class Digest:
    """Counts and hashes, for results that have to be compared rather than read."""

    columns = (("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def __call__(self, ids: bytes, spelled: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(spelled.decode("utf-8", "replace").encode()).hexdigest()


class Full:
    """The ids themselves and the decoded text."""

    columns = (("ids", pa.list_(pa.int32())), ("decoded", pa.string()))
    schema = "doc_id long, ids array<int>, decoded string"

    def __call__(self, ids: bytes, spelled: bytes) -> tuple:
        return np.frombuffer(ids, dtype="<u4").astype(np.int32), spelled.decode("utf-8", "replace")


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", emit=None, is_path: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encodes and decodes every whole text.

    vocabulary: the name of a public file, or with is_path its path.  The
    number of blocks follows the bytes of text, so a block has a bounded size.
    """
    emit = emit or Full()
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // block_bytes))
    # parts own words, whose number grows slower than the texts: with the root of the bytes, so that requests don't grow with their square
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.isqrt(size // PART_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    blocks = rows.mapInArrow(_gather, "block int, ids array<long>, texts binary").repartition(n, "block")
    # all columns go into both uses: else pruning makes two exchanges of the one
    requests = blocks.groupBy("block").applyInArrow(_request(parts), "block int, part int, words binary")
    answers = requests.repartition(parts, "part").sortWithinPartitions("part").select("block", "part", "words").mapInArrow(_answer(vocabulary, is_path), "block int, part int, ids binary, spelled binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_assemble(parts, emit), emit.schema)
