"""Secret scans through an inverted index of trigrams.

1. Each rule's pattern is turned into a Boolean query over trigrams that every
   text with a match must hold: what a pattern spells out gives conjunctions,
   alternatives give disjunctions.  A pattern that spells out no three bytes
   has no query, and its rule scans every text.
2. The index has, for each trigram and segment (the rows of one record batch),
   the keys of the rows that hold it.  Letters A-Z count as a-z in it, so rules
   that ignore case ask the same index.  An index of all trigrams serves any
   rules; for one scan only the trigrams asked for are written.
3. Postings of a segment meet in one group, where a query's conjunctions
   intersect and its disjunctions unite them.  Postings of a segment are
   bounded by its rows, so no group grows with the input.
4. The rows that come out, and no others, are verified with the pattern itself;
   rules without a query are verified on all rows.

A key is a 64-bit code of id and text.  If two rows had one key, both would be
verified, so nothing rests on keys being distinct.  Candidates are broadcast
while they are at most BROADCAST_ROWS, beyond that texts and candidates are
exchanged by key.

Defined results: null and empty texts hold nothing; each of repeated rows gets
its own result row; a null id stays null; an empty table gives an empty result;
columns other than id and text are not read.  Offsets are code points, the end
is exclusive; spans of one kind never overlap, those of different kinds may.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as op, _parser as parser

from ventus.llm import text as tx
from ventus.llm.shelf import Shelf

#: Candidates (8 bytes of key and 8 of rules each) that go to every executor at most.
BROADCAST_ROWS = 1 << 20
#: Bytes of a text worked on at a time.
BLOCK_BYTES = 1 << 20
#: Strings that a part of a pattern may spell out before it counts as unknown, and characters of a class.
MAX_STRINGS, MAX_CLASS = 64, 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches that don't overlap, dropped where the given group is shorter than least."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    either_case: bool = False  # of ASCII letters

    @property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))

    def spans(self, compiled: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
        for m in compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: Published shapes of other credentials.
MORE = (
    Rule("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("repository_token", r"gh[opsru]_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abeprs]-[A-Za-z0-9-]+", 20),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
    Rule("bearer", r"bearer\x20+([A-Za-z0-9._~+/=-]+)", 20, 1, True),
)

#: A query is None (any text), ("gram", code), ("and", parts) or ("or", parts).
Query = tuple | None


def _all_of(parts: Sequence[Query]) -> Query:
    some = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not some else some[0] if len(some) == 1 else ("and", tuple(some))


def _any_of(parts: Sequence[Query]) -> Query:
    if not parts or None in parts:
        return None
    some = list(dict.fromkeys(parts))
    return some[0] if len(some) == 1 else ("or", tuple(some))


def _code(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


def _spelt(strings: frozenset[bytes]) -> Query:
    """The query of a text that holds one of the strings."""
    grams = {frozenset(_code(s[k : k + 3]) for k in range(len(s) - 2)) for s in strings}
    least = [g for g in grams if not any(o < g for o in grams)]  # what asks for more than another alternative adds nothing
    return _any_of([_all_of([("gram", g) for g in sorted(one)]) for one in sorted(least, key=sorted)])


def _folded(char: int) -> bytes:
    return bytes(_LOWER[list(chr(char).encode("utf-8", "surrogatepass"))])


def _class(items) -> frozenset[bytes] | None:
    chars: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            chars.add(value)
        elif kind is op.RANGE and value[1] - value[0] < MAX_CLASS:
            chars.update(range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(map(_folded, chars)) if len(chars) <= MAX_CLASS else None


def _read(node) -> tuple[frozenset[bytes] | None, Query]:
    """Of one item of a pattern: the strings that it spells out (None if they are unknown), else its query."""
    kind, value = node
    if kind is op.LITERAL:
        return frozenset([_folded(value)]), None
    if kind is op.IN:
        return _class(value), None
    if kind is op.AT:
        return frozenset([b""]), None
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        sides = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in sides) and sum(len(s) for s, _ in sides) <= MAX_STRINGS:
            return frozenset().union(*(s for s, _ in sides)), None
        return None, _any_of([q if s is None else _spelt(s) for s, q in sides])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {b""}, None
        if least == 0:
            return None, None
        if strings is not None and (least, most) == (1, 1):
            return strings, None
        return None, query if strings is None else _spelt(strings)
    return None, None  # any other item may stand for anything


def _sequence(items) -> tuple[frozenset[bytes] | None, Query]:
    run, found, whole = frozenset([b""]), [], True
    for item in items:
        strings, query = _read(item)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = frozenset(a + b for a, b in product(run, strings))
            continue
        found += [_spelt(run), query]
        run, whole = strings if strings is not None else frozenset([b""]), False
    return (run, None) if whole else (None, _all_of([*found, _spelt(run)]))


def query_of(pattern: str) -> Query:
    """The Boolean trigram query of a pattern; None if it has no mandatory trigram."""
    strings, query = _sequence(parser.parse(pattern))
    return query if strings is None else _spelt(strings)


def grams_of(query: Query) -> set[int]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "gram" else set().union(*map(grams_of, query[1]))


def _index(grams: list[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        asked = np.ones(1 << 24, dtype=bool) if grams is None else np.zeros(1 << 24, dtype=bool)
        asked[grams or []] = True
        for ordinal, batch in enumerate(batches):
            keys = np.asarray(batch.column("key"))
            found = []
            for t in tx.texts_of(batch.column("text")):
                data = _LOWER[t.data]
                for begin in range(0, max(len(data) - 2, 0), BLOCK_BYTES):
                    own = data[begin : begin + BLOCK_BYTES + 2].astype(np.uint32)
                    code = own[:-2] << np.uint32(16) | own[1:-1] << np.uint32(8) | own[2:]
                    at = np.flatnonzero(asked[code])
                    owner = np.searchsorted(t.offsets, at + begin, side="right") - 1
                    inside = at + begin + 2 < t.offsets[owner + 1]
                    found.append(np.unique(code[at[inside]].astype(np.int64) << 32 | (owner[inside] + t.first)))
            pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
            gram, start = np.unique(pairs >> 32, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(pairs)).astype(np.int32)), pa.array(keys[pairs & 0xFFFFFFFF]))
            segment = np.full(len(gram), part << 32 | ordinal, dtype=np.int64)
            yield pa.record_batch([pa.array(gram.astype(np.int32)), pa.array(segment), lists], names=["gram", "segment", "keys"])

    return run


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", _key())


def index(docs: DataFrame, grams: list[int] | None = None) -> DataFrame:
    """Postings (gram, segment, keys) of docs (doc_id, text): of all trigrams, or of those given by their codes."""
    return _rows(docs).select("key", "text").mapInArrow(_index(grams), "gram int, segment long, keys array<long>")


def _evaluated(query: Query, lists: str) -> Column:
    """The keys of a segment that fulfil a query, from its lists of (gram, keys)."""
    if query[0] == "gram":
        return F.flatten(F.transform(F.filter(lists, lambda x: x["gram"] == query[1]), lambda x: x["keys"]))
    meet = F.array_intersect if query[0] == "and" else F.array_union
    return reduce(meet, [_evaluated(q, lists) for q in query[1]])


def candidates(postings: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """(key, rules): the rows that fulfil queries; bit k of rules is set for the k-th one. None matches no row here."""
    asked = {k: q for k, q in enumerate(queries) if q is not None}
    needed = sorted(set().union(*map(grams_of, asked.values()))) if asked else []
    met = postings.where(F.col("gram").isin(needed)).groupBy("segment").agg(F.collect_list(F.struct("gram", "keys")).alias("lists"))
    marked = lambda k: lambda key: F.struct(key.alias("key"), F.lit(1 << k).cast("long").alias("rule"))
    found = [F.transform(_evaluated(q, "lists"), marked(k)) for k, q in asked.items()]
    every = F.explode(F.flatten(F.array(*found))) if found else F.explode(F.array().cast("array<struct<key:long,rule:long>>"))
    return met.select(every.alias("c")).groupBy("c.key").agg(F.bit_or("c.rule").alias("rules"))


def _verify(rules: Sequence[Rule], always: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [r.compiled for r in rules]
        for batch in batches:
            asked = np.asarray(batch.column("rules").fill_null(0)) | always
            counts, found = np.zeros(batch.num_rows, dtype=np.int32), []
            for t in tx.texts_of(batch.column("text")):
                for k in range(len(t)):
                    mask, text = int(asked[t.first + k]), t.raw(k).decode("utf-8", "replace")
                    own = sorted((start, n, end) for n, rule in enumerate(rules) if mask >> n & 1 for start, end in rule.spans(compiled[n], text))
                    counts[t.first + k] = len(own)
                    found += own
            kinds = pa.array([rules[n].kind for _, n, _ in found], pa.string())
            start, end = (pa.array([x[j] for x in found], pa.int64()) for j in (0, 2))
            spans = pa.StructArray.from_arrays([kinds, start, end], ["kind", "start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), spans)
            yield pa.record_batch([batch.column("doc_id"), lists], names=["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE) -> DataFrame:
    """(doc_id, spans) for each row of docs; spans are (kind, start, end) by start, then by the order of rules (63 at most)."""
    if not 0 < len(rules) < 64:
        raise ValueError("one to 63 rules")
    shelf = Shelf(docs.sparkSession)
    queries = [query_of(r.pattern) for r in rules]
    needed = sorted(set().union(*map(grams_of, queries)))
    always = sum(1 << k for k, q in enumerate(queries) if q is None)
    found = shelf.put(candidates(shelf.put(index(docs, needed), "postings"), queries), "candidates")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found.hint("merge")
    rows = _rows(docs).join(found, "key", "left").select("doc_id", "text", "rules")
    return rows.mapInArrow(_verify(rules, always), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame, base: Sequence[Rule] = BASE) -> DataFrame:
    """Counts by base kind, a hash of their spans, and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    own = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in base]))
    return found.select("doc_id", *(of(r.kind) for r in base), F.sha2(told(own), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
