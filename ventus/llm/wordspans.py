"""Repeated word spans by compaction of a de Bruijn graph.

The windows of ``size`` words are the edges of a de Bruijn graph whose nodes
are one word shorter.  Edges travel packed: a packed edge is a maximal run of
consecutive windows of a document whose least k-mer (by hash) is the same one,
its anchor, so that equal windows lie in packed edges of equal anchor.

1. Anchors that occur in one document only cannot repeat across documents;
   counts, pre-aggregated, leave the others.
2. Where an anchor has one packed edge only, that is an edge of the graph.
   Where it has several, these are opened into single windows (one occurrence
   of each), which are edges of their own.
3. Edges that occur in two documents or more make up the graph.  An edge is
   linked with the next one if no document has anything else after the first
   nor before the second: that the node between them doesn't branch is told by
   the least and greatest neighbour of each edge, an aggregation.
4. Linked edges are compacted to paths by pointer doubling: joins of the table
   of predecessors with itself, as many as the logarithm of the longest path.
5. A path's occurrences are those of its first edge, its source the place of
   the one of least (document, position).  Every other occurrence is a span to
   remove, after its words have been compared with those at the source's
   coordinates: a digest of the words is taken there, sent along and checked.
6. Windows that repeat within a document are found in it.

Only anchors, edges and spans are exchanged, about one row for eight words at
first and few once paths are compacted; texts once for each use.

A document is matched against documents of smaller id and against itself.
Defined results: null and empty texts have no words; rows of the same id are
not matched against each other, nor are those with a null id, which come after
all others; what is found goes back to rows of the same id and text;
repeated rows of different ids lose all words but in the first; an empty table
gives an empty result.  Columns other than id and text pass through ``rows``
untouched, whatever their names; n_removed replaces one of that name.  If two
unlike spans ever had one code, the job would fail rather than remove words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from ventus.llm import text as tx
from ventus.llm.shelf import Shelf

#: Words in the k-mers among which a window's anchor is chosen.
ANCHOR_WORDS = 6
#: Words whose windows are cut into paths at a time; positions within them must fit into _POSITION.
BLOCK_WORDS = 1 << 18
_POSITION = np.uint64((1 << 20) - 1)
#: Ways that an edge's places are dealt where they meet what is known of the edge, if it has over a HOT-th of all places.
SALTS, HOT = 64, 1000
#: A place is its first window times 32, plus the number of windows, plus 16 for an opened window.
_OPENED = 16


def paths(codes: np.ndarray, first: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor, code) of each path; windows are numbered over all words."""
    inside = tx.inside(first, size)
    found = [(np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)]
    for begin in range(0, len(inside), BLOCK_WORDS):  # a path ends with its block at the latest
        ok = np.flatnonzero(inside[begin : begin + BLOCK_WORDS])
        if not len(ok):
            continue
        own = codes[begin : begin + BLOCK_WORDS + size - 1]
        kmers = tx.window_codes(own, k)
        key = (kmers & ~_POSITION) | np.arange(len(kmers), dtype=np.uint64)
        span, least = 1, key
        while span * 2 <= size - k + 1:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        if span < size - k + 1:
            rest = size - k + 1 - span
            least = np.minimum(least[:-rest], least[rest:])
        at = (least[ok] & _POSITION).astype(np.int64)
        new = np.ones(len(ok), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(ok)))
        whole = tx.range_codes(tx.window_codes(own, size), ok[start], count)
        found.append((ok[start] + begin, count, (kmers[at[start]] >> np.uint64(16)).astype(np.int64), whole))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _scan(size: int, k: int):
    """A row for each packed edge of each document, but for those that the document has already shown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tx.texts_of(batch.column("text")):
                w = tx.words_of(t)
                start, count, anchor, whole = paths(tx.word_codes(t.data, w), w.first, size, k)
                owner = np.searchsorted(w.first, start, side="right") - 1
                again, _ = tx.repeats_of(owner, whole)
                known, _ = tx.repeats_of(owner, anchor.view(np.uint64))
                fresh = ~again
                doc, row = (batch.column(c).slice(t.first, len(t)).take(pa.array(owner[fresh])) for c in ("doc", "row"))
                at = (start - w.first[owner]) * 32 + count
                yield pa.record_batch([pa.array(anchor[fresh]), pa.array(whole[fresh].view(np.int64)), doc, row, pa.array(at[fresh]), pa.array(~known[fresh])], names=["one", "two", "doc", "row", "at", "new_anchor"])

    return run


def _open(size: int):
    """The windows of the packed edges that a document is asked to open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("opened")
            for t in tx.texts_of(batch.column("text")):
                w = tx.words_of(t)
                own = lists.slice(t.first, len(t))
                at = np.asarray(own.flatten())
                owner = np.repeat(np.arange(len(t)), np.asarray(own.value_lengths()))
                count = at & 15
                start = np.repeat((at >> 5) + w.first[owner], count)
                start = start + np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
                owner = np.repeat(owner, count)
                order = np.lexsort((start, owner))  # so that of equal windows the earliest stays
                start, owner = start[order], owner[order]
                one, two = (tx.window_codes(tx.word_codes(t.data, w, which), size, which)[start] for which in (0, 1))
                doc, row = (batch.column(c).slice(t.first, len(t)).take(pa.array(owner)) for c in ("doc", "row"))
                again, _ = tx.repeats_of(owner, one)
                out = pa.record_batch([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), doc, row, pa.array((start - w.first[owner]) * 32 + _OPENED + 1)], names=["one", "two", "doc", "row", "at"])
                yield out.filter(pa.array(~again))

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by document and place; gives each edge with the names of the edges right before and after it, zeros for none."""
    held: pa.RecordBatch | None = None
    last: tuple | None = None  # (doc, row, kind, end, one, two) of the row before

    def rows(batch: pa.RecordBatch, before: tuple | None, after: tuple | None) -> pa.RecordBatch:
        doc, row, place, *names = (np.asarray(batch.column(c)) for c in ("doc", "row", "place", "one", "two"))
        kind, start = place >> 58, (place >> 5) & ((1 << 53) - 1)
        end = start + (place & 15)
        joint = (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (kind[1:] == kind[:-1]) & (start[1:] == end[:-1])
        beside = [np.zeros(len(doc), dtype=np.int64) for _ in range(4)]  # one and two of the edge before, of the edge after
        for k, name in enumerate(names):
            beside[k][1:][joint], beside[2 + k][:-1][joint] = name[:-1][joint], name[1:][joint]
        if before is not None and before[:4] == (doc[0], row[0], kind[0], start[0]):
            beside[0][0], beside[1][0] = before[4:]
        if after is not None and after[:4] == (doc[-1], row[-1], kind[-1], end[-1]):
            beside[2][-1], beside[3][-1] = after[4:]
        return pa.record_batch([batch.column("one"), batch.column("two"), pa.array(place & 15), *map(pa.array, beside)], names=["one", "two", "count", "prev_one", "prev_two", "next_one", "next_two"])

    def edge(batch: pa.RecordBatch, k: int, at_end: bool) -> tuple:
        doc, row, place, one, two = (int(np.asarray(batch.column(c))[k]) for c in ("doc", "row", "place", "one", "two"))
        start = (place >> 5) & ((1 << 53) - 1)
        return doc, row, place >> 58, start + (place & 15) * at_end, one, two

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield rows(held, last, edge(batch, 0, False))
            last = edge(held, -1, True)
        held = batch
    if held is not None:
        yield rows(held, last, None)


def compacted(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(one, two, n, windows) of the first edge of each maximal nonbranching path, windows being those of all its edges.

    edges: (one, two, count, prev_one, prev_two, next_one, next_two, n); an edge
    is named by both of one and two, and its neighbours are null where the node
    before or after it ends or branches.
    """
    name = lambda a, b: [F.col(f"{a}_one").alias(f"{b}_one"), F.col(f"{a}_two").alias(f"{b}_two")]
    own = lambda b: [F.col("one").alias(f"{b}_one"), F.col("two").alias(f"{b}_two")]
    before = edges.where("next_one is not null").select(*own("head"), *name("next", "edge"))
    after = edges.where("prev_one is not null").select(*name("prev", "head"), *own("edge"))
    jump = shelf.put(before.join(after, before.columns), "jump-0")
    k = 0
    while True:
        # of an edge whose head has a predecessor the head becomes that one's head, which is twice as far back
        beyond = jump.select(*name("edge", "head"), *name("head", "beyond"))
        moved = Observation()
        step = jump.join(beyond, ["head_one", "head_two"], "left").observe(moved, F.count("beyond_one").alias("n"))
        to = [F.when(F.col("beyond_one").isNull(), F.col(f"head_{x}")).otherwise(F.col(f"beyond_{x}")).alias(f"head_{x}") for x in ("one", "two")]
        jump = shelf.put(step.select("edge_one", "edge_two", *to), f"jump-{k + 1}")
        shelf.drop(f"jump-{k}")
        k += 1
        if not moved.get["n"]:
            break
    led = edges.select("one", "two", "count").join(jump, (F.col("one") == F.col("edge_one")) & (F.col("two") == F.col("edge_two")), "left")
    first = [F.when(F.col("head_one").isNull(), F.col(x)).otherwise(F.col(f"head_{x}")).alias(x) for x in ("one", "two")]
    return edges.select("one", "two", "n").join(led.select(*first, "count").groupBy("one", "two").agg(F.sum("count").alias("windows")), ["one", "two"])


def _plain(t: tx.Texts, w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins (one entry more than words)."""
    length = w.ends - w.starts
    begins = np.concatenate(([0], np.cumsum(length + 1)))
    plain = np.full(begins[-1], 0x20, dtype=np.uint8)
    total = int(length.sum())
    plain[np.arange(total) + np.repeat(np.arange(len(w)), length)] = t.data[~tx._SPACE[t.data]]
    return plain, begins


def _digests(t: tx.Texts, w: tx.Words, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """A digest of the words of each range."""
    if not len(start):
        return []
    plain, begins = _plain(t, w)
    return [xxh3_128_digest(plain[a:b].data) for a, b in zip(begins[start].tolist(), begins[end].tolist(), strict=True)]


def _witness(size: int):
    """What stands at the sources: a digest of the words of each path there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tx.texts_of(batch.column("text")):
                w = tx.words_of(t)
                own = batch.column("paths").slice(t.first, len(t))
                owner = np.repeat(np.arange(len(t)), np.asarray(own.value_lengths()))
                one, two, at, windows = (np.asarray(own.flatten().field(k)) for k in range(4))
                start = (at >> 5) + w.first[owner]
                yield pa.record_batch([pa.array(one), pa.array(two), pa.array(_digests(t, w, start, start + windows + size - 1), pa.binary())], names=["one", "two", "digest"])

    return run


def removed_words(t: tx.Texts, spans: pa.Array, size: int) -> tuple[tx.Words, np.ndarray]:
    """The words of texts, and which of them are in the given spans or in windows that repeat within their text."""
    w = tx.words_of(t)
    ok = np.flatnonzero(tx.inside(w.first, size))
    source = ok[tx.first_equal(w.text_of()[ok], tx.window_codes(tx.word_codes(t.data, w), size)[ok])]
    again = source != ok
    if again.any() and not tx.same_windows(tx.word_codes(t.data, w, 1), ok[again], source[again], size).all():
        raise ValueError("two windows of unlike words have one code")
    owner = np.repeat(np.arange(len(t)), np.asarray(pc.fill_null(spans.value_lengths(), 0)) if len(spans) else 0)
    start = length = np.zeros(0, dtype=np.int64)
    if len(owner):
        given = spans.flatten()
        at, windows = (np.asarray(given.field(k)) for k in range(2))
        start, length = (at >> 5) + w.first[owner], windows + size - 1
        if _digests(t, w, start, start + length) != given.field(2).to_pylist():
            raise ValueError("a span has other words than its source")
    return w, tx.covered(np.concatenate((ok[again], start)), np.concatenate((np.full(int(again.sum()), size), length)), len(w))


class Digest:
    """Counts and the hash of what is left."""

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def __call__(self, batch: pa.RecordBatch, t: tx.Texts, w: tx.Words, gone: np.ndarray) -> pa.RecordBatch:
        digests = []
        for k in range(len(t)):
            words = t.raw(k).split()  # bytes split at 0x20 and 0x09-0x0D
            mine = gone[w.first[k] : w.first[k + 1]]
            digests.append(hashlib.sha256(b" ".join(compress(words, (~mine).tolist()) if mine.any() else words)).hexdigest())
        own = batch.slice(t.first, len(t))
        return pa.record_batch([own.column("doc_id").cast(pa.int64()), pa.array(w.per_text), pa.array(tx.per_text(gone, w.first)), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


class Rows:
    """The rows of the input with their kept words as text (untouched where nothing is removed), and n_removed."""

    def __init__(self, docs: DataFrame):
        fields = [f for f in docs.schema if f.name != "n_removed"]  # a column of that name gives way
        self.columns = [f.name for f in fields]
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_removed long"

    def __call__(self, batch: pa.RecordBatch, t: tx.Texts, w: tx.Words, gone: np.ndarray) -> pa.RecordBatch:
        own = batch.slice(t.first, len(t))
        removed = tx.per_text(gone, w.first)
        texts = own.column("text").to_pylist()
        for k in np.flatnonzero(removed):
            texts[k] = b" ".join(compress(t.raw(k).split(), (~gone[w.first[k] : w.first[k + 1]]).tolist())).decode("utf-8", "replace")
        columns = [pa.array(texts, own.column("text").type) if c == "text" else own.column(c) for c in self.columns]
        return pa.record_batch([*columns, pa.array(removed)], names=[*self.columns, "n_removed"])


class Spans:
    """(doc_id, first word, end word) of each maximal removed run."""

    schema = "doc_id long, start long, end long"

    def __call__(self, batch: pa.RecordBatch, t: tx.Texts, w: tx.Words, gone: np.ndarray) -> pa.RecordBatch:
        start, end = tx.runs(gone, w.first)
        owner = np.searchsorted(w.first, start, side="right") - 1
        ids = batch.slice(t.first, len(t)).column("doc_id").cast(pa.int64()).take(pa.array(owner))
        return pa.record_batch([ids, pa.array(start - w.first[owner]), pa.array(end - w.first[owner])], names=["doc_id", "start", "end"])


def _emit(size: int, emit, spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tx.texts_of(batch.column("text")):
                w, gone = removed_words(t, batch.column(spans).slice(t.first, len(t)), size)
                yield emit(batch, t, w, gone)

    return run


def _apart(name: str, taken: list[str]) -> str:
    """The name, or if columns have it, one that none has."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _met(places: DataFrame, known: DataFrame, on: list[str], hint: str = "merge") -> DataFrame:
    """A join of places with what is known of each edge or anchor, a row each, of which column n is the number of places.

    The places of one that holds over a HOT-th of all are dealt over SALTS
    keys; there are at most HOT such, so that these names are broadcast.
    """
    least = (known.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = F.broadcast(known.where(F.col("n") > least).select(*on, F.lit(True).alias("hot")))
    every = F.when(F.col("hot"), F.array(*[F.lit(x) for x in range(SALTS)])).otherwise(F.array(F.lit(0)))
    one = F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "row"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    known = known.drop("n").join(hot, on, "left").withColumn("salt", F.explode(every)).drop("hot")
    return places.join(hot, on, "left").withColumn("salt", one).drop("hot").join(known.hint(hint), [*on, "salt"]).drop("salt")


def repeated_spans(docs: DataFrame, shelf: Shelf, size: int, k: int) -> DataFrame:
    """(doc, row, spans): of each row of docs (doc, row, text) the spans that an earlier document has, as (at, windows, digest)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.mapInArrow(_scan(size, k), "one long, two long, doc long, row long, at long, new_anchor boolean")
    anchors = shelf.put(found.where("new_anchor").groupBy("one").agg(F.count("*").alias("n")).where("n > 1"), "anchors", large=True)
    # anchors of a partition are fewer than its places by far, and fit into a table in memory
    shared = shelf.put(_met(found.drop("new_anchor"), anchors, ["one"], "shuffle_hash"), "shared", large=True)
    shelf.drop("anchors")
    of_edge = [F.min("doc").alias("source"), F.max("doc").alias("last"), F.count("*").alias("n")]
    packed = shelf.put(shared.groupBy("one", "two").agg(*of_edge), "packed")
    branching = shelf.put(packed.groupBy("one").agg(F.count("*").alias("n_edges"), F.sum("n").alias("n")).where("n_edges > 1").drop("n_edges"), "branching")
    first = packed.drop("n").join(branching, "one").select("one", "two", F.col("source").alias("doc"))
    opened = shared.join(first, ["one", "two", "doc"]).groupBy("doc", "row").agg(F.collect_set("at").alias("opened"))
    windows = docs.join(opened.hint("merge"), ["doc", "row"]).mapInArrow(_open(size), "one long, two long, doc long, row long, at long")
    windows = shelf.put(windows, "windows", large=True)

    ends = windows.groupBy("one", "two").agg(*of_edge)
    twice = shelf.put(packed.unionByName(ends).where("source < last").select("one", "two", "n"), "twice")
    places = shelf.put(_met(shared.unionByName(windows), twice, ["one", "two"], "shuffle_hash"), "places", large=True)
    for name in ("shared", "packed", "branching", "windows", "twice"):
        shelf.drop(name)

    # the kind of an edge comes first, so that packed edges and opened windows make two lists of a document; repeated rows count once
    opened = F.col("at").bitwiseAND(F.lit(_OPENED))
    ordered = places.select("one", "two", "doc", "row", (F.shiftleft(opened, 54) + F.col("at") - opened).alias("place"))
    ordered = ordered.repartition(n, "doc", "row").distinct().sortWithinPartitions("doc", "row", "place")
    ordered = ordered.mapInArrow(_neighbours, "one long, two long, count long, prev_one long, prev_two long, next_one long, next_two long")
    sides = [f"{side}_{x}" for side in ("prev", "next") for x in ("one", "two")]
    only = lambda side, x: F.when((F.min(f"{side}_one") == F.max(f"{side}_one")) & (F.min(f"{side}_two") == F.max(f"{side}_two")) & (F.min(f"{side}_one") != 0), F.min(f"{side}_{x}")).alias(f"{side}_{x}")
    edges = ordered.groupBy("one", "two").agg(F.min("count").alias("count"), *(only(*c.split("_")) for c in sides), F.count("*").alias("n"))
    edges = shelf.put(edges, "edges", large=True)
    heads = shelf.put(compacted(edges, shelf), "heads")
    shelf.drop("edges")

    occurrences = shelf.put(_met(places, heads, ["one", "two"]), "occurrences")
    shelf.drop("places")
    sources = occurrences.groupBy("one", "two").agg(F.min(F.struct("doc", "row", "at", "windows")).alias("s"), F.count("*").alias("n")).select("one", "two", "n", "s.*")
    sources = shelf.put(sources, "sources")
    asked = sources.groupBy("doc", "row").agg(F.collect_list(F.struct("one", "two", "at", "windows")).alias("paths"))
    digests = docs.join(asked.hint("merge"), ["doc", "row"]).mapInArrow(_witness(size), "one long, two long, digest binary")
    digests = digests.groupBy("one", "two").agg(F.min("digest").alias("digest"))  # repeated rows give one each
    digests = shelf.put(sources.select("one", "two", "n", F.col("doc").alias("source")).join(digests, ["one", "two"]), "digests", large=True)
    spans = _met(occurrences, digests, ["one", "two"]).where("source < doc").groupBy("doc", "row").agg(F.collect_set(F.struct("at", "windows", "digest")).alias("spans"))
    spans = shelf.put(spans, "spans", large=True)
    for name in ("heads", "occurrences", "sources", "digests"):
        shelf.drop(name)
    return spans


def remove_repeats(docs: DataFrame, emit=None, size: int = 20, k: int = ANCHOR_WORDS) -> DataFrame:
    """Takes from every document the words of windows of size words that start earlier; emit says what comes back."""
    if not k < size <= k + 14:
        raise ValueError("size must be over k and at most k + 14")
    emit = emit or Rows(docs)
    shelf = Shelf(docs.sparkSession)
    columns = emit.columns if isinstance(emit, Rows) else ["doc_id", "text"]
    # the id is the order; with the text, it tells rows of one id or of none apart
    keys = {"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "row": F.xxhash64(F.col("text").cast("string"))}
    spans = repeated_spans(docs.select(*(c.alias(k) for k, c in keys.items()), F.col("text").cast("string").alias("text")), shelf, size, k)
    names = {c: _apart(f"_{c}", columns) for c in ("doc", "row", "spans")}
    rows = docs.select(*columns, *(c.alias(names[k]) for k, c in keys.items()))
    return rows.join(spans.withColumnsRenamed(names).hint("merge"), [names["doc"], names["row"]], "left").mapInArrow(_emit(size, emit, names["spans"]), emit.schema)
