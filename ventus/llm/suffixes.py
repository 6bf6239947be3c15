"""Repeated byte strings by per-shard suffix arrays.

Every byte that lies in a string of ``size`` bytes which also starts earlier is
removed.  A path is a maximal run of consecutive windows of size bytes whose
least k-gram (by hash) is the same one; equal windows lie in paths of equal
anchor, so the shard of an anchor holds every place where its windows stand.

1. Anchors of one document only are left out by pre-aggregated counts; nothing
   else is decided by a hash of an anchor or of a path.
2. Every other path goes, as bytes, to the shard of its anchor; an anchor of
   very many paths is dealt at random over several shards.
3. A shard sorts the suffixes of its paths by Larsson-Sadakane refinement
   (groups that are still tied are sorted by the rank of what follows, at
   doubling depth), gets common prefixes by Kasai's bound, and takes runs of
   common prefix >= size as equal windows.
4. Windows of anchors dealt over several shards are merged across shards: each
   shard sends the sorted run of its distinct windows, as bytes, and runs are
   merged by binary search.
5. Windows that repeat within a document are found in it, by a hash of the
   window, and are compared byte by byte.

What stands earlier in another document is thus told by comparing bytes alone.
Texts are worked on in blocks of BLOCK_BYTES, so a very long text costs its
own size and not many times that.

Defined results: null and empty texts are empty; rows of the same id are not
matched against each other, nor are those with a null id, which come after all
others; what is found goes back to rows of the same id and text, of which each
is cut and sorted once and what is asked and found is kept as a set, so that
work grows with the rows; repeated rows of different ids lose all bytes but in
the first; an empty table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventus.llm import text as tx
from ventus.llm.shelf import Shelf

GRAM = 24
#: Paths of one anchor in a shard; bytes of paths in one suffix array.
SHARD_PATHS, ARRAY_BYTES = 2048, 512 << 10
#: Buckets of windows to merge for each shard of an anchor.
BUCKETS = 16
#: Bytes whose windows are cut into paths at a time; positions within them must fit into _POSITION.
BLOCK_BYTES = 640 << 10
_POSITION = np.uint64((1 << 20) - 1)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; zeros follow the end."""
    return tx.eights(np.concatenate((data, np.zeros(7, dtype=np.uint8))))


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the wanted suffixes, all if not told, sorted by at least their first depth bytes; which are tied with the one before).

    Suffixes that are not wanted are refined only as far as others are ranked by them.  The end sorts first.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    wanted = np.ones(n, dtype=bool) if wanted is None else wanted
    # bytes are numbered from 1 in their order, and 0 stands for the end; as many of them as fit into a number with a position are sorted at once
    number = np.cumsum(np.bincount(data, minlength=256) > 0)
    bits, place = int(number[-1]).bit_length(), n.bit_length()
    at_once = min((63 - place) // bits, depth)
    rounds = []
    while (h := at_once << len(rounds)) < depth:
        rounds.append(h)
    needed = [wanted]
    for h in rounds[:0:-1]:  # to tell suffixes apart up to 2h, those h further on must be told apart up to h
        more = needed[0].copy()
        more[h:] |= needed[0][:-h]
        needed.insert(0, more)
    key = _numbered(number[data], at_once, bits)
    key <<= place
    key |= np.arange(n)
    key.sort()  # sorting numbers that hold their position is several times faster than sorting positions
    sa, key = key & ((1 << place) - 1), key >> place
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    if not rounds:
        sa, key = sa[wanted[sa]], key[wanted[sa]]
        return sa, np.concatenate(([False], key[1:] == key[:-1]))[: len(sa)]
    width = (n + 1).bit_length()
    rank = np.full(n + 2 * depth + 16, -1, dtype=np.int32)
    first = np.cumsum(new, dtype=np.int32)
    rank[sa] = first
    for h, mine in zip(rounds, needed, strict=True):
        if not mine.all():
            keep = mine[sa]
            sa, first = sa[keep], first[keep]
            new = np.ones(len(sa), dtype=bool)
            new[1:] = first[1:] != first[:-1]
        key = (first.astype(np.int64) << width) | (rank[sa + h] + 1)
        at = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups that are still tied
        if len(at) and 3 * width <= 63:
            own = key[at] << width | sa[at]
            own.sort()
            sa[at], key[at] = own & ((1 << width) - 1), own >> width
        elif len(at):
            order = at[np.argsort(key[at])]
            sa[at], key[at] = sa[order], key[order]
        new = np.ones(len(sa), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first = np.cumsum(new, dtype=np.int32)
        rank[sa] = first
    return sa, ~new


def _numbered(symbols: np.ndarray, count: int, bits: int) -> np.ndarray:
    """The count symbols from each position as one number, the first one highest; zeros follow the end."""
    n = len(symbols)
    run, have, out, taken = symbols.astype(np.int64), 1, np.zeros(n, dtype=np.int64), 0
    while count:
        rest = max(n - have, 0)
        if count & 1:  # runs of the length of each binary digit of count, shortest first
            longer = run << (bits * taken)
            longer[:rest] |= out[have:]
            out, taken = longer, taken + have
        if count > 1:
            longer = run << (bits * have)
            longer[:rest] |= run[have:]
            run, have = longer, have * 2
        count >>= 1
    return out


def common_prefixes(data: np.ndarray, sa: np.ndarray, tied: np.ndarray, depth: int, stride: int = 16) -> np.ndarray:
    """For each place of sa the bytes its suffix has in common with the one before, up to depth; those tied have them all.

    Kasai's bound (a suffix has at least one byte less in common than the
    suffix that starts one byte earlier, if what follows that one's neighbour
    is in the array too) is used in passes over every stride-th position, so
    that a pass is one vector operation.
    """
    n = len(data)
    out = np.zeros(n + 1, dtype=np.int64)
    if len(sa) < 2:
        return out[: len(sa)]
    here = np.zeros(n + 1, dtype=bool)
    here[sa] = True
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    out[sa[tied]] = depth
    head = np.concatenate((words_at(data), np.zeros(depth + 8, dtype=np.uint64)))
    for r in range(stride):
        i = np.arange(r, n, stride)
        i = i[(before[i] >= 0) & (out[i] < depth)]
        j = before[i]
        # the bound needs true order: suffixes tied to full depth may stand either way
        bound = np.where((before[i - 1] >= 0) & here[before[i - 1] + 1], out[i - 1], 0) if r else np.zeros(len(i), dtype=np.int64)
        length = np.where(bound < depth, np.maximum(bound - 1, 0), 0)
        going = np.arange(len(i))
        while len(going):
            differ = head[i[going] + length[going]] ^ head[j[going] + length[going]]
            whole = differ == 0
            part = going[~whole]
            x = differ[~whole]
            lead = np.zeros(len(part), dtype=np.int64)
            for b in range(56, 0, -8):
                lead += (x >> np.uint64(b)) == 0
            length[part] += lead
            going = going[whole]
            length[going] += 8
            going = going[length[going] < depth]
        out[i] = np.minimum(np.minimum(length, depth), n - np.maximum(i, j))
    return out[:n][sa]


def paths(data: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window, number of windows, anchor) of the paths of consecutive texts, block by block; and codes of the block's windows."""
    inside = tx.inside(offsets, size)
    for begin in range(0, len(inside), BLOCK_BYTES):  # a path ends with its block at the latest
        ok = np.flatnonzero(inside[begin : begin + BLOCK_BYTES])
        if not len(ok):
            yield ok, ok, ok, np.zeros(0, dtype=np.uint64)
            continue
        grams, windows = tx.byte_windows(data[begin : begin + BLOCK_BYTES + size - 1], (gram, size))
        key = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        span, least = 1, key
        while span * 2 <= size - gram + 1:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        if span < size - gram + 1:
            rest = size - gram + 1 - span
            least = np.minimum(least[:-rest], least[rest:])
        where = (least[ok] & _POSITION).astype(np.int64)
        new = np.ones(len(ok), dtype=bool)
        new[1:] = (where[1:] != where[:-1]) | (ok[1:] != ok[:-1] + 1)
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(ok)))
        yield ok[start] + begin, count, (grams[where[start]] >> np.uint64(16)).astype(np.int64), windows


def _scan(size: int, gram: int):
    """A row for each path of each document, but for paths that the document has already shown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tx.texts_of(batch.column("text")):
                found = [(np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)]
                for k, (start, count, anchor, windows) in enumerate(paths(t.data, t.offsets, size, gram)):
                    found.append((start, count, anchor, tx.range_codes(windows, start - k * BLOCK_BYTES, count)))
                start, count, anchor, whole = (np.concatenate(x) for x in zip(*found, strict=True))
                owner = np.searchsorted(t.offsets, start, side="right") - 1
                again, _ = tx.repeats_of(owner, whole)
                known, _ = tx.repeats_of(owner, anchor.view(np.uint64))
                fresh = ~again
                ids, row = (batch.column(c).slice(t.first, len(t)).take(pa.array(owner[fresh])) for c in ("doc", "row"))
                at = (start - t.offsets[owner]) * 128 + count
                yield pa.record_batch([pa.array(anchor[fresh]), ids, row, pa.array(at[fresh]), pa.array(~known[fresh])], names=["anchor", "doc", "row", "at", "new_anchor"])

    return run


def _cut(size: int):
    """The bytes of the paths that a document is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            for t in tx.texts_of(batch.column("text")):
                own = asked.slice(t.first, len(t))
                owner = np.repeat(np.arange(len(t)), np.asarray(own.value_lengths()))
                flat = own.flatten()
                anchor, parts, at = (np.asarray(flat.field(k)) for k in range(3))
                start = (at >> 7) + t.offsets[owner]
                length = (at & 127) + size - 1
                ids, row = (batch.column(c).slice(t.first, len(t)).take(pa.array(owner)) for c in ("doc", "row"))
                salt = (tx.joined(np.asarray(row).view(np.uint64), at.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
                ends = np.cumsum(length)
                for a, b in _pieces(ends, OUT_BYTES):
                    offsets = np.concatenate(([0], np.cumsum(length[a:b])))
                    picked = t.data[np.repeat(start[a:b] - offsets[:-1], length[a:b]) + np.arange(offsets[-1])]
                    strings = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(picked)])
                    part = slice(a, b)
                    yield pa.record_batch([pa.array(anchor[part]), pa.array(salt[part]), pa.array(parts[part]), ids[part], row[part], pa.array(at[part]), strings], names=["anchor", "salt", "parts", "doc", "row", "at", "bytes"])

    return run


#: Bytes of paths handed on at a time.
OUT_BYTES = 4 << 20


def _pieces(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes, given by their running sum, come to about most."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


SHARD_SCHEMA = "doc long, row long, at long, merged boolean, anchor long, salt int, bucket int, window binary"


def _sorted_shards(size: int):
    """Rows come sorted by (anchor, salt); gives windows with an earlier source, and sorted runs to merge."""

    def work(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        strings = table.column("bytes").chunk(0)
        raw = strings.buffers()
        ends = np.frombuffer(raw[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
        data = np.frombuffer(raw[2], dtype=np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        doc, row, at, parts, anchor, salt = (np.asarray(table.column(c)) for c in ("doc", "row", "at", "parts", "anchor", "salt"))
        step = np.zeros(len(data) + 1, dtype=np.int8)
        step[ends[:-1]] = 1
        step[ends[:-1] + (at & 127)] = -1
        sa, tied = suffix_array(data, size, np.cumsum(step[:-1], dtype=np.int8) > 0)
        group = np.cumsum(common_prefixes(data, sa, tied, size) < size) - 1
        path = np.repeat(np.arange(len(strings)), np.diff(ends))[sa]
        window = sa - ends[path]
        # one array may hold several shards, but none in part: windows of other anchors are never equal
        own = doc[path]
        least = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, group, own)
        late = own > least[group]
        where = ((at[path] >> 7) + window) * 128 + 1
        doc_out, row_out, at_out = _runs(own[late], row[path[late]], where[late])
        # a sorted run for the merge: of each window of an anchor that other shards have too, the earliest place in its
        # least document (the later ones there repeat it, which is found within the document), in every row of that
        pick = np.flatnonzero(~late & (parts[path] > 1))
        if len(pick):
            pick = pick[np.lexsort((where[pick], row[path[pick]], group[pick]))]
            new = np.ones(len(pick), dtype=bool)
            new[1:] = (group[pick[1:]] != group[pick[:-1]]) | (row[path[pick[1:]]] != row[path[pick[:-1]]])
            pick = pick[new]
        yield _shard_rows(doc_out, row_out, at_out)
        code = tx.byte_windows(data, (size,))[0][sa[pick]] if len(pick) else pick
        for a in range(0, len(pick), OUT_BYTES // size):
            part = pick[a : a + OUT_BYTES // size]
            of = path[part]
            picked = data[sa[part][:, None] + np.arange(size)].reshape(-1)
            windows = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.arange(len(part) + 1, dtype=np.int32) * size), pa.py_buffer(picked)])
            bucket = (code[a : a + len(part)] % (parts[of] * BUCKETS).astype(np.uint64)).astype(np.int32)
            yield _shard_rows(doc[of], row[of], where[part], anchor[of], salt[of], bucket, windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size_held = 0
        for batch in batches:
            tx.release()
            if not batch.num_rows:
                continue
            anchor, salt = np.asarray(batch.column("anchor")), np.asarray(batch.column("salt"))
            if held:  # the last held shard may go on here
                last = held[-1]
                go_on = (anchor[0], salt[0]) == (last.column("anchor")[-1].as_py(), last.column("salt")[-1].as_py())
                if not go_on and size_held >= ARRAY_BYTES:
                    yield from work(held)
                    held, size_held = [], 0
            lengths = (np.asarray(batch.column("at")) & 127) + size - 1
            new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
            begin, total = 0, size_held
            sums = np.concatenate(([0], np.cumsum(lengths)))
            for e in new.tolist():
                if total + sums[e] - sums[begin] >= ARRAY_BYTES:
                    held.append(batch.slice(begin, e - begin))
                    yield from work(held)
                    held, total, begin = [], 0, e
            held.append(batch.slice(begin))
            size_held = total + int(sums[-1] - sums[begin])
        if held:
            yield from work(held)

    return run


def _shard_rows(doc, row, at, anchor=None, salt=None, bucket=None, windows=None) -> pa.RecordBatch:
    n = len(doc)
    rest = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())] if windows is None else [pa.array(anchor), pa.array(salt), pa.array(bucket), windows]
    return pa.record_batch([pa.array(doc), pa.array(row), pa.array(at), pa.array(np.full(n, windows is not None)), *rest], names=["doc", "row", "at", "merged", "anchor", "salt", "bucket", "window"])


def _runs(doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single windows joined to runs of at most 100."""
    if not len(doc):
        return doc, row, at
    start = at >> 7
    order = np.lexsort((start, row, doc))
    doc, row, start = doc[order], row[order], start[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    new |= (start - start[begin]) % 100 == 0
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], row[first], start[first] * 128 + (start[last] - start[first] + 1)


def _merge(size: int):
    """Merges the runs of shards by binary search; gives the places that are not in the least document.

    Rows come sorted by (anchor, bucket, salt, window): a bucket has a share of
    an anchor's windows, each salt of it is one sorted run.
    """
    kind = np.dtype(f"S{size}")  # of one length all, so that zeros at the end don't matter

    def group(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        doc, row, at, salt = (np.asarray(table.column(c)) for c in ("doc", "row", "at", "salt"))
        strings = table.column("window").chunk(0)
        start = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset]
        window = np.frombuffer(strings.buffers()[2], dtype=kind, count=len(strings), offset=start)
        edges = [0, *(np.flatnonzero(salt[1:] != salt[:-1]) + 1).tolist(), len(salt)]
        merged, source = np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            values, place = np.unique(window[a:b], return_inverse=True)
            least = np.full(len(values), np.iinfo(np.int64).max)
            np.minimum.at(least, place, doc[a:b])
            to = np.searchsorted(merged, values)
            known = to < len(merged)
            known[known] = merged[to[known]] == values[known]
            np.minimum.at(source, to[known], least[known])
            merged, source = np.insert(merged, to[~known], values[~known]), np.insert(source, to[~known], least[~known])
        late = doc > source[np.searchsorted(merged, window)]
        return pa.record_batch([pa.array(x) for x in _runs(doc[late], row[late], at[late])], names=["doc", "row", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        mark = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("anchor", "bucket")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(keys[:, s].tolist())
                if key != mark and held:
                    yield group(held)
                    held = []
                mark = key
                held.append(batch.slice(s, e - s))
        if held:
            yield group(held)

    return run


def removed_bytes(t: tx.Texts, spans: pa.Array, size: int, gram: int) -> np.ndarray:
    """Which bytes of texts lie in the given paths or in windows that repeat within their text."""
    none = np.zeros(0, dtype=np.int64)
    blocks = list(paths(t.data, t.offsets, size, gram)) if len(t.data) <= BLOCK_BYTES else [(*x[:3], None) for x in paths(t.data, t.offsets, size, gram)]
    start, count, anchor = (np.concatenate((none, *(x[k] for x in blocks))) for k in range(3))
    owner = np.searchsorted(t.offsets, start, side="right") - 1
    _, twice = tx.repeats_of(owner, anchor.view(np.uint64))
    many = count[twice]
    window = np.repeat(start[twice], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    codes = np.empty(len(window), dtype=np.uint64)
    if len(window) and len(t.data) <= BLOCK_BYTES:
        codes = blocks[0][3][window]
    elif len(window):  # one long text: its windows are coded again, block by block
        for begin in range(0, len(t.data), BLOCK_BYTES):
            a, b = np.searchsorted(window, (begin, begin + BLOCK_BYTES))
            if b > a:
                codes[a:b] = tx.byte_windows(t.data[begin : begin + BLOCK_BYTES + size - 1], (size,))[0][window[a:b] - begin]
    source = tx.first_equal(np.repeat(owner[twice], many), codes)
    again = np.flatnonzero(source != np.arange(len(window)))
    if len(again):
        eight, a, b = words_at(t.data), window[again], window[source[again]]
        for j in (*range(0, size - 7, 8), size - 8):
            if not (eight[a + j] == eight[b + j]).all():
                raise ValueError("two windows of unlike bytes have one code")
    lengths = np.asarray(spans.fill_null([]).value_lengths())
    of = np.repeat(np.arange(len(t)), lengths)
    at = np.asarray(spans.flatten()) if len(of) else np.zeros(0, dtype=np.int64)
    given = (at >> 7) + t.offsets[of]
    starts = np.concatenate((window[again], given))
    ends = np.concatenate((window[again] + size, given + (at & 127) + size - 1))
    n = len(t.data)
    return np.cumsum(np.bincount(starts, minlength=n + 1)[:n] - np.bincount(ends, minlength=n + 1)[:n]) > 0


class Digest:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def __call__(self, ids: pa.Array, t: tx.Texts, gone: np.ndarray) -> pa.RecordBatch:
        start, _ = tx.runs(gone, t.offsets[t.offsets < len(gone)])
        spans = np.bincount(np.searchsorted(t.offsets, start, side="right") - 1, minlength=len(t))
        kept = [hashlib.sha256(t.data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True)]
        return pa.record_batch([ids, pa.array(t.n_bytes), pa.array(tx.per_text(gone, t.offsets)), pa.array(spans), pa.array(kept)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


class Kept:
    """The remaining bytes, and how many went."""

    schema = "doc_id long, kept binary, n_removed long"

    def __call__(self, ids: pa.Array, t: tx.Texts, gone: np.ndarray) -> pa.RecordBatch:
        kept = [t.data[a:b][~gone[a:b]].tobytes() for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True)]
        return pa.record_batch([ids, pa.array(kept, pa.binary()), pa.array(tx.per_text(gone, t.offsets))], names=["doc_id", "kept", "n_removed"])


class Spans:
    """(doc_id, start, end) of each maximal removed run of bytes."""

    schema = "doc_id long, start long, end long"

    def __call__(self, ids: pa.Array, t: tx.Texts, gone: np.ndarray) -> pa.RecordBatch:
        start, end = tx.runs(gone, t.offsets[t.offsets < len(gone)])
        owner = np.searchsorted(t.offsets, start, side="right") - 1
        return pa.record_batch([ids.take(pa.array(owner)), pa.array(start - t.offsets[owner]), pa.array(end - t.offsets[owner])], names=["doc_id", "start", "end"])


def _emit(size: int, gram: int, emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tx.texts_of(batch.column(1)):
                gone = removed_bytes(t, batch.column(2).slice(t.first, len(t)), size, gram)
                yield emit(batch.column(0).slice(t.first, len(t)), t, gone)

    return run


def remove_repeats(docs: DataFrame, emit=None, size: int = 100, gram: int = GRAM) -> DataFrame:
    """Takes from every text the bytes of strings of size bytes that start earlier; emit says what comes back."""
    if not gram < size <= gram + 126:
        raise ValueError("size must be over gram and at most gram + 126")
    emit = emit or Kept()
    spark = docs.sparkSession
    shelf = Shelf(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("doc", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    rows = rows.withColumn("row", F.xxhash64("text"))  # doc is the order; with it, row tells rows of one id or of none apart
    found = rows.select("doc", "row", "text").mapInArrow(_scan(size, gram), "anchor long, doc long, row long, at long, new_anchor boolean")
    parts = F.ceil(F.col("n") / SHARD_PATHS).cast("int").alias("parts")
    anchors = shelf.put(found.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("new_anchor").alias("n_docs")).where("n_docs > 1").select("anchor", parts), "anchors")
    asked = shelf.put(found.drop("new_anchor").join(anchors, "anchor").groupBy("doc", "row").agg(F.collect_set(F.struct("anchor", "parts", "at")).alias("asked")), "asked")

    cut = rows.select("doc", "row", "text").join(asked.hint("merge"), ["doc", "row"]).mapInArrow(_cut(size), "anchor long, salt int, parts int, doc long, row long, at long, bytes binary")
    shards = cut.repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_sorted_shards(size), SHARD_SCHEMA)
    shards = shelf.put(shards, "shards")
    shelf.drop("asked")
    runs = shards.where("merged").select("doc", "row", "at", "anchor", "salt", "bucket", "window")
    late = runs.repartition(n, "anchor", "bucket").sortWithinPartitions("anchor", "bucket", "salt").mapInArrow(_merge(size), "doc long, row long, at long")
    spans = shards.where("not merged").select("doc", "row", "at").unionByName(late)
    spans = shelf.put(spans.groupBy("doc", "row").agg(F.collect_set("at").alias("spans")), "spans").withColumnsRenamed({"doc": "of", "row": "of_row"})
    shelf.drop("shards")
    return rows.join(spans.hint("merge"), (F.col("doc") == F.col("of")) & (F.col("row") == F.col("of_row")), "left").select("doc_id", "text", "spans").mapInArrow(_emit(size, gram, emit), emit.schema)
