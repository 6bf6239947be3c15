"""Vectorised work on whole texts held in Arrow string columns.

Every function here takes the raw UTF-8 buffer of a run of texts and returns
numpy arrays, so the operators touch each byte a fixed number of times and
never loop over words in Python.  A *word* is a maximal run of bytes outside
0x20 and 0x09-0x0D; UTF-8 never uses those bytes inside a character, so byte
work and character work agree.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest

#: Bytes of text worked on at a time; a longer single text is one slice.
SLICE_BYTES = 512 << 10

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

U64 = np.uint64
#: Odd multipliers of the mixers; a second family of codes uses the others.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_RIGHT = (0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407)
_byte_codes = tuple(np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1) for seed in (11, 12))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def joined(left: np.ndarray, right: np.ndarray, which: int = 0) -> np.ndarray:
    """A code of two codes in their order.

    The mixer stands between every two levels, so that codes of windows have
    no algebraic form: sums of powers modulo 2**64 collide on sequences that
    are easy to write down, whatever the base.
    """
    with np.errstate(over="ignore"):
        out = left * U64(_BASES[which])
        more = right * U64(_RIGHT[which])
        out += more
        np.right_shift(out, U64(32), out=more)
        out ^= more
        out *= U64(0xBF58476D1CE4E5B9)
        np.right_shift(out, U64(29), out=more)
        out ^= more
    return out


def release() -> None:
    """Gives memory that is no longer in use back to the machine, which the executor's limit counts else."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


@dataclass
class Texts:
    """Consecutive whole texts: their bytes, where each starts, and which rows they are."""

    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than there are texts
    first: int  # row of the batch that the first text has
    valid: np.ndarray  # bool, false where the text is null

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_bytes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def raw(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def texts_of(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a string column in slices of about max_bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return
    valid = np.asarray(column.is_valid())
    if not valid.all():
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = column.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8) if whole is not None and whole.size else np.zeros(0, dtype=np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1)
        yield Texts(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], start, valid[start:end])
        start = end
    release()


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How much of flags lies in each of the ranges that bounds delimits."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds])


@dataclass
class Words:
    """The words of Texts: byte ranges, and the first word of each text (one entry more than texts)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)


def words_of(t: Texts) -> Words:
    solid = ~_SPACE[t.data]
    n = len(solid)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, np.zeros(len(t) + 1, dtype=np.int64))
    edge = np.zeros(n + 1, dtype=bool)
    edge[t.offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = solid[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, t.offsets))


def line_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges in their order, which must not overlap, as one Arrow column."""
    step = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(step[:-1]) > 0])])


def distinct(column: pa.Array) -> np.ndarray:
    """A number for each value: equal numbers are equal bytes."""
    return np.asarray(column.dictionary_encode().indices)


#: Longer words are hashed one by one.
LONG_WORD = 64


def word_codes(data: np.ndarray, w: Words, which: int = 0) -> np.ndarray:
    """A 64-bit code of each word from all its bytes, eight at a time."""
    length = w.ends - w.starts
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from each position
    out = (length.astype(np.uint64) + U64(1)) * U64(_BASES[1 - which])
    at, going = 0, np.flatnonzero(length <= LONG_WORD)
    while len(going):
        value, left = eight[w.starts[going] + at], length[going] - at
        short = left < 8
        value[short] &= (U64(1) << (left[short] * 8).astype(np.uint64)) - U64(1)
        out[going] = joined(mix(out[going]) if at else out[going], mix(value), which)
        going = going[left > 8]
        at += 8
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        out[k] = int.from_bytes(xxh3_128_digest(data[w.starts[k] : w.ends[k]].tobytes())[8 * which : 8 * which + 8], "little")
    return out


def window_codes(codes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A code of every run of size codes, by doubling; empty if there are fewer."""
    if len(codes) < size:
        return np.zeros(0, dtype=np.uint64)
    out, span = codes, 1
    while span * 2 <= size:
        out, span = joined(out[:-span], out[span:], which), span * 2
    rest = size - span
    return joined(out[:-rest], out[rest:], which) if rest else out


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number, as far as there are eight."""
    data = np.ascontiguousarray(data)
    return np.ndarray((len(data) - 7,), ">u8", data.data, 0, (1,)).astype(np.uint64)


def byte_windows(data: np.ndarray, sizes: tuple[int, ...], which: int = 0) -> list[np.ndarray]:
    """Codes of every run of each of the sizes of bytes (ascending, 16 at least)."""
    found, n = [], len(data)
    out, span = eights(data) if n > 7 else np.zeros(0, dtype=np.uint64), 8
    for size in sizes:
        if n < size:
            found.append(np.zeros(0, dtype=np.uint64))
            continue
        while span * 2 <= size:
            out, span = joined(out[:-span], out[span:], which), span * 2
        rest = size - span
        found.append(joined(out[:-rest], out[rest:], which) if rest else out)
    return found


def range_codes(windows: np.ndarray, start: np.ndarray, count: np.ndarray, which: int = 0) -> np.ndarray:
    """A code of each run of count windows, count being at most a window's size: its first and last window cover it."""
    with np.errstate(over="ignore"):
        return joined(windows[start], windows[start + count - 1] + count.astype(np.uint64) * U64(_RIGHT[1 - which]), which)


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """For every window of size over all words: whether it stays within one text."""
    total = int(first[-1])
    n = total - size + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    last_start = np.repeat(first[1:] - size, np.diff(first))[:n]
    return np.arange(n) <= last_start


def covered(starts: np.ndarray, size: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n positions lie in a range [start, start + size)."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:-1]) > 0


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def runs(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs, cut where a text begins."""
    n = len(flags)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    cut = np.zeros(n + 1, dtype=bool)
    cut[first] = True
    before = np.concatenate(([False], flags[:-1]))
    after = np.concatenate((flags[1:], [False]))
    return np.flatnonzero(flags & (~before | cut[:-1])), np.flatnonzero(flags & (~after | cut[1:])) + 1


def repeats_of(owner: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier one of the same owner, found twice or more there)."""
    source = first_equal(owner, codes)
    later = source != np.arange(len(source))
    twice = later.copy()
    twice[source[later]] = True
    return later, twice


def first_equal(owner: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each entry the place of the first one with the same owner and code."""
    if not len(codes):
        return np.zeros(0, dtype=np.int64)
    key = joined(codes.astype(np.uint64, copy=False), owner.astype(np.uint64))
    order = np.argsort(key)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[order][1:] != key[order][:-1]
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def same_windows(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the runs of size symbols from places a and b are equal, symbol by symbol."""
    out = np.ones(len(a), dtype=bool)
    for j in range(size):
        out &= symbols[a + j] == symbols[b + j]
    return out
