"""Vectorised word and hash kernels over Arrow string batches.

Every text operator of this subpackage sees a batch as one UTF-8 byte buffer
with document offsets.  Words, their 64-bit hashes and hashes of runs of
words come from a handful of numpy passes over that buffer, so no Python
object is made for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: White space that separates words: space, tab, newline, VT, FF, CR.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same and all ASCII but letters and digits.
PLAIN = np.ones(256, dtype=bool)
PLAIN[128:] = PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_TABLE_FOLDED = _TABLE[FOLD]
_STEP = U64(0x9E3779B97F4A7C15 | 1)
#: Bytes or words that a kernel looks at together: its arrays stay in the processor's cache, whatever the text's length.
PIECE = 1 << 16


def _powers(step: U64) -> np.ndarray:
    table = np.full(PIECE + 1, step, dtype=np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


_POWERS = _powers(_STEP)
_INVERSE = _powers(U64(pow(int(_STEP), -1, 2**64)))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (bijective for each seed)."""
    x = x + U64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """The words of a run of documents.

    ``data``: the bytes; ``start`` and ``end``: byte bounds of each word;
    ``first``: for document d its words are ``first[d]:first[d + 1]``.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE, cut: tuple[np.ndarray, np.ndarray] | None = None):
        self.data, self.bounds = data, bounds
        inner = bounds[1:-1]
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(data), 1 << 20):
            hi = min(lo + (1 << 20), len(data))
            # One byte more on either side settles whether a word goes on there.
            a, b = max(lo - 1, 0), min(hi + 1, len(data))
            own = data[a:b]
            word = ~space[own]
            opens = word.copy()
            opens[1:] &= ~word[:-1]
            if a:
                opens[0] = False
            first = inner[np.searchsorted(inner, a) : np.searchsorted(inner, b)] - a
            opens[first] = word[first]
            if cut is not None:  # a word also begins at a byte of the second set after one of the first
                opens[1:] |= cut[0][own[:-1]] & cut[1][own[1:]]
            # A word ends at the next space or at its document's end, whichever is first.
            closes = word.copy()
            closes[:-1] &= ~word[1:] | opens[1:]
            starts.append(np.flatnonzero(opens[lo - a : hi - a]) + lo)
            ends.append(np.flatnonzero(closes[lo - a : hi - a]) + lo + 1)
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.first = np.searchsorted(self.start, bounds)

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, with A-Z lower-cased if ``fold``: a polynomial of its bytes, whatever the pieces."""
        table, start, end = (_TABLE_FOLDED if fold else _TABLE), self.start, self.end
        out = np.empty(len(start), dtype=np.uint64)
        k = 0
        while k < len(start):
            a = start[k]
            to = int(np.searchsorted(end, a + PIECE, side="right"))
            if to <= k:
                out[k] = _long(table, self.data[a : end[k]])
                k += 1
                continue
            total = _totals(table[self.data[a : end[to - 1]]])
            own = total[end[k:to] - a]
            own -= total[start[k:to] - a]
            own *= _INVERSE[start[k:to] - a]
            out[k:to] = own
            k = to
        out += (end - start).astype(np.uint64)
        return mix(out)

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()

    def texts(self, at: np.ndarray) -> list[str]:
        """The words ``at``; unless they are long, in one pass: none holds a space."""
        size = self.end[at] - self.start[at] + 1  # with the byte after it, which makes way for a space
        if size.sum() > BLOCK:
            return [self.text(k).decode() for k in at.tolist()]
        out = self.data.take(spans(self.start[at], size), mode="clip")
        out[np.cumsum(size) - 1] = 0x20
        return out[:-1].tobytes().decode().split(" ") if len(at) else []


def _totals(terms: np.ndarray) -> np.ndarray:
    """Running sums of up to ``PIECE`` terms, each times its place's power; from 0 on."""
    total = np.zeros(len(terms) + 1, dtype=np.uint64)
    terms *= _POWERS[: len(terms)]
    np.cumsum(terms, out=total[1:])
    return total


def _long(table: np.ndarray, data: np.ndarray) -> np.uint64:
    """The polynomial of one word longer than a piece."""
    with np.errstate(over="ignore"):
        out = power = U64(0)
        for lo in range(0, len(data), PIECE):
            power = U64(1) if not lo else power * _POWERS[PIECE]
            out = out + power * _totals(table[data[lo : lo + PIECE]])[-1]
        return out


def runs(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``size`` words that begin at each word (those that cross a document's end are the caller's to mask)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if size > PIECE:
        raise ValueError(f"runs are of {PIECE} words at most")
    out = np.empty(n, dtype=np.uint64)
    each = max(PIECE - size + 1, 1)
    for lo in range(0, n, each):
        to = min(lo + each, n)
        total = _totals(mix(hashes[lo : to + size - 1], seed + 1))
        own = total[size:] - total[: to - lo]
        own *= _INVERSE[: to - lo]
        out[lo:to] = own
    return mix(out, seed)


def sequences(hashes: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each document's words in their order."""
    n = len(first) - 1
    out = np.diff(first).astype(np.uint64)
    for lo in range(0, len(hashes), PIECE):
        to = min(lo + PIECE, len(hashes))
        doc = np.searchsorted(first, np.arange(lo, to), side="right") - 1
        place = np.arange(lo, to) - first[doc]
        total = np.zeros(to - lo + 1, dtype=np.uint64)
        np.cumsum(mix(hashes[lo:to] + mix(place.astype(np.uint64), seed), seed), out=total[1:])
        a, b = int(doc[0]), int(doc[-1]) + 1
        edges = np.clip(first[a : b + 1], lo, to) - lo
        out[a:b] += total[edges[1:]] - total[edges[:-1]]
    return mix(out[:n], seed)


def run_starts(first: np.ndarray, size: int) -> np.ndarray:
    """True for each word that begins a run of ``size`` words inside one document."""
    n = int(first[-1])
    ok = np.zeros(n, dtype=bool)
    room = np.maximum(np.diff(first) - size + 1, 0)
    if room.sum():
        begin = np.repeat(first[:-1], room)
        step = np.arange(len(begin)) - np.repeat(np.cumsum(room) - room, room)
        ok[begin + step] = True
    return ok


def _trim():
    """The C library's function that gives freed memory back, where there is one."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda keep: 0


_malloc_trim = _trim()


def release() -> None:
    """Gives memory that this worker has freed back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    _malloc_trim(0)


#: Bytes of documents that are looked at together, but for a longer one.
BLOCK = 1 << 20


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of documents of about ``limit`` bytes: (from row, to row, bytes, bounds).

    A null counts as an empty text.  One longer document makes a block of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:  # else null rows could hold bytes
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, everything[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to
    release()


def word_blocks(column: pa.Array, limit: int = BLOCK, space: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    for at, to, data, bounds in blocks(column, limit):
        yield at, to, Words(data, bounds, space)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of each span, one after another."""
    lengths = np.asarray(lengths)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    step = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(np.asarray(starts), lengths) + step
