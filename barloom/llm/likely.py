"""Rows whose sets can link with another at all, by counts over shuffled prefixes.

Of a set of n hashes, two sets that link have at least l = ceil(t n) in common,
so the first k of what they share is among the n - l + k least hashes of both.
Each set sends these, with k a part of n, and may link only if at least the
least k of any set that it could link with come from other sets too.  The count
is by hash, dealt over slices; a slice's answer is a number for each row that
shares any of its hashes.  Nothing depends on the size of a sketch or is
broadcast but one bit a row, and false answers only let a row pass.

A hash travels as 4 bytes and the row's number in its block as 2, many in one
binary.  A block is 65536 consecutive row numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import shuffle_partitions
from .words import U64, mix, spans, word_blocks

#: Percent of a set that its prefix holds beyond the least: more is sent, and fewer rows pass by chance.
BEYOND = 15
FLUSH = 1 << 21
#: Bytes of input a slice, and the most slices.
SLICE_BYTES, MOST_SLICES = 1 << 22, 4096


class Rows:
    """A set of row numbers: the bits of each block."""

    def __init__(self, parts: DataFrame):
        self.bits: dict[int, bytes] = dict(map(tuple, parts.collect()))  # a bit a row

    def has(self, rows: np.ndarray) -> np.ndarray:
        out, keys, low = np.zeros(len(rows), dtype=bool), rows >> 16, rows & 0xFFFF
        for key in np.unique(keys):
            bits = np.frombuffer(self.bits.get(int(key), b""), dtype=np.uint8)
            at = np.flatnonzero((keys == key) & (low >> 3 < len(bits)))
            out[at] = bits[low[at] >> 3] >> (low[at] & 7).astype(np.uint8) & 1
        return out

    def cut(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = self.has(batch.column("row").to_numpy())
        return batch if keep.all() else batch.filter(pa.array(keep))


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """Runs of one key over sorted batches: (key, its rows of a batch, whether the key begins there)."""
    last = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1, append=keys[-1:] + 1)) if len(keys) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield int(keys[lo]), batch.slice(lo, hi - lo), keys[lo] != last
            last = keys[lo]


def _bits(key: int, chosen: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([key], pa.int64()), pa.array([np.packbits(chosen, bitorder="little").tobytes().rstrip(b"\0")], pa.binary())], names=["key", "bits"])


def bits_of(rows: DataFrame) -> DataFrame:
    """(key, bits) of the blocks of ``rows`` (a column ``row``)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chosen = None, None
        for key, part, new in _by_key(batches):
            if new:
                if at is not None:
                    yield _bits(at, chosen)
                at, chosen = key, np.zeros(1 << 16, dtype=bool)
            chosen[part.column(1).to_numpy() & 0xFFFF] = True
        if at is not None:
            yield _bits(at, chosen)

    return rows.select(F.shiftright("row", 16).alias("key"), "row").repartition("key").sortWithinPartitions("key").mapInArrow(pack, "key long, bits binary")


def prefixes(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(least hashes that a set of n sends, those of them that must come from other sets too)."""
    least = -(-percent * n // 100)
    beyond = lambda x: np.clip(1 + BEYOND * x // 100, 1, np.maximum(-(-percent * x // 100), 1))
    return np.minimum(n - least + beyond(n), n), beyond(least)


def likely(rows: DataFrame, sets: Callable, chosen, percent: int, n_bytes: int) -> DataFrame:
    """(key, bits) of those of the ``chosen`` (a broadcast ``Rows``) ``rows`` (row, text) that may link.

    ``sets(words)``: distinct hashes, document after document and sorted in each, and their bounds.
    """
    slices = max(1, min(MOST_SLICES, n_bytes // SLICE_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            row, sent, need, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            ends = np.concatenate(([0], np.cumsum(sent)))
            edges = np.flatnonzero(np.diff(row >> 16, prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                own, low = hashes[ends[lo] : ends[hi]], (row[lo:hi] & 0xFFFF).astype("<u2")
                part = ((own >> U64(32)) * U64(slices) >> U64(32)).astype(np.uint16)
                order = np.argsort(part, kind="stable")
                cells, docs = own[order].astype("<u4"), np.repeat(low, sent[lo:hi])[order]
                cut = np.searchsorted(part[order], np.arange(slices + 1))
                full = np.flatnonzero(cut[:-1] < cut[1:])
                # What each row needs rides along with one of the slices.
                home = full[int(row[lo] >> 16) % len(full)]
                pack = lambda x: [x[cut[k] : cut[k + 1]].tobytes() for k in full]
                with_home = lambda x: [x.tobytes() if k == home else None for k in full]
                yield pa.record_batch(
                    [pa.array(full, pa.int32()), pa.array([int(row[lo] >> 16)] * len(full), pa.int64()), *(pa.array(x, pa.binary()) for x in (pack(cells), pack(docs), with_home(low), with_home(need[lo:hi].astype("<i4"))))],
                    names=["slice", "key", "cells", "docs", "who", "need"],
                )

        size = 0
        for batch in batches:
            batch = chosen.value.cut(batch)
            for lo, hi, words in word_blocks(batch.column("text")):
                row = batch.column("row").slice(lo, hi - lo).to_numpy()
                own, bounds = sets(words)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                sent, need = prefixes(n[some], percent)
                held.append((row[some], sent, need, mix(own[spans(bounds[some], sent)], 71)))
                size += int(sent.sum())
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            column = lambda name: [x for part in held for x in part.column(name)]
            view = lambda name, kind: [np.frombuffer(x.as_buffer(), dtype=kind) for x in column(name)]
            cells, docs = view("cells", "<u4"), view("docs", "<u2")
            of = np.repeat(np.arange(len(cells), dtype=np.int64), [len(x) for x in cells])
            order = np.sort(np.concatenate(cells).astype(np.uint64) << U64(32) | np.arange(len(of), dtype=np.uint64))
            same = order[1:] >> U64(32) == order[:-1] >> U64(32)
            shared = np.zeros(len(of), dtype=bool)
            place = (order & U64(0xFFFFFFFF)).astype(np.int64)
            shared[place[1:][same]] = shared[place[:-1][same]] = True
            both = (of << 16 | np.concatenate(docs))[shared]  # in order, as each binary keeps the order of its rows
            first = np.flatnonzero(np.diff(both, prepend=-1))
            times = np.diff(first, append=len(both)).astype("<u4")
            both = both[first]
            cut = np.searchsorted(both >> 16, np.arange(len(cells) + 1))
            low = (both & 0xFFFF).astype("<u2")
            who, need = column("who"), column("need")
            out = [(key.as_py(), low[a:b].tobytes(), times[a:b].tobytes(), w.as_py(), x.as_py()) for key, a, b, w, x in zip(column("key"), cut[:-1], cut[1:], who, need, strict=True) if a < b or w.is_valid]
            held.clear()
            kinds = (pa.int64(), *[pa.binary()] * 4)
            return pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["key", "docs", "times", "who", "need"])

        for _, part, new in _by_key(batches):
            if new and held:
                yield done()
            held.append(part)
        if held:
            yield done()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, times, needs = None, None, None

        def done() -> pa.RecordBatch:
            return _bits(at, (needs > 0) & (times >= needs))

        for key, part, new in _by_key(batches):
            if new:
                if at is not None:
                    yield done()
                at, times, needs = key, np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
            for docs, own, who, need in zip(*(part.column(c) for c in ("docs", "times", "who", "need")), strict=True):
                times[np.frombuffer(docs.as_buffer(), "<u2")] += np.frombuffer(own.as_buffer(), "<u4")
                if who.is_valid:
                    needs[np.frombuffer(who.as_buffer(), "<u2")] = np.frombuffer(need.as_buffer(), "<i4")
        if at is not None:
            yield done()

    sent = rows.select("row", "text").mapInArrow(send, "slice int, key long, cells binary, docs binary, who binary, need binary")
    found = sent.repartition(min(slices, shuffle_partitions(rows.sparkSession)), "slice").sortWithinPartitions("slice").mapInArrow(count, "key long, docs binary, times binary, who binary, need binary")
    return found.repartition("key").sortWithinPartitions("key").mapInArrow(settle, "key long, bits binary")
