"""A count-min sketch over hashed items, built by partitions and merged by slices.

Each task sends, for every slice of the cells, the sorted cells that it hit as
gaps; a slice's task adds them up.  What reaches the driver, and is broadcast,
is two bits a cell, whatever the input: the level of the count.  Levels: 0 for
a count of 0 or 1, 1 for 2 or 3, 2 for 4 to 15, 3 from 16 on.  A cell counts
whatever falls in it, so a level never understates an item's count.  Of each
slice the cells of the greatest counts (``HOT`` at most) come along with the
logarithm of their count, so that an order can tell 16 from 16 million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import plan_bytes, shuffle_partitions
from .words import U64, mix, word_blocks

#: Upper bound of cells over all rows: 2 bits each, so 64 MB are broadcast at most.
MOST_CELLS = 1 << 28
FLUSH = 1 << 20
#: Cells of a slice whose counts are told apart above the top level.
HOT = 4096


def cells_for(df: DataFrame, per_byte: float) -> int:
    """Cells in proportion to the planner's estimate of the input, up to MOST_CELLS.

    A sketch that is too small for its input only estimates higher; results don't depend on its size.
    """
    return int(min(max(plan_bytes(df) * per_byte, 1 << 16), MOST_CELLS)) // 64 * 64


def cells_of(keys: np.ndarray, cells: int, rows: int) -> list[np.ndarray]:
    """Each row's cell of each key; row r owns cells [r * cells / rows, (r + 1) * cells / rows)."""
    each = cells // rows
    return [((mix(keys, 101 + r) >> U64(32)) * U64(each) >> U64(32)) + U64(r * each) for r in range(rows)]


def pack_gaps(cells: np.ndarray) -> bytes:
    """Sorted cell numbers of a slice as bytes: runs of 255 add up to long gaps; sparse ones as plain 32-bit numbers."""
    if len(cells) == 0 or int(cells[-1]) // 64 > len(cells):
        return b"\0" + cells.astype("<u4").tobytes()
    gaps = np.diff(cells, prepend=U64(0))
    longs = (gaps // U64(255)).astype(np.int64)
    out = np.full(len(gaps) + int(longs.sum()), 255, dtype=np.uint8)
    out[np.arange(len(gaps)) + np.cumsum(longs)] = (gaps % U64(255)).astype(np.uint8)
    return b"\1" + out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, dtype="<u4", offset=1).astype(np.int64)
    steps = np.frombuffer(data, dtype=np.uint8, offset=1)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


class Levels:
    """Packed levels of all cells, and the hot cells with the binary logarithm of their counts."""

    def __init__(self, packed: np.ndarray, hot: np.ndarray, log: np.ndarray, cells: int, rows: int, counted: int):
        self.counted = counted  # keys, repeats included
        self.packed, self.hot, self.log, self.cells, self.rows = packed, hot, log, cells, rows

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The least level over the rows: never below the level of the true count."""
        out = None
        for at in cells_of(keys, self.cells, self.rows):
            own = self.packed[(at >> U64(2)).astype(np.int64)] >> ((at & U64(3)) << U64(1)).astype(np.uint8) & np.uint8(3)
            out = own if out is None else np.minimum(out, own)
        return out

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The levels, with hot cells above the top level by their counts; of a sketch of one row."""
        out = self.of(keys)
        top = np.flatnonzero(out == 3)
        if len(top) and len(self.hot):
            at = cells_of(keys[top], self.cells, 1)[0].astype(np.int64)
            place = np.minimum(np.searchsorted(self.hot, at), len(self.hot) - 1)
            out[top] = np.where(self.hot[place] == at, self.log[place], 3)
        return out


def build(docs: DataFrame, keys: Callable, cells: int, rows: int) -> Levels:
    """The levels of ``keys(words)`` over every document of ``docs`` (a column ``text``)."""
    slices = max(1, min(1024, cells >> 20))
    width = -(-cells // slices) // 64 * 64 + 64
    schema, result = "slice int, cells binary", "slice int, counted long, cells binary, hot binary, log binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            own = np.sort(np.concatenate(held))
            held.clear()
            cut = np.searchsorted(own, np.arange(slices + 1, dtype=np.uint64) * U64(width))
            full = [k for k in range(slices) if cut[k] < cut[k + 1]]
            return pa.record_batch([pa.array(full, pa.int32()), pa.array([pack_gaps(own[cut[k] : cut[k + 1]] - U64(k * width)) for k in full], pa.binary())], names=["slice", "cells"])

        size = 0
        for batch in batches:
            for _, _, words in word_blocks(batch.column("text")):
                for got in cells_of(keys(words), cells, rows):
                    held.append(got)
                    size += len(got)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def done() -> pa.RecordBatch:
            level = (total >= 2).astype(np.uint8) + (total >= 4) + (total >= 16)
            packed = (level[0::4] | level[1::4] << 2 | level[2::4] << 4 | level[3::4] << 6).astype(np.uint8)
            hot = np.flatnonzero(total >= 16)
            if len(hot) > HOT:
                hot = np.sort(hot[np.argpartition(-total[hot], HOT)[:HOT]])
            log = np.log2(total[hot]).astype(np.uint8)
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([int(total.sum())], pa.int64()), *(pa.array([x], pa.binary()) for x in (packed.tobytes(), (hot + at * width).astype("<i8").tobytes(), log.tobytes()))], names=["slice", "counted", "cells", "hot", "log"])

        for batch in batches:
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("cells"), strict=True):
                if k != at:
                    if at is not None:
                        yield done()
                    at, total = k, np.zeros(width, dtype=np.int64)
                total += np.bincount(unpack_gaps(data.as_py()), minlength=width)
        if at is not None:
            yield done()

    spark = docs.sparkSession
    parts = docs.select("text").mapInArrow(count, schema).repartition(min(slices, shuffle_partitions(spark)), "slice").sortWithinPartitions("slice").mapInArrow(add, result)
    packed, hot, log, counted = np.zeros(slices * width // 4, dtype=np.uint8), {}, {}, 0
    for k, own, data, cell, count in parts.toLocalIterator():  # a slice at a time; all of them are 64 MB and 1024 x HOT cells at most
        packed[k * width // 4 : (k + 1) * width // 4] = np.frombuffer(data, dtype=np.uint8)
        counted += own
        hot[k], log[k] = np.frombuffer(cell, "<i8"), np.frombuffer(count, np.uint8)
    join = lambda x, t: np.concatenate([np.zeros(0, t), *(x[k] for k in sorted(x))])
    return Levels(packed, join(hot, np.int64), join(log, np.uint8), cells, rows, counted // rows)
