"""Operator 9: removal of repeated passages, by a count-min prefilter.

A window is ``size`` consecutive words of one document.  Every word that some
window covers whose word sequence also starts anywhere else is removed.

Pass 1: each task counts the windows of its documents in a sketch and the
tasks' sketches are merged.  Consecutive windows share a key, the smallest
hash of a run of words inside them, so a passage costs few counts; a key's
count is never below that of any window under it, so the estimate is never
too low.  Pass 2 takes only the windows estimated to repeat, groups them
exactly by a 96-bit hash of their words, and finds the few that don't.  Those
are single by definition, so what flows back has no hot key: a passage that a
third of all documents share costs one entry for each task.  The last pass
marks the estimated windows but for those few.

Defined results: a null or empty text has no words and keeps the hash of the
empty text; a null ``doc_id`` is kept as null; rows that repeat are documents
of their own (so their windows repeat); an empty table gives an empty result;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import sketch
from .common import Scratch, documents, map_arrow, shuffle_partitions, texts
from .words import U64, Words, mix, run_starts, runs, word_blocks

ROWS = 2
#: Sketch cells for each byte of the planner's estimate of the input.
PER_BYTE = 1.0
NOWHERE = 2**64 - 2
#: Windows at most, about, for each task that groups them, a quarter of them at a time.
PER_TASK = 4 << 20


def _slide(values: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Smallest (largest) of ``size`` values from each place on; what lies beyond the end doesn't count."""
    pick = np.minimum if least else np.maximum
    out, done = values.copy(), 1
    while done < size:
        step = min(done, size - done)
        if step < len(out):
            out[: len(out) - step] = pick(out[: len(out) - step], out[step:])
        done += step
    return out


class Windows:
    """Window starts of a run of documents, with the sketch key of each."""

    def __init__(self, words: Words, size: int, fold: bool = False):
        self.size, self.words = size, words
        self.hash = words.hashes(fold)
        self.starts = run_starts(words.first, size)
        self.gram = max(1, size * 4 // 7)
        n = len(self.hash)
        self.value = np.full(n, NOWHERE, dtype=np.uint64)
        own = runs(self.hash, self.gram, 7)
        inside = run_starts(words.first, self.gram)[: len(own)]
        self.value[: len(own)][inside] = own[inside] & U64(NOWHERE)
        self.reach = size - self.gram + 1

    def keys(self) -> np.ndarray:
        """The value at each place that is the smallest of some window: the items that are counted."""
        return self.value[self._chosen()]

    def _chosen(self) -> np.ndarray:
        if not len(self.value):
            return np.zeros(0, dtype=bool)
        least = _slide(self.value, self.reach, True)
        least[~self.starts] = 0
        most = _slide(least[::-1], self.reach, False)[::-1]
        return (most == self.value) & (self.value != NOWHERE)

    def repeated(self, levels: sketch.Levels) -> np.ndarray:
        """Starts of the windows whose estimated count is 2 or more."""
        if not len(self.value):
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self._chosen())
        flagged = self.value.copy()
        flagged[at] |= (levels.of(self.value[at]) > 0).astype(np.uint64)
        least = _slide(flagged, self.reach, True)
        return np.flatnonzero(self.starts & ((least & U64(1)) == 1))

    def identity(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return runs(self.hash, self.size, 11)[at], (runs(mix(self.hash, 5), self.size, 13)[at] >> U64(32)).astype(np.uint32)


ENTRY = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i4"), ("pos", "<u4")])
_BLOB = "bucket int, ids binary, marks binary, entries binary"


def _send(broadcast, size: int, buckets: int):
    """Estimated windows of each run of documents, by bucket of their hash; one entry where a run has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = broadcast.value
        held: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        n_docs = n = 0

        def flush() -> pa.RecordBatch:
            own = np.concatenate(held)
            own = own[np.lexsort((own["b"], own["a"]))]
            new = np.ones(len(own), dtype=bool)
            new[1:] = (own["a"][1:] != own["a"][:-1]) | (own["b"][1:] != own["b"][:-1])
            first = np.flatnonzero(new)
            several = np.diff(np.append(first, len(own))) > 1
            own = own[first]
            own["doc"][several] = -1
            bucket = ((own["a"] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            full = [k for k in range(buckets) if cut[k] < cut[k + 1]]
            a, b = np.concatenate(ids), np.concatenate(marks)
            rows = []
            for k in full:
                part = own[cut[k] : cut[k + 1]].copy()
                used, at = np.unique(part["doc"], return_inverse=True)
                single = part["doc"] >= 0
                part["doc"][single] = (at - int(used[0] < 0))[single]
                used = used[used >= 0]
                rows.append((k, a[used].tobytes(), b[used].tobytes(), part["a"].tobytes() + part["b"].tobytes() + part["doc"].tobytes() + part["pos"].tobytes()))
            held.clear(), ids.clear(), marks.clear()
            return pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "ids", "marks", "entries"])

        for batch in batches:
            key, mark = batch.column("key").to_numpy(), batch.column("mark").to_numpy()
            for lo, hi, words in word_blocks(batch.column("text")):
                seen = Windows(words, size)
                at = seen.repeated(levels)
                if not len(at):
                    continue
                part = np.empty(len(at), dtype=ENTRY)
                part["a"], part["b"] = seen.identity(at)
                doc = np.searchsorted(words.first, at, side="right") - 1
                part["pos"] = at - words.first[doc]
                part["doc"] = doc + n_docs
                held.append(part)
                ids.append(key[lo:hi])
                marks.append(mark[lo:hi])
                n_docs += hi - lo
                n += len(at)
                if n >= 1 << 20:
                    yield flush()
                    n_docs = n = 0
        if n:
            yield flush()

    return run


def _unsend(ids: bytes, marks: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 20
    out = np.empty(n, dtype=ENTRY)
    out["a"] = np.frombuffer(data, "<u8", n)
    out["b"] = np.frombuffer(data, "<u4", n, 8 * n)
    out["doc"] = np.frombuffer(data, "<i4", n, 12 * n)
    out["pos"] = np.frombuffer(data, "<u4", n, 16 * n)
    return out, np.frombuffer(ids, "<i8"), np.frombuffer(marks, "<i8")


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket the windows that occur once in all: a bucket at a time."""
    at, parts = None, []

    def done() -> pa.RecordBatch:
        ids, marks, entries, shift = [], [], [], 0
        for a, b, c in parts:
            own, key, mark = _unsend(a, b, c)
            own["doc"][own["doc"] >= 0] += shift
            shift += len(key)
            ids.append(key), marks.append(mark), entries.append(own)
        own = np.concatenate(entries)
        own = own[np.lexsort((own["b"], own["a"]))]
        new = np.ones(len(own) + 1, dtype=bool)
        new[1:-1] = (own["a"][1:] != own["a"][:-1]) | (own["b"][1:] != own["b"][:-1])
        own = own[new[:-1] & new[1:] & (own["doc"] >= 0)]
        key, mark = np.concatenate(ids), np.concatenate(marks)
        return pa.record_batch([pa.array(key[own["doc"]]), pa.array(mark[own["doc"]]), pa.array(own["pos"].astype(np.int32))], names=["key", "mark", "pos"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ids", "marks", "entries")), strict=True):
            if row[0] != at:
                if parts:
                    yield done()
                at, parts = row[0], []
            parts.append(row[1:])
    if parts:
        yield done()


def remove_repeats(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text", per_byte: float = PER_BYTE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document's words that no repeated window covers, joined by one space."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    # A row is known by its id and a hash of its text; rows that agree in both have no single window.
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.lit(-(2**63))), "mark": F.xxhash64("text")})
    cells = sketch.cells_for(docs.select(text_col), per_byte)
    built = sketch.build(rows, lambda words: Windows(words, size).keys(), cells, ROWS)
    levels = spark.sparkContext.broadcast(built)
    # A bucket is sorted by one worker, so buckets grow with the keys counted: even if every window were sent, each would hold about 20 MB.
    windows = built.counted * (size - max(1, size * 4 // 7) + 2) // 2
    n = max(shuffle_partitions(spark), windows // PER_TASK)
    buckets = 4 * n
    sent = rows.select("key", "mark", "text").mapInArrow(_send(levels, size, buckets), _BLOB)
    single = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_singles, "key long, mark long, pos int")
    single = Scratch(spark, "repeats").keep(single, "single").groupBy("key", "mark").agg(F.collect_list("pos").alias("single"))
    joined = rows.join(single, ["key", "mark"], "left").select("doc_id", "text", "single")

    def make():
        known = levels.value

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            singles = batch.column("single")
            for lo, hi, words in word_blocks(batch.column("text")):
                at = Windows(words, size).repeated(known)
                marked = np.zeros(len(words.start), dtype=bool)
                marked[at] = True
                part = singles.slice(lo, hi - lo)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                if len(flat):
                    lengths = pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)
                    marked[np.repeat(words.first[:-1], lengths) + flat] = False
                edge = np.zeros(len(marked) + size + 1, dtype=np.int32)
                on = np.flatnonzero(marked)
                edge[on] += 1
                edge[on + size] -= 1
                gone = np.cumsum(edge)[: len(marked)] > 0
                total = np.concatenate(([0], np.cumsum(gone)))
                removed = total[words.first[1:]] - total[words.first[:-1]]
                kept = []
                for d in range(hi - lo):
                    own = words.data[words.bounds[d] : words.bounds[d + 1]].tobytes().split()
                    if removed[d]:
                        own = compress(own, ~gone[words.first[d] : words.first[d + 1]])
                    kept.append(b" ".join(own))
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

        return work

    return map_arrow(joined, "doc_id long, n_words long, n_removed long, kept string", make)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(documents(spark, sf_dir)))
