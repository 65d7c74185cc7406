"""Operator 1: benchmark decontamination by random-walk embeddings and bit sampling.

Texts and items are sequences of folded words (ASCII punctuation separates).
A text holds an item if some passage of it is within ``ratio`` * n word edits
of the item's n words.

1. After k edits one of the at most k + 1 untouched runs of the item has
   (n - k) / (k + 1) words, so windows of the item's size are laid wherever a
   run of that many (3 at most) words of an item occurs, and one word aside.
2. Each window and item is embedded by a random walk (Chakraborty, Goldenberg,
   Koucky 2016): few edits become a small Hamming distance.  Repetitions
   sample some places of the embedding; equal samples make a candidate.
3. Candidates are verified by exact edit distance with free ends in the text.
4. Samples can miss: each indel shifts the walk.  k edits leave at least
   n - q + 1 - k q of the item's runs of q words, on diagonals (place in the
   text less place in the item) at most k apart, so wherever a text shares so
   many, it is verified as well, unless the item was found there unedited.
   Nothing is left to chance: what is found, its edits and its place are exact.

No shuffle: items go to the tasks in blocks of at most ``BLOCK`` items, one
narrow pass each.

Defined results: null or empty texts hold nothing; null or wordless items are
held by nothing; a null item id is reported as null, a null doc_id as well;
repeated rows are reported each; empty tables give empty results; other
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, text_udf
from .words import PLAIN, U64, Words, mix, runs, spans, word_blocks

RATIO = 0.2
REPEATS = 24
SAMPLES = 3
BLOCK = 20_000
#: Meetings of a text's runs with items' that are looked at together.
ENTRIES = 1 << 20
PAD = U64(0x5851F42D4C957F2D)
_LEAKS = "array<struct<item_id:long,at:int,edits:int>>"
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("at", pa.int32()), ("edits", pa.int32())]))


def walk_keys(rows: np.ndarray, samples: int = SAMPLES, repeats: int = REPEATS) -> np.ndarray:
    """The sampled places of each row's embedding, hashed: a row of keys for each repetition, all walked at once."""
    m, n = rows.shape
    rng = np.random.default_rng((17, n))
    sampled = np.zeros((2 * n, repeats), dtype=bool)
    for r in range(repeats):
        sampled[rng.choice(2 * n, min(samples, 2 * n), replace=False), r] = True
    seeds = rng.integers(0, 2**63, (2 * n, repeats, 1), dtype=np.uint64)
    padded = np.concatenate((rows, np.full((m, 1), PAD)), axis=1)
    at, key, each = np.zeros((repeats, m), np.int64), np.zeros((repeats, m), np.uint64), np.arange(m)
    for j in range(int(np.flatnonzero(sampled.any(axis=1))[-1]) + 1):
        now = padded[each, np.minimum(at, n)]
        take = sampled[j]
        if take.any():
            key[take] = mix(key[take] + now[take], 200 + j)
        at += (mix(now + seeds[j]) >> U64(63)).astype(np.int64)
    return key


def best_edits(item: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each row of ``item`` to any passage of the same row of ``text``, and where the first such passage begins."""
    m, width = text.shape
    item, text = item[:, ::-1], text[:, ::-1]  # from the end, so that the last costs are those of each beginning
    cost = np.zeros((m, width + 1), np.int32)
    slope = np.arange(width + 1, dtype=np.int32)
    for i in range(item.shape[1]):
        step = np.empty_like(cost)
        step[:, 0] = i + 1
        step[:, 1:] = np.minimum(cost[:, :-1] + (text != item[:, i : i + 1]), cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - slope, axis=1) + slope
    cost = cost[:, ::-1]
    return cost.min(axis=1), cost.argmin(axis=1)


def expanded(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, entry) for each entry of the spans ``lo[k]:hi[k]``, about ``ENTRIES`` at a time."""
    n = hi - lo
    total = np.concatenate(([0], np.cumsum(n)))
    k = 0
    while k < len(n):
        to = max(int(np.searchsorted(total, total[k] + ENTRIES, side="right")) - 1, k + 1)
        yield np.repeat(np.arange(k, to), n[k:to]), spans(lo[k:to], n[k:to])
        k = to


class Items:
    """Items by their number of words, with seeds and the keys of every repetition."""

    def __init__(self, ids: list, texts: list[str], ratio: float = RATIO):
        self.ids, self.groups = ids, []
        words = next((w for _, _, w in word_blocks(pa.array(texts, pa.string()), 1 << 62, PLAIN)), None)
        if words is None:
            return
        hashes, counts = words.hashes(fold=True), words.counts
        for n in sorted(set(counts.tolist()) - {0}):
            own = np.flatnonzero(counts == n)
            rows = hashes[words.first[own][:, None] + np.arange(n)]
            k = int(ratio * n)
            q = min(3, -(-(n - k) // (k + 1)))
            self.groups.append((n, k, q, own, rows))
        self.q = sorted({g[2] for g in self.groups})
        self.seeds = {}
        for q in self.q:
            seed, size, offset, row = [], [], [], []
            for n, _, own_q, own, rows in self.groups:
                if own_q == q:
                    flat = runs(rows.ravel(), q, 31).reshape(-1) if rows.size >= q else np.zeros(0, np.uint64)
                    at = (np.arange(len(own))[:, None] * n + np.arange(n - q + 1)).ravel()
                    seed.append(flat[at])
                    size.append(np.full(len(at), n))
                    offset.append(np.tile(np.arange(n - q + 1), len(own)))
                    row.append(np.repeat(np.arange(len(own)), n - q + 1))
            seed, size, offset, row = map(np.concatenate, (seed, size, offset, row))
            order = np.argsort(seed, kind="stable")
            seed = seed[order]
            maybe = np.zeros(1 << 20, dtype=bool)
            maybe[(seed >> U64(44)).astype(np.int64)] = True
            self.seeds[q] = seed, size[order], offset[order], row[order], maybe
        self.keys = {}
        for n, _, _, _, rows in self.groups:
            for r, key in enumerate(walk_keys(rows)):
                order = np.argsort(key, kind="stable")
                self.keys[n, r] = key[order], order

    def find(self, words: Words) -> tuple[np.ndarray, ...]:
        """(document, item, first word in the document, edits), the best for each document and item."""
        none = (np.zeros(0, np.int64),) * 4
        if not self.groups or not len(words.start):
            return none
        hashes = words.hashes(fold=True)
        hits, total = [], 0
        for q, (seed, *_, maybe) in self.seeds.items():
            own = runs(hashes, q, 31)
            at = np.flatnonzero(maybe[(own >> U64(44)).astype(np.int64)])
            doc = np.searchsorted(words.first, at, side="right") - 1
            inside = at + q <= words.first[doc + 1]
            at, doc = at[inside], doc[inside]
            lo, hi = np.searchsorted(seed, own[at]), np.searchsorted(seed, own[at], side="right")
            hit = hi > lo
            hits.append((q, at[hit], doc[hit], own[at[hit]]))
            total += int((hi - lo).sum())
        # Runs that many items share and a text repeats meet often: then a part of the items at a time.
        parts = max(1, -(-total // ENTRIES))
        found = [self._find(words, hashes, hits, p, parts) for p in range(parts)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _find(self, words: Words, hashes: np.ndarray, hits: list, part: int, parts: int) -> tuple[np.ndarray, ...]:
        """``find`` for the items of one part."""
        none = (np.zeros(0, np.int64),) * 4
        doc_of = lambda at: np.searchsorted(words.first, at, side="right") - 1
        docs, sizes, rows_of, diagonals = ([np.zeros(0, np.int64)] for _ in range(4))
        for q, at, doc, own in hits:
            seed, size, offset, row, _ = self.seeds[q]
            mine = (size + row) % parts == part
            seed, size, offset, row = seed[mine], size[mine], offset[mine], row[mine]
            for which, entry in expanded(np.searchsorted(seed, own), np.searchsorted(seed, own, side="right")):
                docs.append(doc[which])
                sizes.append(size[entry])
                rows_of.append(row[entry])
                diagonals.append(at[which] - offset[entry])
        doc, size, row, diagonal = map(np.concatenate, (docs, sizes, rows_of, diagonals))
        out = []
        for n, k, q, ids, rows in self.groups:
            mine = np.flatnonzero(size == n)
            if not len(mine):
                continue
            pair, place = doc[mine] * len(ids) + row[mine], diagonal[mine]
            first, end = words.first[doc[mine]], words.first[doc[mine] + 1]
            start = np.unique(np.concatenate([np.clip(place + d, first, end - 1) for d in (-1, 0, 1)]))

            def verify(at, of, item, more):
                """Keeps those of the items ``item`` of documents ``of`` with a passage from about ``at`` to ``more`` words later."""
                for c in range(0, len(at), 1 << 14):
                    a, d, i = (x[c : c + (1 << 14)] for x in (at, of, item))
                    first, end = words.first[d][:, None], words.first[d + 1][:, None]
                    cells = a[:, None] - k + np.arange(n + 2 * k + more)
                    inside = (cells >= first) & (cells < end)
                    text = np.where(inside, hashes[np.clip(cells, 0, len(hashes) - 1)], PAD)
                    edits, begin = best_edits(rows[i], text)
                    good = edits <= k
                    yield d[good], i[good], np.maximum(a - k + begin - first[:, 0], 0)[good], edits[good]

            end = words.first[doc_of(start) + 1]
            cells = start[:, None] + np.arange(n)
            window = np.where(cells < end[:, None], hashes[np.minimum(cells, len(hashes) - 1)], PAD)
            pairs = []
            for r, own in enumerate(walk_keys(window)):
                key, order = self.keys[n, r]
                if parts > 1:
                    mine = (n + order) % parts == part
                    key, order = key[mine], order[mine]
                for which, entry in expanded(np.searchsorted(key, own), np.searchsorted(key, own, side="right")):
                    pairs.append(np.unique(which * len(ids) + order[entry]))
            alike = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
            at = start[alike // len(ids)]
            found = list(verify(at, doc_of(at), alike % len(ids), 0))
            whole = [d[edits == 0] * len(ids) + i[edits == 0] for d, i, _, edits in found]

            order = np.lexsort((place, pair))
            pair, place = pair[order], place[order]
            least = max(n - q + 1 - k * q, 1)
            last = np.arange(least - 1, len(pair))
            near = (pair[last] == pair[last - least + 1]) & (place[last] - place[last - least + 1] <= k)
            pair, place = pair[: len(near)][near], place[: len(near)][near]
            left = ~np.isin(pair, np.concatenate(whole)) if whole else slice(None)
            # Places go to blocks of k + 1, so that a passage is verified once or twice.
            spot = np.unique(np.stack((pair[left], place[left] // (k + 1))), axis=1)
            found += verify(spot[1] * (k + 1), spot[0] // len(ids), spot[0] % len(ids), k)
            out += [(d, ids[i], at, edits) for d, i, at, edits in found]
        if not out:
            return none
        doc, item, at, edits = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((at, edits, item, doc))
        doc, item, at, edits = doc[order], item[order], at[order], edits[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        return doc[new], item[new], at[new], edits[new]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, ratio: float) -> Iterator[Items]:
    ids, own = [], []
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    for r in rows.orderBy("i", "t").toLocalIterator():
        ids.append(r.i)
        own.append(r.t)
        if len(ids) == BLOCK:
            yield Items(ids, own, ratio)
            ids, own = [], []
    if ids:
        yield Items(ids, own, ratio)


def _finders(docs: DataFrame, benchmark: DataFrame, ratio: float, text_col: str, item_col: str, item_text_col: str) -> Iterator:
    """For each block of items, a column: those that the row's text holds, with the first word and the edits."""
    for block in _blocks(benchmark, item_col, item_text_col, ratio):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def make(sent=sent):
            items = sent.value

            def work(column: pa.Array) -> pa.Array:
                found = [[] for _ in range(len(column))]
                for lo, _, words in word_blocks(column, space=PLAIN):
                    for d, i, at, edits in zip(*items.find(words), strict=True):
                        found[lo + d].append({"item_id": items.ids[i], "at": int(at), "edits": int(edits)})
                return pa.array(found, _LEAK)

            return work

        yield text_udf(_LEAKS, make)(F.col(f"`{text_col}`").cast("string"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, at, edits): a row for each row of ``docs`` and item that it holds."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.select("doc_id", F.array().cast(_LEAKS).alias("leaks")).where(F.lit(False))
    for leaks in _finders(rows, benchmark, ratio, "text", item_col, item_text_col):
        out = out.union(rows.select("doc_id", leaks.alias("leaks")))
    return out.select("doc_id", F.inline("leaks"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", ratio: float = RATIO, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns; a block of items sees what those before have left."""
    for leaks in _finders(docs, benchmark, ratio, text_col, item_col, item_text_col):
        docs = docs.where(F.size(leaks) == 0)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
