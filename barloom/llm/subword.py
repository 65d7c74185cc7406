"""Subword-bag classifier: n-gram embeddings averaged into a linear softmax, trained jointly in numpy.

A word's bag holds its whole form and its byte n-grams with boundary marks,
hashed into a fixed number of buckets.  A text's vector is the mean over its
words of the sum of their buckets' embeddings.  Once trained, embeddings and
softmax fold into one row of class scores for each bucket, so a prediction is
a few gathers for each distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow
from .words import FOLD, PIECE, U64, Words, mix, spans, word_blocks

SIZES = (3, 4, 5)
BUCKETS = 1 << 16


_STEPS = tuple(np.random.default_rng(20240307 + k).integers(1, 2**63, 256, dtype=np.uint64) for k in range(8))


def _grams_of(padded: np.ndarray, first: np.ndarray, buckets: int, sizes: tuple[int, ...], room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) of the n-grams of each size; word w is ``padded[first[w]:]``, and its n-grams begin at its first ``room`` places less the size, ``PIECE`` at most."""
    n, total = len(padded), np.zeros(len(padded), dtype=np.uint64)
    for k in range(max(sizes)):
        if k < n:
            total[: n - k] += _STEPS[k][padded[k:]]
        if k + 1 in sizes:
            each = np.clip(room - k, 0, PIECE)
            h = mix(total[spans(first, each)], 71 + k)
            yield ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32), np.repeat(np.arange(len(first)), each)


def grams(words: Words, at: np.ndarray, hashes: np.ndarray, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, index into ``at``) of every n-gram of the words ``at`` and of the words themselves (``hashes``), in pieces of bounded size."""
    yield ((mix(hashes, 70) >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32), np.arange(len(at))
    lengths = words.end[at] - words.start[at]
    total = np.concatenate(([0], np.cumsum(lengths + 2)))
    k, most = 0, max(sizes)
    while k < len(at):
        to = int(np.searchsorted(total, total[k] + PIECE, side="right")) - 1
        if to <= k:  # one word longer than a piece: its n-grams by their first byte
            whole = words.data[words.start[at[k]] : words.end[at[k]]]
            n = len(whole) + 2
            for lo in range(0, n, PIECE):
                hi = min(lo + PIECE + most - 1, n)
                own = np.empty(hi - lo, dtype=np.uint8)
                inside = FOLD[whole[max(lo - 1, 0) : hi - 1]]
                own[not lo : (not lo) + len(inside)] = inside
                if not lo:
                    own[0] = ord("<")
                if hi == n:
                    own[-1] = ord(">")
                for bucket, owner in _grams_of(own, np.zeros(1, np.int64), buckets, sizes, np.array([n - lo])):
                    yield bucket, owner + k
            k += 1
            continue
        own = lengths[k:to]
        first = total[k:to] - total[k]
        padded = np.full(int(total[to] - total[k]), ord(">"), dtype=np.uint8)
        padded[first] = ord("<")
        padded[spans(first + 1, own)] = FOLD[words.data[spans(words.start[at[k:to]], own)]]
        for bucket, owner in _grams_of(padded, first, buckets, sizes, own + 2):
            yield bucket, owner + k
        k = to


def gram_sums(words: Words, at: np.ndarray, hashes: np.ndarray, table: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the rows of ``table`` over the n-grams of each word of ``at``, number of n-grams)."""
    out, count = np.zeros((len(at), table.shape[1])), np.zeros(len(at), dtype=np.int64)
    for bucket, owner in grams(words, at, hashes, len(table), sizes):
        if len(owner):
            lo, hi = int(owner[0]), int(owner[-1]) + 1
            count[lo:hi] += np.bincount(owner - lo, minlength=hi - lo)
            for k in range(table.shape[1]):
                out[lo:hi, k] += np.bincount(owner - lo, table[bucket, k], minlength=hi - lo)
    return out, count


def word_scores(words: Words, table: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """(scores of the distinct words, a row each; each word's row)."""
    hashes, at, row = np.unique(words.hashes(fold=True), return_index=True, return_inverse=True)
    return gram_sums(words, at, hashes, table, sizes)[0], row


def by_doc(words: Words, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (a row for each word) over each document, each summed alone, so that equal texts have equal sums."""
    out = np.zeros((words.n_docs, values.shape[1]))
    full = np.flatnonzero(words.counts)
    if len(full):
        out[full] = np.add.reduceat(values, words.first[full], axis=0)
    return out


def bags(rows: DataFrame, buckets: int = BUCKETS) -> list:
    """Collects (label, bucket numbers, shares) of the rows (text, label); the caller bounds the rows, and buckets fit 16 bits."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            label = batch.column("label")
            for lo, hi, words in word_blocks(batch.column("text")):
                which, share, hashes = [], [], words.hashes(fold=True)
                for d in range(hi - lo):
                    at = np.arange(words.first[d], words.first[d + 1])
                    count = np.zeros(buckets, np.int64)
                    for bucket, _ in grams(words, at, hashes[at], buckets):
                        count += np.bincount(bucket, minlength=buckets)
                    own = np.flatnonzero(count)
                    which.append(own.astype(np.uint16).tobytes())
                    share.append((count[own] / max(len(at), 1)).astype(np.float16).tobytes())
                yield pa.record_batch([label.slice(lo, hi - lo), pa.array(which, pa.binary()), pa.array(share, pa.binary())], names=["label", "which", "share"])

        return work

    got = map_arrow(rows.select("text", "label"), "label int, which binary, share binary", make).collect()
    got.sort(key=lambda r: (r.label, bytes(r.which), bytes(r.share)))
    return [(r.label, np.frombuffer(r.which, np.uint16), np.frombuffer(r.share, np.float16)) for r in got]


def train(found: list, classes: int, buckets: int = BUCKETS, width: int = 8, epochs: int = 25, rate: float = 0.05, batch: int = 128, decay: float = 1e-6, balance: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(class scores of each bucket, biases) after joint training of embeddings and softmax by Adam."""
    rng = np.random.default_rng(11)
    table = rng.normal(0, 0.1, (buckets, width))
    out = rng.normal(0, 0.3, (width, classes))
    bias = np.zeros(classes)
    if not found:
        return np.zeros((buckets, classes), np.float32), bias
    labels = np.array([x[0] for x in found])
    counts = np.bincount(labels, minlength=classes)
    weight = np.where(counts > 0, len(labels) / np.maximum(counts, 1) / max((counts > 0).sum(), 1), 0.0) if balance else np.ones(classes)
    if not balance:
        bias = np.log((counts + 0.5) / (len(labels) + 0.5 * classes))
    params, step = [table, out, bias], 0
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for _ in range(epochs):
        order = rng.permutation(len(found))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            which = np.concatenate([found[i][1] for i in own])
            share = np.concatenate([found[i][2] for i in own]).astype(np.float64)
            doc = np.repeat(np.arange(len(own)), [len(found[i][1]) for i in own])
            rows = table[which]
            vec = np.stack([np.bincount(doc, rows[:, j] * share, minlength=len(own)) for j in range(width)], axis=1)
            logits = vec @ out + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            p *= weight[labels[own]][:, None] / len(own)
            back = (p @ out.T)[doc] * share[:, None]
            grads = [np.stack([np.bincount(which, back[:, j], minlength=buckets) for j in range(width)], axis=1), vec.T @ p, p.sum(axis=0)]
            step += 1
            for x, g, (m, v) in zip(params, grads, moments, strict=True):
                if x is not bias:
                    g = g + decay * x
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return (table @ out).astype(np.float32), bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def posteriors(words: Words, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A row of class probabilities for each document; without words the biases alone decide."""
    scores, row = word_scores(words, table)
    return softmax(by_doc(words, scores[row]) / np.maximum(words.counts, 1)[:, None] + bias)
