"""Operator 4: language identification of spans.

Script ranges (of code points, letters only) narrow a word's candidates to the
languages that were seen to use its scripts; byte n-gram statistics score the word for each candidate; a
Viterbi pass with a penalty for each switch labels every word, and so spans of
mixed texts.  The text's language is the one that covers most letters bytes.

Learns from at most ``most`` rows of each language, those with the least hash
of their id.

Defined results: a null text and one without any letter are ``und`` with score
0; a null id is labelled like any other but never learned from; ties go to the
language that comes first in code point order; repeated rows are labelled
alike; without anything learned all is ``und``; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import subword
from .common import choose, documents, map_arrow, texts
from .toxicity import part
from .words import U64, Words, word_blocks

#: Most rows of each language that statistics are learned from.
MOST = 1500
BUCKETS = 1 << 17
#: Lengths of the n-grams, in bytes.
SIZES = (2, 3, 4)
#: Cost, in nats of a word's score, of a change of language between two words.
SWITCH = 6.0
#: Scripts by ranges of code points (fixed values of the character set's blocks); what isn't listed is one script more.
RANGES = (
    ("Latin", (0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFF21, 0xFF5A)),
    ("Greek", (0x0370, 0x03FF), (0x1F00, 0x1FFF)), ("Cyrillic", (0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    ("Armenian", (0x0530, 0x058F)), ("Hebrew", (0x0590, 0x05FF)), ("Arabic", (0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    ("Devanagari", (0x0900, 0x097F)), ("Bengali", (0x0980, 0x09FF)), ("Gurmukhi", (0x0A00, 0x0A7F)), ("Gujarati", (0x0A80, 0x0AFF)), ("Oriya", (0x0B00, 0x0B7F)),
    ("Tamil", (0x0B80, 0x0BFF)), ("Telugu", (0x0C00, 0x0C7F)), ("Kannada", (0x0C80, 0x0CFF)), ("Malayalam", (0x0D00, 0x0D7F)), ("Sinhala", (0x0D80, 0x0DFF)),
    ("Thai", (0x0E00, 0x0E7F)), ("Lao", (0x0E80, 0x0EFF)), ("Tibetan", (0x0F00, 0x0FFF)), ("Myanmar", (0x1000, 0x109F)), ("Georgian", (0x10A0, 0x10FF)),
    ("Hangul", (0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)), ("Ethiopic", (0x1200, 0x139F)), ("Khmer", (0x1780, 0x17FF)), ("Mongolian", (0x1800, 0x18AF)),
    ("Kana", (0x3040, 0x30FF), (0x31F0, 0x31FF)), ("Han", (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
)


@functools.cache
def _script_of() -> np.ndarray:
    """The bit of the script of each code point that is a letter, else 0."""
    bits = np.zeros(0x110000, dtype=np.uint64)
    letter = np.zeros(0x110000, dtype=bool)
    letter[:0x10000] = [unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)]
    for lo, hi in ((0x10000, 0x1FFFF), (0x20000, 0x323AF)):
        letter[lo : hi + 1] = [unicodedata.category(chr(c))[0] == "L" for c in range(lo, hi + 1)] if lo < 0x20000 else True
    bits[letter] = U64(1) << U64(len(RANGES))
    for k, (_, *spans) in enumerate(RANGES):
        for lo, hi in spans:
            own = bits[lo : hi + 1]
            own[own > 0] = U64(1) << U64(k)
    return bits


def code_points(data: np.ndarray) -> np.ndarray:
    """The code point that begins at each byte, 0 at the bytes within one."""
    after = [np.concatenate((data[k:], np.zeros(min(k, len(data)), np.uint8))).astype(np.int64) & 0x3F for k in (1, 2, 3)]
    x = data.astype(np.int64)
    out = np.where(x < 0x80, x, 0)
    two, three, four = (x >= 0xC0) & (x < 0xE0), (x >= 0xE0) & (x < 0xF0), x >= 0xF0
    out[two] = (x[two] & 0x1F) << 6 | after[0][two]
    out[three] = (x[three] & 0x0F) << 12 | after[0][three] << 6 | after[1][three]
    out[four] = np.minimum((x[four] & 0x07) << 18 | after[0][four] << 12 | after[1][four] << 6 | after[2][four], 0x10FFFF)
    return out


def scripts(words: Words) -> np.ndarray:
    """Of each word a bit for each script that its letters belong to."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words.start), np.uint64)
    table, k = _script_of(), 0
    while k < len(out):  # in pieces, so that a long text takes no more
        to = max(int(np.searchsorted(words.end, words.start[k] + (1 << 20), side="right")), k + 1)
        a = int(words.start[k])
        marks = table[code_points(words.data[a : words.end[to - 1]])]
        out[k:to] = np.bitwise_or.reduceat(marks, words.start[k:to] - a)
        k = to
    return out


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, uses: np.ndarray):
        self.langs, self.table, self.uses = langs, table, uses

    def words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(scores of the distinct words by language, each word's row)."""
        hashes, at, row = np.unique(words.hashes(fold=True), return_index=True, return_inverse=True)
        score, n = subword.gram_sums(words, at, hashes, self.table, SIZES)
        n = np.maximum(n, 1)
        score *= (np.sqrt(n) / n)[:, None]  # n-grams of a word overlap
        used = scripts(words)[at]
        score[used == 0] = 0
        fits = np.stack([(used & ~u) == 0 for u in self.uses], axis=1)
        score[~fits & fits.any(axis=1)[:, None]] -= 20.0
        return score, row


def viterbi(score: np.ndarray, row: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; all documents advance together, the longest first."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    long = counts[order]
    most = int(long[0]) if len(long) else 0
    width = score.shape[1]
    label = np.zeros(len(row), dtype=np.int32)
    stay = np.zeros((len(row), width), dtype=bool)
    top = np.zeros(len(row), dtype=np.int32)
    live = np.searchsorted(-long, -np.arange(1, most + 1), side="right")
    starts = first[:-1][order]
    best = np.zeros((len(order), width))
    for t in range(most):
        n = live[t]
        at = starts[:n] + t
        if t:
            own = best[:n]
            lead = own.argmax(axis=1)
            high = own[np.arange(n), lead][:, None] - switch
            keep = own >= high
            stay[at], top[at] = keep, lead
            best[:n] = np.where(keep, own, high) + score[row[at]]
        else:
            best[:n] = score[row[at]]
    end = best.argmax(axis=1).astype(np.int32)
    now = np.zeros(len(order), dtype=np.int32)
    for t in range(most - 1, -1, -1):
        n = live[t]
        m = live[t + 1] if t + 1 < most else 0
        now[m:n] = end[m:n]
        at = starts[:n] + t
        label[at] = now[:n]
        if t:
            now[:n] = np.where(stay[at, now[:n]], now[:n], top[at])
    return label


def fit(docs: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None) -> Model:
    """Learns n-gram statistics and scripts from the rows with a language for which ``learn`` (over doc_id) holds."""
    lang = F.col(f"`{lang_col}`").cast("string").alias("lang")
    rows = texts(docs, id_col, text_col, lang).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    if learn is not None:
        rows = rows.where(learn)
    own, known = choose(rows, "lang", most, 4)
    langs, rows = sorted(known), rows.where(own)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0, np.uint64))

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lang = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for lo, hi, words in word_blocks(batch.column("text")):
                own = lang[lo:hi][words.doc_of()]
                used, hashes = scripts(words), words.hashes(fold=True)
                for k in np.unique(own):
                    at = np.flatnonzero(own == k)
                    seen = np.zeros(BUCKETS, dtype=np.int64)
                    for bucket, _ in subword.grams(words, at, hashes[at], BUCKETS, SIZES):
                        seen += np.bincount(bucket, minlength=BUCKETS)
                    full = np.flatnonzero(seen)
                    marks = np.array([int((used[at] >> U64(s) & U64(1)).sum()) for s in range(len(RANGES) + 1)])
                    yield pa.record_batch(
                        [pa.array([int(k)], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([marks.tolist()], pa.list_(pa.int64())), pa.array([full.tolist()], pa.list_(pa.int32())), pa.array([seen[full].tolist()], pa.list_(pa.int64()))],
                        names=["lang", "n", "marks", "bucket", "seen"],
                    )

        return work

    told = map_arrow(rows, "lang int, n long, marks array<long>, bucket array<int>, seen array<long>", make)
    sums = told.select("lang", F.inline(F.arrays_zip("bucket", "seen"))).groupBy("lang", "bucket").agg(F.sum("seen").alias("seen"))
    counts = np.full((BUCKETS, len(langs)), 0.5)
    for r in sums.collect():  # BUCKETS rows a language at most
        counts[r.bucket, r.lang] += r.seen
    uses = np.zeros(len(langs), np.uint64)
    marks = told.select("lang", "n", F.posexplode("marks")).groupBy("lang", "pos").agg(F.sum("col").alias("seen"), F.sum("n").alias("n"))
    for r in marks.collect():
        if r.seen > 0.0005 * r.n:
            uses[r.lang] |= U64(1) << U64(r.pos)
    logs = np.log(counts / counts.sum(axis=0))
    return Model(langs, logs - logs.mean(axis=1, keepdims=True), uses)


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) of every row; spans: (first word, number of words, language)."""
    rows = texts(docs, id_col, text_col).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("lang", pa.string())]))

    def make():
        m = sent.value
        names = np.array([*m.langs, "und"], dtype=object)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            for lo, hi, words in word_blocks(batch.column("text")):
                n, k = hi - lo, len(m.langs)
                pred, score = np.full(n, k), np.zeros(n)
                label = np.zeros(len(words.start), dtype=np.int32)
                if k:
                    by_word, row = m.words(words)
                    label = viterbi(by_word, row, words.first, switch)
                    size = np.where(by_word[row].any(axis=1), words.end - words.start, 0)
                    cover = np.zeros((len(label), k))
                    cover[np.arange(len(label)), label] = size
                    cover = subword.by_doc(words, cover)
                    total = cover.sum(axis=1)
                    evidence = subword.by_doc(words, by_word[row])
                    told = letters[lo:hi] & (total > 0)
                    pred = np.where(told, cover.argmax(axis=1), np.where(letters[lo:hi], evidence.argmax(axis=1), k))
                    sure = subword.softmax(evidence)[np.arange(n), np.minimum(pred, k - 1)]
                    share = cover[np.arange(n), np.minimum(pred, k - 1)] / np.maximum(total, 1)
                    score = np.where(told, np.clip(share * sure, 0, 1), 0.0)
                out = [batch.column("doc_id").slice(lo, n), pa.array(list(names[pred]), pa.string()), pa.array(score, pa.float64())]
                if spans:
                    rows = []
                    for d in range(n):
                        own = label[words.first[d] : words.first[d + 1]]
                        cut = np.flatnonzero(np.diff(own, prepend=-1))
                        rows.append([{"first": int(a), "n": int(b - a), "lang": names[own[a]] if k else "und"} for a, b in zip(cut, np.append(cut[1:], len(own))[: len(cut)], strict=True)])
                    out.append(pa.array(rows, kind))
                yield pa.record_batch(out, names=["doc_id", "lang_pred", "score", *(["spans"] if spans else [])])

        return work

    return map_arrow(rows, "doc_id long, lang_pred string, score double" + ", spans array<struct<first:int,n:int,lang:string>>" * spans, make)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, learn=part("doc_id", 3) != 1)
    return identify(docs, model).select("doc_id", (F.coalesce(part("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")
