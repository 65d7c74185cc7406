"""Operator 7: mixing to target weights by soft membership.

A subword-bag classifier (``subword``), learned from labelled rows, gives each
document a posterior over domains.  Nonnegative rates x are fitted so that the
expected tokens of each domain, sum of x_i t_i p_ik, match targets in least
squares, by projected gradient: a step moves x_i by -p_i . g and clips it at
``floor``.  The gradient g has one number for each domain, so a document's
rate follows from its posterior and the few g so far; each step is one
distributed sum and nothing of a document's size reaches the driver.  What is
still missed after the last step is in ``Mix.miss``, with a warning if it is
more than ``TOLERANCE`` of all targets.

``floor`` is 0 where targets are given and 1 otherwise.  Without targets, the domains' token shares are raised to ``power`` and scaled
so that no domain needs fewer tokens than it has; with ``floor`` 1 every
document then stays and scarce domains repeat.

Defined results: a null or empty text has no tokens, the posterior of the
biases and a rate like any other; null ids are kept and never learned from;
repeated rows have equal rates; without labelled rows or documents every rate
is 1; other columns pass through ``mix``.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import subword
from .common import Scratch, choose, documents, fresh, map_arrow, text_udf, texts
from .words import word_blocks

#: Labelled rows of each domain, about, that the classifier learns from.
MOST = 250
STEPS = 40
TOLERANCE = 1e-4


class Mix:
    def __init__(self, domains: list[str], table: np.ndarray, bias: np.ndarray):
        self.domains, self.table, self.bias = domains, table, bias
        self.base, self.floor, self.path = 1.0, 0.0, []
        self.targets = self.reached = np.zeros(len(domains))
        #: Tokens reached less tokens wanted, by domain, of targets that are not met.
        self.miss: dict[str, float] = {}
        self.table_of: DataFrame | None = None

    def frozen(self) -> Mix:
        """What tasks need of it."""
        out = Mix(self.domains, self.table, self.bias)
        out.base, out.floor, out.path = self.base, self.floor, self.path
        return out

    def rates(self, p: np.ndarray, path: list | None = None) -> np.ndarray:
        x = np.full(len(p), max(self.base, self.floor))
        for g in self.path if path is None else path:
            x = np.maximum(self.floor, x - p @ g)
        return x

    def posteriors(self, words) -> np.ndarray:
        if not self.domains:
            return np.zeros((words.n_docs, 0))
        return subword.posteriors(words, self.table, self.bias)


def _sums(df: DataFrame, work_of) -> np.ndarray:
    """Adds up the vectors that ``work_of`` makes of the batches of ``df``."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if batch.num_rows:
                yield pa.record_batch([pa.array([work_of(batch).tolist()], pa.list_(pa.float64()))], names=["v"])

        return work

    got = map_arrow(df, "v array<double>", make).select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    return np.array([r.s for r in got])


def _report(model: Mix, targets: dict[str, float] | None) -> Mix:
    """Sets ``miss``, a target of no known domain included, and warns of it."""
    want = dict(zip(model.domains, model.targets.tolist(), strict=True)) | {d: float(t) for d, t in (targets or {}).items()}
    got = dict(zip(model.domains, model.reached.tolist(), strict=True))
    bound = TOLERANCE * sum(want.values())
    model.miss = {d: got.get(d, 0.0) - t for d, t in want.items() if abs(got.get(d, 0.0) - t) > bound}
    if model.miss:
        warnings.warn(f"targets not met, tokens reached less tokens wanted: {model.miss}", stacklevel=3)
    return model


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | str | None = None, power: float = 0.7, floor: float | None = None, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> Mix:
    """Learns domains from ``labelled`` (doc_id, domain) and fits rates of ``docs`` to ``targets``: tokens of each domain, or "even" for equal shares of all tokens."""
    spark = docs.sparkSession
    floor = (1.0 if targets is None else 0.0) if floor is None else floor
    given = targets if isinstance(targets, dict) else None
    known = labelled.select(F.col("doc_id").cast("long"), F.col("domain").cast("string")).where("domain IS NOT NULL AND doc_id IS NOT NULL").distinct()
    own, counts = choose(known, "domain", most, 7)
    domains = sorted(counts)
    if not domains:
        return _report(Mix([], np.zeros((1, 0)), np.zeros(0)), given)
    label = (F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1).cast("int").alias("label")
    # Ids and domains alone are chosen from; texts meet them where they are read.
    sample = known.where(own).select("doc_id", label)
    found = subword.bags(texts(docs, id_col, text_col).join(F.broadcast(sample), "doc_id"))
    found = list({(k, which.tobytes(), share.tobytes()): (k, which, share) for k, which, share in found}.values())  # equal texts of a domain teach once
    model = Mix(domains, *subword.train(found, len(domains), epochs=8, balance=True))
    size = len(domains)
    model.table_of = posteriors(docs, model, Scratch(spark, "mix"), id_col, text_col)
    rows = model.table_of.select("t", *(f"p{k}" for k in range(size)))

    def parts(batch):
        return batch.column("t").to_numpy(), np.stack([batch.column(f"p{k}").to_numpy() for k in range(size)], axis=1)

    def moments(batch):
        t, p = parts(batch)
        return np.concatenate((t @ p, ((p * t[:, None]).T @ p).ravel()))

    first = _sums(rows, moments)
    if not len(first) or not first[:size].sum():
        return _report(model, given)
    supply, cross = first[:size], first[size:].reshape(size, size)
    if targets is None:
        want = np.maximum(supply, 1e-9) ** power
        want *= (supply / want).max()
    elif given is None:
        want = np.full(size, supply.sum() / size)
    else:
        want = np.array([float(given.get(d, 0.0)) for d in domains])
    scale = 1 / np.maximum(np.diag(cross), 1e-9)
    root = np.sqrt(scale)
    step = 1 / max(np.linalg.eigvalsh(root[:, None] * cross * root).max(), 1e-9)
    model.floor, model.base, model.targets = floor, float(want.sum() / supply.sum()), want
    frozen = model.frozen()

    def reached_by(path: list):
        def reached(batch):
            t, p = parts(batch)
            return (t * frozen.rates(p, path)) @ p

        return reached

    for k in range(STEPS + 1):  # the last sum is that of the last step's rates
        model.reached = _sums(rows, reached_by(model.path))
        left = model.reached - want
        if k == STEPS or np.abs(left).max() <= TOLERANCE * want.sum() or len(model.path) > 1 and np.abs(model.path[-1]).max() < 1e-6:
            break
        model.path = [*model.path, step * scale * left]
    return _report(model, given)


def posteriors(docs: DataFrame, model: Mix, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, u, t, p0, p1, ...) of every row, written once: a hash of the row, its words and its posterior."""
    size = len(model.domains)
    sent = docs.sparkSession.sparkContext.broadcast(model.frozen())

    def make():
        m = sent.value

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lo, hi, words in word_blocks(batch.column("text")):
                p = m.posteriors(words)
                yield pa.record_batch([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "u")), pa.array(words.counts.astype(np.float64)), *(pa.array(p[:, k]) for k in range(size))], names=["doc_id", "u", "t", *(f"p{k}" for k in range(size))])

        return work

    rows = texts(docs, id_col, text_col).withColumn("u", _chance(F.col("doc_id"), F.col("text")))
    return scratch.keep(map_arrow(rows, "doc_id long, u double, t double" + "".join(f", p{k} double" for k in range(size)), make), "posteriors")


def _chance(doc_id: Column, text: Column) -> Column:
    """A number from 0 to 1 by a hash of a row."""
    return F.xxhash64(F.lit(77), text, doc_id).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)


def rates(model: Mix) -> DataFrame:
    """(doc_id, n_tokens, domain, rate, copies) of every row that the model was fitted to: copies is the rate rounded up or down by a hash of the row."""
    m, size = model.frozen(), len(model.domains)
    domains = np.array([*m.domains, None], dtype=object)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n = batch.num_rows
            p = np.stack([batch.column(f"p{k}").to_numpy() for k in range(size)], axis=1) if n else np.zeros((0, size))
            rate = m.rates(p)
            best = p.argmax(axis=1) if n else np.zeros(0, np.int64)
            copies = np.floor(rate) + (batch.column("u").to_numpy() < rate - np.floor(rate))
            yield pa.record_batch([batch.column("doc_id"), batch.column("t").cast(pa.int64()), pa.array(list(domains[best]), pa.string()), pa.array(rate), pa.array(copies.astype(np.int32))], names=["doc_id", "n_tokens", "domain", "rate", "copies"])

        return work

    return map_arrow(model.table_of, "doc_id long, n_tokens long, domain string, rate double, copies int", make)


def mix(docs: DataFrame, model: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, with their own columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model.frozen())

    def make():
        m = sent.value

        def work(column: pa.Array, u: pa.Array) -> pa.Array:
            out = [np.zeros(0, np.int32)]
            chance = u.to_numpy(zero_copy_only=False)
            for lo, hi, words in word_blocks(column):
                rate = m.rates(m.posteriors(words))
                out.append((np.floor(rate) + (chance[lo:hi] < rate - np.floor(rate))).astype(np.int32))
            return pa.array(np.concatenate(out))

        return work

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    doc_id = F.col(f"`{id_col}`").cast("long") if id_col in docs.columns else F.lit(None).cast("long")
    copies = text_udf("int", make, 2)(text, _chance(doc_id, text))
    (name,) = fresh(docs, "copy")
    return docs.select("*", F.explode(F.array_repeat(F.lit(1), copies)).alias(name)).drop(name)


def languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of the rows that ``labels`` covers."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("domain"))
    return own.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rate; every language is to have an equal share of the tokens."""
    docs = documents(spark, sf_dir)
    return rates(fit(docs, languages(docs, documents(spark, sf_dir, "labels")), "even"))
