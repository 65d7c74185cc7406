"""Operator 5: toxicity by a subword-bag classifier (see ``subword``).

Learns from about ``most`` labelled rows of each class, chosen by a hash of
their id, and scores every whole text.  Unseen misspellings share
n-grams, and so embeddings, with words that were learned.

Defined results: a null or empty text has the score of the biases alone; a
null id is scored like any other and is never learned from; repeated rows are
scored alike; labels other than 0 and 1 or null teach nothing; without any
label the score is 0.5 times nothing learned, that is 0.5 for every text; with
no text of a label, or toxic ones only, nothing tells texts apart: all have the
score of the biases and ``drop_toxic`` keeps every row; an empty table gives an
empty result; other columns are ignored or, by ``drop_toxic``, passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import subword
from .common import choose, documents, text_udf, texts
from .words import word_blocks

#: Labelled rows of each class, about, that the classifier learns from.
MOST = 1500
EPOCHS = 12


def part(id_col: str, of: int) -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % of


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket scores, biases) learned from the labelled rows for which ``learn`` (a column over doc_id) holds; an id of both labels is toxic."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    if learn is not None:
        known = known.where(learn)
    own, share = choose(known, "label", most, 5)
    found = subword.bags(texts(docs, id_col, text_col).join(F.broadcast(known.where(own)), "doc_id"))
    table, bias = subword.train(found, 2, epochs=EPOCHS, balance=True)
    if all(label == 1 for label, _, _ in found):
        table = np.zeros_like(table)
    if len(share) == 2:  # classes are sampled alike, so the biases carry the shares among all labelled rows
        bias = bias + np.log([share[0], share[1]])
    return table, bias


def scorer(spark: SparkSession, model):
    """The score of a text as a column function."""
    sent = spark.sparkContext.broadcast(((model[0][:, 1:] - model[0][:, :1]), model[1][1] - model[1][0]))

    def make():
        table, bias = sent.value

        def work(column: pa.Array) -> pa.Array:
            out = [np.zeros(0)]
            for _, _, words in word_blocks(column):
                scores, row = subword.word_scores(words, table)
                x = subword.by_doc(words, scores[row])[:, 0] / np.maximum(words.counts, 1) + bias
                out.append(1 / (1 + np.exp(-np.clip(x, -60, 60))))
            return pa.array(np.concatenate(out))

        return work

    return text_udf("double", make)


def score_toxicity(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    return texts(docs, id_col, text_col).select("doc_id", scorer(docs.sparkSession, model)("text").alias("score"))


def drop_toxic(docs: DataFrame, model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their own columns; all rows if nothing was learned."""
    if not model[0].any():
        return docs
    score = scorer(docs.sparkSession, model)(F.col(f"`{text_col}`").cast("string"))
    return docs.where(score < threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, documents(spark, sf_dir, "labels"), learn=part("doc_id", 5) != 0)
    out = score_toxicity(docs, model)
    return out.select("doc_id", (F.coalesce(part("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
