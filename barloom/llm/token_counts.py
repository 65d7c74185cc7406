"""Operator 6: token counts of a unigram tokenizer, without its tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in each
different word of a batch; dynamic programming over their ends carries the
best score and its number of pieces.  Ties keep the piece that starts first,
as the tokenizer does (it replaces a path only by a strictly better one, and
goes through starts in ascending order).  A character that is no piece is
unknown, at the least score less 10; neighbouring unknowns are one piece.

Words are what white space separates; a mark is put before each.

Defined results: null and empty texts have no tokens and score 0; ids are not
looked at; repeated rows are counted alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import subword
from .common import documents, map_arrow, texts
from .words import word_blocks

MARK = "▁"
UNKNOWN = 10.0
CACHE = 1 << 20


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece vocabulary, scored by Zipf's law from their order."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    return [(model.id_to_piece(k), -math.log(rank + 2)) for rank, k in enumerate(plain)]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN
        self.known: dict[int, tuple[int, float]] = {}

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of ``text``."""
        n = len(text)
        best, pieces, unknown = [-math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0], at = 0.0, 0
        single = [False] * (n + 1)

        def close(to: int) -> None:
            """Ends up to ``to`` get no more matches; where no piece is the last character, an unknown may end there."""
            nonlocal at
            while at < to:
                at += 1
                if not single[at] and best[at - 1] + self.unknown > best[at]:
                    best[at] = best[at - 1] + self.unknown
                    pieces[at] = pieces[at - 1] + (not unknown[at - 1])
                    unknown[at] = True

        for last, (size, score) in self.automaton.iter(text):
            close(last)
            begin = last + 1 - size
            if size == 1:
                single[last + 1] = True
            if best[begin] + score > best[last + 1]:
                best[last + 1], pieces[last + 1], unknown[last + 1] = best[begin] + score, pieces[begin] + 1, False
        close(n)
        return pieces[n], best[n]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) of every row."""

    def make():
        counter = Counter(load_pieces(vocabulary))

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lo, hi, words in word_blocks(batch.column("text")):
                hashes, at, row = np.unique(words.hashes(), return_index=True, return_inverse=True)
                if len(counter.known) > CACHE:
                    counter.known = {}
                for h, k in zip(hashes.tolist(), at.tolist(), strict=True):
                    if h not in counter.known:
                        counter.known[h] = counter.count(MARK + words.text(k).decode())
                own = np.array([counter.known[h] for h in hashes.tolist()], dtype=np.float64).reshape(-1, 2)
                total = subword.by_doc(words, own[row]) if len(row) else np.zeros((hi - lo, 2))
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.rint(total[:, 0]).astype(np.int64)), pa.array(total[:, 1])], names=["doc_id", "n_tokens", "score"])

        return work

    return map_arrow(texts(docs, id_col, text_col), "doc_id long, n_tokens long, score double", make)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", F.round("score", 6).alias("score"))
