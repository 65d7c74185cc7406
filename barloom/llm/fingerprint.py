"""Operator 3: document fingerprints by I-Match over randomised lexicons, in DataFrame operations only.

The lexicon holds the words (folded, split at white space) whose inverse
document frequency ln(N / df) lies in a band.  ``FAMILIES`` random lexicons
keep a quarter of it each, by a hash of the word, and each of them is halved
``LEVELS - 1`` times, so that texts of every length have lexicons of which they
hold a few words.  A fingerprint's part is the hash of the sorted distinct
words that the text shares with one lexicon, empty if none; likeness of two
fingerprints is the share of equal parts among those that either fills.

Frequencies cover all documents.  A word in the band is in at least N / e^9
documents, so the lexicon is bounded by the mean number of distinct words times
e^9, whatever N is.  Up to ``BOUND`` words it is broadcast, and a text's words
then never leave the task that holds the text; beyond that, words are joined
with it by shuffle.

Defined results: null and empty texts, and others without a word of any random
lexicon, take the hash of the text as their one part, so that equal texts have
equal fingerprints; rows that agree in id and text get equal
results; null ids (and -2^63, which is shown as null) count as rows of an id of
their own; a table of one document has itself as the next; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, documents, texts
from .ranking import ranked

#: ln(N / df) from and to which a word belongs to the lexicon.
BAND = (2.0, 9.0)
FAMILIES = 8
LEVELS = 8
#: Words of a lexicon that is broadcast: 8 MB, and a few times that as a hash table.
BOUND = 1 << 20
NO_ID = -(2**63)


def words_of(text: Column) -> Column:
    """Hashes of the distinct words."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(rows: DataFrame, scratch: Scratch, band: tuple[float, float] = BAND) -> DataFrame:
    """The words of the band, once each; written once."""
    total = rows.count()
    counts = rows.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(max(total, 1))) / F.col("df"))
    return scratch.keep(counts.where((idf >= band[0]) & (idf <= band[1])).select("word"), "lexicon")


def low_half_of(h: Column) -> Column:
    """The low 32 bits of a hash."""
    return F.shiftright(F.shiftleft(h, 32), 32).cast("int")


def low_half(words: Column) -> Column:
    """Those of the hash of an array of words."""
    return low_half_of(F.xxhash64(words))


class Printer:
    """Fingerprints by one lexicon."""

    def __init__(self, lex: DataFrame, bound: int = BOUND):
        self.lex = F.broadcast(lex) if lex.count() <= bound else lex

    def add(self, df: DataFrame, texts: dict[str, str], keys: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
        """``keys``, what ``keep`` says, and the parts, array<int>, of each text (name to column); ``keys`` are not null and settle the row.

        The words of all texts of a row leave it together and come back in one
        aggregate, and one row more carries what is kept, so that words stay
        small.  Rows that are dealt by ``keys`` stay in their task while the
        lexicon is broadcast.
        """
        tag = lambda k: lambda w: F.struct(F.lit(k).alias("of"), w.alias("word"))
        words = F.concat(F.array(F.struct(F.lit(-1).alias("of"), F.lit(None).cast("long").alias("word"))), *(F.transform(words_of(F.col(c)), tag(k)) for k, c in enumerate(texts.values())))
        also = F.struct(*(c.alias(n) for n, c in (keep or {}).items()), *(low_half_of(F.xxhash64(F.col(c))).alias(f"alone{k}") for k, c in enumerate(texts.values())))
        rows = df.select(*keys, also.alias("__also"), F.explode(words).alias("__one"))
        rows = rows.select(*keys, F.col("__one.of").alias("__of"), F.col("__one.word").alias("word"), F.when(F.col("__one.of") < 0, F.col("__also")).alias("__also"))
        held = rows.join(self.lex.withColumn("__in", F.lit(True)), "word", "left").where("__in OR __of < 0")
        own = [F.collect_list(F.when(F.col("__of") == k, F.col("word"))).alias(f"__terms{k}") for k in range(len(texts))]
        found = held.groupBy(*keys).agg(F.first("__also", ignorenulls=True).alias("__also"), *own)
        for k, name in enumerate(texts):
            found = found.withColumn(f"__terms{k}", F.array_distinct(F.sort_array(f"__terms{k}")))
            found = self._parts(found, name, f"__terms{k}", F.col(f"__also.alone{k}"))
        return found.select(*keys, *(F.col(f"__also.{n}").alias(n) for n in keep or {}), *texts)

    @staticmethod
    def _parts(df: DataFrame, out: str, terms: str, alone: Column) -> DataFrame:
        quarter = lambda g: F.filter(terms, lambda w: F.pmod(F.xxhash64(w, F.lit(g)), F.lit(4)) == 0)
        kept = [quarter(g) for g in range(FAMILIES)]
        df = df.withColumn("__level0", F.array(*kept))
        for k in range(1, LEVELS):  # a step each, so that no level is computed twice
            half = lambda words, g: F.filter(words, lambda w: F.pmod(F.xxhash64(w, F.lit(FAMILIES + k), g), F.lit(2)) == 0)  # noqa: E731, B023
            df = df.withColumn(f"__level{k}", F.transform(f"__level{k - 1}", half))
        levels = [f"__level{k}" for k in range(LEVELS)]
        part = lambda words: F.when(F.size(words) == 0, 0).otherwise(low_half(words))
        parts = F.concat(*(F.transform(c, part) for c in levels))
        # Families are a quarter each: a text may hold words of the lexicon and yet fill no part.
        filled = F.exists("__level0", lambda words: F.size(words) > 0)
        return df.withColumn(out, F.when(filled, parts).otherwise(F.array(alone))).drop(*levels)


def shown(parts: str) -> Column:
    """A fingerprint as text: parts of eight hexadecimal digits or none, joined by hyphens."""
    digits = lambda p: F.lower(F.lpad(F.hex(p.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.array_join(F.transform(parts, lambda p: F.when(p == 0, "").otherwise(digits(p))), "-")


def likeness(a: str, b: str) -> Column:
    """Share of equal parts among those that either of two fingerprints fills, 0 to 1."""
    both = F.filter(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda p: (F.coalesce(p["x"], F.lit(0)) != 0) | (F.coalesce(p["y"], F.lit(0)) != 0))
    equal = F.filter(both, lambda p: p["x"].eqNullSafe(p["y"]))
    return F.when(F.col(a) == F.col(b), 1.0).when(F.size(a) != F.size(b), 0.0).otherwise(F.size(equal) / F.greatest(F.size(both), F.lit(1))).cast("double")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text; both counted against the lexicon of the given texts.

    Texts are dealt by (id, hash) once, and that exchange serves both joins, the
    one that takes each document's first characters and the one that brings
    them to the document before, as well as the fingerprints.  Rows that agree
    in id and text are one until the end.
    """
    scratch = Scratch(spark, "imatch")
    rows = texts(documents(spark, sf_dir), "doc_id", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("h"), "text")
    printer = Printer(lexicon(rows.select("text"), scratch))

    meta = rows.groupBy("id", "h", F.length("text").cast("long").alias("n_chars")).agg(F.count("*").alias("copies"))
    meta = scratch.keep(ranked(meta, ["id", "h"], scratch, "order"), "ranked")
    total = meta.count()
    after = F.expr(f"CASE WHEN rank = {total} - 1 THEN 0 ELSE rank + 1 END").alias("rank")
    before = meta.select(after, F.struct("id", "h", "rank", "copies", "n_chars").alias("of"))
    need = scratch.keep(meta.select("id", "h", "rank").join(before, "rank").select("id", "h", "of"), "need")

    ahead = rows.join(need, ["id", "h"]).select("of.*", F.expr("substring(text, 1, int(of.n_chars div 4))").alias("head")).dropDuplicates(["id", "h"])
    both = rows.join(ahead, ["id", "h"]).withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 4))"), "head"))
    keep = {c: F.col(c) for c in ("rank", "copies", "n_chars")} | {"edited_sha256": F.sha2(F.encode("edited", "UTF-8"), 256)}
    made = scratch.keep(printer.add(both, {"parts": "text", "edited_parts": "edited"}, ["id", "h"], keep), "parts")
    ahead = made.select(F.expr(f"CASE WHEN rank = 0 THEN {total} - 1 ELSE rank - 1 END").alias("rank"), F.col("parts").alias("next_parts"))
    return made.join(ahead, "rank").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        shown("parts").alias("fingerprint"),
        shown("edited_parts").alias("edited_fingerprint"),
        likeness("parts", "edited_parts").alias("near_edited"),
        likeness("parts", "next_parts").alias("near_next"),
    )
