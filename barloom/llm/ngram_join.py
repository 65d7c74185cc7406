"""Operator 8: join of documents by Jaccard similarity of word shingles.

Two documents link when the Jaccard similarity of their sets of distinct
``size``-word shingles is at least ``percent`` / 100, exactly.  Texts with the
same words collapse first and one of them stands for all.

First filter.  Most documents share too little with all others together to
link.  ``likely`` finds the rest from counts of the least hashes of each set; only these go on.

Filter.  Under any fixed order of shingles, two linked sets share a shingle
among the first n - ceil(t n) + 1 of each.  Several orders are used; each puts
shingles that a count-min sketch knows to be rarer first and breaks ties by
its own hash.  A candidate pair must share a prefix shingle, with sizes and
positions that still allow the similarity, under *every* order; the orders'
candidates are intersected before any set is compared.  Shingles that the
sketch counts once are in prefixes but can't be shared, so they aren't sent.

Large groups.  Within a group of near copies all pairs would be candidates.
So a few pairs for each shingle come first, each document with the one that
shares the shingle and has the fewest shingles of its own (the likely origin of
a group of edited copies) and with its neighbour by size; they are verified
without the intersection, as there are at most two for each entry sent, and
components are formed.  Then only pairs from different components are
candidates, and of those none between two members of a shingle's most common
component.  No pair of different components escapes, so no link that matters
to a component is lost, and no cap is used.

Defined results: a null, empty or blank text has an empty set, links with
nothing and is a component of its own; rows link by their texts, whatever
their ids, so rows that repeat an id may be of different components and a text
without an id links others; a component is named by its smallest id, null if no
row of it has one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import likely, sketch
from .common import Scratch, documents, fresh, map_arrow, plan_bytes, texts
from .components import components
from .words import U64, Words, mix, run_starts, runs, sequences, word_blocks

ORDERS = 3
PER_BYTE = 0.5


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes, document after document and sorted in each; bounds; word hashes)."""
    hashes = words.hashes(fold=True)
    own = runs(hashes, size)
    short = {n: runs(hashes, n, 20 + n) for n in range(1, size)}
    parts, bounds, counts = [], np.zeros(words.n_docs + 1, dtype=np.int64), words.counts
    for d in range(words.n_docs):
        at, n = words.first[d], counts[d]
        if n >= size:
            part = np.sort(own[at : at + n - size + 1])
            new = np.empty(len(part), dtype=bool)
            new[0] = True
            np.not_equal(part[1:], part[:-1], out=new[1:])
            part = part[new]
        else:
            part = short[n][at : at + 1] if n else own[:0]
        parts.append(part)
        bounds[d + 1] = bounds[d] + len(part)
    return (np.concatenate(parts) if parts else own[:0]), bounds, hashes


def _sketch_keys(size: int):
    def keys(words: Words) -> np.ndarray:
        hashes = words.hashes(fold=True)
        own = runs(hashes, size)
        return own[run_starts(words.first, size)[: len(own)]]

    return keys


def _number(rows: DataFrame, size: int) -> DataFrame:
    """Adds the keys of each row's word sequence and its set's size."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lo, hi, words in word_blocks(batch.column("text")):
                _, bounds, hashes = shingle_sets(words, size)
                keys = (pa.array(sequences(hashes, words.first, seed).view(np.int64)) for seed in (61, 62))
                yield pa.record_batch([*batch.slice(lo, hi - lo).columns, *keys, pa.array(np.diff(bounds))], names=[*batch.schema.names, "k1", "k2", "n"])

        return work

    return map_arrow(rows, "row long, doc_id long, t1 long, t2 long, text string, k1 long, k2 long, n long", make)


def _scan(rows: DataFrame, packed, size: int, percent: int, orders: int) -> DataFrame:
    """Of each row whose prefixes hold a shingle that may be shared: its set's size, those and the set."""

    def make():
        levels = packed.value

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lo, hi, words in word_blocks(batch.column("text")):
                sets, bounds, hashes = shingle_sets(words, size)
                level = levels.ranks(sets)
                n = np.diff(bounds)
                short = words.counts < size
                level[np.repeat(short, n)] = 3  # too short for the sketch; taken as common
                single = np.concatenate(([0], np.cumsum(level == 0)))
                single = single[bounds[1:]] - single[bounds[:-1]]
                prefix = n - -(-percent * n // 100) + 1
                tokens, order, place, kept, ends, which = [], [], [], [], [0], []
                total = 0
                for d in range(hi - lo):
                    if n[d] and single[d] < prefix[d]:
                        own = sets[bounds[d] : bounds[d + 1]]
                        lv = level[bounds[d] : bounds[d + 1]]
                        rest, lv = own[lv > 0], lv[lv > 0]
                        most = prefix[d] - single[d]
                        if len(rest):
                            for k in range(orders):
                                at = np.lexsort((mix(rest, 40 + k), lv))[:most]
                                tokens.append(rest[at])
                                order.append(np.full(len(at), k, np.int8))
                                place.append(np.arange(single[d], single[d] + len(at), dtype=np.int32))
                                total += len(at)
                            which.append(d)
                            kept.append(own.tobytes())
                            ends.append(total)
                offsets = pa.array(ends, pa.int32())
                cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
                yield pa.record_batch(
                    [
                        batch.column("row").slice(lo, hi - lo).take(pa.array(which, pa.int64())),
                        pa.array(n[which].astype(np.int64)),
                        pa.array(single[which].astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.array(cat(tokens, np.uint64).view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(cat(order, np.int8))),
                        pa.ListArray.from_arrays(offsets, pa.array(cat(place, np.int32))),
                        pa.array(kept, pa.binary()),
                    ],
                    names=["row", "n", "single", "tokens", "orders", "places", "shingles"],
                )

        return work

    return map_arrow(rows.select("row", "text"), "row long, n long, single int, tokens array<long>, orders array<byte>, places array<int>, shingles binary", make)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows next to each other that share a token, over sorted rows (token, n, doc)."""
    last = None
    for batch in batches:
        token, n, doc = (batch.column(c).to_numpy() for c in ("token", "n", "doc"))
        if last is not None:
            token, n, doc = (np.concatenate(([x], y)) for x, y in zip(last, (token, n, doc), strict=True))
        if len(token):
            last = (token[-1], n[-1], doc[-1])
        same = (token[1:] == token[:-1]) & (doc[1:] != doc[:-1])
        a, b = doc[:-1][same], doc[1:][same]
        yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(n[:-1][same]), pa.array(n[1:][same])], names=["a", "b", "na", "nb"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return work

    full = pairs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("sb")), "b")
    return map_arrow(full.select("a", "b", "sa", "sb"), "a long, b long", make)


def _text_keys(text_col: str) -> list:
    """Two hashes of a text; null counts as empty."""
    return [F.xxhash64(F.lit(k), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias(f"t{k}") for k in (1, 2)]


def _components(docs: DataFrame, size: int = 5, percent: int = 75, orders: int = ORDERS, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, t1, t2, n, best) for every row: ``best`` is the least (doc_id, t1, t2) of its component's rows with an id."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram")
    rows = texts(docs, id_col, text_col)
    # Rows are numbered where they are written, so a number is never null, nor dealt anew.
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", *_text_keys("text"), "text")
    numbered = scratch.keep(_number(numbered, size), "rows", "zstd")
    ids = scratch.keep(numbered.drop("text"), "ids")

    best = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t1", "t2")))
    reps = scratch.keep(ids.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("rep"), best.alias("own")), "reps")
    chosen = spark.sparkContext.broadcast(likely.Rows(likely.bits_of(reps.select(F.col("rep").alias("row")))))
    some = likely.likely(numbered, lambda words: shingle_sets(words, size)[:2], chosen, percent, plan_bytes(docs.select(text_col)))
    some = spark.sparkContext.broadcast(likely.Rows(some))
    kept = scratch.keep(map_arrow(numbered.select("row", "text"), "row long, text string", lambda: lambda batch: [some.value.cut(batch)]), "likely", "zstd")
    scratch.drop("rows")
    scratch.sweep()

    cells = sketch.cells_for(kept.select("text"), PER_BYTE)
    packed = spark.sparkContext.broadcast(sketch.build(kept, _sketch_keys(size), cells, 1))
    posted = scratch.keep(_scan(kept, packed, size, percent, orders), "scan")
    scratch.drop("likely")
    scratch.sweep()
    sets = posted.select("row", "shingles")
    posts = posted.select(F.col("row").alias("doc"), "n", "single", F.inline(F.arrays_zip("orders", "tokens", "places"))).select(F.col("orders").alias("ord"), F.col("tokens").alias("token"), "doc", "n", "single", F.col("places").alias("pos"))
    posts = scratch.keep(posts, "sent")
    shared = posts.groupBy("ord", "token").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    posts = scratch.keep(posts.join(shared.select("ord", "token"), ["ord", "token"], "left_semi"), "posts")
    scratch.drop("sent")
    scratch.sweep()

    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    first = posts.where("ord = 0").select("token", "n", "doc", "single")
    # The text with the fewest shingles of its own is the likeliest origin of the others' edits.
    pivot = first.groupBy("token").agg(F.min(F.struct("single", "doc", "n")).alias("p")).select("token", F.col("p.doc").alias("p"), F.col("p.n").alias("np"))
    star = first.join(pivot, "token").where("doc <> p").select(F.least("doc", "p").alias("a"), F.greatest("doc", "p").alias("b"), F.col("n").alias("na"), F.col("np").alias("nb"))
    first = first.drop("single")
    chain = first.repartitionByRange("token", "n", "doc").sortWithinPartitions("token", "n", "doc").mapInArrow(_neighbours, "a long, b long, na long, nb long")
    seeds = star.union(chain).where(fits).select("a", "b").distinct()
    links = scratch.keep(_verify(seeds, sets, percent), "links")
    labels = scratch.keep(components(links, scratch, "cc"), "labels")

    own = posts.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    own = scratch.keep(own, "labelled")
    scratch.drop("posts")
    common = own.groupBy("ord", "token", "label").agg(F.count("*").alias("c")).groupBy("ord", "token").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("k")).where("k > 1").select("ord", "token", F.col("top.label").alias("top"))
    own = scratch.keep(own.join(common, ["ord", "token"]), "mixed")
    scratch.drop("labelled")
    left = own.where("label <> top").select("ord", "token", "top", *(F.col(c).alias(f"{c}_a") for c in ("doc", "n", "pos", "label")))
    right = own.select("ord", "token", *(F.col(c).alias(f"{c}_b") for c in ("doc", "n", "pos", "label")))
    meet = left.join(right, ["ord", "token"]).where(
        "label_a <> label_b AND (label_b = top OR doc_a < doc_b)"
        f" AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        f" AND {100 + percent} * least(n_a - pos_a, n_b - pos_b) >= {percent} * (n_a + n_b)"
    )
    # A pair must come from every order; within an order it may come from several shingles.
    pairs = meet.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"), "ord").distinct().groupBy("a", "b").agg(F.count("*").alias("k")).where(F.col("k") == orders).select("a", "b")
    more = scratch.keep(_verify(pairs, sets, percent), "more")
    scratch.drop("mixed")
    scratch.drop("scan")
    scratch.sweep()

    names = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    bridges = more.join(names("a"), "a", "left").join(names("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    tops = scratch.keep(components(bridges, scratch, "bridge"), "tops")
    labels = labels.join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")).union(tops.join(labels, "node", "left_anti").select("node", "label"))
    found = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "own", F.coalesce("label", "rep").alias("component"), F.col("label").isNotNull().alias("linked"))
    least = found.where("linked").groupBy("component").agg(F.min("own").alias("least"))
    found = found.join(least, "component", "left").select("k1", "k2", F.coalesce("least", "own").alias("best"))
    return ids.select("doc_id", "t1", "t2", "k1", "k2", "n").join(found, ["k1", "k2"], "left").select("doc_id", "t1", "t2", "n", F.when(F.col("n") > 0, F.col("best")).alias("best"))


def ngram_components(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    out = _components(docs, **how)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component, that of its smallest id (of the least hash where an id repeats); rows without an id stay."""
    scratch = Scratch(docs.sparkSession, "kept")
    found = _components(docs, id_col=id_col, text_col=text_col, scratch=scratch, **how)
    keys = fresh(docs, "key_id", "key_t1", "key_t2")
    gone = found.where("doc_id IS NOT NULL AND best <> struct(doc_id, t1, t2)").select(*(F.col(c).alias(k) for c, k in zip(("doc_id", "t1", "t2"), keys, strict=True)))
    gone = scratch.keep(gone.distinct(), "gone")
    scratch.drop("ids")
    scratch.drop("reps")
    keyed = docs.select("*", F.col(f"`{id_col}`").cast("long").alias(keys[0]), *(c.alias(k) for c, k in zip(_text_keys(text_col), keys[1:])))
    kept = keyed.join(gone, keys, "left_anti")
    known = kept.where(F.col(keys[0]).isNotNull()).dropDuplicates(keys)
    return known.unionByName(kept.where(F.col(keys[0]).isNull())).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))
