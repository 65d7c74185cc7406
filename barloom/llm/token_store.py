"""Operator 2: token ids in a content-addressed store.

Texts become ids; a rolling hash over the last ``REACH`` ids cuts a document's
ids into chunks, so equal passages give equal chunks wherever they stand.  The
store holds

``chunks``    each different chunk once: digest, ids (little-endian, 2 bytes
              an id if the vocabulary allows, else 4);
``recipes``   a document's digests in order, the Merkle root over them, and
              ``start``, the ids of all documents before it by ascending id,
              in parts of about ``PART`` ids;
``manifest``  of each part: documents, ids, and the Merkle root of their roots;
``layout``    the number of buckets of the chunks.

Reading sends each part the chunks that it needs once, so a chunk that a third
of all documents share moves once for each part, and checks every digest and
root.

Where a word's ids don't depend on its neighbours beyond white space, nor those
of letters and digits on marks that follow them, each different word is encoded
once; other tokenizers encode whole texts. ``Encoder`` tries which holds.

Defined results: null and empty texts have the end id alone; null ids come
first, repeated rows are documents of their own, in an order that their
content decides; an empty table gives an empty store; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, documents, map_arrow, shuffle_partitions, texts
from .ranking import ranked
from .words import PLAIN, U64, Words, blocks, mix, runs, spans

REACH, LEAST, MOST, MEAN = 16, 64, 2048, 256
PART = 1 << 20
#: Parts under one node of the manifest's upper tree.
FAN = 1 << 12
#: Words in either generation of a worker's cache.
CACHE = 1 << 19
#: Words that the tokenizer sees at once, joined by spaces.
JOINED = 512
#: Digests of a task's chunks that it remembers.
SEEN = 1 << 17
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".,;:!?")] = True
_ASCII = ~PLAIN
_ASCII[128:] = False


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"\1" + leaves[k] + leaves[k + 1]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0]


class Cache:
    """Ids of words by their hash: open addressing in arrays, so that a block's words are looked up at once."""

    def __init__(self, most: int):
        self.most, self.slots = most, 1 << (2 * most - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys, self.where = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.begin, self.size = np.zeros(self.most, np.int64), np.zeros(self.most, np.int32)
        self.flat, self.ids, self.used = np.zeros(1 << 16, np.uint32), 0, 0

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(20)).astype(np.int64) & (self.slots - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 if there is none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        left, slot = np.arange(len(hashes)), self._slot(hashes)
        while len(left):
            key = self.keys[slot]
            same = key == hashes[left]
            out[left[same]] = self.where[slot[same]]
            on = ~same & (key != 0)
            left, slot = left[on], slot[on] + 1 & self.slots - 1
        return out

    def ids_of(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of entry after entry, number of ids of each)."""
        size = self.size[entry]
        return self.flat[spans(self.begin[entry], size)], size

    def add(self, hashes: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Adds words, distinct and new; a hash is never 0."""
        if self.ids + len(flat) > len(self.flat):
            grown = np.zeros(2 * (self.ids + len(flat)), np.uint32)
            grown[: self.ids] = self.flat[: self.ids]
            self.flat = grown
        self.flat[self.ids : self.ids + len(flat)] = flat
        self.begin[self.used : self.used + len(size)] = self.ids + np.cumsum(size) - size
        self.size[self.used : self.used + len(size)] = size
        left, slot = np.arange(len(hashes)), self._slot(hashes)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]
            self.where[slot[free]] = self.used + left[free]
            won = self.keys[slot] == hashes[left]
            # Two words may have met in a free slot: the last one written has it.
            won &= self.where[slot] == self.used + left
            left, slot = left[~won], slot[~won] + 1 & self.slots - 1
        self.used += len(hashes)
        self.ids += len(flat)


class Encoder:
    """Ids of whole texts from the ids of their different words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.by_word, self.caseless = self._checked()
        self.last = self._lasts() if self.by_word else None
        self.cache, self.older = Cache(CACHE), Cache(CACHE)

    def _checked(self) -> tuple[bool, bool]:
        """Whether words can be encoded one by one, and whether ASCII case makes no difference, tried on a text of every kind of mark."""
        plain = "".join(map(chr, range(33, 127)))
        words = [f"{plain[k:k + 3]}a{plain[k]}" for k in range(0, 94, 2) if "<|" not in plain[k : k + 3]] + ["Abc", "\u00c9t\u00e9", "\u6f22\u5b57", "x1,y", "don't.", "\u0301b"]
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        each = [i for w in words for i in ids(w)]
        cut = [i for w in ("ab,", "b7.", "Zz?!") for i in (*ids(w[:2]), *ids(w[2:]))]
        by_word = all(ids(between.join(words)) == each for between in (" ", "\n\t ", "  \r\x0b\x0c")) and ids("ab, b7. Zz?!") == cut and ids(" a ") == ids("a")
        return by_word, by_word and all(ids(w) == ids(w.lower()) for w in words if w.isascii())

    def _lasts(self) -> np.ndarray | None:
        """By id, whether it ends a piece of a word; None where the vocabulary doesn't mark that for every byte."""
        from tokenizers import pre_tokenizers

        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        if not suffix or any(c + suffix not in vocab for c in pre_tokenizers.ByteLevel.alphabet()):
            return None
        last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        for w in ("a", "Abc", "\u00c9t\u00e9", "\u6f22\u5b57"):
            ids = self.tokenizer.encode(w, add_special_tokens=False).ids
            if not ids or not last[ids[-1]] or last[ids[:-1]].any():
                return None
        return last

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of word after word, number of ids of each)."""
        letters = np.fromiter(map(str.isalpha, words), bool, len(words)) & (self.last is not None)
        order, flats, sizes = [], [], []
        for own, code in ((np.flatnonzero(letters), self._letters), (np.flatnonzero(~letters), self._any)):
            for lo in range(0, len(own), JOINED):
                order.append(own[lo : lo + JOINED])
                flat, size = code([words[j] for j in order[-1].tolist()])
                flats.append(flat)
                sizes.append(size)
        size, back = np.concatenate(sizes), np.argsort(np.concatenate(order))
        begin = np.cumsum(size) - size
        return np.concatenate(flats)[spans(begin[back], size[back])], size[back]

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of letters alone: without offsets, which take half the time.  Each word has a last id at least; if there are as many as words, one each."""
        flat = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        at = np.flatnonzero(self.last[flat])
        # A letter whose lower case has a mark of its own, say, makes two pieces.
        return (flat, np.diff(at, prepend=-1)) if len(at) == len(words) else self._any(words)

    def _any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of any words, told apart by offsets; one call for all but those that may hold a special token."""
        plain = [w for w in words if "<|" not in w]
        got = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        starts = np.cumsum(lengths + 1) - lengths - 1
        flat = np.array(got.ids, dtype=np.uint32)
        begin = np.fromiter((a for a, _ in got.offsets), np.int64, len(flat))
        size = np.bincount(np.searchsorted(starts, begin, side="right") - 1, minlength=len(plain)) if len(plain) else np.zeros(0, np.int64)
        if len(plain) == len(words):
            return flat, size
        parts, k = np.split(flat, np.cumsum(size)[:-1]) if len(plain) else [], 0
        own = []
        for w in words:
            if "<|" in w:
                own.append(np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=np.uint32))
            else:
                own.append(parts[k])
                k += 1
        return np.concatenate(own), np.array([len(x) for x in own])

    def _rows(self, words: Words) -> tuple[np.ndarray, Cache]:
        """The cache's entry of each word, and the cache."""
        fold = self.caseless and b"<|" not in words.data.tobytes()  # special tokens are one thing that case changes
        hashes, cache = np.maximum(words.hashes(fold=fold), U64(1)), self.cache
        entry = cache.find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            known, at = np.unique(hashes[new], return_index=True)
            if cache.used + len(known) > cache.most:
                if cache.used:  # a full cache serves on as the older one, from which words in use move over
                    self.cache, self.older = self.older, cache
                    self.cache.clear()
                    return self._rows(words)
                cache = Cache(len(known))  # for this block alone
            at, there = new[at], self.older.find(known)
            cache.add(known[there >= 0], *self.older.ids_of(there[there >= 0]))
            known, at = known[there < 0], at[there < 0]
            for k in range(0, len(known), 4096):
                cache.add(known[k : k + 4096], *self._encode(words.texts(at[k : k + 4096])))
            entry[new] = cache.find(hashes[new])
        return entry, cache

    def encode(self, data: np.ndarray, edges: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of document after document, each with the end id; bounds)."""
        if not self.by_word:
            each = self.tokenizer.encode_batch([data[a:b].tobytes().decode() for a, b in zip(edges, edges[1:])], add_special_tokens=False)  # noqa: B905
            size = np.array([len(x.ids) for x in each])
            body = np.array([i for x in each for i in x.ids], dtype=np.uint32)
        else:
            words = Words(data, edges, cut=(_ASCII, _STOPS))
            entry, cache = self._rows(words)
            body, lengths = cache.ids_of(entry)
            total = np.concatenate(([0], np.cumsum(lengths)))
            size = np.diff(total[words.first])
        bounds = np.concatenate(([0], np.cumsum(size + 1)))
        out = np.empty(int(bounds[-1]), dtype=np.uint32)
        mark = np.zeros(len(out), dtype=bool)
        mark[bounds[1:] - 1] = True
        out[mark], out[~mark] = end, body
        return out, bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker, so that what a task has learned serves the next."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document."""
    h = runs(mix(ids.astype(np.uint64), 91), REACH, 92)
    spots = np.flatnonzero((h >> U64(40)) % U64(MEAN) == 0) + REACH
    lo = np.searchsorted(spots, bounds[:-1] + LEAST)
    out = []
    for d in range(len(bounds) - 1):
        at, end, ends, k = int(bounds[d]), int(bounds[d + 1]), [], int(lo[d])
        while at < end:
            while k < len(spots) and spots[k] < at + LEAST:
                k += 1
            to = min(at + MOST, end)
            if k < len(spots) and spots[k] < to:
                to = int(spots[k])
            ends.append(to)
            at = to
        out.append(ends)
    return out


def _digests(blob: str) -> Column:
    """The digests that a recipe's blob holds one after another."""
    return F.expr(f"transform(sequence(0, length({blob}) div 16 - 1), k -> substring({blob}, 16 * k + 1, 16))")


def write_store(docs: DataFrame, place: str, tokenizer_path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the store of ``docs`` to ``place`` and returns the Merkle root of it all, in hexadecimal."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "encoded")

    def make():
        coder = encoder(tokenizer_path)
        kind = "<u4" if coder.wide or end >= 1 << 16 else "<u2"
        width, seen = int(kind[-1]), set()

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lo, hi, data, edges in blocks(batch.column("text")):
                ids, bounds = coder.encode(data, edges, end)
                raw = memoryview(ids.astype(kind)).cast("B")
                roots, recipes, fresh, held, ends_at = [], [], [], [], [0]
                if len(seen) > SEEN:
                    seen.clear()
                for d, ends in enumerate(cuts(ids, bounds)):
                    own, a = [], int(bounds[d])
                    for b in ends:
                        part = raw[width * a : width * b]
                        own.append(digest(part))
                        if own[-1] not in seen:  # a task sends a chunk once
                            seen.add(own[-1])
                            fresh.append(len(own) - 1)
                            held.append(part)
                        a = b
                    roots.append(merkle(own))
                    recipes.append(b"".join(own))
                    ends_at.append(len(held))
                at = pa.array(ends_at, pa.int32())
                yield pa.record_batch(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array([width] * (hi - lo), pa.int32()), pa.array(roots, pa.binary()), pa.array(recipes, pa.binary()), pa.ListArray.from_arrays(at, pa.array(fresh, pa.int32())), pa.ListArray.from_arrays(at, pa.array(held, pa.binary()))],
                    names=["doc_id", "n_tokens", "width", "root", "digests", "fresh", "chunks"],
                )

        return work

    made = map_arrow(texts(docs, id_col, text_col), "doc_id long, n_tokens long, width int, root binary, digests binary, fresh array<int>, chunks array<binary>", make)
    made = scratch.keep(made, "encoded", "zstd")  # ids have few bits each
    chunks = made.select("digests", F.inline(F.arrays_zip("fresh", "chunks"))).select(F.expr("substring(digests, 16 * fresh + 1, 16)").alias("digest"), F.col("chunks").alias("ids"))
    # In buckets by digest, so that readers join the chunks where they lie.
    buckets = shuffle_partitions(spark)
    chunks.dropDuplicates(["digest"]).write.format("parquet").option("compression", "zstd").option("path", f"{place}/chunks").bucketBy(buckets, "digest").saveAsTable(_table_name(place))
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{place}/layout")
    recipes = scratch.keep(made.drop("fresh", "chunks"), "recipes")
    scratch.drop("encoded")
    placed = ranked(recipes, ["doc_id", "root"], scratch, "placed", weight=F.col("n_tokens")).withColumnRenamed("before", "start")
    placed = placed.withColumn("part", F.expr(f"start div {PART}"))
    placed.repartitionByRange("part", "start").sortWithinPartitions("part", "start").write.parquet(f"{place}/recipes")
    scratch.drop("recipes")
    scratch.drop("placed")

    def roots(of: str, value: str, order: str):
        def root(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by(order)
            return pa.table({of: [key[0].as_py()], "docs": [sum(table["docs"].to_pylist())], "tokens": [sum(table["tokens"].to_pylist())], value: [merkle(table["leaf"].to_pylist())]}, pa.schema([(of, pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), (value, pa.binary())]))

        return root

    recipes = spark.read.parquet(f"{place}/recipes").select("part", "start", F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"), F.col("root").alias("leaf"))
    recipes.groupBy("part").applyInArrow(roots("part", "root", "start"), "part long, docs long, tokens long, root binary").write.parquet(f"{place}/manifest")
    # Subtrees of ``FAN`` leaves, a power of two, stand where they would in one tree over all parts.
    level = spark.read.parquet(f"{place}/manifest").select("part", "docs", "tokens", F.col("root").alias("leaf"))
    level = level.withColumn("above", F.expr(f"part div {FAN}")).groupBy("above").applyInArrow(roots("above", "leaf", "part"), "above long, docs long, tokens long, leaf binary")
    tops = level.orderBy("above").toLocalIterator()
    return merkle([bytes(r.leaf) for r in tops]).hex()  # 16 bytes for each FAN * PART ids


def _table_name(place: str) -> str:
    return f"barloom_chunks_{digest(place.encode()).hex()}"


def _chunks(spark: SparkSession, place: str) -> DataFrame:
    """The chunks as a table of this session, which knows their buckets."""
    name = _table_name(place)
    if not spark.catalog.tableExists(name):
        buckets = spark.read.parquet(f"{place}/layout").first()["buckets"]
        where = place.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} (digest BINARY, ids BINARY) USING parquet CLUSTERED BY (digest) INTO {buckets} BUCKETS LOCATION '{where}/chunks'")
    return spark.table(name)


def read_store(spark: SparkSession, place: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the store, verified; ids as little-endian 32-bit numbers."""
    recipes = spark.read.parquet(f"{place}/recipes")
    chunks = _chunks(spark, place)
    needs = recipes.select(F.col("part").alias("of_part"), F.explode(_digests("digests")).alias("digest")).distinct().join(chunks, "digest")
    proof = spark.read.parquet(f"{place}/manifest").select("part", F.col("root").alias("proof"))

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right["digest"].to_pylist(), right["ids"].to_pylist(), strict=True))
        if any(digest(v) != k for k, v in known.items()):
            raise ValueError("a chunk doesn't match its digest")
        left = left.sort_by("start")
        ids = []
        for width, root, blob, n in zip(*(left[c].to_pylist() for c in ("width", "root", "digests", "n_tokens")), strict=True):
            own = [blob[k : k + 16] for k in range(0, len(blob), 16)]
            x = np.frombuffer(b"".join([known[k] for k in own]), f"<u{width}").astype("<u4")
            if merkle(own) != root or len(x) != n:
                raise ValueError("a document doesn't match its recipe")
            ids.append(x.tobytes())
        if left.num_rows and merkle(left["root"].to_pylist()) != left["proof"][0].as_py():
            raise ValueError("a part doesn't match the manifest")
        return pa.table({"doc_id": left["doc_id"], "start": left["start"], "n_tokens": left["n_tokens"], "ids": pa.array(ids, pa.binary())})

    recipes = recipes.join(proof, "part", "left")
    return recipes.groupBy("part").cogroup(needs.groupBy("of_part")).applyInArrow(build, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    place = f"{Scratch(spark, 'store').dir}/store"
    write_store(documents(spark, sf_dir), place, public_tokenizers.path("word_bpe_49k.json"))
    return read_store(spark, place).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
