"""More small inputs: exact models against plain ones, clashing names, very long texts, and the pipeline as a whole."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import common, decontamination, language, mixing, ngram_join, sharding, subword, substring_dedup, token_store, toxicity
from barloom.llm.words import SPACE, Words, runs, sequences, word_blocks

SF = "/root/testdata/sf0.001"


def words_of(*texts):
    data = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))))


def test_hashes_do_not_depend_on_place_or_pieces():
    rng = random.Random(2)
    texts = ["ab cd  ef\n", "", "x" * 200_000 + " yy zz", " lead", "É ß", " ".join(f"w{rng.randrange(50)}" for _ in range(60_000)), "x" * 200_000]
    known = {}
    for _, _, w in word_blocks(pa.array([*texts, None], pa.string())):
        for k, h in enumerate(w.hashes().tolist()):
            assert known.setdefault(w.text(k), h) == h
    assert len(set(known.values())) == len(known) and set(known) == {x for t in texts for x in t.encode().split()}
    h = np.random.default_rng(0).integers(0, 2**63, 200_000, dtype=np.uint64)
    r = runs(h, 5, 3)
    for at in (0, 65_530, 131_070, 199_995):
        assert runs(h[at : at + 5], 5, 3)[0] == r[at]
    s = sequences(h, np.array([0, 3, 3, 150_000, 200_000]), 5)
    assert s[0] == sequences(h[:3], np.array([0, 3]), 5)[0] and s[2] == sequences(h[3:150_000], np.array([0, 149_997]), 5)[0]
    assert SPACE.sum() == 6


def test_scripts_are_those_of_letters():
    bit = {name: 1 << k for k, (name, *_) in enumerate(language.RANGES)}
    w = words_of("“hello” × — 12 नमस्ते বাংলা ไทย தமிழ் 漢字 かな 한글 привет αβγ mixedж 𐌰")
    got = language.scripts(w).tolist()
    want = [bit["Latin"], 0, 0, 0, bit["Devanagari"], bit["Bengali"], bit["Thai"], bit["Tamil"], bit["Han"], bit["Kana"], bit["Hangul"], bit["Cyrillic"], bit["Greek"], bit["Latin"] | bit["Cyrillic"], 1 << len(language.RANGES)]
    assert got == want


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(20):
        counts = rng.integers(0, 6, 5)
        first = np.concatenate(([0], np.cumsum(counts)))
        score = rng.normal(size=(int(first[-1]) or 1, 3))
        row = np.arange(first[-1])
        got = language.viterbi(score, row, first, 0.7)
        for d in range(5):
            own = score[first[d] : first[d + 1]]
            if len(own):
                value = lambda p: sum(own[k, x] for k, x in enumerate(p)) - 0.7 * sum(x != y for x, y in itertools.pairwise(p))  # noqa: B023, E731
                best = max(map(value, itertools.product(range(3), repeat=len(own))))
                assert value(got[first[d] : first[d + 1]].tolist()) == pytest.approx(best)


def test_more_than_127_languages(spark):
    rows = [(d, f"{chr(97 + d % 26)}{chr(97 + d // 26)}z " * 8, f"l{d:03d}") for d in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(df, language.fit(df)).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 140


def plain_score(text, table, bias):
    """Class scores of a text by plain sums."""
    total, n = np.zeros(table.shape[1]), 0
    for w in text.split():
        one = words_of(w)
        at = np.arange(1)
        for bucket, _ in subword.grams(one, at, one.hashes(fold=True), len(table)):
            for b in bucket.tolist():
                total += table[b]
        n += 1
    return total / max(n, 1) + bias


def test_toxicity_is_the_plain_forward_pass(spark):
    rng = np.random.default_rng(1)
    table, bias = rng.normal(size=(subword.BUCKETS, 2)).astype(np.float32), np.array([0.3, -0.2])
    texts = ["Some Words here", "", "é ß 漢字", "one two two two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_toxicity(df, (table, bias)).collect():
        x = plain_score(texts[r.doc_id], table, bias)
        assert r.score == pytest.approx(1 / (1 + np.exp(x[0] - x[1])), rel=1e-4)
    twice = toxicity.score_toxicity(df.union(df).repartition(3), (table, bias)).groupBy("doc_id").agg(F.countDistinct("score").alias("n")).collect()
    assert all(r.n == 1 for r in twice)


def test_an_id_of_both_labels_is_toxic(spark):
    docs = spark.createDataFrame([(1, "foul words"), (2, "clean talk")], "doc_id long, text string")
    fit = lambda rows: toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    a, b = fit([(1, 0), (1, 1), (2, 0)]), fit([(1, 1), (2, 0), (1, 0)])
    assert (a[0] == b[0]).all() and (a[0] == fit([(1, 1), (2, 0)])[0]).all()


def test_mixing_equals_an_independent_solver(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = docs.select("doc_id", F.col("lang").alias("domain"))
    model = mixing.fit(docs, labels, "even")
    rows = mixing.rates(model).collect()
    table = {r.doc_id: r for r in model.table_of.collect()}
    k = len(model.domains)
    p = np.array([[table[r.doc_id][f"p{j}"] for j in range(k)] for r in rows])
    t, x = np.array([float(r.n_tokens) for r in rows]), np.array([r.rate for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (x >= 0).all()
    reached = (t * x) @ p
    assert np.abs(reached - t.sum() / k).max() <= 1e-3 * t.sum()
    # Least squares by the normal equations meets the same targets, so the least possible miss is none.
    a = (p * t[:, None]).T
    y = np.linalg.lstsq(a, np.full(k, t.sum() / k), rcond=None)[0]
    assert np.abs(a @ y - t.sum() / k).max() <= 1e-6 * t.sum()
    assert {r.doc_id: r.n_tokens for r in rows} == {r.doc_id: len([w for w in (r.text or "").replace("\r", " ").split(" ") for w in w.split()]) if (r.text or "").isascii() else table[r.doc_id].t for r in docs.collect()}
    assert all(r.domain in model.domains and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)


CLASH = ["__leaks", "__text", "Score", "__n", "__domain", "__rate", "__copies", "__u", "__copy", "__row", "row_number", "key_id", "KEY_T1", "copy", "found", "leaks"]


def test_clashing_names_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(5)
    odd = docs.select("*", *(F.lit(f"kept {c}").alias(c) for c in CLASH)).cache()
    model = mixing.fit(docs, mixing.languages(docs, labels))
    toxic = toxicity.fit(docs, labels)
    for out in (toxicity.drop_toxic(odd, toxic), decontamination.drop_leaks(odd, bench), mixing.mix(odd, model), ngram_join.drop_near_copies(odd), sharding.shard(odd).drop("shard", "slot")):
        assert out.columns == odd.columns or sorted(out.columns) == sorted(odd.columns)
        assert out.count() > 0
        for c in CLASH:
            assert out.where(F.col(f"`{c}`") != f"kept {c}").count() == 0


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    rows = [(1, long), (2, long + " one more"), (3, "x" * 300_000), (4, "short one"), (5, None)]
    df = spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id long, text string, lang string, source string")
    model = language.fit(df)
    assert {r.doc_id: r.lang_pred for r in language.identify(df, model).collect()} == {1: "en", 2: "en", 3: "en", 4: "en", 5: "und"}
    assert {(r.doc_id, r.component_id) for r in ngram_join.ngram_components(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}
    gone = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()}
    assert gone == {1: (150_000, 150_000), 2: (150_002, 150_000), 3: (1, 0), 4: (2, 0), 5: (0, 0)}
    table = np.ones((subword.BUCKETS, 2), np.float32)
    assert all(r.score == 0.5 for r in toxicity.score_toxicity(df, (table, np.zeros(2))).collect())
    item = spark.createDataFrame([(7, " ".join(long.split()[1000:1030]))], "item_id long, text string")
    assert {(r.doc_id, r.at, r.edits) for r in decontamination.find_leaks(df, item).collect()} == {(1, 1000, 0), (2, 1000, 0)}


def test_token_store_query_and_sharding_query(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in token_store.op2_token_store(spark, SF).collect()}
    tokenizer, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    shards = {r.doc_id: r for r in sharding.op10_sharding(spark, SF).collect()}
    assert {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs} == {d: (r["size"], r.text_crc32) for d, r in shards.items()}


def test_token_store_words_cost_little(monkeypatch):
    """Words of letters take no offsets, and those in use outlive a full cache; ids stay the library's."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer, asked, offsets = Tokenizer.from_file(path), [], []

    class Spy:
        def encode(self, text, **more):
            asked.extend(text.split(" "))
            offsets.extend(text.split(" "))
            return tokenizer.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            asked.extend(w for t in texts for w in t.split(" "))
            return tokenizer.encode_batch_fast(texts, **more)

    def encoded(coder, *texts):
        data = [t.encode() for t in texts]
        ids, bounds = coder.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))), 1)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]

    monkeypatch.setattr(token_store, "CACHE", 64)
    coder = token_store.Encoder(path)
    coder.tokenizer = Spy()
    encoded(coder, "Abc \u00c9t\u00e9", "", "\u6f22\u5b57 abc \u1112\u1161\u11ab \u017f \ufb01x e\n")
    assert len(asked) == 7 and not offsets
    for k in range(20):  # 20 words a block: the cache of 64 fills over and over
        encoded(coder, "common " + " ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(19)))
    assert asked.count("common") == 1 and len(asked) == 8 + 20 * 19 and not offsets
    # Letters whose lower case has a mark, letters with a mark, white space that doesn't part words, special tokens.
    encoded(coder, "\u0130b \u0130\u0130 a", "don't e\u0301 \u0301 \u00a0 x\u00a0y 12 a$$$ <|endoftext|>z <|", "\u0130 \u3000 \u0130", "q" * 3000)
    for words in (words_of("ab \u00e9", "", "c"), words_of("ab \u00e9", "x" * 2_000_000 + " c"), words_of("", " ")):
        every = np.arange(len(words.start))
        assert words.texts(every[::-1]) == [words.text(k).decode() for k in every[::-1]]
    encoded(coder, " ".join(f"z{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600)) + " common \u0130")  # more words than the cache takes


def test_merkle_of_subtrees_is_that_of_the_whole():
    leaves = [token_store.digest(bytes([k])) for k in range(45)]
    for n in (1, 7, 8, 9, 16, 31, 45):
        parts = [token_store.merkle(leaves[k : min(k + 8, n)]) for k in range(0, n, 8)]
        assert token_store.merkle(parts) == token_store.merkle(leaves[:n])


def test_a_shared_folder_is_asked_for_off_local_masters(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: None)})()
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "mixing", "sharding"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, columns, kept = source, set(source.columns), [source.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
        if name != "sharding":
            assert set(docs.columns) == columns
        assert docs.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "ngram_join":
            own = ngram_join.ngram_components(docs)
            assert own.groupBy("component_id").count().where("count > 1").count() == 0
        if name == "decontamination":
            assert decontamination.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if name == "mixing":
            assert docs.select("doc_id").distinct().count() == before.count()
    assert kept[0] > kept[1] * 0.9 and kept[2] <= kept[1] and kept[3] <= kept[2] and kept[4] >= kept[3] and kept[5] == kept[4]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.select("doc_id", "shard", "slot").collect())) == sorted(map(str, docs.select("doc_id", "shard", "slot").collect()))
    empty = source.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "a", 0), (7, "", "en", "a", 0), (8, "x y z", None, None, 5)], source.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 3
