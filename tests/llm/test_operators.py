"""Small inputs with nulls, empty texts, repeats, clashing names and empty tables, against brute force where there is one."""

import collections
import functools
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

from barloom.llm import decontamination, fingerprint, language, mixing, sharding, token_counts, token_store, toxicity
from barloom.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, score double, shard int"
SF = "/root/testdata/sf0.001"


def frame(spark, texts):
    return spark.createDataFrame([(d, t, "en", s, 1.0, 7) for d, t, s in texts], SCHEMA)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "One two, three!", "a"), (4, "One two, three!", "a"), (None, "é ß 漢字 <|endoftext|> ,.", "b"), (5, "word " * 3000, "b")]


def test_token_store_round_trip(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = ODD + [(d + 10, r.text, "x") for d, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").collect())]
    place = f"{Scratch(spark, 'test').dir}/store"
    root = token_store.write_store(frame(spark, rows), place, path)
    got = sorted(token_store.read_store(spark, place).collect(), key=lambda r: r.start)
    tokenizer, want = Tokenizer.from_file(path), []
    for d, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, np.array(ids, "<u4").tobytes()))
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=str) == sorted(want, key=str)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert [r.doc_id or 0 for r in got] == sorted(r.doc_id or 0 for r in got)
    again = f"{Scratch(spark, 'test').dir}/store"
    assert token_store.write_store(frame(spark, rows[::-1]), again, path) == root
    empty = f"{Scratch(spark, 'test').dir}/store"
    token_store.write_store(frame(spark, []), empty, path)
    assert token_store.read_store(spark, empty).count() == 0


def test_token_counts_equal_the_tokenizer(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.load_pieces(P.path("piece_bpe_32k.model"))
    whole = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces], unk_id=0))
    whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    rows = ODD + [(9, "漢漢x漢 aaaa", "a")]
    got = {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(frame(spark, rows), P.path("piece_bpe_32k.model")).collect()}
    assert got == {(d, len(whole.encode(t or "").ids)) for d, t, _ in rows}


def test_sharding(spark):
    rng = random.Random(3)
    rows = ODD + [(d, f"t{d % 9}", rng.choice("aaab")) for d in range(100, 400)]
    got = sharding.shard(frame(spark, rows), 5).collect()
    n = len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(5)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        for s in "ab":
            assert abs(sum(r.source == s for r in own) - sum(x[2] == s for x in rows) / 5) <= 2
    key = lambda r: (hashlib.md5(f"10:{'' if r[0] is None else r[0]}".encode()).hexdigest(), zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1)
    places = []
    for s in {x[2] for x in rows}:
        own = sorted((x for x in rows if x[2] == s), key=key)
        places += [((2 * k + 1) / (2 * len(own)), key(x), x) for k, x in enumerate(own)]
    want = sorted(((x[0], k * 5 // n) for k, (_, _, x) in enumerate(sorted(places, key=lambda p: p[:2]))), key=str)
    assert sorted(((r.doc_id, r.shard) for r in got), key=str) == want
    assert sharding.shard(frame(spark, []), 5).count() == 0


def test_decontamination(spark):
    rng = random.Random(1)
    items = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(6, 40)))) for k in range(20)] + [(50, None), (51, "  ")]
    rows = list(ODD)
    want = set()
    for d in range(100, 200):
        k, text = rng.choice(items[:20])
        own = text.split()
        for _ in range(rng.randint(0, int(0.2 * len(own)))):
            own[rng.randrange(len(own))] = "zz"
        around = [f"x{rng.random()}" for _ in range(20)]
        rows.append((d, " ".join(around[:10] + own + around[10:]), "a"))
        want.add((d, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    kept = decontamination.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len({d for d, _ in got})
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontamination.find_leaks(frame(spark, []), bench).count() == 0


def least_edits(item, text):
    """(edits, first word) of the first of the passages of ``text`` nearest to ``item``, by plain dynamic programming."""
    cost = [(0, j) for j in range(len(text) + 1)]
    for i, w in enumerate(item):
        step = [(i + 1, 0)]
        for j, t in enumerate(text):
            step.append(min((cost[j][0] + (w != t), cost[j][1]), (cost[j + 1][0] + 1, cost[j + 1][1]), (step[j][0] + 1, step[j][1])))
        cost = step
    return min(cost)


def test_decontamination_finds_every_passage_within_its_edits(spark):
    rng = random.Random(11)
    for n in (1, 2, 5, 6, 15, 59, 100):
        k, items, rows, want = int(0.2 * n), [], [], set()
        for kind in ("delete", "insert", "replace", "any") * 5:
            own = [f"w{rng.randrange(4000)}" for _ in range(n)]
            items.append((len(items), " ".join(own)))
            for _ in range(k + (len(items) % 5 == 0)):  # some of one edit too many
                how, at = kind if kind != "any" else rng.choice(["delete", "insert", "replace"]), rng.randrange(len(own))
                own[at : at + (how != "insert")] = [] if how == "delete" else [f"z{rng.random()}".replace(".", "")]
            around = [f"x{rng.randrange(10**9)}" for _ in range(rng.randrange(12))]
            rows.append((len(rows), " ".join(around + own + around), "a"))
        for d, t, _ in rows:
            for i, own in items:
                edits, _ = least_edits(own.split(), t.split())
                if edits <= k:
                    want.add((d, i, edits))
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = decontamination.find_leaks(frame(spark, rows), bench).collect()
        assert {(r.doc_id, r.item_id, r.edits) for r in got} == want and len(got) == len(want) >= 16
        for r in got:
            text, own = rows[r.doc_id][1].split(), items[r.item_id][1].split()
            assert least_edits(own, text[r.at :])[0] == r.edits and (least_edits(own, text[r.at + 1 :])[0] > r.edits or r.edits)


def test_mixing_to_given_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = docs.select("doc_id", docs.lang.alias("domain"))
    supply = mixing.fit(docs, labelled, power=1.0)
    assert np.allclose(supply.targets, supply.reached) and not supply.miss
    want = {d: t * (0.4 if k % 2 else 1.5) for k, (d, t) in enumerate(zip(supply.domains, supply.targets))}
    model = mixing.fit(docs, labelled, want)
    assert np.abs(model.reached - model.targets).max() <= 1e-2 * model.targets.sum()
    with pytest.warns(UserWarning, match="not met"):
        held = mixing.fit(docs, labelled, want | {"none": 100.0}, floor=1.0)
    assert held.miss["none"] == -100 and max(held.miss.values()) > 0.05 * sum(want.values())
    with pytest.warns(UserWarning, match="not met"):
        assert mixing.fit(docs, labelled.limit(0), {"none": 1.0}).miss == {"none": -1.0}


def brute_parts(texts):
    """Parts of a fingerprint by plain Python, by the lexicon of ``texts``."""
    signed = lambda n: (n + (1 << 63)) % (1 << 64) - (1 << 63)
    step = lambda n, seed=42: xxhash.xxh64_intdigest(struct.pack("<q", signed(n)), seed)
    words = lambda t: {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0d]+", t.lower()) if w}
    df = collections.Counter(w for t in texts for w in words(t))
    low, high = fingerprint.BAND
    lex = {w for w, n in df.items() if low <= math.log(len(texts) / n) <= high}
    salted = lambda w, *salts: functools.reduce(lambda seed, s: xxhash.xxh64_intdigest(struct.pack("<i", s), seed), salts, step(w))

    def one(t):
        families = [sorted(w for w in words(t) & lex if signed(salted(w, g)) % 4 == 0) for g in range(fingerprint.FAMILIES)]
        if not any(families):
            return None
        out = []
        for k in range(fingerprint.LEVELS):
            if k:
                families = [[w for w in f if salted(w, fingerprint.FAMILIES + k, g) % 2 == 0] for g, f in enumerate(families)]
            for f in families:
                out.append(f"{functools.reduce(lambda seed, w: step(w, seed), f, 42) & 0xFFFFFFFF:08x}" if f else "")
        return "-".join(out)

    return one


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.op3_fingerprint(spark, SF).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    one = brute_parts([t for _, t in rows])
    known, plain = 0, {}
    for k, (d, t) in enumerate(rows):
        cut, after = len(t) // 4, rows[(k + 1) % len(rows)]
        edited = t[: len(t) - cut] + after[1][:cut]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        want, want_edited, want_next = one(t), one(edited), one(after[1])
        if want is None:
            assert len(got[d].fingerprint) == 8 and plain.setdefault(t, got[d].fingerprint) == got[d].fingerprint
            continue
        known += 1
        assert got[d].fingerprint == want
        for other, near in ((want_edited, got[d].near_edited), (want_next, got[d].near_next)):
            pairs = [(x, y) for x, y in zip(want.split("-"), other.split("-")) if x or y] if other else []
            assert near == pytest.approx(sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0)
    assert known > len(rows) / 2
    assert sum(r.near_edited for r in got.values()) > sum(r.near_next for r in got.values())


def test_fingerprints_of_odd_rows_and_a_large_lexicon(spark, tmp_path):
    frame(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    got = fingerprint.op3_fingerprint(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got if r.doc_id) == sorted((d, len(t or "")) for d, t, _ in ODD if d)
    assert len(got) == len(ODD) and all(r.near_edited == r.near_next == 1 for r in got if r.doc_id == 1)
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert fingerprint.op3_fingerprint(spark, str(tmp_path / "none")).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "coalesce(text, '') AS text")
    lex = fingerprint.lexicon(docs.select("text"), Scratch(spark, "test"))
    within, joined = ({(r.id, r.shown) for r in fingerprint.Printer(lex, bound).add(docs, {"parts": "text"}, ["id"]).select("id", fingerprint.shown("parts").alias("shown")).collect()} for bound in (fingerprint.BOUND, 0))
    assert within == joined and len(within) == docs.count()


def test_fingerprints_of_texts_of_rare_words(spark, tmp_path):
    rows = [(d, " ".join(f"c{(d * 7 + k) % 50}" for k in range(5)), "a") for d in range(1500)]
    rows += [(d, " ".join(f"r{d}x{k}" for k in range(60)), "a") for d in range(1500, 1510)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    rare = [r for r in fingerprint.op3_fingerprint(spark, str(tmp_path)).collect() if r.doc_id >= 1500]
    assert len(rare) == 10 and all("-" in r.fingerprint for r in rare)
    assert sum(r.near_edited for r in rare) > 1 and sum(r.near_next for r in rare) == 0


def test_language_and_toxicity(spark):
    docs = frame(spark, ODD)
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(known, learn=toxicity.part("doc_id", 3) != 1)
    held = language.identify(known, model).join(known.select("doc_id", "lang"), "doc_id").where(toxicity.part("doc_id", 3) == 1).collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    got = language.identify(docs, model, spans=True).collect()
    assert len(got) == len(ODD) and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    toxic = toxicity.fit(known, labels, learn=toxicity.part("doc_id", 5) != 0)
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, toxic).collect())
    kept = toxicity.drop_toxic(docs, toxic)
    assert sorted(kept.columns) == sorted(docs.columns)
    assert language.identify(frame(spark, []), model).count() == 0 and toxicity.drop_toxic(frame(spark, []), toxic).count() == 0


def test_nothing_learned_of_toxicity_drops_nothing(spark):
    docs = frame(spark, ODD)
    taught = lambda rows: toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    for rows in ([], [(4, 1, None), (None, 1, 1)], [(99, 0, 1)], [(4, 0, 1), (5, 0, 1)]):
        kept = toxicity.drop_toxic(docs, taught(rows))
        assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert toxicity.drop_toxic(docs, taught([(4, 0, 1), (5, 0, 0)])).count() < len(ODD)


def test_mixing_reaches_its_targets(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = mixing.fit(known, mixing.languages(known, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")))
    assert np.abs(model.reached - model.targets).max() <= 1e-3 * model.targets.sum()
    out = mixing.mix(known, model)
    assert out.columns == known.columns and out.select("doc_id").distinct().count() == known.count()
    assert mixing.mix(frame(spark, []), model).count() == 0
    assert mixing.mix(frame(spark, ODD), model).count() >= len(ODD)
