import os
import random

import numpy as np
import pytest

from barloom.llm import common, likely, sketch
from barloom.llm.ngram_join import drop_near_copies, ngram_components

from . import brute

SCHEMA = "doc_id long, text string, n long, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)


def near_copies(rng, groups, members):
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 80))]
        for _ in range(members):
            own = list(base)
            kind = rng.random()
            if kind < 0.4:
                for _ in range(rng.randint(0, 3)):
                    own[rng.randrange(len(own))] = f"e{rng.random()}"
            elif kind < 0.7:
                own = own[: rng.randint(len(own) // 2, len(own))]
            elif kind < 0.8:
                own = [w.upper() for w in own]
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = near_copies(rng, 6, 30)
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "two one"), (n + 6, "a a a a a a a a"), (n + 7, "É b c d e f"), (n + 8, "é b c d e f")]
    got = sorted(map(tuple, ngram_components(frame(spark, rows)).collect()))
    assert got == sorted(brute.components(rows))
    kept = {r.doc_id for r in drop_near_copies(frame(spark, rows)).collect()}
    assert kept == {d for d, s, c in got if d == c}


def test_null_ids_repeats_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (None, None)]
    got = sorted((tuple(r) for r in ngram_components(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 2, None), (None, 0, None)], key=str)
    assert drop_near_copies(frame(spark, rows)).count() == 4
    assert ngram_components(frame(spark, [])).count() == 0
    assert drop_near_copies(frame(spark, [])).columns == ["doc_id", "text", "n", "component_id"]


def test_rows_link_by_their_texts_whatever_their_ids(spark):
    words = [f"v{k}" for k in range(60)]
    near = lambda k: " ".join(words[k : k + 40])
    rows = [(7, "a clean text of its own that none copies"), (7, "another one with nothing in common at all"), (7, near(0)), (5, near(3)), (6, near(3))]
    rows += [(None, "p q r s t u v w"), (None, "p q r s t u v w"), (None, near(6)), (8, near(9))]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(frame(spark, rows)).collect()}
    # 8 is linked with 5 by a text without an id only.
    assert got == {(7, 5, 7), (7, 4, 7), (7, 36, 5), (5, 36, 5), (6, 36, 5), (None, 4, None), (None, 36, 5), (8, 36, 5)}
    kept = drop_near_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "n", "component_id"]
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == sorted([rows[0][:2], rows[1][:2], rows[3][:2]])


def test_disk_does_not_hang_on_the_sketch(spark, monkeypatch):
    """Past its bound a sketch tells nothing apart: documents that can't link still aren't stored as sets and prefixes."""
    rng = random.Random(11)
    line = " ".join(f"often{k}" for k in range(12))  # all documents share a line
    rows = [(d, " ".join([*(f"w{rng.randint(0, 5000)}" for _ in range(150)), line, *(f"w{rng.randint(0, 5000)}" for _ in range(150))])) for d in range(2000)]
    rows += [(2000 + d, f"{text} more") for d, text in rows[:20]]
    docs = frame(spark, rows).repartition(2)
    written, keep = {}, common.Scratch.keep

    def kept(self, df, name, *compression):
        out = keep(self, df, name, *compression)
        top = f"{self.dir.removeprefix('file://')}/{name}"
        written[name] = sum(os.path.getsize(f"{top}/{f}") for f in os.listdir(top) if f.endswith(".parquet"))
        return out

    monkeypatch.setattr(common.Scratch, "keep", kept)
    monkeypatch.setattr(sketch, "MOST_CELLS", 1 << 10)
    got = {r.doc_id: r.component_id for r in ngram_components(docs).collect()}
    assert got == {d: d % 2000 for d, _ in rows}
    assert sum(written.values()) < 1.5 * sum(len(t) for _, t in rows), written


@pytest.mark.parametrize("percent", [1, 40, 75, 90, 100])
def test_rows_that_link_pass_whatever_the_slices(spark, monkeypatch, percent):
    monkeypatch.setattr(likely, "SLICE_BYTES", 1 << 6)
    monkeypatch.setattr(likely, "FLUSH", 500)
    rng = random.Random(percent)
    rows = near_copies(rng, 5, 8) + [(100, "a b c d e"), (101, "a b c d e a b c d e"), (102, None), (103, "a a a a a a"), (104, "a a a a a a a")]
    sets = {d: brute.shingles(t) for d, t in rows}
    low = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    got = {r.doc_id: r.component_id for r in ngram_components(frame(spark, rows), percent=percent).collect()}
    assert got == low


def test_prefixes_hold_what_must_be_shared():
    rng = np.random.default_rng(3)
    for percent in (1, 30, 75, 99, 100):
        for _ in range(300):
            n = int(rng.integers(1, 200))
            most = n * 100 // percent
            m = int(rng.integers(n, min(most, 400) + 1))
            both = max(1, -(-percent * (n + m) // (100 + percent)))  # the least intersection of linked sets of n and m
            if both > n:
                continue
            everything = rng.permutation(n + m - both)
            a, b = np.sort(everything[:n]), np.sort(everything[n - both :])
            (sent_a, sent_b), (need_a, need_b) = likely.prefixes(np.array([n, m]), percent)
            seen = len(np.intersect1d(a[:sent_a], b[:sent_b]))
            assert seen >= need_a and seen >= need_b


def test_row_sets(spark):
    rows = [0, 1, 8, 65535, 65536, 3 << 33, (3 << 33) + 77]
    chosen = likely.Rows(likely.bits_of(spark.createDataFrame([(r,) for r in rows], "row long")))
    asked = np.array([*rows, 2, 65534, 65537, 5 << 33, (3 << 33) + 76])
    assert chosen.has(asked).tolist() == [True] * 7 + [False] * 5
    assert not likely.Rows(likely.bits_of(spark.createDataFrame([], "row long"))).has(asked).any()
