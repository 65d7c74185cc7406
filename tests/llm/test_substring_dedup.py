import random

import pytest

from barloom.llm.substring_dedup import digest, remove_repeats

from . import brute

SCHEMA = "doc_id long, text string, lang string, key string, mark string"


def run(spark, rows, size, **more):
    df = spark.createDataFrame([(d, t, None, "k", "m") for d, t in rows], SCHEMA)
    return sorted(map(tuple, digest(remove_repeats(df, size, **more)).collect()), key=str)


@pytest.mark.parametrize("per_byte", [1.0, 0.0])
def test_equals_brute_force(spark, per_byte):
    rng = random.Random(7)
    vocabulary = ["a", "b", "É", "the", "The", "x y"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(6, 14))] for _ in range(6)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            own += rng.choice(passages) if rng.random() < 0.5 else [str(rng.random()) for _ in range(rng.randint(0, 12))]
        rows.append((d, rng.choice([" ", "\n", "\t \x0b"]).join(own)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "a " * 500), (None, "p q r s t u v w x y"), (None, "p q r s t u v w x z"), (3, rows[3][1])]
    assert run(spark, rows, 8, per_byte=per_byte) == sorted(brute.remove_repeats(rows, 8), key=str)


def test_empty_table(spark):
    assert run(spark, [], 35) == []


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, digest(remove_repeats(docs)).collect())) == sorted(brute.remove_repeats(rows, 35))
