"""The similarity join of names against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from skeinwork.functions.text import token_sort_ratio
from skeinwork.operators import names as N

rng = random.Random(8)
SYLLABLES = ["con", "fig", "ser", "ver", "ma", "in", "uti", "ls", "par", "ser", "da", "ta", "mo", "del", "re", "quest", "que", "ry", "lo", "ad", "ba", "se", "gra", "ph", "Ü", "ß", "x", "-"]


def name():
    return rng.choice([" ", "_", ""]).join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) + rng.choice([".py", ".py", ""])


def misspelled(s):
    s = list(s)
    for _ in range(rng.randint(1, 4)):
        at = rng.randrange(len(s) + 1)
        s[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "Z", " "])
    return "".join(s)


KNOWN = sorted({name() for _ in range(700)} | {"", " ", "aaaaaaaaaaaaaaaa", "a a a a"})
TYPED = sorted({misspelled(rng.choice(KNOWN)) for _ in range(60)} | {name() for _ in range(20)} | {"", "  ", "aaaaaaaaaaaa", "A A A A", KNOWN[5]})


@pytest.mark.parametrize("least", [70, 75, 90])
def test_join_loses_nothing(spark, least):
    known, typed = spark.createDataFrame([(n,) for n in KNOWN] + [(None,)], "name string"), spark.createDataFrame([(t,) for t in TYPED], "typed string")
    got = {r.typed: (r.name, r.score) for r in N.resolve(typed, known, least).collect()}
    assert set(got) == set(TYPED)
    for t in TYPED:
        score, best = max((round(token_sort_ratio(t, n), 6), n) for n in KNOWN)
        assert got[t] == ((t, 100.0) if t in KNOWN else (best, score) if score >= least else (None, None))
    pairs = N.survivors(typed, known.where("name is not null"), least).count()
    assert pairs < 0.05 * len(KNOWN) * len(TYPED)


def test_no_loop_over_pairs(spark):
    known, typed = spark.createDataFrame([(n,) for n in KNOWN], "name string"), spark.createDataFrame([(t,) for t in TYPED], "typed string")
    plan = N.resolve(typed, known)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_part_names(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select(F.col("p_name").alias("name"))
    typed = known.distinct().select(F.regexp_replace("name", "^(..).", "$1").alias("typed"))
    n = known.distinct().count()
    assert N.survivors(typed, known.distinct(), 75).count() < 0.05 * n * typed.count() + 2 * n
    assert N.resolve(typed, known, 75).where("name is null").isEmpty()
