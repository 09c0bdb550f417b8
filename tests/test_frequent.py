"""Frequent values against plain counting."""

import random
from collections import Counter

import pytest

from sievework.operators import clean, frequent, profile


def best(values, n):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0].encode()))[:n]


def data(n=6000):
    draw = random.Random(2)
    return [(i, draw.choice("abc"), f"k{i:05d}", f"z{int(draw.paretovariate(0.6)) % 5000}", None, draw.choice([None, "é", "e"]), f"t{i % 4}") for i in range(n)]


@pytest.mark.parametrize("tracked", [16, 64, 10_000])
def test_like_counting(spark, tracked):
    rows = data()
    df = spark.createDataFrame(rows, "i int, few string, key string, `long.tail` string, none string, holes string, tied string").repartition(5)
    names = ["few", "key", "long.tail", "none", "holes", "tied"]
    got = {c: [] for c in names}
    for r in sorted(frequent.top_values(df, names, 3, tracked).collect(), key=lambda r: r["rank"]):
        assert names[r["place"]] == r["column"]
        got[r["column"]].append((r["value"], r["n"]))
    assert got == {c: best([r[k + 1] for r in rows], 3) for k, c in enumerate(names)}


def test_keys_are_counted_in_full_and_skewed_columns_are_not(spark):
    df = spark.createDataFrame(data(), "i int, few string, key string, tail string, none string, holes string, tied string")
    known, unsure = frequent.survivors(df, ["few", "key", "tail", "none", "tied"], 3)
    assert unsure == ["key"] and known["none"] == [] and len(known["tail"]) == 3


def test_modes(spark):
    df = spark.createDataFrame([(1, "b", 10, "x"), (2, "a", 10, "y"), (3, None, None, None), (4, None, 9, None), (5, "c", 9, "z")], "i int, s string, n int, k string")
    got = [tuple(r) for r in clean.fill_mode(df, ["s", "n", "k", "absent"]).orderBy("i").collect()]
    assert got == [(1, "b", 10, "x"), (2, "a", 10, "y"), (3, "a", 9, "x"), (4, "a", 9, "x"), (5, "c", 9, "z")]
    assert clean.fill_mode(df.filter("i = 3"), ["s"]).first().s is None
    assert profile.top_values(df.limit(0), ["s"]).count() == 0
