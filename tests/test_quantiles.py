"""Exact selection and sketches against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import quantiles as Q


def interpolated(values, q):
    p = q * (len(values) - 1)
    a, b = values[math.floor(p)], values[math.ceil(p)]
    return float(a) if a == b else a + (b - a) * (p - math.floor(p))


def data(seed, n):
    draw = random.Random(seed)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, math.inf, -math.inf, 1.5, -1.5]
    return [(i, draw.choice(odd) if draw.random() < 0.2 else draw.gauss(0, 10 ** draw.randint(-300, 300)), draw.choice([None, draw.randint(-(2**63), 2**63 - 1), draw.randint(-3, 3)]), draw.randint(0, 5), 7, None if i % 3 else draw.random()) for i in range(n)]


@pytest.mark.parametrize("few", [1, 100, 1 << 14])
def test_like_sorted_lists(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "_FEW", few)
    rows = data(few, 1501)
    df = spark.createDataFrame(rows, "i int, `a.b` double, w long, small int, same short, part double")
    shares = [0.0, 0.25, 0.5, 0.731, 1.0]
    got = Q.quantiles(df, ["i", "a.b", "w", "small", "same", "part"], shares) if few > 1 else Q.quantiles(df, ["a.b", "w", "small"], shares)
    for c, k in (("i", 0), ("a.b", 1), ("w", 2), ("small", 3), ("same", 4), ("part", 5)):
        if c in got:
            values = sorted(r[k] for r in rows if r[k] is not None)
            want = [interpolated(values, q) for q in shares]
            assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got[c], want)), c


def test_passes_do_not_grow_with_the_rows_of_a_value(spark, monkeypatch):
    """Few values in many rows: a bucket of one value is done, although it has more rows than a last pass would bring."""
    monkeypatch.setattr(Q, "_FEW", 10)
    df = spark.range(20000).selectExpr("cast(id % 50 + 1 as double) as a", "(id % 11) / 100.0 as b")
    passes, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: passes.append(1) or plain(self, *a, **k))
    assert Q.quantiles(df, ["a", "b"], [0.0, 0.5, 1.0]) == {"a": [1.0, 25.5, 50.0], "b": [0.0, 0.05, 0.1]}
    assert 1 <= len(passes) <= 2


def test_edges(spark):
    df = spark.createDataFrame([(None, 1.0, True), (None, math.nan, False)], "a double, b double, c boolean")
    got = Q.quantiles(df, ["a", "b", "c"], [0.0, 1.0])
    assert got["a"] == [None, None] and got["c"] == [0.0, 1.0] and got["b"][0] == 1.0 and math.isnan(got["b"][1])
    assert Q.quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
    assert Q.quantiles(df, [], [0.5]) == {}
    with pytest.raises(ValueError):
        Q.quantiles(df, ["b"], [1.5])
    with pytest.raises(ValueError):
        Q.order_statistics(df, {"b": [2]})


def test_sketches_of_files_merge(spark, tmp_path):
    draw = random.Random(4)
    rows = [(draw.lognormvariate(0, 2), draw.randint(0, 1000)) for _ in range(40000)]
    spark.createDataFrame(rows, "x double, n int").repartition(7).write.parquet(str(tmp_path / "t"))
    sketches = Q.sketch(spark.read.parquet(str(tmp_path / "t")), ["x", "n"])
    assert sketches.count() == 14
    sketches.write.parquet(str(tmp_path / "s"))
    shares = [0.01, 0.25, 0.5, 0.9, 0.99]
    for r in Q.merged_quantiles(spark.read.parquet(str(tmp_path / "s")), shares).collect():
        values = sorted(row[0 if r["column"] == "x" else 1] for row in rows)
        below, at_most = (sum(f(v) for v in values) / len(values) for f in (lambda v: v < r.value, lambda v: v <= r.value))  # noqa: B023
        assert r.n == 40000 and below - 0.01 <= r.share <= at_most + 0.01
    nothing = Q.sketch(spark.createDataFrame([], "g int, x double"), ["x"], by=["g"])
    assert Q.merged_quantiles(nothing, [0.5]).count() == 0
    assert Q.sketch(spark.createDataFrame([(1, None), (1, 2.0), (2, None)], "g int, x double"), ["x"], by=["g"]).filter(F.col("sketch").isNotNull()).count() >= 1
