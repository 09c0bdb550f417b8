"""States of parts against the profile of the whole."""

import pytest
from pyspark.sql import functions as F

from sievework.operators import incremental as inc
from sievework.operators.profile import profile

from .test_engine import hotel


def same(a, b):
    return a == b or abs(a - b) <= 0.011


def test_parts_are_the_whole(spark, tmp_path):
    df = hotel(spark, 600).withColumn("flag", F.col("lead_time") % 2 == 0).withColumn("none", F.lit(None).cast("double")).cache()
    for k in range(3):
        inc.add_batch(df.filter(F.col("_row_id") % 3 == k), str(tmp_path / "s"), f"b{k}")
    inc.add_batch(df.filter(F.col("_row_id") % 3 == 1), str(tmp_path / "s"), "b1")  # tried again: counts once
    parts = inc.states(spark, str(tmp_path / "s"))
    got = {r["column"]: r for r in inc.profile_of(parts).collect()}
    want = {r["column"]: r for r in profile(df).collect()}
    assert got.keys() == want.keys()
    for c, w in want.items():
        g = got[c]
        assert (g.dtype_detected, g.pct_missing, g.min, g.max) == (w.dtype_detected, w.pct_missing, w.min, w.max)
        assert (g.mean is None) == (w.mean is None) and (w.mean is None or same(g.mean, w.mean)) and (w.std is None or same(g.std, w.std))
        assert abs(g.n_unique - w.n_unique) <= 0.05 * w.n_unique + 1
        assert [tuple(v) for v in g.top_values or []][:1] == [tuple(v) for v in w.top_values or []][:1] or len(w.top_values) > 4 or w.top_values[0].n == w.top_values[1].n
    one = {r["column"]: r for r in inc.profile_of(inc.state(df)).collect()}
    assert all(one[c].n_unique == got[c].n_unique for c in one)
    exact = sorted(r.adr for r in df.collect())
    assert abs(got["adr"].median - exact[len(exact) // 2]) <= 0.02 * len(exact)


def test_more_batches_and_edges(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, `t.x` string")
    store = str(tmp_path / "s")
    inc.add_batch(df, store, "1")
    inc.add_batch(df.limit(0), store, "2")
    inc.add_batch(df.withColumn("more", F.lit(1.5)), store, "3")
    got = {r["column"]: r for r in inc.profile_of(inc.states(spark, store)).collect()}
    assert (got["n"].mean, got["n"].min, got["n"].pct_missing, got["n"].n_unique) == (1.5, 1.0, 0.0, 2)
    assert got["t.x"].pct_missing == 50.0 and [tuple(v) for v in got["t.x"].top_values] == [("a", 2)] and got["more"].mean == 1.5
    empty = inc.profile_of(inc.state(df.limit(0))).collect()
    assert all(r.pct_missing is None and r.n_unique == 0 for r in empty)
    with pytest.raises(ValueError):
        inc.add_batch(df, store, "a/b")
