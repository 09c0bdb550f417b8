import random

import pytest

from sievework.llm import mixing

from .fixtures import SCHEMA, rows, table


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s] + 1e-9}
        if not full:
            out |= {s: level * weight[s] for s in free}
            break
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def corpus(n, seed=1):
    draw = random.Random(seed)
    sources = [f"s{k}" for k in range(7)] + [None, "Z", "é"]
    share = [2 ** (k % 6) for k in range(len(sources))]
    return [(i, " ".join(["w"] * int(draw.lognormvariate(4, 1))), None, draw.choices(sources, share)[0], None) for i in range(n)]


def test_targets_and_draw(spark):
    data = corpus(4000)
    got = mixing.mix(table(spark, data)).collect()
    assert len(got) == len(data)
    size = {i: len((t or "").split()) for i, t, *_ in data}
    sizes = {}
    for i, _, _, s, _ in data:
        sizes[s] = sizes.get(s, 0) + size[i]
    want, taken = plain_targets(sizes), {}
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.02)
    again = mixing.mix(table(spark, data[::-1])).collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in got}


def test_caps_are_reshared(spark):
    data = [(i, "w " * 10, None, s, None) for i, s in enumerate(["a"] * 100 + ["b"] * 2 + ["c"] * 3)]
    got = {r.source: r.target for r in mixing.mix(table(spark, data)).collect()}
    assert got == pytest.approx(plain_targets({"a": 1000, "b": 20, "c": 30}))
    assert got["b"] == 60 and got["c"] == 90


def test_take_and_edges(spark):
    docs = table(spark, rows(60))
    plan = mixing.mix(docs)
    out = mixing.take(docs, plan)
    assert out.columns == docs.columns
    assert out.count() == plan.groupBy().sum("copies").first()[0]
    assert mixing.mix(table(spark, [])).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "a", None)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


def test_rows_with_one_identifier_are_rows_of_their_own(spark):
    docs = spark.createDataFrame([(1, "w " * 10, "a", 7, "p"), (1, "v " * 10, "b", 8, "q"), (1, "v " * 10, "b", 8, "q"), (None, "u", None, None, "r")], "doc_id long, text string, source string, turn int, copies string")
    plan = spark.createDataFrame([(1, "a", 3, "w " * 10), (1, "b", 1, "v " * 10), (1, "b", 0, "v " * 10), (None, None, 2, "u")], "doc_id long, source string, copies long, t string")
    plan = plan.selectExpr("doc_id", "source", "copies", "xxhash64(t) AS mark")
    got = sorted((tuple(r) for r in mixing.take(docs, plan).collect()), key=str)
    assert got == sorted([(1, "w " * 10, "a", 7, "p")] * 3 + [(1, "v " * 10, "b", 8, "q")] + [(None, "u", None, None, "r")] * 2, key=str)


def test_one_offset_and_integer_boundaries(spark):
    """A plain walk along the line of one source gives the same copies."""
    data = corpus(600, seed=3)
    u = mixing.offset(mixing.SEED)
    got = {}
    for r in mixing.mix(table(spark, data)).collect():
        got.setdefault(r.source, []).append(r)
    for rs in got.values():
        rate = rs[0].target / rs[0].source_size
        assert sum(r.copies for r in rs) in {int(len(rs) * rate + u) + k for k in (-1, 0, 1)}
        assert all(int(rate) <= r.copies <= int(rate) + 1 for r in rs)
