import itertools
import random

import numpy as np
import pytest

from sievework.llm import ngram_join

from .fixtures import rows, table


def outright(data, words, low, high=100):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t, *_ in data]
    ids = [i for i, *_ in data]
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if sets[a] and sets[b] and high * len(sets[a] & sets[b]) >= low * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(sets[k]), least[root(k)]) for k, i in enumerate(ids))


@pytest.mark.parametrize(("words", "low", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_against_all_pairs(spark, words, low, seed):
    data = rows(150, seed=seed)
    got = sorted(tuple(r) for r in ngram_join.similar_groups(table(spark, data), words=words, low=low).collect())
    assert got == outright(data, words, low)


@pytest.mark.parametrize(("low", "high"), [(90, 100), (80, 100), (60, 100), (95, 100)])
def test_similar_sets_share_a_token(low, high):
    draw = np.random.default_rng(low)
    for n in [*range(1, 70), 100, 127, 128, 129, 255, 256, 500, 1000, 4000]:
        base = draw.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        for _ in range(6):
            # the other set as far away as it may be, by removals, additions or both
            gone = int(draw.integers(0, n * (high - low) // high + 1))
            new = 0
            while high * (n - gone) >= low * (n + new + 1):
                new += 1
            new = int(draw.integers(0, new + 1)) if draw.random() < 0.3 else new
            other = np.concatenate([base[draw.permutation(n)[gone:]], draw.integers(0, 1 << 63, new).astype(np.uint64) * np.uint64(2) + np.uint64(1)])
            if not len(other) or high * (n - gone) < low * (n + new):
                continue
            with np.errstate(over="ignore"):
                token, owner = ngram_join.segments([np.unique(base), np.unique(other)], low, high)
            assert set(token[owner == 0].tolist()) & set(token[owner == 1].tolist()), (n, gone, new)


@pytest.mark.parametrize("copies", [0, 2, 1 << 20])
def test_large_group_without_a_common_neighbour(spark, monkeypatch, copies):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "COPIES", copies)
    base = [f"w{i}" for i in range(60)]
    data = [(i, " ".join(w if (7 * i + k) % 60 > 5 else f"x{i}_{k}" for k, w in enumerate(base)), "en", "s", 1) for i in range(90)]
    data += [(200 + i, " ".join([*base[: 50 - i], *(f"y{k}" for k in range(i))]), "en", "s", 1) for i in range(12)]
    for low in (60, 75):
        got = sorted(tuple(r) for r in ngram_join.similar_groups(table(spark, data), words=1, low=low).collect())
        assert got == outright(data, 1, low)


def test_pages_of_a_template_make_no_square(spark):
    """Two thirds of the words shared, little linked: rows of blocks grow with the pages, not with their square."""
    seen, plain = {}, ngram_join._links
    try:
        for n in (600, 1200, 2400):
            ngram_join._links = lambda blocks, *a: seen.update({n: seen.get(n, 0) + blocks.count()}) or plain(blocks, *a)  # noqa: B023
            data = [(i, " ".join([*(f"t{k}" for k in range(80)), *(f"p{i}_{k}" for k in range(40))]), "en", "s", 1) for i in range(n)]
            data += [(5000 + i, " ".join([*(f"t{k}" for k in range(80)), *(f"p{i}_{k}" for k in range(39)), "new"]), "en", "s", 1) for i in range(5)]
            got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(table(spark, data), words=5, low=80).collect()}
            assert got == {i: i for i in range(n)} | {5000 + i: i for i in range(5)}
    finally:
        ngram_join._links = plain
    assert seen[1200] <= 2.2 * seen[600] and seen[2400] <= 2.2 * seen[1200], seen


def test_ngrams_of_a_template_make_no_rows_for_each_page(spark, monkeypatch):
    """Of n-grams that very many pages share only what is handed on becomes rows, not one for each page."""
    monkeypatch.setattr(ngram_join, "SHARE", 0)
    n, shared, own = 1200, 160, 30
    data = [(i, " ".join([*(f"t{k}" for k in range(shared)), *(f"p{i}_{k}" for k in range(own))]), "en", "s", 1) for i in range(n)]
    data += [(5000 + i, " ".join([*(f"t{k}" for k in range(shared)), *(f"p{i}_{k}" for k in range(own - 1)), "new"]), "en", "s", 1) for i in range(5)]
    written, write = {}, ngram_join.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join.Scratch, "write", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(table(spark, data), words=1, low=90).collect()}
    assert got == {i: i for i in range(n)} | {5000 + i: i for i in range(5)}
    assert "rare" in written
    assert written["grams"] <= 1.2 * n * own, written


@pytest.mark.parametrize("frequent", [1, 20, 1 << 16])
def test_rarest_ngrams_whatever_travels(spark, monkeypatch, frequent):
    """The same n-grams are handed on with any table of frequent ones: a plain count gives them too."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    draw = random.Random(frequent)
    sets = {k - 30: sorted({int(draw.paretovariate(0.5)) - 40 for _ in range(draw.randint(1, 40))}) for k in range(60)}
    outside = {k: draw.random() < 0.3 for k in sets}
    arrays = spark.createDataFrame([(k, len(x), np.array(x, np.int64).tobytes()) for k, x in sets.items()], "node long, n long, grams binary")
    unsettled = spark.createDataFrame(list(outside.items()), "node long, outside boolean")
    got = sorted(map(tuple, ngram_join._rare_members(unsettled, arrays.repartition(3), 80, 100, ngram_join.Scratch(spark, "rarest")).collect()))
    met = {t: sum(t in x for x in sets.values()) for x in sets.values() for t in x}
    want = []
    for k, x in sets.items():
        rarest = sorted(x, key=lambda t: (met[t], t))[: len(x) - -(-len(x) * 80 // 100) + 1]
        want += [(t, k) for t in rarest if met[t] > 1 and any(outside[j] for j, y in sets.items() if t in y)]
    assert got == sorted(want)


def test_null_and_repeated_identifiers_and_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    data = [(None, text, "en", "s", 1), (4, text + " more", "en", "s", 1), (4, text + " more", "en", "s", 1), (4, "something else entirely here", "en", "s", 1), (9, None, "en", "s", 1)]
    docs = table(spark, data).withColumnRenamed("lang", "node").withColumnRenamed("source", "hub").withColumnRenamed("n_chars", "root")
    got = sorted((tuple(r) for r in ngram_join.similar_groups(docs, words=3, low=80).collect()), key=str)
    assert got == sorted([(None, 28, None), (4, 29, None), (4, 29, None), (4, 2, 4), (9, 0, 9)], key=str)


def test_small_blocks_and_fragments(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "FRAGMENT", 7)
    base = " ".join(f"w{i}" for i in range(40)).split()
    data = []
    for i in range(60):  # a chain of small edits: many nodes near each other, few linked
        w = list(base)
        for k in range(i % 7):
            w[(5 * k + i) % 40] = f"x{i}{k}"
        data.append((i, " ".join(w), "en", "s", 1))
    got = sorted(tuple(r) for r in ngram_join.similar_groups(table(spark, data), words=2, low=70).collect())
    assert got == outright(data, 2, 70)


def test_empty_table(spark):
    assert ngram_join.similar_groups(table(spark, [])).count() == 0


def test_small_open_groups_are_compared_at_once(spark, monkeypatch):
    """A group of several blocks that is open and wide, but small beside the table, is not grouped anew, which is a dozen passes more."""
    draw = random.Random(3)
    page = [f"p{i}" for i in range(12)]
    pages = [" ".join(page + [f"n{k}x{draw.randint(0, 10**9)}"]) for k in range(80)]
    data = [(i, t, None, None, None) for i, t in enumerate(pages + [f"a{k} b{k} c{k} d{k}" for k in range(4000)])]
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    written, write = [], ngram_join.Scratch.write
    monkeypatch.setattr(ngram_join.Scratch, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(table(spark, data), words=3, low=95).collect()}
    assert got == {i: i for i in range(len(data))}
    assert "rare" not in written
