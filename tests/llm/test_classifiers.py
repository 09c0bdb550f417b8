import random
import zlib

import numpy as np
import pytest

from sievework.llm import quality, toxicity

from .fixtures import SCHEMA, table

BAD = ["grumblefish", "snarkwort"]


def corpus(n=600, seed=1):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("aeioubcdlmnrst") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [draw.choice(vocabulary) for _ in range(draw.randint(20, 80))]
        toxic, poor = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(3):
                w[draw.randrange(len(w))] = draw.choice(BAD) + draw.choice(["", "s"])
        if poor:
            w = [f"{x}!!" for x in w]
        docs.append((i, " ".join(w), None, None, None))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


def frames(spark):
    docs, labels = corpus()
    return table(spark, docs), spark.createDataFrame([*labels, (9999, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), labels


def test_held_out_rule(spark):
    ids = list(range(50)) + [None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(toxicity.held_out("doc_id").alias("h")).collect()
    assert [r.h for r in got] == [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


def test_toxicity(spark):
    docs, labels, truth = frames(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, _, t in truth)
    extra = [(1, "a grumblefsh snarkwrot and grumbelfish you are snarkwort", None, None, None), (2, None, None, None, None), (3, "", None, None, None), (4, "plain words only " * 2000, None, None, None)]
    s = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(extra, SCHEMA), model).collect()}
    assert s[1] > s[2] == s[3] and s[4] < 0.5
    kept = toxicity.below(docs.withColumnRenamed("source", "row").withColumnRenamed("lang", "words"), model, 0.5)
    assert kept.columns == ["doc_id", "text", "words", "row", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, t in truth if not t]
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("share", [0.33, 0.5, 0.8])
def test_toxicity_at_high_shares_of_toxic_labels(spark, share):
    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("aeioubcdlmnrst") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        w = [draw.choice(vocabulary) for _ in range(40)]
        toxic = int(i < share * 600)
        if toxic:
            w[draw.randrange(40)] = draw.choice(BAD)
        docs.append((i, " ".join(w), None, None, None))
        labels.append((i, 1, toxic))
    docs = table(spark, docs)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, _, t in labels)


def test_copies_of_a_toxic_text_count_once(spark):
    docs, labels, truth = frames(spark)
    same = "one odd text is here a thousand times"
    many = docs.union(table(spark, [(10_000 + i, same.replace(" ", "  ", i % 3), None, None, None) for i in range(1000)]))
    more = labels.union(spark.createDataFrame([(10_000 + i, 1, 1) for i in range(1000)], labels.schema))
    one, all_copies = toxicity.fit(many.filter("doc_id <= 10000"), more), toxicity.fit(many, more)
    assert one.terms == all_copies.terms and not any(same.split()[k].startswith(t) for t in one.terms for k in range(8))
    got = {r.doc_id: r.score for r in toxicity.score(docs, all_copies).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, _, t in truth)


def test_nothing_is_rejected_if_all_labels_are_toxic(spark):
    docs, labels, _ = frames(spark)
    assert toxicity.score(docs, toxicity.fit(docs, labels.selectExpr("doc_id", "quality", "1 AS toxic"))).filter("score >= 0.5").count() == 0


def test_words_and_contexts():
    m = toxicity.Model(["grumble", "stupid"], [False, True], [0.99, 0.99])
    found = {w: m.matcher().word(w) for w in ("grumble", "grumbled", "grumbel", "grmble", "stupids", "stupd", "stupidity", "humble", "gr")}
    assert found["grumble"] == found["grumbled"] == (0, False)
    assert found["grumbel"] == found["grmble"] == (0, True)
    assert found["stupids"] == found["stupd"] == (1, True)
    assert found["stupidity"][0] == found["humble"][0] == found["gr"][0] == -1
    plain, quoted = toxicity.spans("you are stupid".split(), m), toxicity.spans("the word \" stupid \" is".split(), m)
    assert not plain[0][3] and quoted[0][3]


def test_an_edit_at_any_letter(spark):
    m = toxicity.Model(["idiot", "moron", "stupid", "scum"], [True] * 4, [0.99] * 4)
    text = "1diot diot omron xstupid $tupid *diot xidiot stupi! scm sxum stupid! **moron**"
    words = table(spark, [(1, text, None, None, None)]).select(toxicity.tokens("text").alias("w")).first().w
    assert words == text.split()
    assert [(m.terms[k], wrong) for k, wrong in map(m.matcher().word, words)] == [(t, True) for t in "idiot idiot moron stupid stupid idiot idiot stupid scum scum".split()] + [("stupid", False), ("moron", False)]


def test_ordinary_words_near_a_term_give_no_hits(spark):
    docs, labels, truth = frames(spark)
    clean = [(20_000 + i, f"the rumblefish number{i} swims", None, None, None) for i in range(40)]
    model = toxicity.fit(docs.union(table(spark, clean)), labels.union(spark.createDataFrame([(d[0], 1, 0) for d in clean], labels.schema)))
    assert [bool(toxicity.spans([w], model)) for w in ("grumblefish", "xgrumblefish", "rgumblefish", "rumblefish")] == [True, True, True, False]


def test_without_labels(spark):
    docs, labels, _ = frames(spark)
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).filter("score > 0.2").count() == 0
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).filter("score = 0.5").count() == docs.count()


def test_quality(spark):
    docs, labels, truth = frames(spark)
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(i, q) for i, q, _ in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == bool(q) for i, q in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None), (3, "\n\n", None, None, None), (4, "x" * 100_000, None, None, None)], SCHEMA)
    s = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert s[1] == s[2] and all(0 <= x <= 1 for x in s.values())
    assert quality.score(docs.limit(0), model).count() == 0


def test_trees_walk_like_a_plain_walk():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(500, len(quality.NAMES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality.grow(x, y, trees=20)
    p = t.predict(x)
    assert ((p > 0.5) == y).mean() > 0.95
    for row, want in zip(x[:40], p[:40]):
        total = t.start
        for at in t.roots:
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
            total += t.value[at]
        assert abs(1 / (1 + np.exp(-total)) - want) < 1e-12


def test_statistics_of_one_text():
    text = "Ab cd. ab\n\nab cd!\n".encode()
    s = dict(zip(quality.NAMES, quality.statistics(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]))
    assert s["lines"] == np.log1p(2) and s["words"] == np.log1p(5) and s["line_words"] == 2.5
    assert s["upper"] == 1 / len(text) and s["distinct_words"] == 4 / 5 and s["marked_words"] == 1 / 5 and s["upper_words"] == 1 / 5
