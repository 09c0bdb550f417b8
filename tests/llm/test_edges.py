"""Every operator on null and repeated identifiers, very long texts and columns with names of the operators' own."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.llm import bpe, exact_dedup, fill_middle, fingerprints, licenses, mixing, ngram_join, pieces, quality, repeats, toxicity

draw = random.Random(3)
WORDS = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(3000)]
LONG = " ".join(draw.choice(WORDS) for _ in range(180_000))  # more than a megabyte
RUN = "a" * 300_000
TEXTS = [(None, "no identifier"), (None, "no identifier"), (1, LONG), (2, LONG + " more"), (3, RUN), (4, None), (5, ""), (6, " \t\n"), (7, "word " * 60_000), (7, "again under one identifier"), (8, "\x00\x1f🙂é　")]
SCHEMA = "doc_id long, text string, source string, id string, token string, node string, `row` string, file string, place string, hub string, `rank` string, body string, words string, n string, units string, `a.b` string, __part string"


def table(spark, parts=2):
    rows = [(i, t, None if i == 3 else "s", *(["x"] * 14)) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def run(name, docs, labels):
    return {
        "ngrams": lambda: ngram_join.similar_groups(docs), "exact": lambda: exact_dedup.decide(docs), "repeats": lambda: repeats.find_repeats(docs),
        "bpe": lambda: bpe.encode(docs, bpe.default_vocabulary()), "sketches": lambda: fingerprints.fingerprint(docs), "neighbours": lambda: fingerprints.compare_neighbours(docs).withColumnRenamed("id", "doc_id"),
        "toxicity": lambda: toxicity.score(docs, toxicity.fit(docs, labels)), "quality": lambda: quality.score(docs, quality.fit(docs, labels)),
        "licenses": lambda: licenses.scan(docs), "mix": lambda: mixing.mix(docs), "middle": lambda: fill_middle.fill_in_middle(docs), "pieces": lambda: pieces.encode(docs, pieces.default_model()),
    }[name]()


#: Operators that answer with a row for every row of the table.
EVERY = ["ngrams", "exact", "bpe", "sketches", "neighbours", "toxicity", "quality", "mix", "middle", "pieces"]


@pytest.mark.parametrize("name", [*EVERY, "repeats", "licenses"])
def test_rows_survive(spark, name):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    got = run(name, table(spark), labels).collect()
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    if name in EVERY:
        assert ids == sorted((i is not None, i or 0) for i, _ in TEXTS)
    else:
        assert {i for _, i in ids} <= {i or 0 for i, _ in TEXTS}


def test_long_texts_are_whole(spark):
    docs = table(spark).filter("doc_id in (1, 2, 3)")
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()}
    assert near[1][1] == near[2][1] == 1 and near[1][0] > 170_000 and near[3] == (1, 3)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, pieces.default_model()), pieces.default_model()).collect()}
    assert back == {1: LONG, 2: LONG + " more", 3: RUN}
    made = fill_middle.fill_in_middle(docs).select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert {r.doc_id: r.t for r in made} == back
