import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from sievework.llm import bpe, mixing

from .fixtures import SCHEMA
from .test_ngram_join import outright as near_groups


def corpus():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("aeioubcdlmnrst") for _ in range(draw.randint(2, 8))) for _ in range(500)]
    docs, labels, texts = [], [], []
    for i in range(400):
        w = [draw.choice(vocabulary) for _ in range(draw.randint(30, 80))]
        if i % 7 == 0:
            for _ in range(4):
                w[draw.randrange(len(w))] = "snarkwort"
        text = " ".join(w)
        if i % 10 == 3:
            text = draw.choice(texts).replace(" ", "\n", 2)
        elif i % 10 == 4:
            w = draw.choice(texts).split()
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        texts.append(text)
        docs.append((i, text if i != 20 else None, "en", f"s{i % 3}" if i % 11 else None, len(text)))
        labels.append((i, 1, int("snarkwort" in text)))
    return docs, labels


def test_every_stage_against_a_plain_computation(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {d[0]: d for d in docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        out = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert out.columns == now.columns, name
        if k == 0:
            kept = {i: d for i, d in kept.items() if "snarkwort" not in (d[1] or "")}
        elif k == 1:
            first = {}
            for i, d in kept.items():
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", d[1] or ""), i)
            kept = {i: kept[i] for i in first.values()}
        elif k == 2:
            kept = {i: kept[i] for i, _, c in near_groups(list(kept.values()), 5, 80) if i == c}
        if k < 3:
            assert sorted(tuple(r) for r in out.collect()) == sorted(kept.values()), name
        elif k == 3:
            copies = {r.doc_id: r.copies for r in mixing.mix(now).collect()}
            mixed = [r.doc_id for r in out.collect()]
            assert sorted(mixed) == sorted(i for i, c in copies.items() for _ in range(c)) and 0 < len(mixed)
        else:
            t = Tokenizer.from_file(bpe.default_vocabulary())
            want = sorted((i, t.encode(kept[i][1] or "", add_special_tokens=False).ids) for i in mixed)
            assert sorted((r.doc_id, r.ids) for r in out.collect()) == want
        now = out
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((i, len(x)) for i, x in want)


def test_near_copies_that_share_an_identifier(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:-1] + ["other"])
    docs = [(5, " ".join(words), "en", "s", 1), (5, near, "en", "s", 1), (None, near + " more", "en", "s", 1), (5, "quite another text, and clean", "en", "s", 1), (7, None, "en", "s", 1), (7, None, "en", "s", 1)]
    spark.createDataFrame(docs, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/d")
    kept = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, near + " more"), (5, "quite another text, and clean"), (7, ""), (7, "")]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
