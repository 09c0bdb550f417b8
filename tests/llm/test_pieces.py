import hashlib
import random

import pytest
from sentencepiece import SentencePieceProcessor

from sievework.llm import pieces

from .fixtures import rows, table

HARD = ["", None, " ", "  a  b ", "\t\n a", "a▁b", "▁▁ ▁a", "ﬁ Ａ １ é́", "\x00x\x1f", "<s>hi</s> <0x41> <unk>", "　x​", "🙂漢字", "�﻿", "a\r\nb", "x" * 5000, " " * 3000, "a" + " " * 77 + "漢", "trans" * 900, "\n" * 500, "long words " * 20000]


def library():
    return SentencePieceProcessor(model_file=pieces.default_model())


def test_arrays_like_the_library():
    model, lib = pieces.PieceModel(pieces.default_model()), library()
    draw = random.Random(7)
    texts = ["".join(draw.choice("abcdeghinorst ▁\n.,'é漢🙂") for _ in range(draw.randint(0, 200))) for _ in range(800)]
    texts += ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(0, 300))) for _ in range(300)]
    texts += [" " * k + "x" * (k % 3) for k in range(130)]
    ids, counts = model.encode(texts)
    end = counts.cumsum().tolist()
    got = [ids[e - c : e].tolist() for e, c in zip(end, counts.tolist())]
    assert got == lib.encode(texts, num_threads=1)
    assert [model.decode(ids[e - c : e]) for e, c in zip(end, counts.tolist())] == lib.decode(got)


def test_frames_like_the_library(spark):
    data = rows(60) + [(1000 + i, t, None, None, None) for i, t in enumerate(HARD)] + [(None, "no id", None, None, None)]
    docs = table(spark, data).withColumnRenamed("lang", "ids").withColumnRenamed("source", "id")
    tokens = pieces.encode(docs, pieces.default_model())
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted(((r.doc_id, r.ids) for r in tokens.collect()), key=key)
    want = sorted(((i, library().encode(t or "")) for i, t, *_ in data), key=key)
    assert got == want
    back = sorted(((r.doc_id, r.body) for r in pieces.decode(tokens, pieces.default_model(), text_col="body").collect()), key=key)
    assert back == [(i, library().decode(ids)) for i, ids in want]


def test_query(spark, tmp_path):
    data = rows(30)
    table(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in pieces.op13_sentencepiece(spark, str(tmp_path)).collect())
    want = []
    for i, t, *_ in data:
        ids = library().encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library().decode(ids).encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_table_and_unknown_ids(spark):
    assert pieces.encode(table(spark, []), pieces.default_model()).count() == 0
    model = pieces.PieceModel(pieces.default_model())
    with pytest.raises(ValueError):
        model.decode(__import__("numpy").array([40000]))
