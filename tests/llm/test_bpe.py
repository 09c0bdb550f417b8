import hashlib

import pytest
from tokenizers import Tokenizer

from sievework.llm import bpe

from .fixtures import rows, table

HARD = ["", None, " ", "  a", "a  ", "it's we'll I'd 's'S", "tab\tend \n\n x y 　", "12³½ ٣ Ⅷ", "🙂🙂 é \x00\x1c\x1f\x85 z", "a<|endoftext|> b <|endoftext|>", "  <|endoftext|>  !<|endoftext|", "x" * 5000, " " * 3000, "漢字かな​交じり\r\n", "﻿'’s"]


def expected(data):
    t = Tokenizer.from_file(bpe.default_vocabulary())
    out = []
    for i, text, *_ in data:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((i, ids, t.decode(ids, skip_special_tokens=False)))
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("most", [0, 5, 1 << 18])
def test_like_the_library(spark, most):
    data = rows(60) + [(1000 + i, t, None, None, None) for i, t in enumerate(HARD)]
    tokens = bpe.encode(table(spark, data), bpe.default_vocabulary(), most_words=most)
    got = sorted(((r.doc_id, r.ids) for r in tokens.collect()), key=lambda r: r[0])
    want = expected(data)
    assert got == [(i, ids) for i, ids, _ in want]
    back = sorted((r.doc_id, r.text) for r in bpe.decode(tokens, bpe.default_vocabulary()).collect())
    assert back == [(i, t) for i, _, t in want]


def test_query(spark, tmp_path):
    data = rows(30)
    table(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in bpe.op5_bpe(spark, str(tmp_path)).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == [(i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(t.encode())) for i, ids, t in expected(data)]


def test_query_has_one_python_step(spark, tmp_path):
    """Ids are digested where they are made: a second step would be a second Python worker beside each, with a vocabulary of its own."""
    table(spark, rows(30)).write.parquet(f"{tmp_path}/documents.parquet")
    assert bpe.op5_bpe(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_empty_table(spark):
    assert bpe.encode(table(spark, []), bpe.default_vocabulary()).count() == 0


@pytest.mark.parametrize("words,size,all_", [(5, 1 << 20, False), (1000, 1 << 20, True), (0, 10, False), (1000, 50, False), (700, 1 << 20, False)])
def test_bound_of_the_travelling_table(spark, words, size, all_):
    """Counts far above and below a million; classes that do not fit are cut, not taken whole."""
    rows = [(f"w{i:03d}", n) for i, n in enumerate([2_000_000 + i for i in range(300)] + [1 << 40] * 300 + [2] * 300)]
    counted = spark.createDataFrame(rows, "word string, n long")
    kept = counted.filter(bpe.most_frequent(counted, words, size)).collect()
    assert len(kept) <= words and sum(len(r.word) for r in kept) <= size
    assert (len(kept) == 900) is all_
    if words == 700:
        assert len(kept) > 550 and sum(r.n == 1 << 40 for r in kept) == 300 and sum(2_000_000 <= r.n < 1 << 40 for r in kept) == 300
    if words == 5:
        assert all(r.n == 1 << 40 for r in kept)
