import hashlib
import re

from pyspark.sql import functions as F

from sievework.llm import exact_dedup, scratch

from .fixtures import rows, table


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def outright(data):
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(norm(t), []).append(i)
    seen, out = set(), []
    for i, t, *_ in data:
        g = groups[norm(t)]
        first = i == min(g) and (i, norm(t)) not in seen
        seen.add((i, norm(t)))
        out.append((i, min(g), len(g), first, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


def test_against_groups(spark):
    data = rows(90)
    docs = table(spark, data)
    decisions = exact_dedup.decide(docs)
    assert sorted(tuple(r) for r in decisions.collect()) == outright(data)
    kept = exact_dedup.keep_rows(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(r[0] for r in outright(data) if r[3])
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_by_bytes_gives_the_same(spark, tmp_path):
    data = rows(60)
    table(spark, data).write.parquet(f"{tmp_path}/d")
    base = exact_dedup.located(spark.read.parquet(f"{tmp_path}/d"), "doc_id", "text", f"{tmp_path}/rows")
    got = exact_dedup._by_bytes(base).select("id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(tuple(r) for r in got.collect()) == outright(data)


def test_a_later_batch_goes_on_with_the_state(spark, tmp_path):
    batches = [[(10, "a  b"), (11, "c"), (12, None)], [(20, "a b"), (21, "d"), (5, "c"), (22, "d ")], [(30, "d"), (31, ""), (32, "a\nb")]]
    seen = {}
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "doc_id long, text string").write.parquet(f"{tmp_path}/in{k}")
        docs = spark.read.parquet(f"{tmp_path}/in{k}")
        for i, t in batch:
            seen.setdefault(norm(t), []).append(i)
        want = sorted((i, min(seen[norm(t)]), len(seen[norm(t)]), i == min(seen[norm(t)])) for i, t in batch)
        for _ in range(2):  # run again, as after a failure
            got = exact_dedup.decide(docs, state=f"{tmp_path}/seen", batch=f"b{k}")
            assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want


def test_batches_that_are_no_files(spark, tmp_path):
    """Locators outlive the scratch folder, text columns may change their name, joined frames have rows of their own."""
    state = f"{tmp_path}/seen"
    first = spark.createDataFrame([(1, "a  b"), (2, "c"), (3, "only")], "doc_id long, body string")
    assert exact_dedup.decide(first, text_col="body", state=state, batch="x").filter("kept").count() == 3
    scratch._sweep()
    second = spark.createDataFrame([(4, "a b", 1), (5, "new", 1)], "doc_id long, text string, c1 long").join(spark.createDataFrame([(1,)], "c1 long"), "c1")
    for _ in range(2):
        got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decide(second, state=state, batch="y").collect())
        assert got == [(4, 1, 2, False), (5, 5, 1, True)]
        scratch._sweep()
    spark.createDataFrame([(6, "c"), (7, "new")], "doc_id long, `the text` string").write.parquet(f"{tmp_path}/in")
    got = exact_dedup.decide(spark.read.parquet(f"{tmp_path}/in").filter("doc_id > 0"), text_col="the text", state=state, batch="z").collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(6, 2, 2, False), (7, 5, 2, False)]


def test_long_texts(spark):
    long = "word  " * 400_000
    docs = spark.createDataFrame([(1, long), (2, long.replace("  ", "\n")), (3, long + "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.decide(docs).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_clashing_columns_and_one_digest_for_two_texts(spark, monkeypatch):
    data = [(i, f"text {i % 4}", "x", "y") for i in range(12)]
    docs = spark.createDataFrame(data, "doc_id long, text string, `row` string, file string")
    assert sorted(tuple(r) for r in exact_dedup.keep_rows(docs).collect()) == data[:4]
    monkeypatch.setattr(exact_dedup, "sha256_hex", lambda c: F.lit("ab" * 32))
    assert sorted(tuple(r) for r in exact_dedup.keep_rows(docs).collect()) == data[:4]


def test_null_identifier_and_empty_table(spark):
    data = [(None, "a  b", None, None, None), (3, "a b", None, None, None), (2, "c", None, None, None)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.decide(table(spark, data)).collect()}
    assert got == {None: (None, 2, True), 3: (None, 2, False), 2: (2, 1, True)}
    assert exact_dedup.decide(table(spark, [])).count() == 0
