import hashlib

from pyspark.sql import functions as F

from sievework.llm import fingerprints as fp

from .fixtures import rows, table


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(data, got, k):
    order = sorted((i, t or "") for i, t, *_ in data)
    assert len(got) == len(order)
    seen = {}
    for (i, t), r in zip(order, sorted(got, key=lambda r: (r.doc_id, r.n_chars)), strict=True):
        assert (r.doc_id, r.n_chars) == (i, len(t))
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
    for n, (i, t) in enumerate(order):
        nxt = order[(n + 1) % len(order)][1]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + nxt[:cut]
        r = next(x for x in got if x.doc_id == i)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(nxt)
        exact = max(len(a | b), len(a | c)) <= k
        assert abs(r.near_edited - jaccard(a, b)) < (1e-9 if exact else 0.2)
        assert abs(r.near_next - jaccard(a, c)) < (1e-9 if exact else 0.2)


def test_query_against_sets(spark, tmp_path, monkeypatch):
    data = rows(90)[:-1]
    table(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    check(data, fp.op6_fingerprints(spark, str(tmp_path)).collect(), fp.K)


def test_many_parts(spark):
    data = rows(90)[:-1]
    placed, parts = fp.in_order(table(spark, data).select(F.col("doc_id").alias("id"), "text"), "id", rows_per_part=7)
    assert parts > 5
    assert placed.filter("__guest = 0").count() == len(data) and placed.filter("__guest = 1").count() == parts


def test_merge_containment_and_count(spark):
    a = " ".join(f"a{i}" for i in range(1000))
    b = " ".join(f"a{i}" for i in range(500))
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string")
    s = df.select(*(fp.sketch(fp.shingle_hashes(F.col(c))).alias(c) for c in "abc"))
    r = s.select(fp.containment(F.col("b"), F.col("a")).alias("ba"), fp.resemblance(F.col("a"), F.col("b")).alias("ab"), fp.distinct_count(F.col("a")).alias("n"), fp.resemblance(fp.merge(F.col("a"), F.col("b")), F.col("a")).alias("m")).first()
    assert r.ba > 0.9 and abs(r.ab - 0.5) < 0.15 and abs(r.n - 996) < 200 and r.m == 1.0


def test_edges(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert fp.op6_fingerprints(spark, f"{tmp_path}/e").count() == 0
    table(spark, [(1, "a b", None, None, None)]).write.parquet(f"{tmp_path}/s/documents.parquet")
    assert fp.op6_fingerprints(spark, f"{tmp_path}/s").first().near_next == 1.0
    table(spark, [(None, "x", None, None, None), (1, None, None, None, None), (1, "", None, None, None)]).write.parquet(f"{tmp_path}/n/documents.parquet")
    assert fp.op6_fingerprints(spark, f"{tmp_path}/n").count() == 3
