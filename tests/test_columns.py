"""Cleaning that looks at a whole column: many known values, evidence for date forms, reports of one pass, duplicates."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from sievework.operators import clean, nearest


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def misspelt(draw, word, n):
    for _ in range(n):
        i = draw.randrange(len(word) + 1)
        word = draw.choice([word[:i] + draw.choice("abcé") + word[i:], word[:i] + word[i + 1 :], word[:i] + draw.choice("abc") + word[i + 1 :]])
    return word


@pytest.mark.parametrize("distance,letters", [(1, 32), (2, 32), (2, 4), (3, 6)])
def test_nearest_like_all_pairs(spark, distance, letters):
    draw = random.Random(distance * 10 + letters)
    known = sorted({"".join(draw.choice("abcdé ") for _ in range(draw.randint(1, 12))).strip() for _ in range(150)} | {"Ab", "ab ", "long " * 10})
    values = [misspelt(draw, draw.choice(known), draw.randint(0, distance + 1)) for _ in range(200)] + ["", " AB ", "zzzzzzzzzzzz", None, known[3], "long " * 9 + "lon"]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "i int, v string, known string")
    got = {r.i: r.v for r in nearest.harmonise_known(df, "v", spark.createDataFrame([(k,) for k in known] + [(None,)], "k string"), distance, letters).collect()}
    own = {}
    for k in known:
        own.setdefault(k.strip().lower(), k)
    for i, v in enumerate(values):
        near = [] if v is None else [(edits(v.strip().lower(), o), k) for o, k in own.items()]
        want = min(near) if near else (99, None)
        assert got[i] == (want[1] if want[0] <= distance else v), v


def test_nearest_edges(spark):
    df = spark.createDataFrame([("a", 1)], "v string, n int")
    none = spark.createDataFrame([], "k string")
    assert nearest.harmonise_known(df, "v", none).collect() == df.collect()
    assert nearest.harmonise_known(df, "absent", none) is df
    assert nearest.harmonise_known(df.limit(0), "v", df.select("v")).count() == 0


def test_evidence(spark):
    rows = [("03/04/2015", "03/04/2015", "03/04/2015", None), ("03/25/2015", "25/03/2015", "2015-01-02", None), ("junk", "13/13/2015", "99/01/2015", None), ("25/03/2015", None, "", None), ("04/30/2015", "1/2/2015", "x", None)]
    df = spark.createDataFrame(rows, "m string, d string, even string, none string")
    found = {r["column"]: (r.day_first, r.month_first) for r in clean.date_evidence(df, ["m", "d", "even", "none", "absent"]).collect()}
    assert found == {"m": (1, 2), "d": (1, 0), "even": (0, 0), "none": (0, 0)}
    first = clean.unify_dates_by_evidence(df, ["m", "d", "even", "none"]).collect()
    assert first[0][:3] == ("2015-03-04", "2015-04-03", "2015-04-03") and first[3].m == "2015-03-25" and first[1].d == "2015-03-25" and first[2].m is None
    assert clean.date_evidence(df, []).count() == 0


def test_report_of_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "NA")], "n int, `t.x` string")
    cleaning = lambda d: clean.drop_missing_rows(d.dropDuplicates().withColumnRenamed("t.x", "t"), ["t"])
    group, tracker = uuid.uuid4().hex, spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, "one pass")
    try:
        made = clean.write_and_report(df, cleaning, lambda d: d.write.format("noop").mode("overwrite").save())
        jobs = tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setJobGroup("other", "")
    got = sorted((r.metric, r["column"] or "", r.value) for r in made.collect())
    assert got == [("null_after", "n", 0), ("null_before", "n", 0), ("rows_after", "", 2), ("rows_before", "", 4)]
    plain = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(plain, "write alone")
    cleaning(df).write.format("noop").mode("overwrite").save()
    alone = tracker.getJobIdsForGroup(plain)
    spark.sparkContext.setJobGroup("other", "")
    assert len(jobs) == len(alone) > 0


def test_duplicates_keep_a_row_that_was_there(spark):
    df = spark.createDataFrame([("x", 1, 9), ("x", 2, 3), ("y", None, 5), ("y", 4, 1)], "k string, a int, b int")
    assert sorted(map(tuple, clean.drop_duplicate_rows(df, ("a", "b")).collect())) == [("x", 1, 9), ("y", None, 5)]
    assert clean.drop_duplicate_rows(df.select("a"), ("a",)).count() == 1
    assert clean.drop_duplicate_rows(df.withColumn("n", F.lit(None).cast("int")), ("absent",)).count() == 4


def test_nearest_broadcasts_nothing_that_grows(spark):
    """Each value has dozens of entries, which the planner takes for one: what looks small to it is not."""
    df = spark.range(500).selectExpr("substr(md5(cast(id as string)), 1, 10) as v")
    out = nearest.harmonise_known(df, "v", df)
    assert out.count() == 500
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
