"""Row numbers of frames of every kind."""

from pyspark.sql import functions as F

from sievework.operators import rows


def numbers(df):
    return sorted(r[rows.ROW] for r in rows.with_row_id(df).select(rows.ROW).collect())


def test_numbers_after_sorts_groups_and_joins(spark, tmp_path):
    spark.range(0, 5000, 1, 7).withColumn("k", F.col("id") % 911).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    frames = {
        5000: [t, t.orderBy(F.desc("id")), t.repartition(5, "k"), t.select("k"), t.join(t.select("id"), "id"), t.withColumn("_metadata", F.lit(1))],
        911: [t.groupBy("k").count(), t.select("k").distinct(), t.dropDuplicates(["k"])],
        2500: [t.filter("id % 2 = 0")], 10000: [t.unionByName(t), t.join(spark.range(2).withColumnRenamed("id", "c"), F.lit(True))], 0: [t.filter("id < 0"), t.limit(0)], 1: [t.agg(F.max("id"))],
    }
    for n, some in frames.items():
        for df in some:
            assert numbers(df) == list(range(n))


def test_sorted_frames_are_numbered_in_their_order(spark):
    df = rows.with_row_id(spark.range(0, 3000, 1, 6).orderBy(F.desc("id"))).collect()
    assert all(r.id == 2999 - r[rows.ROW] for r in df)


def test_numbers_are_the_same_each_time(spark, tmp_path):
    spark.range(0, 4000, 1, 9).withColumn("v", F.rand(1)).write.parquet(str(tmp_path / "t"))
    t = rows.with_row_id(spark.read.parquet(str(tmp_path / "t")))
    assert t.join(t.withColumnRenamed("v", "w"), rows.ROW).filter("v <> w").count() == 0


def test_located_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "`a.b` int, `_metadata` int")
    out = rows.located(df)
    assert out.columns == ["a.b", "_metadata", "file", "place"]
    assert sorted((r[0], r[1]) for r in out.collect()) == [(1, 2), (3, 4)]
