"""Reading CSV in splits or as whole files."""

from sievework.sources import tables


def test_breaks_decide_how_a_csv_is_read(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(3000)]
    tables.write_csv(spark.createDataFrame(rows, "i long, v string"), str(tmp_path / "plain"), single=True)
    tables.write_csv(spark.createDataFrame([*rows, (3000, 'a "quoted"\nline\r\nand more'), (3001, '"'), (3002, "x,\r")], "i long, v string"), str(tmp_path / "broken"))
    assert not tables.has_breaks_in_cells(spark, str(tmp_path / "plain"))
    assert tables.has_breaks_in_cells(spark, str(tmp_path / "broken"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        plain = tables.read_csv(spark, str(tmp_path / "plain"))
        assert plain.rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.i, r.v) for r in plain.collect()) == rows
    back = {r.i: r.v for r in tables.read_csv(spark, str(tmp_path / "broken")).collect()}
    assert len(back) == 3003 and back[3000] == 'a "quoted"\nline\r\nand more' and back[3001] == '"'


def test_empty_csv(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([], "i long, v string"), str(tmp_path / "t"))
    assert tables.read_csv(spark, str(tmp_path / "t")).count() == 0
