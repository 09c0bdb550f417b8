"""Exact deduplication by stateful streaming with keyed state that never expires.

Every document is reduced to (digest, stable identifier, content locator); the locator is the file and the row in it. That
narrow log is a stream; a keyed streaming aggregation over RocksDB state keeps, for each digest ever seen, the smallest
identifier with its locator and the number of rows. The texts under each digest are then compared byte by byte, with those
that the locators of earlier batches lead to as well.

With a folder for the state it outlives the process, and later batches are judged against all that was seen before; rows of
frames that read no files are kept there too, so that locators lead somewhere.

Defined cases: a null text is an empty text; texts are equal if identical after each run of ASCII white space became one
blank; a null identifier sorts before all others, as Spark orders nulls; of repeated identical rows with one identifier
exactly one is kept; an empty table gives an empty result; further columns of the input, whatever their names, do not
matter. A frame that does not read files directly is written once, so that its rows have locators. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import located as placed
from .scratch import Scratch
from .text import SPACE, sha256_hex, whole

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": _PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space laid out ahead
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(whole(text), SPACE, " ")


def located(docs: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """id, text, row (all columns of docs), and the locator: file, place. What is no scan of files is written to folder first."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)))
    return placed(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), row.alias("row")), folder=folder)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def keyed_state(spark: SparkSession, folder: str, log_schema: T.StructType, log_path: str) -> DataFrame:
    """Run what is new in folder/log through the keyed state; per digest of the batch: first (id, file, place) and n, over all batches.

    What the state gives out are the digests that were touched, so a batch reads no more than that; only one that is run again looks
    through what earlier runs gave out.
    """
    touched: list[int] = []
    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        first = F.min(F.struct("id", "file", "place"))
        stream = spark.readStream.schema(log_schema).parquet(f"{folder}/log/*").groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))

        def keep(batch: DataFrame, number: int) -> None:
            touched.append(number)
            batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/state/batch={number}")

        run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(keep).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    id_type = log_schema["id"].dataType.simpleString()
    kind = f"digest binary, first struct<id:{id_type},file:string,place:long>, n long"
    if not _exists(spark, f"{folder}/state"):  # an empty log starts no batch
        return spark.createDataFrame([], kind)
    # A digest that several runs touched has one row for each; the identifier only falls and the count only grows.
    given = spark.read.schema(kind).option("basePath", f"{folder}/state").parquet(*([f"{folder}/state/batch={k}" for k in touched] or [f"{folder}/state"]))
    if not touched:
        given = given.join(spark.read.schema(log_schema).parquet(log_path).select("digest"), "digest", "left_semi")
    return given.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))


def _decide(base: DataFrame, scratch: Scratch, text_col: str, state: str | None, batch: str) -> DataFrame:
    """id, file, place, keep_id, group_size, kept, text_sha256 for every row of base."""
    spark, folder = base.sparkSession, state or scratch.path("seen")
    digest = F.unhex(sha256_hex(normalised(F.col("text"))))
    kind = T.StructType([T.StructField("digest", T.BinaryType()), base.schema["id"], base.schema["file"], base.schema["place"]])
    log_path = f"{folder}/log/{batch}"
    if not _exists(spark, f"{log_path}/_SUCCESS"):  # a batch that was tried before is not counted twice
        base.select(digest.alias("digest"), "id", "file", "place").write.mode("overwrite").option("compression", "zstd").parquet(log_path)
    seen = scratch.write(keyed_state(spark, folder, kind, log_path), "groups")
    members = spark.read.schema(kind).parquet(log_path).join(seen, "digest")

    # The bytes of all texts under one digest: the least and the greatest are the same if all are. Map tasks reduce copies first.
    bodies = base.select(digest.alias("digest"), normalised(F.col("text")).alias("body"))
    if state:
        # Where this batch's texts stand, for later ones: files, and the column that has the text.
        column = "c1" if base.select("file").limit(1).filter(F.contains("file", F.lit(f"{state}/rows/{batch}/"))).count() else text_col
        files = base.select("file").distinct().withColumn("text_col", F.lit(column))
        files.write.mode("overwrite").parquet(f"{folder}/files/{batch}")
        earlier = members.select("digest", "first.file", "first.place").join(files.select("file"), "file", "left_anti").distinct()
        known = spark.read.schema("file string, text_col string").parquet(f"{folder}/files/*").distinct()
        hit = earlier.select("file").distinct().join(known, "file").groupBy("text_col").agg(F.collect_set("file").alias("files")).collect()  # names of files, not documents
        for r in hit:
            fetched = spark.read.parquet(*r.files).select(F.col(f"`{r.text_col}`").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
            bodies = bodies.unionByName(fetched.join(earlier, ["file", "place"]).select("digest", normalised(F.col("text")).alias("body")))
    odd = bodies.groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a <> b").select("digest")
    odd = scratch.write(odd, "odd")
    if not odd.isEmpty():  # different texts with one digest: the rows are grouped again, by the bytes themselves
        return _by_bytes(base)
    kept = (F.col("file") == F.col("first.file")) & (F.col("place") == F.col("first.place"))
    return members.select("id", "file", "place", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _by_bytes(base: DataFrame) -> DataFrame:
    """The exact way for digests that different texts share; within the rows given."""
    body = base.select("id", "file", "place", normalised(F.col("text")).alias("body"))
    groups = body.groupBy("body").agg(F.min(F.struct("id", "file", "place")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    kept = (F.col("file") == F.col("first.file")) & (F.col("place") == F.col("first.place"))
    return body.join(groups, "body").select("id", "file", "place", F.col("first.id").alias("keep_id"), "group_size", kept.alias("kept"), sha256_hex(F.col("body")).alias("text_sha256"))


def _rows_folder(scratch: Scratch, state: str | None, batch: str) -> str:
    """Where rows that are in no file are written: beside the state, which keeps locators into them, if there is one."""
    return f"{state}/rows/{batch}" if state else scratch.path("rows")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: str | None = None, batch: str = "0") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    state: a folder in storage that all machines share, for state that outlives the call; batch: the batch's name there. A
    batch that was run before, or was cut short, may be run again. keep_id and group_size are over all batches seen so far.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    out = _decide(located(docs, id_col, text_col, _rows_folder(scratch, state, batch)), scratch, text_col, state, batch)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: str | None = None, batch: str = "0") -> DataFrame:
    """The rows of docs that decide() keeps, with all their columns."""
    scratch = Scratch(docs.sparkSession, "exact")
    base = located(docs, id_col, text_col, _rows_folder(scratch, state, batch))
    kept = _decide(base, scratch, text_col, state, batch).filter("kept").select("file", "place")
    out = base.select("row", "file", "place").join(kept, ["file", "place"])
    return out.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
