"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words: its weight's share of all words, at most three times its own size, the excess
reshared by weight until no source is above. A document's expected copies are its source's target over size. The documents
of a source stand in a line; expected copies are summed along it, one offset is added, and a document is emitted once for
each integer that the sum crosses.

The line rises and falls: documents with an even salt come first, by growing size, then those with an odd salt, by falling
size. Its ends are the shortest documents and its neighbours are alike, so what one offset rounds up at one document it
rounds down at one nearly as long, and the words taken come out near the target; a source of few or very unequal documents may
miss it by up to the length of its longest. Ranks are counted within (source, size class, salt) and the few group counts of a
source are summed ahead of them, so a source with a third of all rows is still ranked in many tasks.

The limit binds targets; a document is taken at most as often as the limit, rounded up. The salt comes from MD5 of the
identifier and all else is exact arithmetic on numbers, so SQL gives the same rows.

Defined cases: a null text has size 0; the null source is a source of its own, last in order; documents of a source without
words are taken 0 times; repeated identifiers are documents of their own, of those with one text and source any may be
taken more often than another; an empty table gives an empty result; other columns, whatever their names, do not matter. Only
DataFrame functions are used.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import WORD, whole

SALTS, SEED = 64, 20240607


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0, share: float = 1.0) -> DataFrame:
    """Per source: weight, source_size, target. sources: source, source_size; one row per source.

    With caps limit*size, the final targets are min(cap, level*weight) for the one level at which they add up to the
    total: sources reach their caps in the order cap/weight, so the level follows from sums along that order.
    """
    line = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source stands here, no document
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(line) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    rank = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    after = rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(after))
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # The first source in this order that stays below its cap fixes the level for itself and all after it;
    # further on the level only falls.
    below = F.col("level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("fixed", F.max(F.when(below, F.col("level"))).over(everything))
    target = F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("fixed") * F.col("weight")))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), F.greatest(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, copies, taken (copies * size), mark (hash of the text)."""
    scratch = Scratch(docs.sparkSession, "mix")
    text = whole(F.col(text_col))
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    salt = (F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("int") % SALTS).alias("salt")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("mark"), salt)
    # Size classes, four for each doubling: the number of binary digits and the two after the first.
    more, digits = F.col("size") + 1, F.length(F.bin(F.col("size") + 1))
    klass = 4 * digits + F.floor(more * 4 / F.pow(F.lit(2.0), digits - 1)).cast("int")
    rows = scratch.write(rows.withColumn("falls", F.col("salt") % 2).withColumn("klass", klass.cast("int")), "sizes")

    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit, share)
    sources = sources.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumnRenamed("source", "s")
    # One row per source, read back as a file: Spark broadcasts it if its size allows.
    sources = scratch.write(sources.coalesce(1), "sources")
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    # A bounded number of cells per source: SALTS times the size classes.
    cells = rows.groupBy("source", "klass", "salt").agg(F.count(F.lit(1)).alias("n"))
    up_and_down = F.col("c") * (1 - 2 * (F.col("t") % 2))
    ahead = Window.partitionBy("s").orderBy(F.col("t") % 2, up_and_down, "t").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("s"), F.col("klass").alias("c"), F.col("salt").alias("t"), "n").withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    within = Window.partitionBy("source", "klass", "salt").orderBy(F.col("size") * (1 - 2 * F.col("falls")), "id", "mark")
    ranked = rows.withColumn("place", F.row_number().over(within))
    placed = ranked.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("klass") == F.col("c")) & (F.col("salt") == F.col("t")))
    place = F.col("ahead") + F.col("place")
    # Integer boundaries that the running sum of expected copies, one offset added, crosses at this document.
    copies = (F.floor(place * F.col("rate") + offset(seed)) - F.floor((place - 1) * F.col("rate") + offset(seed))).cast("long")
    return placed.withColumn("copies", copies).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "mark")


def offset(seed: int) -> float:
    """The random offset in [0, 1), the same in every run."""
    return random.Random(seed).random()


def take(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: every row of docs as often as the plan says, with all its columns.

    A row is found by identifier, source and text; rows that agree in all three share the copies planned for them evenly.
    """
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    rows = docs.select(row.alias("row"), F.struct(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(whole(F.col(text_col))).alias("mark")).alias("key"))
    planned = plan.groupBy(F.struct(F.col(id_col).alias("id"), "source", "mark").alias("key")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike"))
    found = rows.join(planned.filter("copies > 0"), "key")
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    several = found.filter("alike > 1").withColumn("turn", turn).withColumn("times", F.floor(F.col("turn") * F.col("copies") / F.col("alike")) - F.floor((F.col("turn") - 1) * F.col("copies") / F.col("alike")))
    times = found.filter("alike = 1").select("row", F.col("copies").alias("times")).unionByName(several.filter("times > 0").select("row", "times"))
    return times.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, 4) AS INTEGER) % {SALTS} AS salt FROM documents),
classed AS (SELECT *, 4 * length(bin(size + 1)) + CAST(floor((size + 1) * 4 / pow(2.0, length(bin(size + 1)) - 1)) AS INTEGER) AS klass FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM classed GROUP BY source),
weighed AS (
  SELECT source, source_size, ([1.0, 2.0, 3.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
    source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
fixed AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS fixed FROM levels),
targets AS (SELECT source, source_size, greatest(CASE WHEN fixed IS NULL THEN cap ELSE least(cap, fixed * weight) END, 0.0) AS target FROM fixed),
rated AS (SELECT source AS s, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
line AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY salt % 2, klass * (1 - 2 * (salt % 2)), salt, size * (1 - 2 * (salt % 2)), doc_id) AS place
  FROM classed JOIN rated ON source IS NOT DISTINCT FROM s),
counted AS (SELECT *, CAST(floor(place * rate + {offset(SEED)!r}::DOUBLE) - floor((place - 1) * rate + {offset(SEED)!r}::DOUBLE) AS BIGINT) AS copies FROM line)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, copies * size AS taken, source, copies FROM counted
"""
