"""Fill-in-middle transformation of texts, with cuts at unit boundaries found relationally.

A text's units are runs of letters A-Z and a-z, and all other characters one by one. They are matched in blocks of BLOCK units,
and the blocks are exploded with their positions; a window sums lengths along each text, so every block knows how many units
and characters stand before it. Two cut requests per text are joined with the blocks by ordinal; what they find is
gathered into one row of offsets per text, and the text is cut by substring, the last few units of an offset being counted inside
the block that a cut falls into. Blocks, requests and offsets are narrow rows; texts are shuffled once, to meet their offsets.

Cuts and forms come from the SHA-256 of seed and identifier, so reruns agree. Forms: plain leaves a text as it is; psm is
prefix, suffix, middle; spm is suffix, prefix, middle; each part follows its mark.

Defined cases: a null text is an empty text and plain; a text that holds a mark is plain; a null identifier counts as
an empty one; repeated rows and identifiers are documents of their own, told apart by file and row; texts of any length are
cut whole; columns besides identifier and text, whatever their names, do not matter; an empty table gives an empty result.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rows import located
from .scratch import Scratch
from .text import sha256_hex, whole

UNIT = "[A-Za-z]+|[^A-Za-z]"
BLOCK = 256
MARKS = ("<P>", "<S>", "<M>")
_KEY = ["file", "place"]


def _draw(id_: Column, seed: int, k: int) -> Column:
    """The k-th group of eight hex digits, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _blocks(docs: DataFrame) -> DataFrame:
    """file, place, id, block, units, chars: every block of units."""
    found = docs.select(*_KEY, "id", F.regexp_extract_all("text", F.lit(rf"(?:[A-Za-z]++|[^A-Za-z]){{1,{BLOCK}}}"), F.lit(0)).alias("found"))
    rows = found.select(*_KEY, "id", F.size("found").alias("blocks"), F.posexplode("found").alias("block", "part"))
    units = F.when(F.col("block") + 1 < F.col("blocks"), F.lit(BLOCK)).otherwise(F.regexp_count("part", F.lit(UNIT)))
    return rows.select(*_KEY, "id", "block", units.cast("long").alias("units"), F.length("part").cast("long").alias("chars"))


def cut_offsets(docs: DataFrame, seed: int) -> DataFrame:
    """file, place, n, and for both cuts (before, chars, rest): where the block of a cut begins, its length, the units of it before the cut."""
    whole_text = Window.partitionBy(*_KEY)
    run = whole_text.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = _blocks(docs).select("*", F.sum("units").over(whole_text).alias("n"), F.coalesce(F.sum("chars").over(run), F.lit(0)).alias("before"), F.coalesce(F.sum("units").over(run), F.lit(0)).alias("first"))
    ends = [F.pmod(_draw(F.col("id"), seed, k), F.col("n") + 1) for k in (0, 1)]
    requests = placed.filter("block = 0").select(*_KEY, "n", F.posexplode(F.array(F.least(*ends), F.greatest(*ends))).alias("which", "unit"))
    last = F.floor((F.col("n") - 1) / BLOCK)
    requests = requests.withColumn("block", F.least(F.floor(F.col("unit") / BLOCK), last).cast("int"))
    met = requests.join(placed.select(*_KEY, "block", "before", "chars", "first"), [*_KEY, "block"])
    place = F.struct("before", "chars", (F.col("unit") - F.col("first")).alias("rest"))
    return met.groupBy(*_KEY).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("which") == k, place)).alias(f"cut{k}") for k in (0, 1)))


def _at(cut: str) -> Column:
    """Characters before a cut."""
    part = F.substring("text", F.col(f"{cut}.before").cast("int") + 1, F.col(f"{cut}.chars").cast("int"))
    inside = F.slice(F.regexp_extract_all(part, F.lit(UNIT), F.lit(0)), 1, F.col(f"{cut}.rest").cast("int"))
    return F.col(f"{cut}.before") + F.length(F.array_join(inside, ""))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """id_col, n (units), form, prefix_chars, middle_chars, output: the rearranged text; plain_from and spm_below in hundredths."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole(F.col(f"`{text_col}`")).alias("text"))
    base = located(rows, folder=Scratch(docs.sparkSession, "middle").path("rows"))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (_draw(F.col("id"), seed, 2) % 100 >= plain_from), "plain").when(_draw(F.col("id"), seed, 3) % 100 < spm_below, "spm").otherwise("psm")
    met = base.join(cut_offsets(base, seed), _KEY, "left").select("id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"), form.alias("form"), _at("cut0").alias("a"), _at("cut1").alias("b"))
    prefix, middle = F.substring("text", F.lit(1), F.col("a").cast("int")), F.substring("text", F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int"))
    suffix = F.substring("text", F.col("b").cast("int") + 1, F.lit((1 << 31) - 1))
    p, s, m = map(F.lit, MARKS)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return met.select(
        F.col("id").alias(id_col), "n", "form", F.when(cut, F.col("a")).cast("long").alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).cast("long").alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; marks stand only where this operator put them."""
    parts = F.split(output, "<[PSM]>")
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_hex(F.col("output")).alias("output_sha256"), sha256_hex(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END AS output FROM p),
r AS (SELECT *, string_split_regex(output, '<[PSM]>') AS r FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END::BIGINT AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN r[2] || r[4] || r[3] ELSE r[3] || r[4] || r[2] END) AS restored_sha256 FROM r"""
