"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's five-word shingles. Sketches
merge (the k smallest of the union), and two of them estimate resemblance and containment; one alone estimates the number
of distinct shingles. Texts with fewer than k shingles are held whole, so estimates about
them are exact; a full sketch does not tell whether there were more, so the count of a text with just k is an estimate.

Defined cases: a null text is an empty text and has an empty sketch; a text of fewer than five words is one shingle; two
empty sketches have likeness 1, an empty and another 0; equal texts have equal fingerprints; document order needs identifiers that are whole numbers; rows with a null
one come after all others, repeated identifiers are ordered by their texts; an empty table gives an empty
result. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import SPACE, sha256_hex, whole

SHINGLE, K = 5, 256


def shingle_hashes(text: Column, words: int = SHINGLE) -> Column:
    """Hash of each shingle of a text; [] for an empty text. The array is computed once per use: project it first."""
    each = F.transform(F.filter(F.split(F.lower(text), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    # Shifting the word hashes against each other gives the shingles without slicing an array for each.
    return F.transform(
        F.array(each),
        lambda h: F.when(F.size(h) == 0, F.expr("cast(array() as array<bigint>)"))
        .when(F.size(h) < words, F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " "))))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(h) - (words - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(words)]))),
    )[0]


def sketch(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets, from sketches."""
    both = F.size(F.array_intersect(F.array_intersect(merge(a, b, k), a), b))
    whole_ = F.least(F.size(F.array_union(a, b)), F.lit(k))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both.cast("double") / whole_)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k-1) over the share of the hash space passed."""
    last = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and the counts."""
    r, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / (F.lit(1.0) + r) / na))


def packed(a: Column) -> Column:
    """A sketch as text: its hashes, eight bytes each, in base64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = SHINGLE) -> DataFrame:
    """id_col, sketch (array of hashes), distinct_shingles for each row; the table is read once and nothing is shuffled."""
    made = docs.select(F.col(id_col), sketch(shingle_hashes(whole(F.col(text_col)), words), k).alias("sketch"))
    return made.withColumn("distinct_shingles", distinct_count(F.col("sketch"), k))


def in_order(docs: DataFrame, id_col: str, rows_per_part: int = 4000, most_parts: int = 20000) -> tuple[DataFrame, int]:
    """docs by identifier in parts of neighbouring identifiers; adds __part and __guest.

    The first identifier of each part stands in the part before it too, as a guest at its end (that of the first part in
    the last), so that each row finds its successor inside its part. The boundaries are quantiles of the identifiers:
    their number is bounded, and each is an identifier that occurs.
    """
    at = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    n = docs.select(F.count(F.lit(1))).first()[0]
    parts = int(max(1, min(most_parts, n // rows_per_part)))
    cuts = docs.select(at.alias("a")).agg(F.min("a").alias("least"), F.percentile_approx("a", [i / parts for i in range(parts)], max(10000, 10 * parts)).alias("cuts")).first()
    bounds = sorted({cuts["least"], *(cuts["cuts"] or [])}) if cuts["least"] is not None else [0]
    top = len(bounds)
    # A literal array, searched by halving: the number of boundaries that are not above the identifier.
    literal = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << i for i in reversed(range(top.bit_length()))]
    part = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, s: F.when((low + s <= top) & (F.element_at(literal, F.least(low + s, F.lit(top))) <= F.col("__at")), low + s).otherwise(low))
    rows = docs.withColumn("__at", at).withColumn("__home", part)
    opens = F.element_at(literal, F.greatest(F.col("__home"), F.lit(1))) == F.col("__at")
    before = F.when(F.col("__home") == 1, F.lit(top)).otherwise(F.col("__home") - 1)
    places = F.when(opens, F.array(F.struct(F.col("__home").alias("p"), F.lit(0).alias("g")), F.struct(before.alias("p"), F.lit(1).alias("g")))).otherwise(F.array(F.struct(F.col("__home").alias("p"), F.lit(0).alias("g"))))
    return rows.withColumn("__place", F.explode(places)).withColumn("__part", F.col("__place.p")).withColumn("__guest", F.col("__place.g")).drop("__place", "__home"), top


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = SHINGLE) -> DataFrame:
    """For each row: its sketch, that of its edited text (see op6) and their likenesses."""
    placed, _ = in_order(docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text")), "id")
    order = Window.partitionBy("__part").orderBy("__guest", "__at", "text")
    after = placed.withColumn("next", F.lead("text").over(order)).filter("__guest = 0")
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    next_text = F.coalesce(F.col("next"), F.col("text"))  # a single row is its own successor
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(next_text, F.lit(1), cut))
    rows = after.select("id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), next_text.alias("next_text"))
    hashed = rows.select("id", "n_chars", sha256_hex(F.col("edited")).alias("edited_sha256"), *(shingle_hashes(F.col(c), words).alias(c) for c in ("text", "edited", "next_text")))
    return hashed.select("id", "n_chars", "edited_sha256", *(sketch(F.col(c), k).alias(c) for c in ("text", "edited", "next_text")))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return s.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", packed(F.col("text")).alias("fingerprint"), packed(F.col("edited")).alias("edited_fingerprint"),
        resemblance(F.col("text"), F.col("edited")).alias("near_edited"), resemblance(F.col("text"), F.col("next_text")).alias("near_next"), distinct_count(F.col("text")).alias("distinct_shingles"),
    )


SQL = None  # sketches are Spark's hashes; tests compare them with sets of shingles
