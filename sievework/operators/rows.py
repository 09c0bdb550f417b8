"""Row identity and exact-count sampling."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..session import work_folder

ROW = "_row_id"
#: Hex digits that one pass adds to a bucket's prefix (4,096 buckets), digits of a key, and rows of a bucket that the driver orders.
_DIGITS, _KEY_DIGITS, _SMALL = 3, 32, 1 << 16
#: Files up to which their offsets are broadcast (about 100 bytes each).
_MOST_FILES = 100_000


def plain_scan(df: DataFrame, whole: bool = True) -> bool:
    """Whether df is columns of one table of files, each row of a file once, or (not whole) at most once: no join, sort or grouping in
    between, and nothing that comes out differently each time."""
    if "_metadata" in df.columns or not hasattr(df, "_jdf"):
        return False
    node = df._jdf.queryExecution().analyzed()
    between = ("Project", "SubqueryAlias", "View") if whole else ("Project", "SubqueryAlias", "View", "Filter")
    while node.nodeName() in between and node.deterministic() and node.children().size() == 1:
        node = node.children().apply(0)
    return node.nodeName().startswith("LogicalRelation") and "HadoopFsRelation" in node.relation().getClass().getName()


def located(df: DataFrame, file: str = "file", place: str = "place", whole: bool = False, folder: str | None = None) -> DataFrame:
    """df with each row's place: the file it is in and its number there. The place is read, not counted, so it is the same however
    often and however the plan runs. A frame that does not come straight from files is written once, in its order of rows, to
    `folder` or a new one; with whole, so is one that leaves out rows of a file, and numbers have no gaps."""
    place_columns = F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)
    if plain_scan(df, whole):
        try:
            return df.select("*", *place_columns)
        except AnalysisException:  # files of a kind that has no row numbers
            pass
    path = folder or work_folder(df.sparkSession, "rows")
    columns = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    columns.write.mode("overwrite").option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(columns.schema).parquet(path)
    return written.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)), *place_columns)


def with_row_id(df: DataFrame, name: str = ROW) -> DataFrame:
    """Adds row numbers 0..N-1: files by name, rows as they stand in them, without a sort. Each row's number is its place in its file and
    the rows of the files before; one row per file reaches the driver and goes out again."""
    placed = located(df, "__file", "__place", whole=True)
    sizes = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pydict()
    offsets, before = [], 0
    for path, n in sorted(zip(sizes["__file"], sizes["n"])):
        offsets.append((path, before))
        before += n
    table = df.sparkSession.createDataFrame(offsets, "__file string, __before bigint")
    joined = placed.join(F.broadcast(table) if len(offsets) <= _MOST_FILES else table, "__file")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__before") + F.col("__place")).alias(name))


@dataclass(frozen=True)
class Cut:
    """The last (key, row) that a sample takes; n the number of rows it takes."""

    n: int
    key: str = ""
    row: object = None

    def takes(self, hex_key: Column, row: Column) -> Column:
        if self.n == 0:
            return F.lit(False)
        return (hex_key < self.key) | ((hex_key == self.key) & (row <= F.lit(self.row)))


def _cells(df: DataFrame, keys: dict[str, Column], prefixes: dict[str, str], row: str) -> DataFrame:
    """c, k, row: the keys that begin with their prefix."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(p).alias("p"), keys[c].alias("k")) for c, p in prefixes.items()])
    return df.select(F.col(row).alias("row"), F.explode(cells).alias("x")).filter(F.col("x.k").startswith(F.col("x.p"))).select("x.c", "x.k", "row")


def _counts(df: DataFrame, keys: dict[str, Column], prefixes: dict[str, str], row: str) -> dict[str, list[tuple[str, int]]]:
    """(bucket, rows) of each key, in order: the prefixes of _DIGITS more digits, a fixed number of buckets."""
    width = max(map(len, prefixes.values())) + _DIGITS
    names = list(prefixes)
    cells = F.array(*[F.when(keys[c].startswith(p) if p else F.lit(True), F.struct(F.lit(i).alias("c"), F.substring(keys[c], 1, width).alias("b"))) for i, (c, p) in enumerate(prefixes.items())])
    wanted = F.filter(cells, lambda x: x.isNotNull()) if any(prefixes.values()) else cells
    counted = df.select(F.explode(wanted).alias("x")).groupBy("x.c", "x.b").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pydict()
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in keys}
    for c, b, n in sorted(zip(counted["c"], counted["b"], counted["n"])):
        out[names[c]].append((b, n))
    return out


def exact_cuts(df: DataFrame, keys: dict[str, Column], sizes: Callable[[int], dict[str, int]], row: str = ROW) -> dict[str, Cut]:
    """Where to cut so that each named key takes exactly the rows that sizes names for the table's number of rows, smallest keys first,
    ties by row.

    One pass counts the prefixes of all keys, which gives the number of rows and the bucket in which each sample ends. While such a
    bucket has more than _SMALL rows it is counted by longer prefixes, in one pass for all keys; a last pass brings the
    rows of the small buckets. No pass sorts the table, and taking the sample is then a comparison per row.
    Rows with one key (repeated row identifiers) are taken together, or not at all.
    """
    counts = _counts(df, keys, dict.fromkeys(keys, ""), row) if keys else {}
    n_rows = max((sum(n for _, n in b) for b in counts.values()), default=0)
    wanted = {c: n for c, n in sizes(n_rows).items() if n > 0}
    cuts = {c: Cut(0) for c in keys if c not in wanted}
    left, buckets = dict(wanted), {}
    large = set(wanted)
    while large:
        for c in sorted(large):
            for bucket, n in counts[c]:
                if left[c] <= n:
                    buckets[c] = bucket
                    if n <= _SMALL or len(bucket) >= _KEY_DIGITS:
                        large.discard(c)
                    break
                left[c] -= n
            else:
                raise ValueError(f"{c}: a sample of {wanted[c]} rows is larger than the table")
        if large:
            counts = _counts(df, {c: keys[c] for c in large}, {c: buckets[c] for c in large}, row)
    if buckets:
        ends = _cells(df, keys, buckets, row).distinct().collect()  # at most _SMALL different keys for each name
        for c, n in wanted.items():
            inside = sorted((r["k"], r["row"]) for r in ends if r["c"] == c)
            cuts[c] = Cut(n, *inside[min(left[c], len(inside)) - 1])
    return cuts


def sample_exact(df: DataFrame, n: int, seed: int = 42, family: str = "sample", name: str = "row", row: str = ROW) -> DataFrame:
    """Exactly n rows, uniformly and without replacement."""
    k = draws.key(seed, family, name, row)
    return df.filter(exact_cuts(df, {name: k}, lambda _: {name: n}, row)[name].takes(k, F.col(row)))
