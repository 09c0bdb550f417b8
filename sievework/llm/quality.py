"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text's bytes, words and lines are computed for whole batches with numpy. Trees are grown on quantile bins
with second-order gain, then flattened into arrays (feature, threshold, left, right, value), and all rows of a batch walk
all trees together, one level at a time.

Bounds: fit() uses at most about most_rows labelled documents, drawn by a hash of the identifier.

Defined cases: null and empty texts have the statistics of an empty text and get that score; labels without a document, null
labels and null identifiers are not learned from; a document with several labels is good only if all say so; without
usable labels of both kinds every score is the share of good labels (0.5 without any); repeated rows are scored alike; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestrings import packs, prefix_sums, span_hash, utf8
from .scratch import Scratch
from .shingles import words_of
from .text import whole
from .toxicity import held_out

MOST_ROWS, TREES, DEPTH, RATE, BINS, LEAST_LEAF = 20_000, 120, 4, 0.1, 64, 8.0

#: Byte classes whose shares are statistics, by name.
CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9), "newline": (10, 13), "stop": b".", "comma": b",", "mark": b"!?", "bar": b"|", "symbol": b"#$%&*+=@\\^_`~<>/", "bracket": b"()[]{}",
    "quote": b"\"'", "colon": b":;-", "high": range(128, 256),
}
NAMES = ("bytes", *CLASSES, "words", "word_length", "word_spread", "distinct_words", "top_word", "repeated_pairs", "lines", "line_words", "distinct_lines", "short_lines", "no_stop_lines", "marked_words", "upper_words", "entropy")


def _group_counts(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct values, and how often its most frequent one occurs."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])) if len(r) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    often = np.diff(np.append(at, len(r)))
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, r[at], often)
    return np.bincount(r[at], minlength=rows), most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of NAMES per text; data and off as from utf8()."""
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)))
    classes = np.zeros((256, len(CLASSES)))
    for k, members in enumerate(CLASSES.values()):
        classes[list(members), k] = 1
    for i, j in packs(np.diff(off), 1 << 20):
        part, here, m = data[off[i] : off[j]], (off[i : j + 1] - off[i]).astype(np.int64), j - i
        size = np.diff(here)
        some = np.maximum(size, 1)[:, None]
        row = np.repeat(np.arange(m), size)
        counts = np.zeros((m, 256))
        np.add.at(counts.ravel(), row * 256 + part, 1) if m * 256 > 4 * len(part) else counts.__iadd__(np.bincount(row * 256 + part, minlength=m * 256).reshape(m, 256))
        share = counts / some
        start, end, owner = words_of(part, here)
        c = prefix_sums(part)
        word = span_hash(c, start, end)
        words = np.bincount(owner, minlength=m)
        length = (end - start).astype(float)
        many = np.maximum(words, 1)
        mean = np.bincount(owner, length, m) / many
        spread = np.sqrt(np.maximum(0, np.bincount(owner, length**2, m) / many - mean**2))
        distinct, most = _group_counts(owner, word, m)
        same = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
        pairs, _ = _group_counts(owner[same], word[same] * np.uint64(31) + word[same + 1], m)
        first, last = part[start] if len(start) else part[:0], part[end - 1] if len(end) else part[:0]
        odd = ~((last >= 48) & (last <= 57) | (last >= 65) & (last <= 90) | (last >= 97) & (last <= 122) | (last >= 128) | np.isin(last, np.frombuffer(b".,", np.uint8)))
        # lines, empty ones left out
        cut = np.flatnonzero(part == 10)
        ls = np.unique(np.concatenate([here[:-1][size > 0], cut + 1]))
        ls = ls[ls < len(part)]
        le = np.append(ls[1:], len(part))
        lrow = np.searchsorted(here, ls, side="right") - 1
        le = np.minimum(le - (part[np.maximum(le - 1, 0)] == 10), here[lrow + 1]) if len(ls) else le[:0]
        full = le > ls
        ls, le, lrow = ls[full], le[full], lrow[full]
        lines = np.bincount(lrow, minlength=m)
        rows_l = np.maximum(lines, 1)
        line_distinct, _ = _group_counts(lrow, span_hash(c, ls, le), m)
        line_words = np.searchsorted(start, le) - np.searchsorted(start, ls)
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
        out[i:j] = np.column_stack([
            np.log1p(size), share @ classes, np.log1p(words), mean, spread, distinct / many, most / many, 1 - pairs / np.maximum(words - 1, 1), np.log1p(lines), words / rows_l, line_distinct / rows_l,
            np.bincount(lrow, line_words < 4, m) / rows_l, np.bincount(lrow, part[np.maximum(le - 1, 0)] != 46, m) / rows_l if len(ls) else np.zeros(m), np.bincount(owner, odd, m) / many, np.bincount(owner, (first >= 65) & (first <= 90), m) / many, entropy,
        ])
    return out


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points at itself."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability for every row; all trees at once, level by level, in blocks of rows."""
        out = np.empty(len(x))
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024]
            at = np.tile(self.roots, (len(part), 1))
            rows = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                at = np.where(part[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[i : i + 1024] = self.start + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, pull: float = 1.0) -> Trees:
    """Boosted trees for labels y (0/1) by logistic loss."""
    share = min(0.999, max(0.001, float(y.mean()))) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []

    def leaf(value: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), value])
        return len(nodes) - 1

    if len(np.unique(y)) < 2:
        roots.append(leaf(0.0))
        trees = 0
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])] if len(x) else []
    binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(x.shape[1])]).astype(np.int64) if len(x) else np.zeros((0, 0), np.int64)
    width = BINS + 1
    flat = binned + np.arange(binned.shape[1]) * width if len(x) else binned
    score = np.full(len(y), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)

        def build(rows: np.ndarray, level: int) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            if level < depth and len(rows) >= 2 * LEAST_LEAF:
                f = flat[rows].ravel()
                k = flat.shape[1]
                gb = np.bincount(f, np.repeat(g[rows], k), k * width).reshape(k, width).cumsum(axis=1)
                hb = np.bincount(f, np.repeat(h[rows], k), k * width).reshape(k, width).cumsum(axis=1)
                nb = np.bincount(f, minlength=k * width).reshape(k, width).cumsum(axis=1)
                gain = gb**2 / (hb + pull) + (gs - gb) ** 2 / (hs - hb + pull) - gs**2 / (hs + pull)
                gain[(nb < LEAST_LEAF) | (len(rows) - nb < LEAST_LEAF)] = -1
                best = int(np.argmax(gain))
                if gain.ravel()[best] > 1e-6:
                    feature, b = divmod(best, width)
                    me = len(nodes)
                    nodes.append([feature, float(cuts[feature][b]), 0, 0, 0.0])
                    low = binned[rows, feature] <= b
                    nodes[me][2] = build(rows[low], level + 1)
                    nodes[me][3] = build(rows[~low], level + 1)
                    return me
            value = rate * gs / (hs + pull)
            score[rows] += value
            return leaf(float(value))

        roots.append(build(np.arange(len(y)), 0))
    table = [np.array(c) for c in zip(*nodes)]
    return Trees(start, np.array(roots), table[0].astype(np.int64), table[1].astype(float), table[2].astype(np.int64), table[3].astype(np.int64), table[4].astype(float))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(*utf8(batch.column("text")))
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
        yield pa.record_batch([batch.column("label"), values], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most_rows: int = MOST_ROWS) -> Trees:
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("lid")).agg(F.min(F.col(label).cast("int")).alias("label"))
    scratch = Scratch(docs.sparkSession, "quality")
    n = usable.count()
    drawn = usable.filter(F.pmod(F.xxhash64("lid"), F.lit(1_000_000)) < int(min(1.0, most_rows / max(1, n)) * 1_000_000))
    # about most_rows identifiers and labels: small whatever the corpus, so no text is shuffled
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("lid")).select("label", "text")
    table = scratch.write(rows.mapInArrow(_statistics, "label int, x array<double>"), "statistics").orderBy("label", "x").toArrow()  # about most_rows rows of numbers
    scratch.drop("statistics")
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)) if table.num_rows else np.zeros((0, len(NAMES)))
    return grow(x, table.column("label").to_numpy().astype(float) if table.num_rows else np.zeros(0))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score for every row of docs."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # at most TREES * 2**(DEPTH + 1) nodes
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("id"), pa.array(handle.value.predict(statistics(*utf8(batch.column("text")))))], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


SQL = None  # tests use labels that follow from statistics, and a plain walk of the trees
