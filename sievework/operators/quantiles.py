"""Exact quantiles without a sort and without a state that grows: selection by refined histograms.

Every number becomes a 64-bit key with the same order. One pass finds rows, least and greatest key of all columns; each further pass counts, for
all columns and all wanted ranks together, the next DIGITS bits of the keys that still share the prefix of a rank, in arrays of fixed size in each task, so
what reaches the driver is a histogram of fixed size for each rank. A bucket brings its least and greatest key too: if these are one, the rank
is found, else the next pass begins where they part. Passes: at most 64 / DIGITS, and no more than the values have
digits, however many rows share a value; no task holds the values of a column.

Defined cases: nulls do not count; NaN is the greatest number, as Spark orders it; a column without values has no quantiles; between two ranks
a quantile is their linear interpolation.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 12
#: No longer a bound: passes end where a bucket has one key, however many rows have it.
_FEW = 1 << 14
_SIGN = 1 << 63
#: Bits of the format of doubles.
_NAN, _INFINITE = 0x7FF8 << 48, 0x7FF0 << 48


def _is_whole(kind: T.DataType) -> bool:
    return isinstance(kind, (T.IntegralType, T.BooleanType))


def _key(x: float | int, whole: bool) -> int:
    """The unsigned key of a number."""
    if whole:
        return int(x) + _SIGN
    bits = _NAN if x != x else int.from_bytes(struct.pack(">d", x + 0.0), "big")
    return ~bits & (2 * _SIGN - 1) if bits & _SIGN else bits | _SIGN


def _value(key: int, whole: bool) -> float | int:
    """The number of an unsigned key."""
    if whole:
        return key - _SIGN
    bits = key ^ _SIGN if key & _SIGN else ~key & (2 * _SIGN - 1)
    return struct.unpack(">d", bits.to_bytes(8, "big"))[0]


@dataclass
class _Search:
    """One rank of one column: its keys agree above `shift` with `prefix`, and `left` of them stand before it."""

    column: int
    rank: int
    shift: int = 64
    prefix: int = 0
    left: int = 0
    size: int = 0
    found: int | None = field(default=None)


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], extent: dict[str, tuple[int, int, int]] | None = None) -> dict[tuple[str, int], float | int]:
    """The values at ranks (from 0) of each column; extent is what `extents` has found, if it is known."""
    names = [c for c in ranks if ranks[c]]
    if not names:
        return {}
    extent = extents(df, names) if extent is None else extent
    whole = {c: _is_whole(df.schema[c].dataType) for c in names}
    searches = []
    for i, c in enumerate(names):
        n, low, high = extent[c]
        for r in sorted(set(ranks[c])):
            if not 0 <= r < n:
                raise ValueError(f"{c}: no rank {r} among {n} values")
            shift = (low ^ high).bit_length()
            searches.append(_Search(i, r, shift, low >> shift, r, n, low if shift == 0 else None))
    numbers = df.select(*(F.col(f"`{c}`").cast("bigint" if whole[c] else "double").alias(f"x{i}") for i, c in enumerate(names)))
    while active := [s for s in searches if s.found is None]:
        groups = list({(s.column, s.shift, s.prefix): None for s in active})
        found = numbers.mapInArrow(_counted(groups), "g int, b bigint, n bigint, low bigint, high bigint").groupBy("g", "b").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        counted = found.toArrow().to_pydict()
        histograms: list[list[tuple[int, int, int, int]]] = [[] for _ in groups]
        for g, b, n, low, high in zip(*(counted[c] for c in ("g", "b", "n", "low", "high"))):
            histograms[g].append((b, n, low + _SIGN, high + _SIGN))
        of = {k: sorted(h) for k, h in zip(groups, histograms)}
        for s in active:
            for _, n, low, high in of[s.column, s.shift, s.prefix]:
                if s.left < n:
                    # the bucket's own least and greatest key say how far its keys agree
                    s.shift = (low ^ high).bit_length()
                    s.prefix, s.size = low >> s.shift, n
                    s.found = low if low == high else None
                    break
                s.left -= n
    return {(names[s.column], s.rank): _value(s.found, whole[names[s.column]]) for s in searches}


def _counted(groups: list[tuple[int, int, int]]):
    """Rows (g, b, n, low, high): how many keys of a task's rows are in bucket b of group g, and the least and greatest of them (as signed numbers). Groups are
    (column, shift, prefix); a task holds a histogram of 2 ** DIGITS buckets at most for each. Workers need not import this package."""

    def in_order(x: np.ndarray) -> np.ndarray:
        """Unsigned keys in the order of the numbers."""
        if x.dtype == np.int64:
            return x.view(np.uint64) ^ np.uint64(_SIGN)
        x = np.where(np.isnan(x), np.float64("nan"), x + 0.0)  # one form of NaN, no negative zero
        bits = x.view(np.uint64)
        return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(_SIGN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [1 << min(DIGITS, shift) for _, shift, _ in groups]
        n = [np.zeros(k, np.int64) for k in sizes]
        low = [np.full(k, 2 * _SIGN - 1, np.uint64) for k in sizes]
        high = [np.zeros(k, np.uint64) for k in sizes]
        for batch in batches:
            keys: dict[int, np.ndarray] = {}
            for g, (column, shift, prefix) in enumerate(groups):
                if column not in keys:
                    keys[column] = in_order(batch.column(column).drop_null().to_numpy(zero_copy_only=False))
                own = keys[column]
                if shift < 64:
                    own = own[own >> np.uint64(shift) == np.uint64(prefix)]
                b = (own >> np.uint64(max(0, shift - DIGITS)) & np.uint64(sizes[g] - 1)).astype(np.int64)
                n[g] += np.bincount(b, minlength=sizes[g])
                np.minimum.at(low[g], b, own)
                np.maximum.at(high[g], b, own)
        for g in range(len(groups)):
            b = np.flatnonzero(n[g])
            ends = [(x[g][b] ^ np.uint64(_SIGN)).view(np.int64) for x in (low, high)]
            yield pa.record_batch([pa.array(np.full(len(b), g, np.int32)), pa.array(b), pa.array(n[g][b]), *map(pa.array, ends)], names=["g", "b", "n", "low", "high"])

    return run


def extents(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int, int]]:
    """(values, least key, greatest key) of each column, in one pass."""
    stats = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("bigint" if _is_whole(df.schema[c].dataType) else "double")
        stats += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    r = df.agg(*stats).first()
    ends = lambda i, c: (_key(r[f"{k}{i}"], _is_whole(df.schema[c].dataType)) for k in "ab")
    return {c: (r[f"n{i}"], *ends(i, c)) if r[f"n{i}"] else (0, 0, 0) for i, c in enumerate(columns)}


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column at shares from 0 to 1, by linear interpolation; None for columns without values."""
    if any(not 0 <= q <= 1 for q in shares):
        raise ValueError("shares are from 0 to 1")
    if not columns:
        return {}
    extent = extents(df, columns)
    places = {c: [q * (extent[c][0] - 1) for q in shares] for c in columns if extent[c][0]}
    values = order_statistics(df, {c: [r for p in ps for r in (floor(p), ceil(p))] for c, ps in places.items()}, extent)
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    for c, ps in places.items():
        out[c] = []
        for p in ps:
            a, b = float(values[c, floor(p)]), float(values[c, ceil(p)])
            out[c].append(a if a == b else a + (b - a) * (p - floor(p)))
    return out


# ---------------------------------------------------------------- sketches


def sketch(df: DataFrame, columns: list[str], by: list[str | Column] = (), k: int = 400) -> DataFrame:
    """by, column, sketch: mergeable KLL sketches of numeric columns (rank error about 0.7 % at k = 400), one for each group of by; without by,
    one per file that is read, so that a stored table needs only its new files. Memory is bounded by k for each group and column."""
    where = list(by) or ["file"]
    if not by:
        df = df.select("*", F.col("_metadata.file_path").alias("file"))
    made = df.groupBy(*where).agg(*(F.kll_sketch_agg_double(F.col(f"`{c}`").cast("double"), k).alias(f"s{i}") for i, c in enumerate(columns)))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)])
    groups = made.columns[: len(where)]
    return made.select(*groups, F.explode(cells).alias("x")).select(*groups, "x.*")


def merged_quantiles(sketches: DataFrame, shares: list[float], k: int = 400) -> DataFrame:
    """column, n, share, value from sketches of any number of files or batches."""
    whole = sketches.filter(F.col("sketch").isNotNull()).groupBy("column").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    values = F.array(*[F.struct(F.lit(q).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("value")) for q in shares])
    n = F.kll_sketch_get_n_double("sketch")
    return whole.select("column", n.alias("n"), F.explode(F.when(n > 0, values)).alias("x")).select("column", "n", "x.*")
