"""Removal of byte strings that occur more than once, by sparse distributed prefix doubling.

Which 200-byte strings start at more than one place? Instead of ranking every byte position, positions are sampled by
content: of the 24-byte strings inside a 200-byte string, that of the least hash is its anchor, so equal strings have equal
anchors at equal offsets, and about one position in 89 is an anchor of some string. The ranks are hashes of what stands
around an anchor, over growing lengths, as in prefix doubling:

1. rank by 24 bytes: anchors whose rank is unique are done (no string around them repeats);
2. the others, by the whole stretch of the strings they anchor: stretches that occur twice repeat entirely;
3. what is still undecided, by every 200-byte string of the stretch, past the threshold.

After each ranking only what shares its rank with another position goes on, equal stretches go on as one with a count. So
groups of thousands of copies shrink to one row in step 2, and no pairs of positions are ever formed.

Defined cases: a null text is an empty text; texts shorter than the threshold keep all bytes; rows that repeat, identifier
and all, repeat each other; a null identifier is an identifier; an empty table gives an empty result. Ranks are 64-bit
hashes, compared only within one rank of the step before, so 128 bits decide; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestrings import mixed, packs, prefix_sums, span_hash, utf8
from .scratch import Scratch
from .text import whole

LENGTH, SEED_LENGTH = 200, 24
_PIECE = 1 << 20  # window starts handled at once; positions fit the low 24 bits below
_HOT = 4096  # distinct stretches of one anchor string from which they are dealt out by offset too


def anchor_runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH, seed: int = SEED_LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of window starts with one anchor: row, first start, last start, anchor (byte positions in data), rank."""
    for i, j in packs(np.diff(off), _PIECE):
        lo, hi = int(off[i]), int(off[j])
        pieces = [(lo, hi)] if hi - lo <= 2 * _PIECE else [(p, min(hi, p + _PIECE + length - 1)) for p in range(lo, max(lo + 1, hi - length + 1), _PIECE)]
        for a, b in pieces:
            part = data[a:b]
            n = len(part)
            if n < length:
                continue
            c = prefix_sums(part)
            at = np.arange(n - seed + 1)
            rank = span_hash(c, at, at + seed)
            w = length - seed + 1
            pad = -len(rank) % w
            v = np.concatenate([(rank & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64), np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
            ahead = np.minimum.accumulate(v, axis=1).ravel()
            behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
            m = n - length + 1
            anchor = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & np.uint64(0xFFFFFF)).astype(np.int64)
            # A window belongs to the row it starts in, if it ends there too.
            lengths = np.clip(off[i + 1 : j + 1], a, b) - np.clip(off[i:j], a, b)
            row = np.repeat(np.arange(i, j), lengths)[:m]
            fits = a + length + np.arange(m) <= np.repeat(off[i + 1 : j + 1], lengths)[:m]
            new = fits.copy()
            new[1:] &= ~fits[:-1] | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            if not len(first):
                continue
            stop = np.flatnonzero(fits & np.append(~fits[1:] | new[1:], True))
            yield row[first], a + first, a + stop, a + anchor[first], rank[anchor[first]]


def _runs_of(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, tuple]]:
    data, off = utf8(batch.column("text"))
    for run in anchor_runs(data, off, length):
        yield data, off, run


def _ranks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, (_, _, _, _, rank) in _runs_of(batch, length):
                yield pa.record_batch({"rank": rank.view(np.int64)})

    return run


def _stretches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tail = batch.column("key").to_numpy(), batch.column("tail").to_numpy()
            for data, off, (row, first, last, anchor, rank) in _runs_of(batch, length):
                view = memoryview(data)
                ext = np.fromiter((xxhash.xxh3_64_intdigest(view[s : e + length]) for s, e in zip(first.tolist(), last.tolist())), np.uint64, len(first))
                start = first - off[row]
                yield pa.record_batch({"rank": rank.view(np.int64), "ext": ext.view(np.int64), "key": key[row], "tail": tail[row], "start": start, "width": (last - first + 1).astype(np.int32), "lead": (anchor - first).astype(np.int32)})

    return run


def _cut_out(length: int):
    """Rows (rank, ext, n, lead, shift, part, body): the bytes of undecided stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            todo = batch.column("todo")
            owner = np.repeat(np.arange(len(todo)), np.diff(todo.offsets.to_numpy()))
            f = {x.name: todo.flatten().field(x.name).to_numpy() for x in todo.type.value_type}
            rank, ext, n, lead, shift, part, body = [], [], [], [], [], [], []
            for o, k, e, c, s, w, a, g in zip(off[owner].tolist(), f["rank"].tolist(), f["ext"].tolist(), f["n"].tolist(), f["start"].tolist(), f["width"].tolist(), f["lead"].tolist(), f["group"].tolist()):
                # Strings of one anchor are equal only at one offset, so a large group can be dealt out by offsets.
                cuts = [0, *(x for x in range(1, w) if (a - x) % 16 == 15), w] if g > _HOT else [0, w]
                for x, y in zip(cuts, cuts[1:]):
                    rank.append(k), ext.append(e), n.append(c), lead.append(a - x), shift.append(x)
                    part.append((a - x) // 16 if g > _HOT else 0)
                    body.append(data[o + s + x : o + s + y - 1 + length].tobytes())
            yield pa.record_batch([pa.array(rank, pa.int64()), pa.array(ext, pa.int64()), pa.array(n, pa.int32()), pa.array(lead, pa.int32()), pa.array(shift, pa.int32()), pa.array(part, pa.int32()), pa.array(body, pa.binary())], names=["rank", "ext", "n", "lead", "shift", "part", "body"])

    return run


def _repeated(table: pa.Table, length: int) -> pa.RecordBatch:
    """Runs of repeated strings among whole groups of rank: rank, ext, lo, hi (starts in the stretch)."""
    rank, n, lead, shift = (table.column(c).to_numpy() for c in ("rank", "n", "lead", "shift"))
    ext = table.column("ext").to_numpy()
    body = table.column("body").combine_chunks()
    body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
    off = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    data = np.frombuffer(body.buffers()[2], np.uint8)[: off[-1]]
    c = prefix_sums(data[off[0] :])
    off = off - off[0]
    width = np.diff(off) - length + 1
    row = np.repeat(np.arange(len(width)), width)
    rel = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
    at = off[row] + rel
    string = span_hash(c, at, at + length) ^ mixed(rank.view(np.uint64)[row] + (lead[row] - rel).astype(np.uint64))
    order = np.argsort(string, kind="stable")
    new = np.append(True, string[order][1:] != string[order][:-1])
    group = np.cumsum(new) - 1
    twice = np.bincount(group, weights=np.minimum(n, 2)[row[order]]) >= 2
    hit = np.empty(len(row), bool)
    hit[order] = twice[group]
    hit &= n[row] < 2  # stretches that occur twice are decided already
    opens = hit & np.append(True, ~hit[:-1] | (row[1:] != row[:-1]))
    closes = hit & np.append(~hit[1:] | (row[1:] != row[:-1]), True)
    i, j = np.flatnonzero(opens), np.flatnonzero(closes)
    r = row[i]
    return pa.record_batch({"rank": rank[r], "ext": ext[r], "lo": (rel[i] + shift[r]).astype(np.int32), "hi": (rel[j] + shift[r]).astype(np.int32)})


def _resolve(length: int, most: int = 1 << 21):
    """mapInArrow function over rows sorted by rank: takes whole groups, as many as fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < most or batch.num_rows == 0:
                continue
            table = pa.Table.from_batches(held)
            rank = table.column("rank").to_numpy()
            last = len(rank) - int(np.argmax(rank[::-1] != rank[-1])) if rank[0] != rank[-1] else 0
            if last:
                yield _repeated(table.slice(0, last), length)
                held = table.slice(last).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
        if held and sum(b.num_rows for b in held):
            yield _repeated(pa.Table.from_batches(held), length)

    return run


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as disjoint ones that do not touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(new[1:], True)]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = utf8(batch.column("text"))
        todo = batch.column("spans")
        rows: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
        for i in range(len(todo)):
            body, spans = data[off[i] : off[i + 1]], todo[i]
            rows["n_bytes"].append(len(body))
            if not spans.is_valid:
                rows["n_removed"].append(0), rows["n_spans"].append(0), rows["spans"].append([])
                rows["kept_sha256"].append(hashlib.sha256(body).hexdigest())
                continue
            a, b = _merge(spans.values.field("a").to_numpy(), spans.values.field("b").to_numpy())
            h, at = hashlib.sha256(), 0
            for s, e in zip(a.tolist(), b.tolist()):
                h.update(body[at:s])
                at = e
            h.update(body[at:])
            rows["n_removed"].append(int((b - a).sum())), rows["n_spans"].append(len(a)), rows["kept_sha256"].append(h.hexdigest())
            rows["spans"].append([{"a": s, "b": e} for s, e in zip(a.tolist(), b.tolist())])
        out = [batch.column("id"), pa.array(rows["n_bytes"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["n_spans"], pa.int64()), pa.array(rows["kept_sha256"], pa.string()), pa.array(rows["spans"], pa.list_(pa.struct({"a": pa.int64(), "b": pa.int64()})))]
        yield pa.record_batch(out, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: id_col, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of byte ranges [a, b) to remove)."""
    if length < SEED_LENGTH + 8:
        raise ValueError(f"length must be at least {SEED_LENGTH + 8}")
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text")).withColumn("tail", F.hash("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    shared = rows.select("text").mapInArrow(_ranks(length), "rank long").groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rank")
    runs = rows.select("key", "tail", "text").mapInArrow(_stretches(length), "rank long, ext long, key long, tail int, start long, width int, lead int")
    live = scratch.write(runs.join(shared, "rank", "left_semi"), "live")

    stretches = scratch.write(live.groupBy("rank", "ext").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "tail", "start", "width", "lead")).alias("at")), "stretches")
    several = stretches.groupBy("rank").agg(F.count(F.lit(1)).alias("group")).filter("group > 1")
    todo = stretches.join(several, "rank").select("at.key", "at.tail", F.struct("rank", "ext", F.least("n", F.lit(2)).cast("int").alias("n"), "at.start", "at.width", "at.lead", "group").alias("item"))
    todo = todo.groupBy("key", "tail").agg(F.collect_list("item").alias("todo"))
    cut = rows.select("key", "tail", "text").join(todo, ["key", "tail"]).select("text", "todo").mapInArrow(_cut_out(length), "rank long, ext long, n int, lead int, shift int, part int, body binary")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = cut.repartition(width, "rank", "part").sortWithinPartitions("rank", "part").mapInArrow(_resolve(length), "rank long, ext long, lo int, hi int")
    decided = stretches.filter("n > 1").select("rank", "ext", F.lit(0).alias("lo"), (F.col("at.width") - 1).alias("hi"))
    repeated = scratch.write(partial.unionByName(decided), "repeated")

    spans = live.join(repeated, ["rank", "ext"]).select("key", "tail", F.struct((F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi") + length).alias("b")).alias("span"))
    spans = scratch.write(spans.groupBy("key", "tail").agg(F.collect_list("span").alias("spans")), "spans")
    scratch.drop("live", "stretches", "repeated")
    out = rows.join(spans, ["key", "tail"], "left").select("id", "text", "spans").mapInArrow(_removed, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>")
    return out.withColumnRenamed("id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every 200-byte string counted outright.
SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT r, i, md5(b[i:i + 199]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM t)),
twice AS (SELECT h FROM places GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 200 AS opens FROM places SEMI JOIN twice USING (h)),
runs AS (SELECT r, min(i) AS a, max(i) + 199 AS z FROM (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS k FROM starts) GROUP BY r, k),
lists AS (SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, CAST(sum(z - a + 1) AS BIGINT) AS n_removed FROM runs GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(len(a), 0) AS n_spans,
  sha256(CASE WHEN a IS NULL THEN b ELSE list_reduce(list_transform(range(len(a) + 1), lambda k: b[(CASE WHEN k = 0 THEN 1 ELSE z[k] + 1 END):(CASE WHEN k = len(a) THEN octet_length(b) ELSE a[k + 1] - 1 END)]), lambda x, y: x || y) END) AS kept_sha256
FROM t LEFT JOIN lists USING (r)
"""
