"""Byte-level BPE encoding and decoding over a table of distinct words.

Spark splits the texts into words (a word here is a piece of the tokenizer's own pre-tokenisation), counts them and writes
a table of distinct words. The most frequent ones, up to a fixed number and size, are encoded once and travel to all tasks; words
beyond these are encoded once per batch of texts that has them. The ids go back to the words of a text by position.
Decoding looks each id up among the vocabulary's pieces, a table of fixed size that every task has.

Defined cases: a null text is an empty text and has no tokens; the text of a special token is that token, as in the
tokenizers library; words of any length are encoded whole; repeated rows and null identifiers are documents of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestrings import ragged
from .scratch import Scratch
from .text import whole

#: The white space of the pre-tokenisation, and its word pattern.
_WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"

MOST_WORDS, MOST_BYTES = 1 << 18, 1 << 24
#: Words that the tokenizers library gets in one call.
AT_ONCE = 4096


class Vocabulary:
    """The pieces of a tokenizer file: bytes by id, special tokens, and the tokenizer itself on each worker."""

    def __init__(self, path: str):
        self.definition = Path(path).read_text()
        parts = json.loads(self.definition)
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        table = parts["model"]["vocab"] | self.special
        back = _byte_of_letter()
        pieces: list[bytes] = [b""] * (max(table.values()) + 1)
        for piece, i in table.items():
            pieces[i] = piece.encode() if piece in self.special else bytes(back[c] for c in piece)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._tokenizer = None

    def __getstate__(self):
        return self.__dict__ | {"_tokenizer": None}

    def encode_words(self, words: list[str]) -> list[list[int]]:
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_str(self.definition)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
        out: list[list[int]] = []
        for i in range(0, len(words), AT_ONCE):  # the library returns far more than ids for each word
            out += [e.ids for e in self._tokenizer.encode_batch(words[i : i + AT_ONCE], add_special_tokens=False)]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined bytes of ids, and each id's number of bytes."""
        lengths = self.lengths[ids]
        return self.bytes[ragged(self.starts[ids], lengths)], lengths


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes each byte as a letter: printable ones as themselves, the others from 256 up, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def split_words(text: Column, special: list[str]) -> Column:
    """The words of a text in order, special tokens as words of their own."""

    def pieces(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))

    out = pieces(text)
    for token in special:
        around = F.split(text, rf"\Q{token}\E")
        marked = F.transform(around, lambda x, i: F.when(i == 0, pieces(x)).otherwise(F.concat(F.array(F.lit(token)), pieces(x))))
        out = F.when(F.contains(text, F.lit(token)), F.flatten(marked)).otherwise(out)
    return out


def _encode_each(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = vocabulary.value.encode_words(batch.column("word").to_pylist())
            yield pa.record_batch([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def word_table(docs: DataFrame, vocabulary, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """word, n: every distinct word of the corpus with its count."""
    special = sorted(vocabulary.value.special)
    words = docs.select(F.explode(split_words(whole(F.col(text_col)), special)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return scratch.write(words, "words")


def most_frequent(counted: DataFrame, most_words: int, most_bytes: int) -> Column:
    """A test that at most most_words words of at most most_bytes bytes in all pass, frequent words first.

    Words fall into classes of about equal counts (eight to each doubling, without a last one); the class that is not taken whole is
    taken by the words' hashes. Two histograms of fixed size reach the driver; no word does.
    """
    level, spot = F.floor(F.log2("n") * 8).cast("int"), F.pmod(F.xxhash64("word"), F.lit(4096)).cast("int")

    def taken(rows: DataFrame, name: str, upwards: bool) -> tuple[int | None, int, int]:
        """(the first class that does not fit, or None; words and bytes that are left)."""
        left_words, left_bytes = most_words, most_bytes
        for r in sorted(rows.collect(), key=lambda r: r[name] if upwards else -r[name]):
            if r["words"] > left_words or r["bytes"] > left_bytes:
                return r[name], left_words, left_bytes
            left_words, left_bytes = left_words - r["words"], left_bytes - r["bytes"]
        return None, left_words, left_bytes

    size = [F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word")).alias("bytes")]
    edge, most_words, most_bytes = taken(counted.groupBy(level.alias("level")).agg(*size), "level", False)
    if edge is None:
        return F.lit(True)
    cut, _, _ = taken(counted.filter(level == edge).groupBy(spot.alias("spot")).agg(*size), "spot", True)
    return (level > edge) | ((level == edge) & (spot < (4096 if cut is None else cut)))


class _Table:
    """Encoded words as flat arrays, and where each word stands; the lookup is built once per worker."""

    def __init__(self, table: pa.Table):
        self.words = table.column("word").combine_chunks()
        ids = table.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        self.flat = ids.flatten().to_numpy()
        self.lengths = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self._place: dict[str, int] | None = None

    def places(self, words: list[str]) -> np.ndarray:
        """Position of each word, -1 for words that are not in the table."""
        if self._place is None:
            self._place = {w: k for k, w in enumerate(self.words.to_pylist())}
        place = self._place
        return np.fromiter((place.get(w, -1) for w in words), np.int64, len(words))


def _apply(vocabulary, table):
    """Rows with words to rows with ids: only words that the table lacks are encoded here, once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Table = table.value
        for batch in batches:
            lists = batch.column("words")
            offsets = lists.offsets.to_numpy()
            coded = lists.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            place = known.places(distinct)
            missing = place < 0
            extra = vocabulary.value.encode_words([distinct[k] for k in np.flatnonzero(missing).tolist()])
            # of the batch's distinct words: where their ids start, in the table or behind it, and how many they are
            own = np.array([len(x) for x in extra], np.int64)
            lengths, starts = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            lengths[~missing], starts[~missing] = known.lengths[place[~missing]], known.starts[place[~missing]]
            lengths[missing], starts[missing] = own, len(known.flat) + np.cumsum(own) - own
            added = np.array([i for x in extra for i in x], np.int32)
            words = coded.indices.to_numpy()
            # by parts: what a very long text's ids take stays in proportion to that text
            at = np.append(0, np.cumsum(lengths[words]))[offsets - offsets[0]]
            step, ids = 1 << 20, [np.zeros(0, np.int32)]
            for w in (words[i : i + step] for i in range(0, len(words), step)):
                from_ = ragged(starts[w], lengths[w])
                behind = from_ >= len(known.flat)
                part = np.empty(len(from_), np.int32)
                part[~behind], part[behind] = known.flat[from_[~behind]], added[from_[behind] - len(known.flat)]
                ids.append(part)
            yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate(ids), pa.int32()))], names=["id", "ids"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES, then=None) -> DataFrame:
    """id_col, ids (array of token ids) for every row.

    then: (make, columns) where make(vocabulary) gives a function on batches of id and ids, and columns are those it returns, in place of ids. It runs
    in the tasks that encode, so ids go to no second Python worker with a vocabulary of its own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    vocabulary = spark.sparkContext.broadcast(Vocabulary(path))  # fixed size
    counted = word_table(docs, vocabulary, scratch, text_col)
    # At most most_words words and most_bytes bytes of words: the size that is broadcast is bounded whatever the corpus.
    often = counted.filter(F.col("n") > 1)
    frequent = often.filter(most_frequent(often, most_words, most_bytes)).select("word")
    encoded = frequent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_encode_each(vocabulary), "word string, ids array<int>")
    table = spark.sparkContext.broadcast(_Table(encoded.toArrow()))
    rows = docs.select(F.col(id_col).alias("id"), split_words(whole(F.col(text_col)), sorted(vocabulary.value.special)).alias("words"))
    id_type = rows.schema["id"].dataType.simpleString()
    apply, columns = _apply(vocabulary, table), "ids array<int>"
    if then:
        make, columns = then
        apply = _in_turn(apply, make(vocabulary))
    return rows.mapInArrow(apply, f"id {id_type}, {columns}").withColumnRenamed("id", id_col)


def _in_turn(first, second):
    return lambda batches: second(first(batches))


def _decoded(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            off, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            texts = [vocabulary.value.decode(flat[a:b])[0].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.record_batch([batch.column("id"), pa.array(texts, pa.large_string()).cast(pa.string())], names=["id", "text"])

    return run


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, text from id_col, ids: the pieces of the ids, in order. Null ids are none."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(Vocabulary(path))
    rows = tokens.select(F.col(id_col).alias("id"), "ids")
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_decoded(vocabulary), f"id {id_type}, text string").withColumnRenamed("id", id_col)


def _digests(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            off, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            n, ids_sha, text_sha = [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                own = flat[a:b]
                n.append(b - a)
                ids_sha.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(vocabulary.value.decode(own)[0].tobytes().decode("utf-8", "replace").encode()).hexdigest())
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, default_vocabulary(), then=(_digests, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


SQL = None  # tests compare with the tokenizers library
