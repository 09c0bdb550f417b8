"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text becomes one flat array of symbols. It is cut into words where no piece can reach across (before a blank mark that
follows another character, and between characters that no piece holds side by side); the distinct words of a batch are
merged together: each round takes, per word, the best rank that a neighbouring pair has (a segmented minimum), merges its
occurrences from the left at once, closes the gaps, and goes on until no pair is left. Occurrences behind one whose
merge makes a pair that is as good or better wait for a later round, so the order is that of the library's queue. Runs of blank marks, whose
pieces all have the lowest score, are joined after all else. A character without a piece becomes its UTF-8 bytes.

Decoding gathers the pieces' bytes by id. Nothing is shuffled; tables are as large as the model.

Defined cases: a null text is an empty text and has no ids; the text of a control piece is ordinary text; blank marks in a
text come back as blanks; texts and words of any length are encoded whole (a word of n characters that no place cuts takes up to n rounds);
repeated rows and null identifiers are documents of their own; columns besides identifier and text do not matter; an
empty table gives an empty result; an id without a piece is a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestrings import packs, prefix_sums, ragged, span_hash
from .text import sha256_hex, whole

BLANK = "▁"
_NONE = np.int32(1 << 30)
_PACK = 1 << 20


class PieceModel:
    """A model file as arrays: pieces, ranks, and which two pieces make which."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        named = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_unknown(i) or model.is_control(i) for i in range(size)]
        self.byte_ids = np.zeros(256, np.int32)
        byte = [i for i in range(size) if model.is_byte(i)]
        for i in byte:
            self.byte_ids[int(named[i][3:5], 16)] = i
        places = {named[i]: i for i in range(size) if not special[i] and not model.is_byte(i)}
        whole_pieces = all(c in places for p in places for c in p) and not any(BLANK in p.lstrip(BLANK) for p in places)
        if len(byte) != 256 or any(map(model.is_unused, range(size))) or not whole_pieces or model.normalize("  Ａ b ") != f"{BLANK * 3}Ａ{BLANK}b{BLANK}":
            raise ValueError(f"{path}: not a BPE model with byte fallback, a blank mark in front and texts taken as they are")

        texts = [b"" if special[i] else bytes([int(named[i][3:5], 16)]) if model.is_byte(i) else named[i].replace(BLANK, " ").encode() for i in range(size)]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.blank_led = np.array([not model.is_byte(i) and named[i].startswith(BLANK) for i in range(size)])

        score = {i: model.get_score(i) for i in places.values()}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.full(size, _NONE, np.int32)
        for i, s in score.items():
            self.rank[i] = order[s]
        runs = {len(p): i for p, i in places.items() if not p.strip(BLANK)}
        worst = max(order.values())
        apart = all(self.rank[i] == worst for n, i in runs.items() if n > 1) and not any(p.startswith(BLANK * 2) and p.strip(BLANK) for p in places)
        self.runs = runs if apart else {}
        self.blank = places[BLANK]

        made = {}
        for p, i in places.items():
            if not (apart and not p.strip(BLANK)):
                made |= {places[p[:k]] * size + places[p[k:]]: i for k in range(1, len(p)) if p[:k] in places and p[k:] in places}
        self.size = size
        self.pair_keys = np.array(sorted(made), np.int64)
        self.pair_made = np.array([made[k] for k in sorted(made)], np.int32)
        chars = sorted((ord(p), i) for p, i in places.items() if len(p) == 1)
        self.char_points, self.char_ids = (np.array(x) for x in zip(*chars))
        together = {(ord(a), ord(b)) for p in places for a, b in zip(p, p[1:])}
        self.together = np.array(sorted((a << 21) + b for a, b in together), np.int64)
        self.plain_together = np.zeros((128, 128), bool)
        for a, b in together:
            if a < 128 and b < 128:
                self.plain_together[a, b] = True

    # ------------------------------------------------------------ encoding

    def _make(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, rank) that pairs of symbols make; rank _NONE if they make none."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == key
        piece = np.where(found, self.pair_made[at], -1)
        return piece, np.where(found, self.rank[piece], _NONE)

    def _word_starts(self, points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        a, b = points[:-1], points[1:]
        joined = self.plain_together[np.minimum(a, 127), np.minimum(b, 127)]
        wide = np.flatnonzero((a > 127) | (b > 127))
        key = (a[wide].astype(np.int64) << 21) + b[wide]
        joined[wide] = self.together[np.minimum(np.searchsorted(self.together, key), len(self.together) - 1)] == key
        cut = np.append(True, ~joined | ((b == ord(BLANK)) & (a != ord(BLANK))))
        if self.runs:
            cut[1:] &= ~((a == ord(BLANK)) & (b == ord(BLANK)))  # runs of blank marks stay whole
        cut[text_starts] = True
        return np.flatnonzero(cut)

    def _merge(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words that begin at starts, merged; and the number of symbols of each word."""
        n_words = len(starts)
        word = np.repeat(np.arange(n_words), np.diff(np.append(starts, len(sym))))
        piece, rank = self._pairs(sym, word, np.arange(len(sym)))
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(sym)))
            if (best == _NONE).any():
                over = np.repeat(best == _NONE, counts)
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, piece, rank = sym[~over], word[~over], piece[~over], rank[~over]
                best, counts = best[best < _NONE], counts[best < _NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, counts))
            # of occurrences that overlap, every second one
            run = np.append(True, np.diff(at) > 1)
            at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            new, own = piece[at], word[at]
            # what an occurrence would meet: on its left perhaps a piece of this round, on its right the symbol as it is
            before = np.append(-2, at[:-1]) == at - 2
            left = np.where(before, np.append(-1, new[:-1]), sym[at - 1])
            left = np.where((at > 0) & (word[at - 1] == own), left, -1)
            after = np.minimum(at + 2, len(sym) - 1)
            right = np.where((at + 2 < len(sym)) & (word[after] == own), sym[after], -1)
            sooner = np.minimum(self._make(left, new)[1], self._make(new, right)[1]) <= rank[at]
            passed = np.cumsum(sooner) - sooner
            head = np.append(True, own[1:] != own[:-1])
            at = at[passed == passed[np.flatnonzero(head)[np.cumsum(head) - 1]]]
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            sym, word, piece, rank = sym[keep], word[keep], piece[keep], rank[keep]
            changed = np.union1d(moved, np.maximum(moved - 1, 0))
            piece[changed], rank[changed] = self._pairs(sym, word, changed)
        out, of = np.concatenate([*done_sym, np.zeros(0, np.int32)]), np.concatenate([*done_word, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(of, kind="stable")
        return out[order], np.bincount(of, minlength=n_words)

    def _pairs(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(at + 1, len(sym) - 1)
        right = np.where((at + 1 < len(sym)) & (word[after] == word[at]), sym[after], -1)
        return self._make(sym[at], right)

    @lru_cache(maxsize=4096)  # noqa: B019  a few lengths
    def _run(self, n: int) -> np.ndarray:
        """Ids of n blank marks: equal scores, so what stands furthest left grows first."""
        most = 4 * max(self.runs)
        if n > most:  # the first piece is done before anything that far to the right is looked at
            head = self._run(most)[:1]
            width = next(k for k, i in self.runs.items() if i == head[0])
            times = (n - most) // width + 1
            return np.concatenate([np.repeat(head, times), self._run(n - times * width)])
        sizes = [1] * n
        while (k := next((k for k in range(len(sizes) - 1) if sizes[k] + sizes[k + 1] in self.runs), None)) is not None:
            sizes[k : k + 2] = [sizes[k] + sizes[k + 1]]
        return np.array([self.runs[s] for s in sizes], np.int32)

    def _finish(self, sym: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of blank marks joined, characters without a piece written as bytes."""
        word = np.repeat(np.arange(len(counts)), counts)
        swaps: list[tuple[int, int, np.ndarray]] = [(k, 1, self.byte_ids[list(chr(-1 - int(sym[k])).encode())]) for k in np.flatnonzero(sym < 0)]
        if self.runs:
            blank = sym == self.blank
            pair = np.flatnonzero(blank[1:] & blank[:-1] & (word[1:] == word[:-1]))
            if len(pair):
                head = np.append(True, np.diff(pair) > 1)
                length = np.diff(np.append(np.flatnonzero(head), len(pair))) + 1
                swaps += [(a, n, self._run(n)) for a, n in zip(pair[head].tolist(), length.tolist())]
        if not swaps:
            return sym, counts
        width, bodies = np.ones(len(sym), np.int64), []
        for a, n, ids in swaps:
            width[a : a + n] = 0
            width[a] = len(ids)
            bodies.append(ids)
        out = np.repeat(sym, width)
        begin = (np.cumsum(width) - width)[[a for a, _, _ in swaps]]
        out[ragged(begin, np.array([len(b) for b in bodies], np.int64))] = np.concatenate(bodies)
        return out, np.bincount(word, weights=width, minlength=len(counts)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        marked = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.int32)
        sizes = np.array([len(m) for m in marked], np.int64)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        begin = (np.cumsum(sizes) - sizes)[sizes > 0]
        start = self._word_starts(points, begin)
        end = np.append(start[1:], len(points))
        _, first, inverse = np.unique(span_hash(prefix_sums(points), start, end), return_index=True, return_inverse=True)
        # words of one hash are compared with the first of them; one that differs stands for itself
        length, model = end - start, first[inverse]
        odd = length != length[model]
        same = np.flatnonzero(~odd)
        differ = points[ragged(start[same], length[same])] != points[ragged(start[model[same]], length[same])]
        odd[same[np.repeat(np.arange(len(same)), length[same])[differ]]] = True
        own = np.concatenate([first, np.flatnonzero(odd)])
        inverse = inverse.copy()
        inverse[odd] = len(first) + np.arange(int(odd.sum()))

        letters = points[ragged(start[own], length[own])]
        at = np.minimum(np.searchsorted(self.char_points, letters), len(self.char_points) - 1)
        sym = np.where(self.char_points[at] == letters, self.char_ids[at], -1 - letters).astype(np.int32)
        ids, counts = self._finish(*self._merge(sym, np.cumsum(length[own]) - length[own]))
        offset = np.cumsum(counts) - counts
        per_text = np.add.reduceat(counts[inverse], np.searchsorted(start, begin)) if len(begin) else np.zeros(0, np.int64)
        totals = np.zeros(len(texts), np.int64)
        totals[sizes > 0] = per_text
        return ids[ragged(offset[inverse], counts[inverse])], totals

    # ------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray) -> str:
        """The pieces of a text's ids; the first loses the blank that stands for the beginning."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id without a piece")
        body = self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()
        return body[1 if len(ids) and self.blank_led[ids[0]] else 0 :].decode("utf-8", "replace")


def _encoded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in packs(np.array([len(t) for t in texts], np.int64), _PACK):
                ids, counts = model.value.encode(texts[i:j])
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                yield pa.record_batch([batch.column("id").slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=["id", "ids"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of piece ids) for every row."""
    model = docs.sparkSession.sparkContext.broadcast(PieceModel(path))  # fixed size
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole(F.col(f"`{text_col}`")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encoded(model), f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def _decoded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            texts = [model.value.decode(flat[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.record_batch([batch.column("id"), lists, pa.array(texts, pa.string())], names=["id", "ids", "text"])

    return run


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids, text_col from id_col, ids."""
    model = tokens.sparkSession.sparkContext.broadcast(PieceModel(path))
    rows = tokens.select(F.col(f"`{id_col}`").alias("id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_decoded(model), f"id {id_type}, ids array<int>, text string")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_model()
    tokens = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_hex(listed).alias("ids_sha256"), sha256_hex(F.col("text")).alias("decoded_sha256"))


SQL = None  # tests compare with the sentencepiece library
