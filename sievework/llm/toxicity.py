"""Toxicity by a learned lexicon, matched with Levenshtein automata.

fit() learns from labelled documents which words, and which beginnings of words, go with the label, and keeps those that do
so beyond chance. Terms are judged by their shares of the toxic and of the clean texts, so how many of the labels are toxic
does not matter. Scoring splits texts into words, and runs each distinct word of a batch once through the lexicon's trie,
intersected with the automaton of its misspellings (one edit anywhere, from EDIT_FROM letters on; marks at a word's edges count
as letters if that gives a term). Misspellings that the clean labelled texts have are ordinary words and give no hits. Hits are told apart by kind and
context: plain, misspelled, and quoted (inside quotation marks or after a word of speech within the window). A logistic
regression over how much of each kind a text has, over its distinct terms and their density gives the score.

Bounds: fit() uses at most most_rows labelled documents, drawn by a hash of the identifier; of these, texts of the same words
count once. The lexicon has at most most_terms terms.

Defined cases: null and empty texts get the score of texts without hits; labels without a document, null labels and null identifiers are
not learned from; if a document, or a text of the same words, has several labels it counts as toxic if any is 1; without usable labels, or if no term
goes with them, every score is the prior's, about 0.1; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import whole

MOST_ROWS, MOST_TERMS, SHORTEST, LONGEST, EDIT_FROM, WINDOW = 20_000, 2_000, 4, 8, 4, 6
#: A term is kept if chance alone gives as much less than once in 10**CHANCE; most_rows documents have some 10**6 words and beginnings.
CHANCE = 6.5
#: Terms are judged as if this share of the texts were toxic; the prior's score.
USUAL = 0.1
#: Marks that stand for letters, inside a word or at its edges.
MARKS = "@$!*"
QUOTES = frozenset("\"“”„«»‹›")
#: Words after which something is reported rather than said.
SPEECH = frozenset("said says called calls quote quoted word term insult sagte nannte wort dit appelle mot dijo llama palabra".split())


def tokens(text: Column) -> Column:
    """Lower-case words (letters and digits, with @ $ ! * ' inside them, the first four at their edges too) and quotation marks, in
    order. A run of such letters and marks is one loop of the pattern, so it may be as long as it likes."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[@$!*'\p{L}\p{N}]++|[\"“”„«»‹›]"), F.lit(0))
    words = F.transform(runs, lambda w: F.trim(w, F.lit("'")))
    return F.filter(words, lambda w: F.rlike(w, F.lit(r"[\p{L}\p{N}\"“”„«»‹›]")))


def held_out(id_col: str) -> Column:
    """One identifier in five, by the checksum of its digits; never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most_rows: int) -> DataFrame:
    """id, text, label of at most about most_rows labelled documents that are not held out."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("lid")).agg(F.max(F.col(label).cast("int")).alias("label"))
    n = usable.count()
    # Drawn by hash: the same rows in every run. One in a million of the hash space is the grain.
    share = 1.0 if n <= most_rows else most_rows / n
    drawn = usable.filter(F.pmod(F.xxhash64("lid"), F.lit(1_000_000)) < int(share * 1_000_000))
    # about most_rows identifiers and labels: small whatever the corpus, so no text is shuffled
    return docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("lid")).select("id", "text", "label")


class Trie:
    """Terms as a trie, walked together with the automaton of at most one edit."""

    def __init__(self, terms: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        for k, term in enumerate(terms):
            at = 0
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                at = self.next[at][c]
            self.ends[at] = k

    def exact(self, word: str, whole_terms: list[bool]) -> int:
        """The term that the word is, or begins with; the longest, else -1."""
        at, best = 0, -1
        for i, c in enumerate(word):
            at = self.next[at].get(c, -1)
            if at < 0:
                return best
            k = self.ends.get(at)
            if k is not None and (not whole_terms[k] or i == len(word) - 1):
                best = k
        return best

    def near(self, word: str, whole_terms: list[bool], lengths: list[int]) -> int:
        """A term within one edit (insertion, deletion, substitution, swap of neighbours) of the word or its beginning.

        States are (node, letters read, edits); at a term's node the word, or the part read, is accepted.
        """
        n = len(word)
        stack, seen = [(0, 0, 0)], set()
        best = -1
        while stack:
            state = stack.pop()
            if state in seen:
                continue
            seen.add(state)
            at, i, e = state
            k = self.ends.get(at)
            if k is not None and e and lengths[k] >= EDIT_FROM and (i == n or not whole_terms[k]) and k > best:
                best = k
            if k is not None and not e and lengths[k] >= EDIT_FROM and i == n - 1 and whole_terms[k]:
                best = max(best, k)  # one letter too many at the end
            edges = self.next[at]
            if i < n and word[i] in edges:
                stack.append((edges[word[i]], i + 1, e))
            if e:
                continue
            # One edit, only where the next letter goes on or a term ends.
            if i + 1 < n and word[i + 1] in edges:
                stack.append((at, i + 1, 1))
            for c, to in edges.items():
                ends, after = to in self.ends, self.next[to]
                if ends or (i < n and word[i] in after):
                    stack.append((to, i, 1))
                if i < n and c != word[i] and (ends or (i + 1 < n and word[i + 1] in after)):
                    stack.append((to, i + 1, 1))
            if i + 1 < n and word[i + 1] in edges and word[i] in self.next[edges[word[i + 1]]]:
                stack.append((self.next[edges[word[i + 1]]][word[i]], i + 2, 1))
        return best


#: What features are worth before any label is seen: plain hits most, misspelled ones less, quoted ones least.
PRIOR = (-2.2, 1.0, 0.6, 0.3, 0.5, 0.5)


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    whole_terms: list[bool] = field(default_factory=list)
    sure: list[float] = field(default_factory=list)  # share of toxic documents among those with the term, were USUAL of all toxic
    weight: list[float] = field(default_factory=lambda: list(PRIOR))  # of Matcher.features
    ordinary: frozenset[str] = frozenset()  # words one edit from a term that are no misspellings of it

    def matcher(self) -> "Matcher":
        return Matcher(self)


class Matcher:
    """A model with its trie and the words seen so far, a bounded number."""

    def __init__(self, model: Model):
        self.model, self.trie = model, Trie(model.terms)
        self.lengths = [len(t) for t in model.terms]
        self.known: dict[str, tuple[int, bool]] = {}

    def word(self, word: str) -> tuple[int, bool]:
        """(term or -1, misspelled)."""
        found = self.known.get(word)
        if found is None:
            k, wrong = self.trie.exact(word.strip(MARKS), self.model.whole_terms), False
            if k < 0:
                k, wrong = next(((near, True) for form, near in self.misspelled(word) if form not in self.model.ordinary), (-1, False))
            found = k, wrong
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = found
        return found

    def misspelled(self, word: str) -> Iterator[tuple[str, int]]:
        """(form, term) of the word with and without marks at its edges, where that is one edit from a term."""
        for form in dict.fromkeys((word, word.rstrip(MARKS), word.strip(MARKS))):
            k = self.trie.near(form, self.model.whole_terms, self.lengths) if len(form) >= EDIT_FROM - 1 else -1
            # marks after a beginning are not read
            if k >= 0 and (form[-1] not in MARKS or self.model.whole_terms[k]):
                yield form, k

    def hits(self, batch: pa.ListArray) -> Iterator[tuple[int, int, bool, bool]]:
        """(row, term, misspelled, quoted) of every hit."""
        off = batch.offsets.to_numpy() - batch.offsets[0].as_py()
        coded = batch.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        term = np.full(len(words) + 1, -1, np.int64)
        wrong = np.zeros(len(words) + 1, bool)
        for i, w in enumerate(words):
            term[i], wrong[i] = self.word(w)
        marks = np.array([w in QUOTES for w in words], bool)
        speech = np.array([w.strip(MARKS) in SPEECH for w in words], bool)
        index = coded.indices.to_numpy().astype(np.int64)
        at = np.flatnonzero(term[index] >= 0) if len(index) else np.zeros(0, np.int64)
        rows = np.searchsorted(off, at, side="right") - 1
        for p, r in zip(at.tolist(), rows.tolist()):
            a, b = max(int(off[r]), p - WINDOW), min(int(off[r + 1]), p + WINDOW + 1)
            around = index[a:b]
            quoted = bool(marks[around[: p - a]].any() and marks[around[p - a + 1 :]].any()) or bool(speech[around[: p - a]].any())
            yield r, int(term[index[p]]), bool(wrong[index[p]]), quoted

    def features(self, batch: pa.ListArray) -> np.ndarray:
        """Per row: 1, and by kind of hit (plain, misspelled, quoted) how much of it, on a log scale; distinct terms; density."""
        n = np.maximum(1, np.diff(batch.offsets.to_numpy()))
        amount = np.zeros((len(batch), 3))
        distinct: dict[int, set[int]] = defaultdict(set)
        for r, k, wrong, quoted in self.hits(batch):
            p = self.model.sure[k]
            amount[r, 2 if quoted else 1 if wrong else 0] += max(0.2, math.log(p / (1 - p)) / 3)
            if not wrong and not quoted:
                distinct[r].add(k)
        terms = np.array([min(10, len(distinct.get(r, ()))) for r in range(len(batch))]) / 3
        return np.column_stack([np.ones(len(batch)), np.log1p(amount), terms, np.log1p(200 * amount[:, 0] / n)])

    def scores(self, batch: pa.ListArray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(batch) @ np.array(self.model.weight), -30, 30)))


def regress(x: np.ndarray, y: np.ndarray, start: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; coefficients are pulled towards those of start."""
    b = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull * np.eye(len(b)), x.T @ (y - p) - pull * (b - start))
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, whole, toxic, clean: in how many documents of the task a word, or a beginning of a word, occurs."""
    found: dict[tuple[str, bool], list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for words, label in zip(batch.column("words").to_pylist(), batch.column("label").to_pylist()):
            own = {w.strip(MARKS) for w in words}
            terms = {(w, True) for w in own if len(w) >= 3} | {(w[:k], False) for w in own for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}
            for t in terms:
                found[t][0 if label else 1] += 1
    keys = list(found)
    yield pa.record_batch([pa.array([t for t, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.bool_()), pa.array([found[t][0] for t in keys], pa.int64()), pa.array([found[t][1] for t in keys], pa.int64())], names=["term", "whole", "toxic", "clean"])


def _forms(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """form, toxic, clean: in how many texts of the task a form occurs that is one edit from a term and no term itself."""
        matcher = model.value.matcher()
        found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for words, label in zip(batch.column("words").to_pylist(), batch.column("label").to_pylist()):
                wrong = [w for w in set(words) if matcher.word(w)[1]]
                for form in {form for w in wrong for form, _ in matcher.misspelled(w)}:
                    found[form][0 if label else 1] += 1
        yield pa.record_batch([pa.array(list(found), pa.string()), pa.array([t for t, _ in found.values()], pa.int64()), pa.array([c for _, c in found.values()], pa.int64())], names=["form", "toxic", "clean"])

    return run


def _features(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.value.matcher()
        for batch in batches:
            x = matcher.features(batch.column("words"))
            yield pa.record_batch([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("label")], names=["x", "label"])

    return run


def sure(t: float, c: float, toxic: float, clean: float) -> float:
    """Share of toxic texts among those with a term, were USUAL of all toxic; t of the toxic and c of the clean texts have it."""
    a, b = USUAL * t / max(1, toxic), (1 - USUAL) * c / max(1, clean)
    return a / (a + b) if a + b else 0.0


def log_chance(t: int, c: int, toxic: int, clean: int) -> float:
    """log10 of the chance to find t or more toxic ones among t+c texts drawn from all (hypergeometric); its tail is bounded by a geometric series."""

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    more = (toxic - t) * c / ((t + 1) * (clean - c + 1))  # how much less likely one more is
    if more >= 1:
        return 0.0
    return min(0.0, (choose(toxic, t) + choose(clean, c) - choose(toxic + clean, t + c) - math.log1p(-more)) / math.log(10))


def choose_terms(rows: list, toxic: int, clean: int, most_terms: int) -> Model:
    """Terms that go with the label beyond chance; a longer one only where it says as much as each shorter one.

    Of equal ones the longest is taken: fewer ordinary words are one edit from it.
    """
    candidates = []
    for term, is_whole, t, c in rows:
        if sure(t, c, toxic, clean) < 0.5:
            continue
        chance = log_chance(t, c, toxic, clean)
        if chance < -CHANCE:
            candidates.append((chance, term, is_whole, t, c))
    model = Model()
    taken: list[tuple[str, bool]] = []
    for _, term, is_whole, t, c in sorted(candidates, key=lambda x: (x[0], -len(x[1]), x[1], x[2])):
        if any(term.startswith(a) and not w or (a.startswith(term) and not is_whole) or (a == term) for a, w in taken):
            continue
        taken.append((term, is_whole))
        model.terms.append(term), model.whole_terms.append(is_whole), model.sure.append(sure(t + 0.5, c + 0.5, toxic + 1, clean + 1))
        if len(taken) >= most_terms:
            break
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS, most_terms: int = MOST_TERMS) -> Model:
    from .scratch import Scratch

    scratch = Scratch(docs.sparkSession, "toxicity")
    words = labelled(docs, labels, label, id_col, text_col, most_rows).select("label", tokens(F.col("text")).alias("words"))
    # at most about most_rows texts are shuffled, whatever the corpus; copies meet before that in each task
    rows = scratch.write(words.groupBy("words").agg(F.max("label").alias("label")).select("label", "words"), "labelled")
    sizes = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    if not sizes["n"]:
        return Model()
    counted = rows.mapInArrow(_counts, "term string, whole boolean, toxic long, clean long").groupBy("term", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    toxic, clean = sizes["toxic"], sizes["n"] - sizes["toxic"]
    ahead = F.col("toxic") * (USUAL / max(1, toxic)) - F.col("clean") * ((1 - USUAL) / max(1, clean))
    counted = counted.filter((F.col("toxic") >= 3) & (ahead > -1e-9))  # choose_terms draws the exact line
    best = [tuple(r) for r in counted.collect()]  # of the words of about most_rows texts, those with the label
    model = choose_terms(best, toxic, clean, most_terms)
    if not model.terms:
        scratch.drop("labelled")
        return model
    handle = docs.sparkSession.sparkContext.broadcast(model)
    # at most the words of about most_rows texts that are one edit from a term
    forms = rows.mapInArrow(_forms(handle), "form string, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("clean > 0").collect()
    ordinary = {r.form: r.clean for r in forms if sure(r.toxic, r.clean, toxic, clean) < 0.5}
    # What one clean text alone has still counts for the weights: the words of texts not seen here are like that.
    model.ordinary = frozenset(form for form, c in ordinary.items() if c > 1)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    seen = rows.mapInArrow(_features(handle), "x array<double>, label int").toArrow()  # at most about most_rows rows of six numbers
    model.weight = regress(np.array(seen.column("x").to_pylist()), seen.column("label").to_numpy().astype(float), np.array(PRIOR)).tolist()
    model.ordinary = frozenset(ordinary)
    scratch.drop("labelled")
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score for every row of docs."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # at most most_terms terms
    rows = docs.select(F.col(id_col).alias("id"), tokens(whole(F.col(text_col))).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = handle.value.matcher()
        for batch in batches:
            yield pa.record_batch([batch.column("id"), pa.array(matcher.scores(batch.column("words")))], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def below(docs: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of docs that score less than limit, with their columns, whatever their names; nothing is joined or shuffled."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("row"), tokens(whole(F.col(text_col))).alias("words"))
    schema = T.StructType([rows.schema["row"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = handle.value.matcher()
        for batch in batches:
            yield batch.select(["row"]).filter(pa.array(matcher.scores(batch.column("words")) < limit))

    return rows.mapInArrow(run, schema).select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)))


def spans(text_words: list[str], model: Model) -> list[tuple[int, str, bool, bool]]:
    """(word position, term, misspelled, quoted) of the hits in one text, for inspection."""
    matcher = model.matcher()
    out = []
    for i, w in enumerate(text_words):
        k, wrong = matcher.word(w)
        if k >= 0:
            around = [x.strip(MARKS) for x in text_words[max(0, i - WINDOW) : i]], text_words[i + 1 : i + 1 + WINDOW]
            out.append((i, model.terms[k], wrong, bool(QUOTES & set(around[0]) and QUOTES & set(around[1])) or bool(SPEECH & set(around[0]))))
    return out


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL = None  # tests use planted terms and held-out labels
