import random

from pyspark.sql import functions as F

from sievework.llm import toxicity

from .fixtures import table


def test_very_long_words_and_marks(spark):
    model = toxicity.Model(["grumblefish"], [True], [0.9])
    long = ["a'" * 500_000 + "a", "@" * 1_000_000, "x" * 1_000_000 + " grumblefish", "'" * 1_000_000, '"' * 300_000, "b$" * 300_000]
    got = {r.doc_id: r.score for r in toxicity.score(table(spark, [(i, t, None, None, None) for i, t in enumerate(long)]), model).collect()}
    assert [i for i, s in got.items() if s > got[1]] == [2]


def test_words_of_a_text(spark):
    text = "It's 'quoted' $tupid! @@ ''' “no” d'o'nt'' f*** **A**"
    got = spark.createDataFrame([(text,)], "t string").select(toxicity.tokens(F.col("t"))).first()[0]
    assert got == ["it's", "quoted", "$tupid!", "“", "no", "”", "d'o'nt", "f***", "**a**"]


def edits(a, b):
    """Distance with insertions, deletions, substitutions and swaps of neighbours."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_matcher_against_plain_edit_distance():
    draw = random.Random(8)
    terms = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(4, 7))) for _ in range(60)})
    trie, every, lengths = toxicity.Trie(terms), [True] * len(terms), [len(t) for t in terms]
    for _ in range(4000):
        word = "".join(draw.choice("abcd") for _ in range(draw.randint(3, 8)))
        assert trie.exact(word, every) == (terms.index(word) if word in terms else -1)
        if word in terms:
            continue
        close = {k for k, t in enumerate(terms) if len(t) >= toxicity.EDIT_FROM and edits(word, t) == 1}
        found = trie.near(word, every, lengths)
        assert (found in close) if close else found == -1, (word, found, close)
