"""Small document tables for the tests: made of few words, so that much repeats."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n=120, seed=1, words=40):
    """Random texts, near and exact copies, empty, null and long ones, one repeated row."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 9))) for _ in range(300)]
    texts = []
    for i in range(n):
        kind = i % 6
        if kind < 3 or not texts:
            text = " ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, words * 3)))
        elif kind == 3:
            text = draw.choice(texts)
        elif kind == 4:
            w = draw.choice(texts).split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            text = " ".join(w)
        else:
            a, b = draw.choice(texts), draw.choice(texts)
            text = a[: len(a) // 2] + "\n\t" + b[len(b) // 3 :]
        texts.append(text)
    texts[5], texts[7], texts[8], texts[9] = "", " \t\n", "one", "One  TWO\n"
    texts[11] = "ab " * 3000
    out = [(3 * i, t, "en", f"s{i % 4}" if i % 9 else None, len(t)) for i, t in enumerate(texts)]
    out[20] = (60, None, None, "s1", None)
    return out + [out[12]]


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)
