import hashlib
import re

from sievework.llm import fill_middle as fim

from .fixtures import rows, table

TEXTS = ["a", "é", "<P>", "x<S>y", "<P", "<M", "one two", "a" * 300 + "1", ("ab1 " * 1000)[:-1], "🙂 é\n\r\t ", "1" * 256, "1" * 255, "1" * 512, "w " * 256, "x9\n" * 40000, "<<P" + "q " * 30, "S> M> <S", "\x00\x01"]


def expected(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, text)
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 20
    return (i, n, "spm" if spm else "psm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}" if spm else f"<P>{x}<S>{z}<M>{y}")


def data():
    out = rows(60) + [(2000 + 7 * k + j, t, None, None, None) for j, t in enumerate(TEXTS) for k in range(4)]
    return out + [(None, "no id here", None, None, None), (None, "no id here", None, None, None), (5, "same id", None, None, None), (5, "same id, other text 1 2 3", None, None, None)]


def order(rows_):
    return sorted(rows_, key=lambda r: tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in r))


def test_like_brute_force(spark):
    made = fim.fill_in_middle(table(spark, data())).collect()
    assert order(tuple(r) for r in made) == order(expected(i, t) for i, t, *_ in data())


def test_restores_whole_texts_and_ignores_other_columns(spark, tmp_path):
    docs = table(spark, data()).withColumnRenamed("lang", "file").withColumnRenamed("source", "place").withColumnRenamed("n_chars", "n")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = fim.op12_fill_middle(spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*expected(i, t)[:5], sha(expected(i, t)[5]), sha(t or "")) for i, t, *_ in data()]
    assert order(tuple(r) for r in made) == order(want)


def test_empty_table(spark):
    assert fim.fill_in_middle(table(spark, [])).count() == 0
