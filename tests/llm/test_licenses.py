import random
import re

from sievework.llm import licenses

from .fixtures import rows, table


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def outright(data):
    """(id, license) with a stretch of twice the template's words that holds 0.8 of its shingles."""
    out = set()
    for i, t, *_ in data:
        g = grams(words(t))
        for name, body in licenses.TEMPLATES.items():
            want = set(grams(words(body)))
            n = len(words(body))
            if set(g) & want and any(len(want & set(g[a : a + n + 2])) >= 0.8 * len(want) for a in range(len(g))):
                out.add((i, name))
    return out


def test_planted(spark):
    draw = random.Random(1)
    data = rows(40)
    for k, (name, body) in enumerate(sorted(licenses.TEMPLATES.items())):
        w = [f"w{draw.randrange(500)}" for _ in range(300)]
        for gap in (0, 7, 33, 150, 300):
            data.append((1000 + 400 * k + gap, " ".join([*w[:gap], body.upper() if gap == 7 else body, *w[gap:]]), None, None, None))
        broken = body.split(" ")
        broken[len(broken) // 2 :: 2] = ["x"] * len(broken[len(broken) // 2 :: 2])
        data.append((9000 + k, " ".join(broken), None, None, None))
        if len(body.split()) > 60:  # one changed word still leaves 0.8 of a long notice
            w = body.split(" ")
            w[len(w) // 2] = "changed"
            data.append((9500 + k, " ".join(w), None, None, None))
    got = {(r.doc_id, r.license) for r in licenses.scan(table(spark, data)).collect()}
    assert got == outright(data)
    assert len(got) >= 5 * len(licenses.TEMPLATES)


def test_positions_and_empty(spark):
    text = "a b c " + licenses.TEMPLATES["MIT-line"] + " d e"
    r = licenses.scan(table(spark, [(1, text, None, None, None)])).collect()
    assert [tuple(x) for x in r] == [(1, "MIT-line", 1.0, 3, 7)]
    assert licenses.scan(table(spark, [])).count() == 0


def test_gnu_licenses_are_told_apart(spark):
    body = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU{1} General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    data = [(1, body.format("program", "")), (2, body.format("library", " Lesser")), (3, body.format("program", " Affero"))]
    got = {(r.doc_id, r.license) for r in licenses.scan(table(spark, [(i, t, None, None, None) for i, t in data])).collect()}
    assert got == {(1, "GPL-notice"), (2, "LGPL-notice"), (3, "AGPL-notice")}
