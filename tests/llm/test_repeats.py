import hashlib
from collections import Counter

import pytest

from sievework.llm.repeats import find_repeats

from .fixtures import rows, table


def outright(data, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in data]
    count = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [40, 200])
def test_against_every_string(spark, length):
    data = rows(150)
    got = sorted(tuple(r)[:5] for r in find_repeats(table(spark, data), length=length).collect())
    assert got == outright(data, length)


def test_large_groups_are_dealt_by_offset(spark, monkeypatch):
    from sievework.llm import repeats

    data = rows(60, seed=3)
    monkeypatch.setattr(repeats, "_HOT", 0)
    got = sorted(tuple(r)[:5] for r in repeats.find_repeats(table(spark, data), length=40).collect())
    assert got == outright(data, 40)


def test_empty_table_and_short_length(spark):
    assert find_repeats(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        find_repeats(table(spark, []), length=10)
