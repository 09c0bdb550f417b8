"""Repair against a plain shortest-path search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from sievework.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string, symbols string, part int"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines) of (role, text, fault) rows."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(rows) and q in ("", "a"):
            return cost, audit, "\n".join(lines)
        for r in "ua":
            if (q, r) in AFTER:
                heapq.heappush(heap, (cost + 3, audit + "I", i, AFTER[q, r], (*lines, f"{NAMES[r]}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if (q, role[:1]) in AFTER:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, AFTER[q, role[:1]], (*lines, f"{role}:{text}")))
                for r in "ua":
                    if (q, r) in AFTER:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, AFTER[q, r], (*lines, f"{NAMES[r]}:{text}")))


def expected(conv_id, rows):
    """The report of one conversation from its (turn, role, text) rows."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], sha(r[2])))
    seen, marked = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    count = lambda f: sum(x == f for _, _, x in marked)
    illegal = sum(len(a) == 0 or a[:1] + b[:1] not in ("su", "ua", "au") for (a, _, _), (b, _, _) in zip(marked, marked[1:]))
    cost, audit, lines = cheapest(marked)
    return (conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha(lines))


def table(seed, n=60, longest=12):
    draw, out = random.Random(seed), []
    for c in range(n):
        for t in range(draw.randint(1, longest)):
            role = draw.choice(["user", "assistant"]) if draw.random() < 0.3 else ["user", "assistant"][t % 2] if t or draw.random() < 0.7 else "system"
            role = draw.choice([None, "", "tool", "User", "üser", "uncle"]) if draw.random() < 0.06 else role
            text = draw.choice(["Yes.", "No!\n", "so", "é?", " \t\n", "", None, "Hm. ", "a b.c", "x" * 70 + draw.choice("ab") + ".", ".", "\x0b"])
            turn = draw.choice([None, t, t, t, t, t + 3, max(0, t - 1)])
            out.append((c if c else None, turn, role, text))
    return out + out[5:9] + [(777, None, "user", "Same.")] * 30 + [(778, t, "user", "Same.") for t in range(25)]


def groups(rows):
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(tuple(rest))
    return by


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("block,size", [(1, 1 << 20), (3, 1 << 20), (1024, 40), (1024, 1 << 20)])
def test_like_a_search(spark, block, size):
    rows = table(block)
    got = conv.report(conv.repair(frame(spark, rows), block_rows=block, block_bytes=size)).collect()
    assert order(map(tuple, got)) == order(expected(c, r) for c, r in groups(rows).items())


def test_one_conversation_over_many_tasks(spark):
    """Hot conversation, hot copies: rows of one turn and text lie in several tasks."""
    draw = random.Random(5)
    rows = [(1, draw.randint(0, 400), draw.choice(["user", "assistant"]), draw.choice(["Same.", "Other", "!"])) for _ in range(700)] + [(1, 7, "user", "Same.")] * 900 + [(2, 0, "user", "Hi.")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = conv.repair(frame(spark, rows), block_rows=64)
        assert pieces.filter("conv_id = 1").select("part").distinct().count() > 1
        got = conv.report(pieces).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert order(map(tuple, got)) == order(expected(c, r) for c, r in groups(rows).items())


def test_repaired_rows_follow_the_pattern(spark):
    rows = table(9, 30)
    pieces = conv.repair(frame(spark, rows), block_rows=2).collect()
    by = {}
    for p in sorted(pieces, key=lambda p: (p.part, p.block)):
        by.setdefault(p.conv_id, []).extend(r.role[:1] for r in p.rows)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r)) for r in by.values())


def test_query(spark, tmp_path):
    rows = table(11, 40) + [(5000 + i, 0, "user", "One.") for i in range(60)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = conv.op11_conversation_repair(spark, str(tmp_path)).collect()
    damaged = {c: [] for c in groups(rows)}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        damaged[c] += [(turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    assert order(map(tuple, got)) == order(expected(c, r) for c, r in damaged.items())


def test_empty_table(spark):
    assert conv.report(conv.repair(frame(spark, [], 1))).count() == 0
