import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from gramlaw.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in own.items()}
    members, ending = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        path = (*own.get(base, [])[:h], *turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ending[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + (len(members[p]) - 1) * words
        digest = hashlib.sha256(",".join(map(str, sorted(ending[p]))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], digest))
    return sorted(out, key=str)


def got(spark, rows, parts=5):
    return sorted((tuple(r) for r in trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()), key=str)


def talk(n, seed, deep=0):
    """Conversations of few different turns, so that many share prefixes; some are very deep."""
    draw, rows = random.Random(seed), []
    for c in draw.sample(range(-60, 3 * n), n):
        length = draw.choice([1, 1, 2, 3, 4, 5, 9])
        rows += [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["a", "a b", "c  d\te", "", None])) for t in range(length)]
    for c in range(10_000, 10_000 + deep):
        common = draw.randint(0, 120)
        rows += [(c, t, "user", "same words here" if t < common else f"{draw.randint(0, 2)}") for t in range(draw.randint(100, 160))]
    return rows


def test_equals_brute_force(spark):
    rows = talk(400, 1, deep=12)
    rows += [(c, t, "user", f"hot {t}") for c in range(5000, 5400) for t in range(3)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("last", [0, 200])
def test_many_slices_and_rounds(spark, monkeypatch, last):
    """Tiny slices leave most nodes open; rounds go on until the open rows are few."""
    rows = talk(300, 2, deep=6) + [(c, 0, "user", "one first turn") for c in range(7000, 7200)]
    monkeypatch.setattr(trie, "SLICE", 8)
    monkeypatch.setattr(trie, "LEAST_ROWS", 4)
    monkeypatch.setattr(trie, "LAST", 700 + last)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert got(spark, rows, 3) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = [(c, 0, "user", "hi") for c in range(0, 4000, 20)]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, 5, "user", "x"), (1, 0, "user", "y"), (2, 0, "user", "r"), (2, 0, "user", "r"), (0, 0, "a", "long " * 5000), (40, None, "b", ""), (-20, 0, "q", "é 😀")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, [(9, 1, "user", "only turn of its own")]) == brute([(9, 1, "user", "only turn of its own")])
    assert got(spark, [(None, 0, "user", "lost")]) == [] == got(spark, rows[:0])
    more = spark.createDataFrame([(*r, 1, "k") for r in rows[1:]], SCHEMA + ", depth int, path string")
    assert sorted((tuple(r) for r in trie.trie(more).collect()), key=str) == brute(rows)
