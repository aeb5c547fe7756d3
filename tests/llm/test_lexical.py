import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, SCHEMA, lower

from gramlaw.llm import lexical

FORM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    bags = [(d, Counter(lower(w) for w in FORM.findall(t or ""))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= {lower(w) for w in FORM.findall(t or "")}
    out = []
    for i, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms if df[t]}
        scored = []
        for d, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n) // total
            s = sum(w * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t, w in weight.items() if b[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0))
        out += [(i, r, d if there else None, -s) for r, (s, there, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, k=10):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in lexical.search(lexical.index(frame), spark.createDataFrame(items, "item_id long, text string"), k).collect()), key=str)


def texts(seed, n, longest):
    draw = random.Random(seed)
    word = lambda: f"w{int(draw.paretovariate(0.7)) % 400}" if draw.random() < 0.9 else draw.choice(["É-a", "THE", "the"])
    return [" ".join(word() for _ in range(draw.choice([3, 20, longest]))) for _ in range(n)]


@pytest.mark.parametrize("shard", [1 << 17, 64])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD", shard)
    docs = [*enumerate(texts(1, 500, 70)), *[(1000 + i, "the same w1 w2 copy") for i in range(300)], *[(r[0], r[1]) for r in ODD], (77, "w1 " * 30_000)]
    items = [*enumerate(texts(2, 30, 40)), (5, "copy of the same"), (None, "w1 ordinary"), (90, None), (91, "neverseen"), (92, "COPY")]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, items, 3) == brute(docs, items, 3)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 40)
    docs, items = [*enumerate(texts(3, 200, 50))], [*enumerate(texts(4, 12, 30))]
    assert len(list(lexical.queries(spark.createDataFrame(items, "item_id long, text string")))) > 2
    assert got(spark, docs, items) == brute(docs, items)


def test_few_strata_are_visited(spark):
    """Once k documents are known, strata of lower bounds are left out, and equal bounds are not."""
    docs = [(i, " ".join(["common"] * (5 + i % 60))) for i in range(600)] + [(1000 + i, "rare common common") for i in range(12)]
    found = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    asked = next(lexical.queries(spark.createDataFrame([(1, "rare common")], "item_id long, text string")))
    rows = list(lexical._rows(found.strata.orderBy("m").toArrow().to_batches()))
    strata = [lexical.Stratum(r, asked, np.array([500, 500])) for r in rows]
    visited, best = [], lexical.Best(10, np.zeros(1, dtype=np.int64))
    for s in sorted(strata, key=lambda s: -s.bound[0]):
        s.scores = lambda q, s=s: visited.append(s) or lexical.Stratum.scores(s, q)
        best.visit(s, np.array([0]))
    assert len(visited) < len(strata) / 2 and sorted(h[2] for h in best.held[0]) == list(range(1000, 1010))


def test_odd_tables(odd, none, spark):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    rows = [tuple(r) for r in lexical.search(lexical.index(odd), items).collect()]
    assert rows == brute([(r[0], r[1]) for r in ODD], [(1, "word")])
    assert lexical.search(lexical.index(none), items).count() == 0
    assert lexical.search(lexical.index(odd), items.where("false")).count() == 0
    more = spark.createDataFrame([(*r, 1, 2) for r in ODD], SCHEMA + ", m int, terms int")
    assert [tuple(r) for r in lexical.search(lexical.index(more), items).collect()] == rows
