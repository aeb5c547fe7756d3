import hashlib
import random

import numpy as np
from helpers import ODD

from gramlaw.llm import phrases
from gramlaw.llm.phrases import fingerprints, likeness


def prose(seed, n=400):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(draw.randint(2, 9))) for _ in range(n))


def test_equal_substrings_share_phrases_at_any_offset():
    x = prose(1)
    a, b, c, d = fingerprints([x, "some other beginning, " + x, x[:1000] + "!" + x[1000:], prose(2)])
    assert likeness(a, b) > 0.85 and likeness(a, c) > 0.85 and likeness(a, d) < 0.1
    half = fingerprints([x[: len(x) // 2] + prose(3)[: len(x) // 2]])[0]
    assert 0.15 < likeness(a, half) < 0.6


def test_parse_is_local():
    x = np.array([ord(c) for c in prose(4)], dtype=np.uint32)
    for shift in (1, 7, 50):
        y = np.concatenate([np.arange(1000, 1000 + shift, dtype=np.uint32), x])
        a, _ = phrases._parse(x, np.array([0]))
        b, _ = phrases._parse(y, np.array([0]))
        assert list(a[8:]) == list(b[-len(a[8:]) :])


def test_neighbours_in_a_slice_do_not_matter(monkeypatch):
    texts = [prose(i, i) for i in range(1, 40)] + ["", "x", "aaaa", "ab" * 3000, "é", "a" * 9000]
    together = fingerprints(texts)
    monkeypatch.setattr(phrases, "CHUNK", 10)
    for t, f, g in zip(texts, together, fingerprints(texts)):
        assert list(f) == list(g) and (len(f) > 0) == (t != "")


def test_likeness_equals_set_arithmetic():
    draw = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(draw.integers(0, 150, draw.integers(0, 120), dtype=np.uint32))[: phrases.SIZE] for _ in range(2))
        least = sorted(set(a) | set(b))[: phrases.SIZE]
        want = len(set(least) & set(a) & set(b)) / len(least) if len(a) and len(b) else float(len(a) == len(b))
        assert likeness(a, b) == want


def brute(rows):
    """Rows in order of (id, nulls first); equal ids must hold equal texts here."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        f, g, h = fingerprints([t, e, after])
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), phrases.as_text(f), phrases.as_text(g), likeness(f, g), likeness(f, h)))
    return sorted(out, key=str)


def test_next_documents_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PER_BUCKET", 7)
    rows = [(i * i % 1009 - 300, prose(i, 5 + i % 60)) for i in range(1, 200)]
    rows = list(dict(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, phrases.fingerprinted(docs).collect()), key=str) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r[0], r[1]) for r in ODD]
    assert sorted(map(tuple, phrases.fingerprinted(odd).collect()), key=str) == brute(rows)
    assert phrases.fingerprinted(none).count() == 0
    one = spark.createDataFrame([(None, "only one row here")], "doc_id long, text string")
    assert [tuple(r) for r in phrases.fingerprinted(one).collect()] == brute([(None, "only one row here")])
