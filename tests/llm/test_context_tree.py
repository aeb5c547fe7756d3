import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from helpers import ODD, tokens

from gramlaw.llm import context_tree as ct
from gramlaw.llm.text import remainder


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def grids(texts, depth):
    """Contexts and byte counts of every depth, nothing left out."""
    seen = [defaultdict(Counter) for _ in range(depth + 1)]
    for t in texts:
        data = bytes([ct.END] * depth) + t.encode() + bytes([ct.END])
        for p in range(depth, len(data)):
            for d in range(depth + 1):
                seen[d][int.from_bytes(data[p - d : p], "big")][data[p]] += 1
    contexts = [np.array(sorted(s), dtype=np.int64) for s in seen]
    return contexts, [np.array([[seen[d][c][x] for x in range(256)] for c in contexts[d]], dtype=float) for d in range(depth + 1)]


def brute(contexts, n, path):
    """log10 probability of every byte after the contexts ``path`` (one for each depth), straight from the definition."""
    depth = len(contexts)
    where = [{int(c): i for i, c in enumerate(cs)} for cs in contexts]

    def bits(d, i, node):
        level = node.bit_length() - 1
        span = 256 >> level
        lo = (node << (8 - level)) - 256
        half = span // 2
        return n[d][i][lo : lo + half].sum(), n[d][i][lo + half : lo + span].sum()

    def both(d, i, node):
        """Own and children's log probability."""
        a, b = bits(d, i, node)
        if d + 1 == depth:
            return kt(a, b), None
        total, ra, rb = 0.0, a, b
        for c, j in where[d + 1].items():
            if c & ((1 << 8 * d) - 1) == contexts[d][i]:
                own, below = both(d + 1, j, node)
                total += own if below is None else np.logaddexp(own, below) - math.log(2)
                x, y = bits(d + 1, j, node)
                ra, rb = ra - x, rb - y
        return kt(a, b), total + kt(ra, rb)

    def one(node):
        known = [(d, where[d][c]) for d, c in enumerate(path) if c in where[d]]
        out, left = 0.0, 1.0
        for d, i in known:
            a, b = bits(d, i, node)
            own, below = both(d, i, node)
            w = 1.0 if (d, i) == known[-1] else 1 / (1 + math.exp(below - own))
            out += left * w * (b + 0.5) / (a + b + 1)
            left *= 1 - w
        return out

    p = np.zeros(512)
    p[1] = 1
    for node in range(1, 256):
        x = one(node)
        p[2 * node], p[2 * node + 1] = p[node] * (1 - x), p[node] * x
    return np.log10(p[256:])


def test_weights_equal_the_definition():
    texts = ["abab abba", "abc abd", "é"]
    contexts, n = grids(texts, 2)
    tree = ct.weighted(contexts, n)
    for d, path in ((2, [0, ord("a"), (ord(" ") << 8) + ord("a")]), (1, [0, ord("b")]), (0, [0])):
        row = tree.table[tree.offset[d] + int(np.searchsorted(contexts[d], path[-1]))]
        assert np.allclose(row, brute(contexts, n, path), atol=1e-4)
        assert abs((10.0 ** row.astype(float)).sum() - 1) < 1e-4


def test_scores_follow_the_longest_known_context(monkeypatch):
    monkeypatch.setattr(ct, "DEPTH", 2)
    contexts, n = grids(["abab", "ab"], 2)
    tree = ct.weighted(contexts, n)
    got = tree.scores(pa.array(["ab", "", None, "zq"]).fill_null(""))
    row = lambda c: tree.table[tree.offset[len(c)] + int(np.searchsorted(contexts[len(c)], int.from_bytes(bytes(c), "big")))]
    e = ct.END
    assert np.isclose(got[0], row([e, e])[97] + row([e, 97])[98] + row([97, 98])[e], atol=1e-4)
    assert np.isclose(got[1], row([e, e])[e], atol=1e-4) and got[1] == got[2]
    assert np.isclose(got[3], row([e, e])[ord("z")] + row([])[ord("q")] + row([])[e], atol=1e-4)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = ct.counts(docs.where(remainder("doc_id", 10) != 0))
    got = ct.scored(docs, table).collect()
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
    c = Counter(w for k, t in rows if not held(k) for w in [*tokens(t), None])
    total, kinds = sum(c.values()), len(c)
    want = sorted((str(k), len(tokens(t)) + 1, sum(c[w] > 0 for w in [*tokens(t), None]), total, round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in [*tokens(t), None]), 6)) for k, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    return got


def test_base_scores_with_rare_words_in_the_join(spark, monkeypatch):
    monkeypatch.setattr(ct, "MIN_WORD", 0.05)
    check(spark, [(r[0], r[1]) for r in ODD] + [(i, f"the word{i % 7} of the {i}") for i in range(20, 60)])


def test_all_odd_rows(spark):
    got = check(spark, [(r[0], r[1]) for r in ODD])
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1


def test_no_rows_and_no_training(spark, none):
    assert ct.scored(none, ct.counts(none)).count() == 0
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = ct.scored(docs, ct.counts(docs.where("false"))).first()
    assert r.train_tokens == 0 and r.n_known == 0 and abs(r.score + 3 * math.log10(256)) < 1e-3


def test_learned_text_is_likelier():
    contexts, n = grids(["the cat sat on the mat " * 20], ct.DEPTH)
    tree = ct.weighted(contexts, n)
    s = tree.scores(pc.ascii_lower(pa.array(["the cat sat on the mat ", "xq zv jkw pfy ghb rrt d "])))
    assert s[0] > s[1] / 4


def test_rare_contexts_and_bytes_keep_their_counts(spark, monkeypatch):
    """Scores of a corpus in which a context of one position in 60,000 decides, by the tree of all counts."""
    monkeypatch.setattr(ct, "NODE_STRINGS", 50, raising=False)
    monkeypatch.setattr(ct, "CHUNK_STRINGS", 200, raising=False)
    common = ["the cat sat on the mat and the dog lay by the door " * 120] * 10
    rows = [(i, t) for i, t in enumerate([*common, "zqxj wvkp zqxj", "The \u00e9t\u00e9", "", "zqxj wvkp", "unmet ~~ here"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    train = [t for k, t in rows if zlib.crc32(str(k).encode()) % 10]
    assert "zqxj wvkp zqxj" in train
    tree = ct.weighted(*grids([t.translate({c: c + 32 for c in range(65, 91)}) for t in train], ct.DEPTH))
    got = {r.doc_id: r.score for r in ct.scored(docs, ct.counts(docs.where(remainder("doc_id", 10) != 0))).collect()}
    want = tree.scores(pc.ascii_lower(pa.array([t for _, t in rows])))
    assert np.allclose([got[k] for k, _ in rows], want, rtol=1e-5, atol=1e-3)
