import random
import re

import pytest
from helpers import ODD, SCHEMA, lower
from pyspark.sql import functions as F

from gramlaw.llm import automaton
from gramlaw.llm.queries import contamination

FORM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=10):
    windows = {}
    for i, text in items:
        w = FORM.findall(lower(text))
        for a in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + window]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, met = FORM.findall(lower(text)), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    met |= windows[tuple(w[a : a + k])]
        out.append((doc, len(w), sorted(hit), sorted(met)))
    return out


def got(spark, docs, items, window=10):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    out = automaton.scanned(frame, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], window)
    return [(r.doc_id, r.hits.n_words, [p for a, z in zip(r.hits.starts, r.hits.stops) for p in range(a, z)], r.hits.items) for r in out.collect()]


def texts(seed, n, words, longest):
    draw = random.Random(seed)
    return [" ".join(draw.choice(words) for _ in range(draw.randint(0, longest))) for _ in range(n)]


def ranked(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("words,longest", [(["a", "B"], 40), (["a", "b", "c", "é", "D-d", "4"], 30)])
def test_equals_brute_force(spark, words, longest):
    items = [*enumerate(texts(1, 25, words, longest)), (3, "a b a b"), (None, "b b"), (77, "a"), (78, "never seen at all"), (79, None), (80, "--- !")]
    docs = [*enumerate(texts(2, 150, [*words, "x"], 90)), *ODD_DOCS]
    assert ranked(got(spark, docs, items)) == ranked(brute(docs, items))
    items = [i for i in items if len(FORM.findall(lower(i[1]))) > 5]
    assert ranked(got(spark, docs, items, 5)) == ranked(brute(docs, items, 5))


ODD_DOCS = [(r[0], r[1]) for r in ODD] + [(900, "A a B b " * 2000), (901, "a"), (902, "x" * 50_000)]


def test_blocks_and_parts(spark, monkeypatch):
    items = [*enumerate(texts(3, 30, ["a", "b", "c"], 60)), (5, "b c " * 300)]
    docs = [*enumerate(texts(4, 120, ["a", "b", "c", "x"], 120)), *ODD_DOCS]
    monkeypatch.setattr(automaton, "BLOCK", 300)
    monkeypatch.setattr(automaton, "PART", 32)
    monkeypatch.setattr(automaton, "PIECE", 16)
    assert len(list(automaton.blocks(spark.createDataFrame(items, "item_id long, text string")))) > 2
    assert ranked(got(spark, docs, items)) == ranked(brute(docs, items))


def test_decontaminated(spark):
    item = "One two three four five six seven eight nine ten eleven"
    rows = [(1, f"Start, {item.upper()}! end of it " + "more words " * 20, "en", "s", 9, 1), (2, item, "en", "s", 9, 2), (3, None, None, None, None, 3), (4, "clean text", "en", "s", 10, 4), (4, "clean text", "en", "s", 10, 4)]
    docs = spark.createDataFrame(rows, SCHEMA + ", hits int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = automaton.decontaminated(docs, items)
    assert out.columns == docs.columns
    text = "Start, ! end of it " + "more words " * 20
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, text, "en", "s", len(text), 1), *rows[2:]], key=str)
    whole = automaton.decontaminated(docs, items, longest=11, most=1.0)
    assert sorted(r.text or "" for r in whole.collect()) == sorted(r[1] or "" for r in rows)


def test_odd_tables(odd, none, spark):
    items = spark.createDataFrame([(1, "no id on this one, only words of an ordinary kind"), (1, "the same text twice over"), (2, "")], "item_id long, text string")
    out = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination(odd, items).collect()}
    assert (None, 11, 11, 1, True) in out and (5, 7, 5, 1, True) in out and (1, 0, 0, 0, False) in out
    assert contamination(odd, items).count() == len(ODD) and contamination(none, items).count() == 0
    assert contamination(odd, items.where("false")).agg(F.sum("n_hit")).first()[0] == 0
