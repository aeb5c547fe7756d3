import random
import re

import pytest
from helpers import ODD, SCHEMA
from pyspark.sql import functions as F

from gramlaw.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def pieces():
    draw = random.Random(9)
    parts = ["a@b.c", "_d@e.f", "@", ".", "1.2.3.4", "256.1.1.1", "001.2.3.4.5", "+1 (499) 555-6503", "+1", "4111 1111 1111 1111", "4111111111111112", "-", " ", "\n", "é", "😀", "x", "9" * 25, "+44.20.7946.0958", "10.0.0.1", "0", "00", "000", "0255", "0256", "256", "0" * 30, "1.2.3"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(1500)]


def octets():
    """Addresses of every kind of part, zeros among them."""
    draw = random.Random(4)
    part = ["0", "00", "000", "0000", "7", "07", "10", "99", "100", "255", "0255", "256", "0256", "999", "1000", "0" * 30, "0" * 30 + "9", "9" * 30]
    return [".".join(draw.choice(part) for _ in range(draw.randint(3, 9))) + draw.choice(["", ".", " x", ".."]) for _ in range(3000)]


def test_base_spans_equal_brute_force(spark):
    texts = [*pieces(), *octets(), *[r[1] for r in ODD], "server at 10.0.0.1, 127.0.0.1 and 1.2.3.0", "0." * 20_000, "a" * 50_000, "1" * 50_000, "1.1.1.1 " * 700, "a.b@c.d " * 700]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    for r in docs.select("text", pii.as_text(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect():
        assert r.s == brute(r.text), r.text[:100]


@pytest.fixture(scope="module")
def context_rows():
    rows = [(i, f"Word {i} then Contact: user{i}@site.org and the weather, the {i}000 items") for i in range(40)]
    rows += [(100 + i, f'please write. Contact: "ZX{i}77A" soon, the 2nd of {i}000 items') for i in range(5)]
    return [*rows, (200, "plain words and the 12345 things"), (None, " \nContact: QQ1234567. ok"), (None, " \nContact: QQ1234567. ok")]


def test_contexts_find_unseen_identifiers(spark, context_rows):
    docs = spark.createDataFrame(context_rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.base, r.spans) for r in pii.spans(docs).select("doc_id", pii.as_text("base").alias("base"), pii.as_text("spans").alias("spans")).collect()]
    assert len(got) == len(context_rows)
    for doc, base, spans in got:
        text = dict(context_rows)[doc]
        found = [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans.split(",") if s.startswith("id:")]
        want = [] if doc is not None and (doc < 100 or doc == 200) else [f"ZX{doc - 100}77A"] if doc else ["QQ1234567"]
        assert base == brute(text) and spans.startswith(base) and found == want


def test_masks(spark, context_rows):
    docs = spark.createDataFrame([(*r, None, None, None) for r in context_rows], SCHEMA)
    got = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert got[1] == "Word 1 then Contact: [EMAIL] and the weather, the 1000 items"
    assert got[100] == 'please write. Contact: "[ID]" soon, the 2nd of 0000 items'
    assert got[None] == " \nContact: [ID]. ok" and got[200] == dict(context_rows)[200]


def test_odd_rows(odd, none):
    assert sorted(str(r.doc_id) for r in pii.spans(odd).collect()) == sorted(str(r[0]) for r in ODD)
    assert pii.spans(none).count() == 0
    assert sorted(map(str, pii.masked(odd).collect())) == sorted(map(str, odd.collect()))
    assert pii.masked(none).columns == none.columns


def plain_mask(text):
    """The union of all spans, each range under the kind of the longest span in it."""
    spans = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in brute(text).split(",") if s))
    merged = []
    for a, b, kind in spans:
        if merged and merged[-1][1] > a:
            merged[-1] = [merged[-1][0], max(merged[-1][1], b), *((b - a, kind) if b - a > merged[-1][2] else merged[-1][2:])]
        else:
            merged.append([a, b, b - a, kind])
    out, at = "", 0
    for a, b, _, kind in merged:
        out, at = out + text[at:a] + f"[{kind.upper()}]", b
    return out + text[at:]


def test_masks_are_the_spans_of_the_original_text(spark):
    texts = pieces()[:400] + octets()[:200] + ["server at 10.0.0.1 and 8.8.8.8", "call +33.1.23.45.67.89 now", "é😀" * 300 + "+33.1.23.45.67.89" + "日" * 600 + "a@b.c", "", "1.1.1.1 " * 700]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    none_found = pii.discovered
    try:
        pii.discovered = lambda docs, base: docs.select("doc_id", F.xxhash64("text").alias("th"), F.array().cast("array<int>").alias("at")).where("false")
        got = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    finally:
        pii.discovered = none_found
    assert got[600] == "server at [IP] and [IP]" and got[601] == "call [PHONE] now"
    assert [got[i] for i in range(len(texts))] == [plain_mask(t) for t in texts]


def ids(docs):
    return sorted((r.doc_id, s) for r in pii.spans(docs).select("doc_id", pii.as_text("spans").alias("s")).collect() for s in r.s.split(",") if s.startswith("id:"))


def test_many_other_seeds_hide_no_context(spark):
    few = [(i, f"badge: u{i}@y.org") for i in range(3)] + [(3, "badge: ZX177A")]
    many = [(10 + i, " ".join(f"see a{j}@b.org" for j in range(3000))) for i in range(40)]
    docs = spark.createDataFrame(few + many, "doc_id long, text string").repartition(4)
    assert ids(docs) == [(3, "id:7:13")]


def test_joined_patterns_as_sent_patterns(spark, context_rows, monkeypatch):
    docs = spark.createDataFrame(context_rows, "doc_id long, text string").repartition(3)
    sent = ids(docs.where("doc_id is not null"))
    monkeypatch.setattr(pii, "OFTEN", 2.0)
    assert len(sent) == 5 and ids(docs.where("doc_id is not null")) == sent
