import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import ODD
from tokenizers import Tokenizer

from gramlaw.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def check(rows, pieces, size=2048):
    """Every id in one piece, gapless sequences, padding small. ``rows``: (doc, text), ids distinct."""
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(ids[d][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[d])
    used = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        used += at
    return used / (size * len(by_seq))


def test_round_trip(spark):
    rows = [(i, f"word {i} <|endoftext|>  of\n\n a text " * (i * 7 % 400)) for i in range(400)] + [(900, "x" * 30_000), (901, None), (902, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert check(rows, packing.pack(docs, PATH).collect()) > 0.97


def test_classes_hold_a_fixed_number():
    bins = packing.Harmonic(0)
    placed = [p for n in (200, 201, 199, 210, 190, 2048, 1024, 512 + 205) * 60 for p in bins.place(n, np.zeros(n, dtype="<u4"))]
    groups = defaultdict(list)
    for (_, _, ids, _), seq, _ in placed:
        groups[seq].append(len(ids))
    for lengths in groups.values():
        k = max(2048 // x for x in lengths)
        assert len(lengths) == k and all(x <= 2048 // k for x in lengths)


def test_odd_rows(odd, none, spark):
    got = packing.pack(odd, PATH).collect()
    assert sum(p.start == 0 for p in got) == len(ODD)
    assert packing.pack(none, PATH).count() == 0
    rows = [(r[0], r[1]) for r in ODD if r[0] != 5]
    check(rows, [p for p in got if p.doc_id != 5])
