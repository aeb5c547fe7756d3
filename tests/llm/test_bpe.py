import hashlib
import random

import public_tokenizers
import pyarrow as pa
from helpers import ODD
from tokenizers import Tokenizer

from gramlaw.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def same(texts):
    theirs, ours = Tokenizer.from_file(PATH), bpe.model(PATH)
    ids, bounds, decoded = bpe.encode_slice(ours, pa.array(texts))
    for i, t in enumerate(texts):
        want = theirs.encode(t or "", add_special_tokens=False).ids
        assert list(ids[bounds[i] : bounds[i + 1]]) == want, repr(t)
        assert decoded[i].as_py() == theirs.decode(want, skip_special_tokens=False)


def test_random_texts():
    draw = random.Random(3)
    letters = "aAbB éÉß İΣσ日本👍🏽̧́'’sStT rReElLvV mMdD  \n\t\x1c\x85\xa0　​ำ 123½² .,!<|>"
    same(["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(3000)])


def test_special_tokens_forms_and_long_words():
    same(["a<|endoftext|>b <|startoftext|> <|endoftext|", "Don't WE'LL i'm ΣΑΣ", "Å Å ﬁ ǅ K", "ab" * 20_000, "", None, "\n\n"])


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    same([f"word{i % 9} again{i % 4} the" for i in range(50)])


def test_odd_rows(odd, none, spark):
    theirs = Tokenizer.from_file(PATH)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in ODD:
        ids = theirs.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(theirs.decode(ids, skip_special_tokens=False).encode())))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(odd, PATH).collect()) == sorted(want)
    assert bpe.digests(none, PATH).count() == 0
    full = bpe.encoded(odd.where("doc_id = 4"), PATH).first()
    assert full.ids == theirs.encode("Word", add_special_tokens=False).ids and full.decoded == "word</w>"


def test_a_piece_is_merged_once_a_slice(monkeypatch):
    """Words that differ in case or punctuation share their pieces, also when the cache is far too small."""
    monkeypatch.setattr(bpe, "CACHE", 1)
    ours, seen = bpe.model(PATH), []
    monkeypatch.setattr(ours, "known", bpe.Recent())
    plain = bpe.Model.merged
    monkeypatch.setattr(bpe.Model, "merged", lambda self, raw: seen.append(tuple(raw)) or plain(self, raw))
    same([f"Other{i % 7}, other. (OTHER) again! Again {'x' * 40} <|endoftext|>again éA Éa" for i in range(20)])
    assert len(seen) <= len(set(seen)) + 1  # the piece beside a special token is encoded by itself
