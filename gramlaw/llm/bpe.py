"""BPE encoding and decoding with the merge list of a public tokenizer file.

A piece of text starts as a doubly linked list of symbols. All neighbouring pairs with a merge rank wait in a priority
queue, lowest rank first, then leftmost; a merge relinks its neighbours and queues the two new pairs. An entry whose
symbols have changed since is stale and skipped, so a piece of n symbols costs O(n log n) however long it is. Decoding
joins vocabulary strings.

Texts are cut at ASCII white space, which no piece crosses. The distinct units of a slice are normalised and cut into pieces
together, and each distinct piece is encoded once; a bounded cache keeps pieces between slices. ``model`` reads what the file says: normalisation (NFC, lower case), pieces
(a pattern), byte alphabet, word-end mark, special tokens, which stay whole wherever they stand in a text.
Character classes and lower case are those of Python's Unicode; a code point assigned later may differ from other libraries.

Results for odd input: a null text is an empty one, with no ids and an empty decoded text. Null and repeated ids are rows
like any other. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from gramlaw.llm.text import batch, filled, mapped

CACHE = 240_000  # entries of one generation
LONGEST = 64  # characters of a cached piece
BREAK = (1 << 32) - 1  # stands between the ids of units
ID_BITS, PLACE_BITS = 24, 40
PLACE = (1 << PLACE_BITS) - 1
NONE = 1 << 30  # no merge
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Recent(dict):
    """A bounded cache of two generations: when the young one is full it becomes the old one, and what is asked for again
    moves back, so that frequent pieces stay."""

    def __init__(self):
        self.old: dict = {}

    def find(self, key: str):
        hit = self.get(key)
        if hit is None and (hit := self.old.get(key)) is not None:
            self.keep(key, hit)
        return hit

    def keep(self, key: str, value) -> None:
        if len(key) <= LONGEST:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = value


@dataclass
class Model:
    vocab: pa.Array  # the string of each id
    merges: dict[int, int]  # two ids in one number: rank
    made: list[int]  # id that the merge of each rank makes
    inner: list[int]  # id of each byte
    final: list[int]  # id of each byte at the end of a word
    start: list[list[int]]  # rank of each two bytes inside a word
    stop: list[list[int]]  # and at its end
    special: dict[str, int]
    pieces: regex.Pattern
    marks: regex.Pattern | None
    known: Recent = field(default_factory=Recent)

    def merged(self, raw: bytes) -> tuple[int, ...]:
        n, find, made = len(raw), self.merges.get, self.made
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        # the rank of the pair that starts at each place, as it is now; ranks tell pairs apart
        rank = [self.start[a][b] for a, b in zip(raw, raw[1:])]  # noqa: B905
        if n > 1:
            rank[-1] = self.stop[raw[-2]][raw[-1]]
        rank.append(NONE)
        queue = [r << PLACE_BITS | i for i, r in enumerate(rank) if r != NONE]
        if not queue:
            return tuple(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & PLACE
            r = entry >> PLACE_BITS
            if rank[i] != r:
                continue  # stale: the symbols here have changed since
            j = after[i]
            new = symbols[i] = made[r]
            symbols[j], rank[j] = -1, NONE
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank[i] = find(new << ID_BITS | symbols[k], NONE)
                if r != NONE:
                    push(queue, r << PLACE_BITS | i)
            else:
                rank[i] = NONE
            h = before[i]
            if h >= 0:
                r = rank[h] = find(symbols[h] << ID_BITS | new, NONE)
                if r != NONE:
                    push(queue, r << PLACE_BITS | h)
        return tuple([s for s in symbols if s >= 0])

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.known.find(text)
        if ids is None:
            ids = self.merged(text.encode())
            self.known.keep(text, ids)
        return ids

    def pieces_of(self, text: str) -> list[str]:
        """The pieces of a text, and the line ends between them. White space is in no piece, so it stays as it is."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # Σ: no form for word ends
        return self.pieces.findall(text.lower())

    def marked(self, text: str) -> list[int]:
        """Ids of a text without line ends, with special tokens in it."""
        parts = self.marks.split(text)
        return [i for p in parts if p for i in ([self.special[p]] if p in self.special else chain.from_iterable(map(self.piece, self.pieces_of(p))))]

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each unit begin and how many they are. A unit holds no line end, so that all units are cut
        into pieces at once; each distinct piece is encoded once."""
        odd = {k: self.marked(u) for k, u in enumerate(units) if "<" in u and self.marks.search(u)} if self.marks else {}
        pieces = self.pieces_of("".join([f"{u}\n" for u in units]) if not odd else "".join(["\n" if k in odd else f"{u}\n" for k, u in enumerate(units)]))
        found = {p: self.piece(p) for p in set(pieces) if p != "\n"}
        found["\n"] = (BREAK,)
        flat = np.fromiter(chain.from_iterable(map(found.__getitem__, pieces)), dtype="<u4")
        ends = np.flatnonzero(flat == BREAK)
        first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        size = ends - first
        for k, ids in odd.items():
            first[k], size[k] = len(flat), len(ids)
            flat = np.append(flat, np.array(ids, dtype="<u4"))
        return flat, first, size


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model of a tokenizer file with word ends; made once a process."""
    if path in _models:
        return _models[path]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges, made = {}, []
    for rank, (a, b) in enumerate(spec["model"]["merges"]):
        merges[ids[a] << ID_BITS | ids[b]] = rank
        made.append(ids[a + b])
    names = {i: s for s, i in [*ids.items(), *special.items()]}
    letters = byte_alphabet()
    inner, final = [ids[c] for c in letters], [ids[c + end] for c in letters]
    ranks = lambda second: [[merges.get(a << ID_BITS | b, NONE) for b in second] for a in inner]
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    marks = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    _models[path] = Model(pa.array([names[i] for i in range(len(names))], pa.string()), merges, made, inner, final, ranks(inner), ranks(final), special, regex.compile("\n|" + pattern.replace(r"\s", r"\t-\r\x20\x85\xa0  -     　")), marks)
    return _models[path]


def encode_slice(bpe: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids of all texts one after another, the bounds of each text's, and the decoded texts."""
    lists = pc.ascii_split_whitespace(filled(texts))
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    flat, first, size = bpe.encode(coded.dictionary.to_pylist())
    each = size[codes] if len(codes) else np.zeros(0, dtype=np.int64)
    ends = each.cumsum()
    ids = flat[np.repeat(first[codes] - (ends - each), each) + np.arange(int(each.sum()))] if len(codes) else flat[:0]
    bounds = np.concatenate([[0], ends])[bounds]
    decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), bpe.vocab.take(pa.array(ids))), " ")
    return ids, bounds, decoded


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("decoded", pa.string())])

    def run(batches):
        bpe = model(path)
        for part in batches:
            ids, bounds, decoded = encode_slice(bpe, part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int64)))
            yield batch(schema, part.column(0), np.diff(bounds), lists, decoded)

    return mapped(docs, ["doc_id", "text"], run, "doc_id long, n_tokens long, ids array<long>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, without moving the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = model(path)
        for part in batches:
            ids, bounds, decoded = encode_slice(bpe, part.column(1))
            of_ids = [hashlib.sha256(ids[lo:hi].tobytes()).hexdigest() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            of_text = [hashlib.sha256(s.as_buffer()).hexdigest() for s in decoded]
            yield batch(schema, part.column(0), np.diff(bounds), of_ids, of_text)

    return mapped(docs, ["doc_id", "text"], run, SCHEMA)
