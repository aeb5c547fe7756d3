"""Benchmark decontamination by a generalised suffix automaton of the test items.

The words of all items, lower-cased, make one suffix automaton: a state stands for the word sequences of the items that
end at the same places. Each text runs through it word by word; the state and the longest matching length are known after
every word. A length of ``WINDOW`` or more means that the last ``WINDOW`` words stand in an item, and the state's suffix
links lead to the one state of just that window, which lists its items. Items of fewer words are marked at the state of
the whole item and met on the same links.

The automaton is built on the driver from blocks of about ``BLOCK`` words of items (a longer item is cut into parts that
overlap by a window), as sorted arrays of some 100 bytes a word, and is broadcast: its size is bounded whatever the
benchmark. Larger benchmarks take one pass over the texts for each block. Within a task the texts' runs of words that any
item has are walked side by side, in pieces that overlap by a window, so every step is one operation on arrays.

Results for odd input: null and empty texts have no words. An item is all rows of one item_id; rows without item_id are
one item with the empty text as its id; items without words are never found. Repeated rows of texts are judged one by one,
alike; repeated rows of an item are one. Without texts there are no rows, without items no hits. Extra columns, of any
name, pass through ``decontaminated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramlaw.llm.text import cut, mapped, terms

WINDOW, BLOCK, PART, PIECE = 10, 1 << 18, 1 << 13, 256
HITS = "n_words long, starts array<int>, stops array<int>, items array<string>"
HIT = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


@dataclass
class Automaton:
    """``keys`` (state * words + word, sorted) lead to ``target``. ``window`` is the state of the last ``size`` words, 0 if
    fewer match. ``whole`` is the nearest state on the links, itself included, that is a short item; ``above`` the next one
    beyond it. ``items[first[s] : first[s + 1]]`` are the items of such a state."""

    size: int
    vocabulary: dict[str, int]
    keys: np.ndarray
    target: np.ndarray
    link: np.ndarray
    length: np.ndarray
    window: np.ndarray
    whole: np.ndarray
    first: np.ndarray
    items: np.ndarray
    names: list[str]
    shortest: int

    def walk(self, tokens: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and longest matching length after each token of the runs ``begin:stop`` (tokens of the vocabulary).
        Lengths count from at least a window back, so they are exact up to ``size``."""
        state, matched = np.zeros(len(tokens), dtype=np.int64), np.zeros(len(tokens), dtype=np.int64)
        many = -(-(stop - begin) // PIECE)
        k = np.arange(int(many.sum())) - np.repeat(many.cumsum() - many, many)
        own = np.repeat(begin, many) + k * PIECE
        end = np.minimum(own + PIECE, np.repeat(stop, many))
        at = np.maximum(own - (self.size - 1), np.repeat(begin, many))
        order = np.argsort(at - end, kind="stable")
        own, end, at = own[order], end[order], at[order]
        lengths = end - at
        s, n = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        words = len(self.vocabulary)
        for t in range(int(lengths[0]) if len(at) else 0):
            live = int(np.searchsorted(-lengths, -t))  # lanes longer than t come first
            now = at[:live] + t
            c = tokens[now]
            todo = np.arange(live)
            while len(todo):
                key = s[todo] * words + c[todo]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[place] == key
                done = todo[hit]
                s[done] = self.target[place[hit]]
                n[done] += 1
                todo = todo[~hit]
                s[todo] = self.link[s[todo]]
                n[todo] = self.length[s[todo]]
            mine = now >= own[:live]
            state[now[mine]], matched[now[mine]] = s[:live][mine], n[:live][mine]
        return state, matched

    def hits(self, tokens: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state, start, stop) of every occurrence of a window; ``tokens`` -1 for words of no item, ``text`` the text of
        each token."""
        none = np.zeros(0, dtype=np.int64)
        if not len(tokens) or not len(self.keys):
            return none, none, none
        known = tokens >= 0
        cuts = np.ones(len(tokens) + 1, dtype=bool)
        cuts[1:-1] = (known[1:] != known[:-1]) | (text[1:] != text[:-1])
        edge = np.flatnonzero(cuts)
        begin, stop = edge[:-1], edge[1:]
        keep = known[begin] & (stop - begin >= self.shortest)
        state, matched = self.walk(tokens, begin[keep], stop[keep])
        long = np.flatnonzero(matched >= self.size)
        out = [(self.window[state[long]], long + 1 - self.size, long + 1)]
        at = np.flatnonzero(matched > 0)
        v = self.whole[state[at]]
        at, v = at[v > 0], v[v > 0]
        while len(at):
            fits = self.length[v] <= matched[at]
            out.append((v[fits], at[fits] + 1 - self.length[v[fits]], at[fits] + 1))
            v = self.whole[self.link[v]]
            at, v = at[v > 0], v[v > 0]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def automaton(parts: list[tuple[str, list[str]]], size: int) -> Automaton:
    """The automaton of (item, words) parts."""
    names = sorted({name for name, _ in parts})
    number = {name: i for i, name in enumerate(names)}
    vocabulary: dict[str, int] = {}
    length, link, step = [0], [0], [{}]

    def state(n, to, edges):
        length.append(n)
        link.append(to)
        step.append(edges)
        return len(length) - 1

    def split(p, c, q):
        """The part of state q that ends like p followed by c, as a state of its own."""
        if length[q] == length[p] + 1:
            return q
        twin = state(length[p] + 1, link[q], dict(step[q]))
        link[q] = twin
        while step[p].get(c) == q:
            step[p][c] = twin
            if p == 0:
                break
            p = link[p]
        return twin

    def extend(last, c):
        if c in step[last]:
            return split(last, c, step[last][c])
        new, p = state(length[last] + 1, 0, {}), last
        while c not in step[p]:
            step[p][c] = new
            if p == 0:
                return new
            p = link[p]
        link[new] = split(p, c, step[p][c])
        return new

    coded = [(number[name], [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for name, words in parts]
    for _, words in coded:
        last = 0
        for c in words:
            last = extend(last, c)
    keys = np.fromiter((s * len(vocabulary) + c for s, edges in enumerate(step) for c in edges), dtype=np.int64)
    target = np.fromiter((q for edges in step for q in edges.values()), dtype=np.int64)
    order = np.argsort(keys)
    links, lengths = np.array(link), np.array(length)
    window, whole, shorter = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64), set()
    found: set[tuple[int, int]] = set()
    by_length = np.argsort(lengths, kind="stable").tolist()
    for s in by_length[1:]:
        if length[s] >= size:
            window[s] = window[link[s]] or s
    for item, words in coded:
        s = 0
        for c in words:
            s = step[s][c]
            if window[s]:
                found.add((int(window[s]), item))
        if 0 < len(words) < size:
            found.add((s, item))
            shorter.add(s)
    for s in by_length[1:]:
        whole[s] = s if s in shorter else whole[link[s]]
    pairs = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
    first = np.searchsorted(pairs[:, 0], np.arange(len(length) + 1))
    shortest = min((min(len(w), size) for _, w in coded if w), default=size)
    return Automaton(size, vocabulary, keys[order], target[order], links, lengths, window, whole, first, pairs[:, 1], names, shortest)


def blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Automaton]:
    """Automata of blocks of the items, each of about ``BLOCK`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item", pa.string()), ("part", pa.int64()), ("words", pa.list_(pa.string()))])
        for b in batches:
            t = terms(b.column(1))
            for i, name in enumerate(b.column(0).to_pylist()):
                n = int(t.bounds[i + 1] - t.bounds[i])
                for k, lo in enumerate(range(0, max(1, n - window + 1) if n else 0, PART)):
                    words = pc.take(t.dictionary, pa.array(t.codes[t.bounds[i] + lo : t.bounds[i] + min(n, lo + PART + window - 1)]))
                    yield pa.RecordBatch.from_pylist([{"item": name or "", "part": k, "words": words.to_pylist()}], schema=schema)

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    parts = cut(mapped(named, ["item", "text"], run, "item string, part long, words array<string>").distinct(), "items")
    total = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    many = -(-total // BLOCK)
    for k in range(many):
        block = parts.where(F.pmod(F.xxhash64("item", "part", "words"), F.lit(many)) == k)
        yield automaton([(r["item"], r["words"]) for r in block.collect()], window)


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _ranges(of: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the ranges of each text: bounds, starts, stops. Texts follow each other in one numbering of words."""
    order = np.lexsort((start, of))
    of, start, stop = of[order], start[order], stop[order]
    reach = np.maximum.accumulate(stop) if len(stop) else stop
    fresh = np.ones(len(of), dtype=bool)
    fresh[1:] = (of[1:] != of[:-1]) | (start[1:] > reach[:-1])
    lead = np.flatnonzero(fresh)
    last = np.append(lead[1:], len(of)) - 1 if len(of) else lead
    return np.searchsorted(of[lead], np.arange(n + 1)), start[lead], reach[last]


def scanned(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """The columns ``keep`` and HITS of every row: number of words, hit ranges of words, ids of the items found."""
    name = "hits"
    while name in docs.columns:
        name += "_"
    first, automata = True, list(blocks(benchmark, window)) or [automaton([], window)]
    for k, own in enumerate(automata):
        shared = docs.sparkSession.sparkContext.broadcast(own)
        final = k + 1 == len(automata)
        carried = keep if final else [c for c in docs.columns if c != name]

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, out=[*carried, name]) -> Iterator[pa.RecordBatch]:  # noqa: B006
            auto = shared.value
            for b in batches:
                t = terms(b.column(b.schema.get_field_index("text")))
                n = len(t.bounds) - 1
                text = np.repeat(np.arange(n), np.diff(t.bounds))
                code = np.array([auto.vocabulary.get(w, -1) for w in t.dictionary.to_pylist()], dtype=np.int64)
                state, start, stop = auto.hits(code[t.codes] if len(code) else t.codes, text)
                of = text[start]
                pair = np.unique(np.stack([of, state], axis=1), axis=0) if len(of) else np.zeros((0, 2), dtype=np.int64)
                size = auto.first[pair[:, 1] + 1] - auto.first[pair[:, 1]]
                item = auto.items[np.repeat(auto.first[pair[:, 1]] - (size.cumsum() - size), size) + np.arange(int(size.sum()))]
                met = np.unique(np.stack([np.repeat(pair[:, 0], size), item], axis=1), axis=0) if len(item) else np.zeros((0, 2), dtype=np.int64)
                names = [auto.names[i] for i in met[:, 1]]
                if not first:  # what earlier blocks found
                    old = b.column(b.num_columns - 1)
                    a, z, i = (old.field(f) for f in ("starts", "stops", "items"))
                    of_old = pc.list_parent_indices(a).to_numpy()
                    of = np.concatenate([of, of_old])
                    start = np.concatenate([start, a.flatten().to_numpy() + t.bounds[of_old]])
                    stop = np.concatenate([stop, z.flatten().to_numpy() + t.bounds[of_old]])
                    both = sorted({*zip(met[:, 0].tolist(), names, strict=True), *zip(pc.list_parent_indices(i).to_pylist(), i.flatten().to_pylist(), strict=True)})
                    met, names = np.array([m for m, _ in both], dtype=np.int64).reshape(-1, 1), [x for _, x in both]
                bounds, start, stop = _ranges(of, start, stop, n)
                base = np.repeat(t.bounds[:-1], np.diff(bounds))
                found = [pa.array(np.diff(t.bounds)), _lists((start - base).astype(np.int32), bounds, pa.int32()), _lists((stop - base).astype(np.int32), bounds, pa.int32()), _lists(names, np.searchsorted(met[:, 0], np.arange(n + 1)), pa.string())]
                hit = pa.StructArray.from_arrays(found, fields=list(HIT))
                yield pa.RecordBatch.from_arrays([hit if c == name else b.column(b.schema.get_field_index(c)) for c in out], names=out)

        schema = T.StructType([*(docs.schema[c] for c in carried), T.StructField(name, T._parse_datatype_string(HITS))])
        docs = mapped(docs, list(dict.fromkeys([*carried, "text", *([] if first else [name])])), run, schema)
        if not final:
            docs = cut(docs, "scanned")
        first = False
    return docs


def items_digest(items: pa.Array) -> pa.Array:
    """SHA-256 of each row's ids in order, joined by commas."""
    return pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items.to_pylist()], pa.string())


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, longest: int = 0, most: float = 0.5) -> DataFrame:
    """``docs`` without hit ranges of more than ``longest`` words; texts of which more than the share ``most`` of all words
    is hit go as a whole. Words are cut out from the first byte of a range to its last; ``n_chars`` follows the text."""
    out = scanned(docs, benchmark, list(docs.columns), window)
    name = out.columns[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, hit = b.schema.get_field_index("text"), b.column(b.num_columns - 1)
            t = terms(b.column(at))
            texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, dtype=bool)
            for i, (starts, stops) in enumerate(zip(hit.field("starts").to_pylist(), hit.field("stops").to_pylist(), strict=True)):
                if not starts:
                    continue
                n = int(t.bounds[i + 1] - t.bounds[i])
                keep[i] = sum(stops) - sum(starts) <= most * n
                raw, parts, last = texts[i].encode(), [], 0
                for a, z in zip(starts, stops, strict=True):
                    if z - a > longest:
                        parts.append(raw[last : t.start[t.bounds[i] + a]])
                        last = int(t.stop[t.bounds[i] + z - 1])
                texts[i] = b"".join([*parts, raw[last:]]).decode()
            columns = [pa.array(texts, b.column(at).type) if j == at else b.column(j) for j in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1]).filter(pa.array(keep))

    clean = mapped(out, out.columns, run, docs.schema)
    if "n_chars" not in docs.columns:
        return clean
    new = F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("n_chars", new)
