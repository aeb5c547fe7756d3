"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, each a node of a 255-node tree. Each node has a context tree of its own: at depth d the
last d bytes. Every context predicts by the Krichevsky-Trofimov estimate (n1 + 1/2) / (n0 + n1 + 1), and the probability
of the training data under a context mixes its own estimate and the product over its longer contexts, half and half:
P_w = (P_e + prod P_w(children)) / 2. Read along the path of a text's context this gives each depth a weight,
w = P_e / (P_e + prod P_w(children)), and the code length of a byte is that of the weighted estimates of all depths.

No context and no count is left out. A pass deals the texts into chunks of bounded size and writes them with the distinct
(DEPTH + 1)-byte strings of each chunk and their counts in training texts; summed by string these are the leaves of the
tree. Strings are dealt and sorted by their context, latest byte first, so that all strings below a context of three bytes
meet in one task, which weighs the depths from three on. Depths up to two, at most 2^16 contexts, are weighed on the driver
and broadcast. A second pass then gives every string of the texts the log probability of its last byte, which goes back
to the chunks that hold the string by a join; there it is looked up for each position.

Beside it stands the unigram base score over words. Words of at least ``MIN_WORD`` of all tokens (at most 2^20) are looked
up in a broadcast table within the tasks; all others meet their counts in a join, where no word is frequent.

Texts are lower-cased (A-Z) for both; the tree also predicts the end of the text, as byte 255, which UTF-8 never has, and
sees bytes 255 before the start. Results for odd input: a null text is an empty one, with one token, the end. Without
training rows every byte has probability 1/256 and N = V = 0. Null ids count as the empty text in the fold. Repeated rows
are scored one by one. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlaw.llm.text import Tally, batch, cut, filled, hash_strings, mapped, sliced, words

DEPTH, END = 5, 255
MIN_WORD = 2.0**-20
WORD, STRING, TEXTS, TEXT = 0, 1, 2, 3  # kinds of counts, and texts
CHUNK_STRINGS, CHUNK_BYTES = 2_000_000, 32 << 20  # a chunk ends at either
TOP = 2  # depths up to here are weighed on the driver
NODE_STRINGS = 200_000  # strings that a task weighs at a time, and what is left of their last context


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, DEPTH ends before each text; where each text starts; the length of each with its end."""
    raw = [s.as_buffer() if s.is_valid else b"" for s in texts]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    starts = size.cumsum() - size + DEPTH * np.arange(1, len(raw) + 1)
    out = np.full(int(size.sum()) + DEPTH * (len(raw) + 1), END, dtype=np.uint8)
    for s, r in zip(starts, raw, strict=True):
        out[s : s + len(r)] = np.frombuffer(r, dtype=np.uint8)
    return out, starts, size + 1


def _positions(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (size.cumsum() - size), size) + np.arange(int(size.sum()))


def strings(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The string at each position as a number: its context, latest byte highest, then the byte itself."""
    key = np.zeros(len(at), dtype=np.uint64)
    for back in [*range(1, DEPTH + 1), 0]:
        key = (key << np.uint64(8)) | data[at - back].astype(np.uint64)
    return key


def chunked(docs: DataFrame, train: Column) -> DataFrame:
    """(kind, chunk, key, n, row, doc_id, text): lower-cased texts with their chunk; each chunk's strings, counted in its
    ``train`` texts (0: in others only); word hashes and the number of texts, of ``train`` texts."""
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = Tally(), Tally(CHUNK_STRINGS)
        part = TaskContext.get().partitionId()
        chunk, row, size_of_chunk, seen = part << 24, part << 36, 0, 0

        def rows(kind, tally):
            keys, n = tally.drain()
            none = pa.nulls(len(keys), pa.int64())
            return batch(schema, np.full(len(keys), kind, dtype=np.int32), np.full(len(keys), chunk), keys.view(np.int64), n, none, none, pa.nulls(len(keys), pa.string()))

        for some in batches:
            lower = pc.ascii_lower(filled(some.column(1)))
            learn = some.column(2).to_numpy(zero_copy_only=False).astype(bool)
            none = pa.nulls(len(lower), pa.int64())
            yield batch(schema, np.full(len(lower), TEXT, dtype=np.int32), np.full(len(lower), chunk), none, none, np.arange(row, row + len(lower)), some.column(0), lower)
            row += len(lower)
            seen += int(learn.sum())
            codes, _, dictionary = words(lower.filter(pa.array(learn)))
            n = np.bincount(codes, minlength=len(dictionary))
            found.add(hash_strings(dictionary)[n > 0], n[n > 0])
            data, starts, size = laid_out(lower)
            key, counted = strings(data, _positions(starts, size)), np.repeat(learn, size)
            held.add(key[counted])
            if not counted.all():
                others = np.unique(key[~counted])
                held.add(others, np.zeros(len(others), dtype=np.int64))
            size_of_chunk += int(size.sum())
            if found.full():
                yield rows(WORD, found)
            if held.full() or size_of_chunk >= CHUNK_BYTES:
                yield rows(STRING, held)
                chunk, size_of_chunk = chunk + 1, 0
        yield rows(WORD, found)
        yield rows(STRING, held)
        yield batch(schema, [TEXTS], [None], [0], [seen], [None], [None], [None])

    texts = docs.select("doc_id", "text", train.alias("train"))
    return mapped(texts, ["doc_id", "text", "train"], run, "kind int, chunk long, key long, n long, row long, doc_id long, text string")


def summed(chunks: DataFrame) -> DataFrame:
    """(kind, key, n): word hashes, byte strings, number of texts."""
    return chunks.where(F.col("kind") != TEXT).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def counts(train: DataFrame) -> DataFrame:
    """The counts of training texts."""
    return summed(chunked(train, F.lit(True)))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series after eight steps up."""
    down = np.ones_like(x)
    for k in range(8):
        down *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(down)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of the counts under the Krichevsky-Trofimov estimator."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _bits(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of zeros and ones at each node of the byte tree (node i has children 2i and 2i + 1; node 0 is unused)."""
    heap = np.zeros((len(n), 512))
    heap[:, 256:] = n
    for level in range(7, -1, -1):
        a, b = 1 << level, 2 << level
        heap[:, a:b] = heap[:, 2 * a : 2 * b].reshape(len(n), a, 2).sum(axis=2)
    return heap[:, 0:512:2].copy(), heap[:, 1:512:2].copy()


def _by_parent(values: np.ndarray, parent: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]))
    if len(parent):
        order = np.argsort(parent, kind="stable")
        p = parent[order]
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        out[p[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


@dataclass
class Tree:
    """``steps[d - 1]`` leads from (node of depth d - 1, byte before) to the node of depth d, 0 for none; ``table`` has
    log10 of every byte's probability at every node."""

    steps: list[np.ndarray]
    offset: list[int]
    table: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        """log10 probability of each (lower-cased) text."""
        data, starts, size = laid_out(texts)
        at = _positions(starts, size)
        node = np.ones(len(at), dtype=np.int64)
        deepest = np.zeros(len(at), dtype=np.int64)
        for d, step in enumerate(self.steps, 1):
            node = step[node * 256 + data[at - d]].astype(np.int64)
            deepest = np.where(node > 0, self.offset[d] + node - 1, deepest)
        found = self.table.ravel()[deepest * 256 + data[at]].astype(np.float64)
        return np.add.reduceat(found, size.cumsum() - size) if len(size) else np.zeros(0)


def weighted(contexts: list[np.ndarray], n: list[np.ndarray]) -> Tree:
    """The tree over sorted contexts of each depth (numbers of d bytes, the latest lowest) with their byte counts."""
    depth = len(contexts)
    parent = [np.zeros(0, dtype=np.int64)] + [np.searchsorted(contexts[d - 1], contexts[d] & ((1 << 8 * (d - 1)) - 1)) for d in range(1, depth)]
    share, ones_at = [None] * depth, [None] * depth
    log_w = below0 = below1 = None
    for d in range(depth - 1, -1, -1):
        zeros, ones = _bits(n[d])
        own = _log_kt(zeros, ones)
        if d + 1 < depth:
            rest = _log_kt(np.maximum(zeros - _by_parent(below0, parent[d + 1], len(zeros)), 0), np.maximum(ones - _by_parent(below1, parent[d + 1], len(zeros)), 0))
            children = _by_parent(log_w, parent[d + 1], len(zeros)) + rest
            share[d] = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))
            log_w = np.logaddexp(own, children) - np.log(2)
        else:
            share[d], log_w = np.ones_like(own), own
        ones_at[d] = (ones + 0.5) / (zeros + ones + 1)
        below0, below1 = zeros, ones
    table, offset, so_far = [], [], None
    for d in range(depth):
        mixed, left = (np.zeros_like(ones_at[0]), np.ones_like(ones_at[0])) if d == 0 else (so_far[0][parent[d]], so_far[1][parent[d]])
        one = np.clip(mixed + left * ones_at[d], 1e-12, 1 - 1e-12)
        heap = np.zeros((len(one), 512))
        for i in range(8):
            a, b = 1 << i, 2 << i
            heap[:, 2 * a : 2 * b : 2] = heap[:, a:b] + np.log10(1 - one[:, a:b])
            heap[:, 2 * a + 1 : 2 * b : 2] = heap[:, a:b] + np.log10(one[:, a:b])
        offset.append(sum(map(len, table)))
        table.append(heap[:, 256:].astype(np.float32))
        so_far = mixed + left * share[d] * ones_at[d], left * (1 - share[d])
    steps = []
    for d in range(1, depth):
        step = np.zeros((len(contexts[d - 1]) + 1, 256), dtype=np.int32)
        step[parent[d] + 1, contexts[d] >> 8 * (d - 1)] = np.arange(1, len(contexts[d]) + 1)
        steps.append(step.ravel())
    return Tree(steps, offset, np.concatenate(table))


_SMALL = np.arange(1 << 14)
_HALF, _ONE = _log_gamma(_SMALL + 0.5), _log_gamma(_SMALL + 1.0)


def _log_kt_counts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """``_log_kt`` of whole numbers, most of them small."""
    both = zeros + ones
    out = np.empty(len(both))
    few = both < len(_SMALL)
    z, o, t = (x[few].astype(np.int64) for x in (zeros, ones, both))
    out[few] = _HALF[z] + _HALF[o] - _ONE[t] - np.log(np.pi)
    out[~few] = _log_kt(zeros[~few], ones[~few])
    return out


@dataclass
class Nodes:
    """Nodes of the byte trees of some contexts of one depth: sorted ids (context, latest byte highest, then the node), how
    often they were met and how often a one followed, the weight of their own estimate and their log probability; ``up``
    is the place of each in the next lesser depth."""

    ids: np.ndarray
    n: np.ndarray
    ones: np.ndarray
    share: np.ndarray
    log_w: np.ndarray
    up: np.ndarray | None = None

    def known(self) -> np.ndarray:
        """Whether the context of a node was seen in training: its first node counts all that followed."""
        context = self.ids >> 8
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, dtype=np.int64)
        return np.repeat(self.n[first] > 0, np.diff(np.concatenate([first, [len(context)]])))


def climb(ids: np.ndarray, n: np.ndarray, ones: np.ndarray, below: np.ndarray | None, depths: int) -> list[Nodes]:
    """The nodes and those of ``depths`` lesser depths, deepest first. ``below`` sums up the log probabilities under the first
    ones; without it they are the deepest of the tree. All strings of a context of a lesser depth must be among them."""
    out = []
    while True:
        own = _log_kt_counts(n - ones, ones)
        if below is None:
            share, log_w = np.ones(len(ids)), own
        else:
            share, log_w = 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.logaddexp(own, below) - np.log(2)
        out.append(Nodes(ids, n, ones, share, log_w))
        if len(out) > depths:
            return out
        ids, n, ones, below = lesser(out[-1])


def lesser(nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and sums of the nodes in contexts shorter by the oldest byte."""
    ids, nodes.up = np.unique(((nodes.ids >> 16) << 8) | (nodes.ids & 255), return_inverse=True)
    return ids, *[np.bincount(nodes.up, weights=v, minlength=len(ids)) for v in (nodes.n, nodes.ones, nodes.log_w)]


@dataclass
class Mix:
    """Of each node: the probability of a one if its context is the longest one known, and the sum and the weight left if not."""

    one: np.ndarray
    mixed: np.ndarray
    left: np.ndarray

    def at(self, place: np.ndarray) -> "Mix":
        return Mix(self.one[place], self.mixed[place], self.left[place])

    def under(self, nodes: Nodes, known: np.ndarray) -> "Mix":
        """One depth further, given this of each node's next lesser depth."""
        ones = (nodes.ones + 0.5) / (nodes.n + 1)
        one = np.where(known, self.mixed + self.left * ones, self.one)
        return Mix(one, self.mixed + self.left * nodes.share * ones, self.left * (1 - nodes.share))


def _leaves(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the deepest contexts with their sums, and the place among them of each string's eight nodes."""
    byte = key & 255
    level = np.arange(8)[:, None]
    ids, at = np.unique(((key >> 8) << 8) | (1 << level) | (byte >> (8 - level)), return_inverse=True)
    at = at.reshape(8, -1)
    bit = (byte >> (7 - level)) & 1
    total = lambda v: np.bincount(at.ravel(), weights=v.ravel(), minlength=len(ids))
    return ids, total(np.broadcast_to(n, at.shape)), total(bit * n), at


def _whole_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted strings with counts, cut between contexts of TOP + 1 bytes."""
    shift, key, n = 8 * (DEPTH - TOP), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    waiting, size = [], 0
    for b in batches:
        waiting.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size < NODE_STRINGS:
            continue
        key, n = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
        last = int(np.searchsorted(key, (key[-1] >> shift) << shift))
        if last:
            yield key[:last], n[:last]
        waiting, size = [(key[last:], n[last:])], len(key) - last
    if size:
        yield tuple(np.concatenate([w[k] for w in waiting]) for k in (0, 1))


def probabilities(table: DataFrame) -> DataFrame:
    """(key, p): log10 of the probability that every string's last byte follows its context."""
    context = F.shiftright("key", 8 * (DEPTH - TOP))
    dealt = table.where(F.col("kind") == STRING).select("key", "n").repartition(context).sortWithinPartitions("key")
    schema = pa.schema([("id", pa.int64()), ("n", pa.float64()), ("ones", pa.float64()), ("below", pa.float64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _whole_contexts(batches):
            ids, m, ones, _ = _leaves(key, n)
            yield batch(schema, *lesser(climb(ids, m, ones, None, DEPTH - TOP - 1)[-1]))

    sums = dealt.mapInArrow(weigh, "id long, n double, ones double, below double").groupBy("id").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    got = sums.orderBy("id").toArrow()
    top = climb(*(got.column(c).to_numpy() for c in ("id", "n", "ones", "below")), TOP)
    size = len(top[-1].ids)
    mix = Mix(np.full(size, 0.5), np.zeros(size), np.ones(size)).under(top[-1], np.ones(size, dtype=bool))
    for nodes in top[-2::-1]:
        mix = mix.at(nodes.up).under(nodes, nodes.known())
    shared = table.sparkSession.sparkContext.broadcast((top[0].ids, mix))
    out = pa.schema([("key", pa.int64()), ("p", pa.float32())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_ids, start = shared.value
        for key, n in _whole_contexts(batches):
            ids, m, ones, at = _leaves(key, n)
            deep = climb(ids, m, ones, None, DEPTH - TOP - 1)
            here = start.at(np.searchsorted(known_ids, lesser(deep[-1])[0]))
            for nodes in deep[::-1]:
                here = here.at(nodes.up).under(nodes, nodes.known())
            one = np.clip(here.one, 1e-12, 1 - 1e-12)
            logs = np.log10(np.stack([1 - one, one]))
            bit = ((key & 255) >> (7 - np.arange(8)[:, None])) & 1
            yield batch(out, key, logs[bit, at].sum(axis=0).astype(np.float32))

    return dealt.mapInArrow(spell, "key long, p float")


@dataclass
class Words:
    hashes: np.ndarray
    n: np.ndarray
    end: int
    total: int
    distinct: int

    def log(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def frequent(table: DataFrame) -> Words:
    """Totals, and the words frequent enough to be sent everywhere."""
    sums = {r["kind"]: r for r in table.where(F.col("kind") != STRING).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    end = sums[TEXTS]["n"] if TEXTS in sums else 0
    total, distinct = (sums[WORD]["n"], sums[WORD]["v"]) if WORD in sums else (0, 0)
    total, distinct = total + end, distinct + (end > 0)
    found = table.where((F.col("kind") == WORD) & (F.col("n") >= MIN_WORD * total)).select("key", "n").toArrow()
    keys, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return Words(keys[order], n[order], end, total, distinct)


def text_scores(texts: pa.Array, keys: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log10 probability of each (lower-cased) text, given those of all its strings by sorted key."""
    data, starts, size = laid_out(texts)
    coded = pa.array(strings(data, _positions(starts, size)).view(np.int64)).dictionary_encode()
    found = p[np.searchsorted(keys, coded.dictionary.to_numpy())].astype(np.float64)
    return np.add.reduceat(found[coded.indices.to_numpy()], size.cumsum() - size) if len(size) else np.zeros(0)


def scored(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of every row, given the counts."""
    chunks = cut(chunked(docs, F.lit(False)), "chunks", "zstd")
    both = table.select("kind", "key", "n").unionByName(summed(chunks)).groupBy("kind", "key").agg(F.sum("n").alias("n"))
    return scored_chunks(chunks, cut(both, "counts"))


def scored_chunks(chunks: DataFrame, table: DataFrame) -> DataFrame:
    """The scores of the texts in written chunks, given a written table of counts that has all their strings."""
    known = frequent(table)
    shared = chunks.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        by_word = shared.value
        keys, p = found.column("key").to_numpy(), found.column("p").to_numpy()
        order = np.argsort(keys)
        keys, p = keys[order], p[order]
        out = []
        for part in sliced(texts.to_batches()):
            lower = part.column("text")
            codes, bounds, dictionary = words(lower)
            h = hash_strings(dictionary)
            place = np.minimum(np.searchsorted(by_word.hashes, h), max(len(by_word.hashes) - 1, 0))
            hit = by_word.hashes[place] == h if len(by_word.hashes) else np.zeros(len(h), dtype=bool)
            value = np.where(hit, by_word.log(by_word.n[place] if len(by_word.n) else np.zeros(len(h))), 0.0)
            total = lambda x: (lambda r: r[bounds[1:]] - r[bounds[:-1]])(np.concatenate([[0], np.cumsum(x[codes])]))  # noqa: B023, E731
            size = np.diff(bounds)
            rare = ~hit[codes]
            pair = np.repeat(np.arange(len(size)), size)[rare] * np.int64(len(dictionary) + 1) + codes[rare]
            pair, times = np.unique(pair, return_counts=True)
            spans = pa.array(np.searchsorted(pair, np.arange(len(size) + 1) * np.int64(len(dictionary) + 1)).astype(np.int32))
            lists = lambda x: pa.ListArray.from_arrays(spans, pa.array(x))  # noqa: B023, E731
            out.append(
                batch(
                    schema,
                    part.column("row"),
                    part.column("doc_id"),
                    size + 1,
                    total(hit.astype(np.int64)) + (by_word.end > 0),
                    total(value) + by_word.log(np.float64(by_word.end)),
                    text_scores(lower, keys, p),
                    pc.binary_length(lower).cast(pa.int64()),
                    lists(h[pair % (len(dictionary) + 1)].view(np.int64)),
                    lists(times.astype(np.int64)),
                )
            )
        return pa.Table.from_batches(out, schema)

    text = "row long, doc_id long, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<long>, times array<long>"
    found = chunks.where(F.col("kind") == STRING).select("key", F.col("chunk").alias("holder")).join(probabilities(table), "key").select("holder", "key", "p")
    texts = chunks.where(F.col("kind") == TEXT).select("chunk", "row", "doc_id", "text")
    rows = cut(texts.groupBy("chunk").cogroup(found.groupBy("holder")).applyInArrow(run, text), "scored")
    each = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("key"), "w.times")
    met = each.join(table.where(F.col("kind") == WORD).select("key", "n"), "key", "left")
    n = F.coalesce("n", F.lit(0))
    log = F.log10((n + 0.1) / F.lit(float(known.total + 0.1 * (known.distinct + 1))))
    more = met.groupBy("row").agg(F.sum(F.col("times") * log).alias("_base"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("_known"))
    out = rows.drop("rare", "times").join(more, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + zero("_known")).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), "score", "n_bytes")
