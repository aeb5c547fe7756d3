"""Near-duplicate groups: MinHash bands propose pairs, odd sketches screen them, full shingle sets confirm them.

1. ``features``: one pass over the texts gives each document's set size, two 64-bit sums over its shingles (the name of its
   set), 200 minima folded into 40 band keys of 5, and the odd sketch: each of the 200 (position, minimum) samples flips
   one of 1024 bits. The XOR of two sketches holds the parity of their symmetric difference, so its population count z
   estimates the similarity as 1 + 1024/(4*200) * ln(1 - 2z/1024), most precisely near 1.
2. Documents of equal sets are one class (summed in the map tasks first, so thousands of copies are one row afterwards).
   Everything below is about classes.
3. Buckets (equal band keys) of two or more classes. In each, the class with the most partners over all buckets is the
   hub, usually what the others were copied from; every other class is paired with its hub, not with all others.
4. Pairs are screened by set size and sketch (``MARGIN`` under the limit: four standard deviations, so that a pair at the
   limit is lost with probability 3e-5, and ever more rarely above), then confirmed on the full sets. Links merge classes into components: each label gives way to the smallest next to it,
   and the links are carried over to the labels that are left, of which there are soon few.
5. ``STARS`` rounds of 3 and 4; after the first, only buckets with several components take part, with a hub for each of
   two components. What then still shares a bucket across components is compared in full, so that no pair that shares a
   bucket stays untested: an equi-join on the bucket that screens inside the join, by sketches and two exact bounds. Of a
   class only the shingles that some other open class holds can be common with any; a copy with many edits of its own has
   too few of them for a link and drops out before the join. And two sets have few shingles in common if few of ``CELLS``
   cells hold a shingle of both. A pair that shares several buckets is formed in the first.

Two sets of similarity 0.75 share no bucket with probability (1 - 0.75^5)^40 = 2e-5, of 0.8 with 1e-7; 0.9: below 1e-15.
Other than that the links are exact. Components and links are never collected. Intermediate tables are written to the
shared folder.

Results for odd input: a null text or one without words has n_shingles 0 and is a group of its own. A text of one to four
words has one shingle, all its words. Null ids take part in groups and give way to any other id of their group; the
component of a group of null ids only is null, and they are kept. Repeated rows are copies of each other; if they share
the id, all have kept = true. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlaw.llm.text import batch, cut, filled, hash_strings, mapped, mix, words

WORDS, BANDS, ROWS, BITS, CELLS = 5, 40, 5, 1024, 4096
SAMPLES = BANDS * ROWS
LEAST, OF = 75, 100  # linked if OF * intersection >= LEAST * union
MARGIN, STARS = 0.13, 2
FEATURES = "doc_id long, th long, n long, a long, b long, bands array<long>, sketch array<long>"

_random = np.random.default_rng(20_240_229)
_FACTORS = _random.integers(1 << 31, size=SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ROW = _random.integers(1 << 63, size=SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _random.integers(1 << 63, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    codes, bounds, dictionary = words(pc.ascii_lower(filled(texts)))
    h = mix(hash_strings(dictionary))[codes]
    total = max(0, len(h) - WORDS + 1)
    runs = np.zeros(total, dtype=np.uint64)
    for k in range(WORDS):
        runs += h[k : k + total] * _STEP[k]
    runs = mix(runs)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= WORDS:
            yield np.unique(runs[lo : hi - WORDS + 1])
        elif hi > lo:
            yield mix((h[lo:hi] * _STEP[: hi - lo]).sum(keepdims=True), int(hi - lo))
        else:
            yield h[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    """``SAMPLES`` MinHash values: the least product with each odd factor, modulo 2^32."""
    x = (mix(shingles, 1) >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 2048):
        np.minimum(out, (_FACTORS[:, None] * x[None, lo : lo + 2048]).min(axis=1), out=out)
    return out


def features(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for part in batches:
            sets = list(shingle_sets(part.column(1)))
            size = np.array([len(s) for s in sets], dtype=np.int64)
            name_a = np.array([mix(s, 2).sum() for s in sets], dtype=np.uint64)
            name_b = np.array([mix(s, 3).sum() for s in sets], dtype=np.uint64)
            m = np.stack([minima(s) for s in sets]).astype(np.uint64)
            keyed = mix((m * _ROW).reshape(-1, BANDS, ROWS).sum(axis=2) + np.arange(BANDS, dtype=np.uint64), 4)
            bits = (mix(m * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64), 5) >> np.uint64(54)).astype(np.int64)
            flips = np.bincount((bits + np.arange(len(sets))[:, None] * BITS).ravel(), minlength=len(sets) * BITS) & 1
            sketch = np.packbits(flips.astype(np.uint8).reshape(len(sets), BITS), axis=1).view(np.int64)

            def lists(x):
                return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.view(np.int64).ravel()))

            yield batch(schema, part.column(0), part.column(2), size, name_a.view(np.int64), name_b.view(np.int64), lists(keyed), lists(sketch))

    return mapped(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), ["doc_id", "text", "th"], run, FEATURES)


#: The most bits in which two sketches may differ: beyond it the estimate is more than ``MARGIN`` under the limit.
FAR = max(z for z in range(BITS) if 1 + BITS / (4 * SAMPLES) * math.log(max(1e-9, 1 - 2 * z / BITS)) >= LEAST / OF - MARGIN)


def _near(n: str, m: str, s: str, t: str) -> Column:
    """Sizes and sketches allow the limit. The words of the sketches are written out one by one, as Spark compiles such sums
    but interprets functions over arrays."""
    apart = reduce(add, (F.bit_count(F.get(s, F.lit(k)).bitwiseXOR(F.get(t, F.lit(k)))) for k in range(BITS // 64)))
    return (OF * F.least(n, m) >= LEAST * F.greatest(n, m)) & (apart <= FAR)


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, items, cells): the packed sets of the ``wanted`` classes, from the text of the smallest id of each, and the numbers
    of the ``CELLS`` cells that hold a shingle."""
    owners = classes.join(wanted, "a", "left_semi").select(F.col("rep").alias("_rep"))
    texts = docs.select("doc_id", "text").join(owners, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    schema = pa.schema([("a", pa.int64()), ("items", pa.binary()), ("cells", pa.list_(pa.int16()))])

    def run(batches):
        for part in batches:
            sets = list(shingle_sets(part.column(1)))
            yield batch(schema, np.array([mix(s, 2).sum() for s in sets], dtype=np.uint64).view(np.int64), [s.tobytes() for s in sets], [np.unique((mix(s, 6) >> np.uint64(52)).astype(np.int16)) for s in sets])

    return mapped(texts, ["doc_id", "text"], run, "a long, items binary, cells array<smallint>").join(wanted, "a", "left_semi").dropDuplicates(["a"])


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) of classes whose full sets reach the limit."""
    side = lambda k: classes.select(F.col("a").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    pairs = cut(pairs.join(side("x"), "x").join(side("y"), "y").where(_near("n_x", "n_y", "s_x", "s_y")).select("x", "y"), "screened")
    both = pairs.join(sets.select(F.col("a").alias("x"), F.col("items").alias("i_x")), "x").join(sets.select(F.col("a").alias("y"), F.col("items").alias("i_y")), "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("x", pa.int64()), ("y", pa.int64())])
        for part in batches:
            keep = []
            for p, q in zip(part.column(2), part.column(3), strict=True):
                p, q = np.frombuffer(p.as_buffer(), dtype=np.uint64), np.frombuffer(q.as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(OF * common >= LEAST * (len(p) + len(q) - common))
            keep = pa.array(keep, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], schema=out)

    return both.select("x", "y", "i_x", "i_y").mapInArrow(check, "x long, y long")


def shared_sizes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, shared): how many shingles of each node occur in another node as well. No other node can have more in common
    with it. Counted by the shingles that occur once, so that frequent ones meet only as counts."""
    schema = pa.schema([("a", pa.int64()), ("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for a, items in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                found = np.frombuffer(items.as_buffer(), dtype=np.int64)
                yield batch(schema, np.full(len(found), a, dtype=np.int64), found)

    own = sets.join(nodes, "a", "left_semi")
    rows = own.select("a", "items").mapInArrow(run, "a long, shingle long")
    once = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("a").alias("a")).where("n = 1").groupBy("a").agg(F.count("*").alias("once"))
    return own.select("a", (F.octet_length("items") / 8).cast("long").alias("n")).join(once, "a", "left").select("a", (F.col("n") - F.coalesce("once", F.lit(0))).alias("shared"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(a, comp): the smallest label reachable over ``links`` (x, y), for every row of ``nodes`` (a, comp). A label is itself a
    row of ``nodes``, and labels are hashes: where they rise along a path, they do so for a few steps only."""
    named = nodes.where("a != comp")
    ends = links.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.*")
    edges = cut(_renamed(ends, named).distinct(), "edges")
    if edges.isEmpty():
        return nodes
    moves = None
    while True:
        # each label gives way to its least neighbour; an edge between the new labels keeps together what was
        step = cut(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("a"), F.least("x", "y").alias("comp")), "step")
        if moves is None:
            moves = step
        else:
            ahead = step.select(F.col("a").alias("comp"), F.col("comp").alias("ahead"))
            moves = cut(moves.join(ahead, "comp", "left").select("a", F.coalesce("ahead", "comp").alias("comp")), "moves")
        edges = cut(_renamed(edges, step).distinct(), "edges")
        if edges.isEmpty():
            break
    moved = moves.select(F.col("a").alias("comp"), F.col("comp").alias("to"))
    return cut(nodes.join(moved, "comp", "left").select("a", F.coalesce("to", "comp").alias("comp")), "labels")


def _renamed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between different labels: ends that ``labels`` (a, comp) names are replaced."""
    for end in ("x", "y"):
        edges = edges.join(labels.select(F.col("a").alias(end), F.col("comp").alias(f"to_{end}")), end, "left").withColumn(end, F.coalesce(f"to_{end}", end))
    return edges.select("x", "y").where("x != y")


def _hubs(members: DataFrame) -> DataFrame:
    """Pairs of each member with its bucket's hub, and with the hub of the bucket's last component, across components."""
    # (negative degree, class) packed by comparison of structs: the most partners first, then the smaller class
    rank = F.struct((-F.col("degree")).alias("d"), F.col("a").alias("hub"), F.col("comp").alias("hub_comp"))
    best = members.groupBy("key", "comp").agg(F.min(rank).alias("best"))
    tops = best.groupBy("key").agg(F.min("best").alias("h"), F.max(F.struct("comp", "best"))["best"].alias("g"))
    near = members.join(tops, "key")
    pair = lambda h: near.where(F.col("comp") != F.col(h)["hub_comp"]).select(F.least("a", F.col(h)["hub"]).alias("x"), F.greatest("a", F.col(h)["hub"]).alias("y"))
    return pair("h").union(pair("g")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, th, component) for every row of ``docs``; th is the hash of the text,
    component the label of the group (null without words)."""
    all_features = cut(features(docs), "features")
    by_set = all_features.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(by_set, "classes")
    rows = classes.select("a", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(rows.join(shared, "key"), "members")
    degree = members.groupBy("a").agg((F.sum("size") - F.count("*")).alias("degree"))
    members = cut(members.select("key", "band", "a").join(degree, "a"), "members")
    sets = cut(full_sets(docs, classes, cut(members.select("a").distinct(), "nodes")), "sets")
    labels = classes.select("a", F.col("a").alias("comp"))
    open_ = members.withColumn("comp", F.col("a"))
    for _ in range(STARS):
        labels = components(labels, confirmed(_hubs(open_), classes, sets))
        open_ = _open(members, labels)
        if open_.isEmpty():
            break
    else:
        labels = components(labels, confirmed(_across(open_, classes, sets), classes, sets))
    least = labels.join(classes.select("a", "rep"), "a").groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = labels.join(least, "comp").join(classes.select("a", "b", "n"), "a").select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("n").alias("_n"), "component_id", F.col("comp").alias("component"))
    named = cut(named, "named")
    # both sides are plain reads, so that the adaptive join can split a class with very many copies
    out = all_features.drop("bands", "sketch").join(named, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("n") == F.col("_n")), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "th", "component")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest id. Repeated rows (id and text) stay once."""
    near = cut(near_duplicates(docs), "near")
    first = near.where("kept and component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("one"))
    marked = near.join(first, "component", "left")
    gone = marked.where(F.col("component").isNotNull() & ~F.struct("doc_id", "th").eqNullSafe(F.col("one"))).select(F.struct("doc_id", "th").alias("_key"))
    # one key (of one type, nullable fields included) for both steps, so that texts are shuffled once; null ids inside a
    # struct are equal
    rows = docs.withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("th")).cast(gone.schema["_key"].dataType))
    return rows.join(gone, "_key", "left_anti").dropDuplicates(["_key"]).drop("_key")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with components, of buckets that hold several."""
    labelled = cut(members.join(labels, "a"), "open")
    several = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    return cut(labelled.join(several, "key"), "open")


def _across(open_: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of a bucket across components that sizes, shared shingles and sketches allow, each once."""
    shared = cut(shared_sizes(open_.select("a").distinct(), sets), "shared")
    able = shared.join(classes.select("a", "n", "sketch", "bands"), "a").where(OF * F.col("shared") >= LEAST * F.col("n")).join(sets.select("a", "cells"), "a")
    earlier = F.slice("bands", F.lit(1), F.col("band")).alias("earlier")  # the document's keys of the bands before this one
    full = cut(open_.join(able, "a").select("a", "key", "comp", "n", "shared", "sketch", "cells", earlier), "across")
    l, r = full.alias("l"), full.alias("r")  # noqa: E741
    most = F.least("l.shared", "r.shared")
    reach = lambda common: OF * common >= LEAST * (F.col("l.n") + F.col("r.n") - common)
    # two sets have at most a shingle in common for each cell that both fill, and one more for each that shares its cell
    # with another of its own set
    both = F.size(F.array_intersect("l.cells", "r.cells"))
    met = both + F.least(F.col("l.n") - F.size("l.cells"), F.col("r.n") - F.size("r.cells"))
    # Spark compiles all of this into the loop over a bucket's pairs, which a function with a lambda would prevent
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.a") < F.col("r.a")) & (F.col("l.comp") != F.col("r.comp")) & reach(most) & _near("l.n", "r.n", "l.sketch", "r.sketch")
    on = on & ~F.arrays_overlap("l.earlier", "r.earlier") & reach(met)
    return l.join(r, on).select(F.col("l.a").alias("x"), F.col("r.a").alias("y"))
