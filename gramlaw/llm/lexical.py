"""Ranked lexical search over a length-stratified index.

Documents with the same normaliser ``m`` form a stratum, as the impact of a term on a document's score,
(10^9 tf) div (1000 tf + 8 m), depends on tf and m alone. Within a stratum the postings of a term are groups of documents
with equal tf, so an impact is computed once for a group, not for each posting. A stratum is stored as rows of about
``SHARD`` postings (a large one as several): sorted terms, their tf groups, the documents of each group. The highest tf of
each term bounds what the stratum can add to a query's score.

Index: one pass counts documents and terms and takes quantiles of the lengths, one pass takes the terms of each text and
deals the documents to ranges of length between these quantiles; ties of length are spread, so that many documents of one
length fill many ranges. All documents with a term are indexed.

Search: queries are taken in blocks of about ``BLOCK`` (query, term) pairs, which are broadcast. A pass over the index
counts the documents of each term; one bounds each stratum for each query; the ``FIRST`` strata of the highest bounds are
visited first and give the k-th score to be beaten; then each task visits the strata whose bound reaches what is known by
then. A bound equal to the k-th score is visited, since a smaller id may win there. The result is exact.

Results for odd input: null and empty texts have no terms, are not counted and never found. A query is all rows of one id
(null ids are one query): each of its terms counts once; without known terms it has no rows. Repeated documents are ranked
one by one; null ids come before others among equal scores. No documents or no queries give no rows. Terms are compared by
64-bit hashes. Extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramlaw.llm.text import cut, hash_strings, mapped, mix, terms
from gramlaw.session import prepare

SHARD, BLOCK, RANGE, FIRST = 1 << 17, 1 << 18, 1 << 19, 8
ROW = pa.schema([("shard", pa.int64()), ("m", pa.int64()), ("docs", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("at", pa.list_(pa.int32()))])
ROW_SQL = "shard long, m long, docs array<long>, terms array<long>, tfs array<int>, stops array<int>, at array<int>"


def normaliser(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """100 - 90 + (90 n N) div L, without forming the whole product."""
    each, rest = divmod(90 * documents, length)
    return 10 + n * each + n * rest // length


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Index:
    """``strata`` holds a row of ``ROW`` for each part of a stratum; ``documents`` and ``length`` are N and L."""

    strata: DataFrame
    documents: int
    length: int


def _keys(n: np.ndarray, seen: int) -> np.ndarray:
    """Lengths with a fraction that spreads equal ones."""
    return n + (mix(np.arange(seen, seen + len(n)).astype(np.uint64)) >> np.uint64(32)).astype(np.float64) / 2**32


def index(docs: DataFrame) -> Index:
    """Index every document that has a term."""
    spark = docs.sparkSession

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 32
        for b in batches:
            n = np.diff(terms(b.column(0)).bounds)
            key = _keys(n, seen)
            seen += len(n)
            yield pa.RecordBatch.from_arrays([pa.array(n[n > 0]), pa.array(key[n > 0])], names=["n", "key"])

    counted = cut(mapped(docs, ["text"], lengths, "n long, key double"), "lengths")
    sums = counted.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    total, length = sums["documents"], sums["length"] or 0
    ranges = length // RANGE + 4 * spark.sparkContext.defaultParallelism
    cuts = counted.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], max(10_000, 20 * ranges))).first()[0]
    cuts = np.array(sorted(cuts or []))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 32
        for b in batches:
            t = terms(b.column(1))
            n = np.diff(t.bounds)
            size = max(len(t.dictionary), 1)
            pair, tf = np.unique(np.repeat(np.arange(len(n)), n) * size + t.codes, return_counts=True)
            bounds = np.searchsorted(pair, np.arange(len(n) + 1) * size).astype(np.int32)
            lists = lambda x, kind, bounds=bounds: pa.ListArray.from_arrays(pa.array(bounds), pa.array(x, kind))
            columns = [
                pa.array(np.searchsorted(cuts, _keys(n, seen)).astype(np.int32)),
                pa.array(normaliser(n, total, length)) if total else pa.array(n),
                b.column(0),
                lists(hash_strings(t.dictionary).view(np.int64)[pair % size], pa.int64()),
                lists(tf, pa.int32()),
            ]
            seen += len(n)
            yield pa.RecordBatch.from_arrays(columns, names=["range", "m", "doc_id", "terms", "tfs"]).filter(pa.array(n > 0))

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, postings, stratum = TaskContext.get().partitionId() << 32, [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column(0).to_numpy()
            size = pc.list_value_length(b.column(2)).to_numpy().astype(np.int64).cumsum()
            lo = 0
            while lo < len(m):
                before = size[lo - 1] if lo else 0
                hi = min(int(np.searchsorted(m, m[lo], side="right")), max(lo + 1, int(np.searchsorted(size, before + SHARD, side="right"))))
                if held and (m[lo] != stratum or postings + size[hi - 1] - before > SHARD):
                    yield _shard(name, stratum, held)
                    name, held, postings = name + 1, [], 0
                held.append(b.slice(lo, hi - lo))
                postings, stratum, lo = postings + int(size[hi - 1] - before), int(m[lo]), hi
        if held:
            yield _shard(name, stratum, held)

    parts = max(ranges // 4, 1)
    rows = mapped(docs, ["doc_id", "text"], listed, "range int, m long, doc_id long, terms array<long>, tfs array<int>")
    dealt = rows.repartition(parts, "range").select("m", "doc_id", "terms", "tfs").sortWithinPartitions("m", "doc_id")
    return Index(cut(dealt.mapInArrow(inverted, ROW_SQL), "strata"), total, length)


def _shard(name: int, m: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The postings of documents with equal normaliser, by term and tf."""
    table = pa.Table.from_batches(held).combine_chunks()
    ids, term, tf = table.column(1).combine_chunks(), table.column(2).combine_chunks(), table.column(3).combine_chunks()
    at = np.repeat(np.arange(len(ids)), pc.list_value_length(term).to_numpy())
    term, tf = term.flatten().to_numpy(), tf.flatten().to_numpy()
    order = np.lexsort((at, tf, term))
    term, tf, at = term[order], tf[order], at[order]
    last = np.append((term[1:] != term[:-1]) | (tf[1:] != tf[:-1]), True)
    one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
    stop = np.flatnonzero(last)
    columns = [pa.array([name]), pa.array([m]), one(ids, pa.int64()), one(term[stop], pa.int64()), one(tf[stop], pa.int32()), one(stop + 1, pa.int32()), one(at, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, schema=ROW)


@dataclass
class Queries:
    """Terms ``words`` (sorted hashes); query ``i`` has those numbered ``term[first[i] : first[i + 1]]``."""

    ids: list[int | None]
    words: np.ndarray
    first: np.ndarray
    term: np.ndarray


def queries(items: DataFrame) -> Iterator[Queries]:
    """Blocks of queries of about ``BLOCK`` (query, term) pairs, from rows of item_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = terms(b.column(1))
            n = np.diff(t.bounds)
            hashed = hash_strings(t.dictionary).view(np.int64)
            yield pa.RecordBatch.from_arrays([pc.take(b.column(0), pa.array(np.repeat(np.arange(len(n)), n))), pa.array(hashed[t.codes])], names=["item_id", "term"])

    pairs = cut(mapped(items, ["item_id", "text"], run, "item_id long, term long").distinct(), "queries")
    many = -(-pairs.count() // BLOCK)
    for k in range(many):
        found = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(many)) == k).orderBy("item_id", "term").toArrow()
        if not found.num_rows:
            continue
        item = found.column("item_id").combine_chunks()
        value, null = pc.fill_null(item, 0).to_numpy(), item.is_null().to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (null[1:] != null[:-1])))
        words, term = np.unique(found.column("term").to_numpy(), return_inverse=True)
        yield Queries(pc.take(item, pa.array(start)).to_pylist(), words, np.append(start, len(term)), term)


class Stratum:
    """One row of the index seen by a block of queries."""

    def __init__(self, row: dict[str, np.ndarray], asked: Queries, weight: np.ndarray):
        m, held, tfs, self.stops = row["m"], row["terms"], row["tfs"].astype(np.int64), row["stops"]
        self.lo, self.hi = np.searchsorted(held, asked.words), np.searchsorted(held, asked.words, side="right")
        self.has = np.flatnonzero(self.hi > self.lo)
        most = np.zeros(len(asked.words), dtype=np.int64)
        most[self.has] = weight[self.has] * impact(tfs[self.hi[self.has] - 1], m)
        sums = np.concatenate([[0], np.cumsum(most[asked.term])])
        self.bound = sums[asked.first[1:]] - sums[asked.first[:-1]]
        self.m, self.tfs, self.at, self.docs, self.weight, self.asked = m, tfs, row.get("at"), row.get("docs"), weight, asked
        self.value = None

    def scores(self, q: int) -> np.ndarray:
        """Score of each document of the stratum for query ``q``."""
        if self.value is None:  # each impact once, spread over the documents of its group
            size = np.diff(self.stops, prepend=0)
            self.value = np.repeat(impact(self.tfs, self.m), size)
        mine = self.asked.term[self.asked.first[q] : self.asked.first[q + 1]]
        mine = mine[self.hi[mine] > self.lo[mine]]
        begin = np.where(self.lo[mine] > 0, self.stops[self.lo[mine] - 1], 0)
        end = self.stops[self.hi[mine] - 1]
        at = np.concatenate([self.at[a:z] for a, z in zip(begin, end, strict=True)])
        value = np.concatenate([self.weight[t] * self.value[a:z] for t, a, z in zip(mine, begin, end, strict=True)])
        if self.bound[q] < 1 << 53:
            return np.bincount(at, weights=value, minlength=len(self.docs)).astype(np.int64)
        out = np.zeros(len(self.docs), dtype=np.int64)
        np.add.at(out, at, value)
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            lists = {c: b.column(j)[i] for j, c in enumerate(b.schema.names)}
            out = {c: v.as_py() if c in ("shard", "m") else v.values if c == "docs" else v.values.to_numpy() for c, v in lists.items()}
            yield out


class Best:
    """The k highest-scoring documents of each query, by score, then id, null first."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor, self.held = k, floor.copy(), defaultdict(list)

    def visit(self, stratum: Stratum, wanted: np.ndarray) -> None:
        reach = wanted[(stratum.bound[wanted] > 0) & (stratum.bound[wanted] >= self.floor[wanted])]
        for q in reach[np.argsort(-stratum.bound[reach], kind="stable")]:
            score = stratum.scores(q)
            at = np.flatnonzero((score > 0) & (score >= self.floor[q]))
            at = at[np.lexsort((at, -score[at]))][: self.k]
            ids = pc.take(stratum.docs, pa.array(at)).to_pylist()
            both = self.held[q] + [(-s, i is not None, i or 0) for s, i in zip(score[at].tolist(), ids, strict=True)]
            self.held[q] = sorted(both)[: self.k]
            if len(self.held[q]) == self.k:
                self.floor[q] = max(self.floor[q], -self.held[q][-1][0])

    def batch(self) -> pa.RecordBatch:
        rows = [(q, i if there else None, -s) for q, held in self.held.items() for s, there, i in held]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=["q", "doc_id", "score"])


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(found: Index, asked: Queries, k: int) -> DataFrame:
    spark, strata = found.strata.sparkSession, found.strata
    shared = spark.sparkContext.broadcast(asked)

    def frequencies(batches):
        asked = shared.value
        total = np.zeros(len(asked.words), dtype=np.int64)
        for row in _rows(batches):
            edge = np.append(0, row["stops"])
            total += edge[np.searchsorted(row["terms"], asked.words, side="right")] - edge[np.searchsorted(row["terms"], asked.words)]
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["word", "df"])

    counts = strata.select("terms", "stops").mapInArrow(frequencies, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    weight = np.zeros(len(asked.words), dtype=np.int64)
    df = counts.column("df").to_numpy()
    weight[counts.column("word").to_numpy()] = np.floor(1000 * np.log((2 * found.documents + 2) / (2 * df + 1))).astype(np.int64)
    weights, many = spark.sparkContext.broadcast(weight), len(asked.ids)

    def bounds(batches):
        top = defaultdict(list)
        for row in _rows(batches):
            bound = Stratum(row, shared.value, weights.value).bound
            for q in np.flatnonzero(bound):
                if len(top[q]) < FIRST or bound[q] > top[q][0][0]:
                    top[q] = sorted([*top[q], (int(bound[q]), row["shard"])])[-FIRST:]
        rows = [(q, s, b) for q, held in top.items() for b, s in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["q", "doc_id", "score"])

    answer = "q int, doc_id long, score long"
    first = _ranked(strata.select("shard", "m", "terms", "tfs", "stops").mapInArrow(bounds, answer), FIRST).collect()  # FIRST rows a query
    wanted = defaultdict(list)
    for r in first:
        wanted[r["doc_id"]].append(r["q"])

    def early(batches):
        best = Best(k, np.zeros(many, dtype=np.int64))
        for row in _rows(batches):
            if row["shard"] in wanted:
                best.visit(Stratum(row, shared.value, weights.value), np.array(sorted(wanted[row["shard"]])))
        yield best.batch()

    chosen = spark.createDataFrame([(s,) for s in wanted], "shard long")
    floor = np.zeros(many, dtype=np.int64)
    for r in _ranked(strata.join(F.broadcast(chosen), "shard", "left_semi").mapInArrow(early, answer), k).where(F.col("rank") == k).collect():  # at most FIRST strata a query were sent
        floor[r["q"]] = r["score"]

    def all_of_them(batches):
        best, everything = Best(k, floor), np.arange(many)
        for row in _rows(batches):
            best.visit(Stratum(row, shared.value, weights.value), everything)
        yield best.batch()

    ranked = _ranked(strata.mapInArrow(all_of_them, answer), k)
    ids = spark.createDataFrame(list(enumerate(asked.ids)), "q int, item_id long")
    return ranked.join(F.broadcast(ids), "q").select("item_id", "rank", "doc_id", "score")  # ids: one row a query of the block


def search(found: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each query."""
    prepare(items.sparkSession)
    out = items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if found.documents:
        for asked in queries(items):
            out = out.unionByName(_searched(found, asked, k))
    return out
