"""Fingerprints by locally consistent parsing.

A text's code points are parsed into phrases, the phrases into longer ones, and so on. Runs of equal symbols first become
one symbol. Deterministic coin tossing then labels each symbol by the lowest bit in which it differs from its left
neighbour; four rounds leave labels 0 to 5, never equal side by side, and a phrase starts wherever a label is a local
minimum (2 to about 12 symbols apart). Whether a phrase starts depends on a few symbols around alone, so equal substrings
are parsed alike inside whatever stands before them. A phrase is named by a hash of the names in it.

A fingerprint is the ``SIZE`` smallest 32-bit names of all phrases from level ``LEVEL`` up to ``TOP`` (a short text ends as one
phrase), as hexadecimal numbers in order. The likeness of two is their Jaccard estimate, the share of
common names among the ``SIZE`` smallest of both.

``with_next`` gives every document the next one by id at the price of one shuffle of the texts: ranges of (id, hash of the
text) become buckets, and the first document of each bucket is also sent to the bucket before as its end. The bounds come
from a bounded sample of pairs of numbers.

Results for odd input: a null text is an empty one; its fingerprint is empty, like another empty one (1.0) and unlike any
other (0.0). Null ids stand before all others, equal ids in the order of their texts' hashes; repeated rows follow each
other. A single row is followed by itself. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlaw.llm.text import batch, filled, mapped, mix

SIZE, LEVEL, TOP = 64, 2, 8
CHUNK = 400_000  # code points parsed at once, or one longer text
PER_BUCKET = 512  # documents of a bucket, about
SAMPLE = 200_000
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_POWER = (np.random.default_rng(10).integers(1 << 62, size=64, dtype=np.uint64) << np.uint64(1)) + np.uint64(1)


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label each symbol by the lowest bit that tells it from its left neighbour (bit 0 where there is none)."""
    one = x.dtype.type(1)
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = x[first] ^ one
    differ = x ^ left
    k = np.bitwise_count((differ & (~differ + one)) - one)
    return (2 * k + ((x >> k.astype(x.dtype)) & one).astype(np.uint8)).astype(np.uint8)


def _parse(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the names of the phrases of ``x`` and where each text's phrases begin."""
    first = np.zeros(len(x), dtype=bool)
    first[starts] = True
    new = first.copy()
    new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(x)))
    x, first = x[at], first[at]
    x = np.where(run > 1, mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + run.astype(np.uint64), 1).astype(x.dtype), x)
    begin = np.flatnonzero(first)
    label = x
    for _ in range(4):
        label = _toss(label, begin)
    low = first.copy()
    low[1:] |= label[1:] < label[:-1]
    ahead = np.zeros(len(x), dtype=bool)
    ahead[:-1] = label[:-1] < label[1:]
    last = np.append(begin[1:], len(x)) - 1
    ahead[last] = False  # a phrase of the last symbol alone tells nothing
    low &= ahead | first
    phrase = np.flatnonzero(low)
    length = np.diff(np.append(phrase, len(x)))
    place = np.arange(len(x)) - np.repeat(phrase, length)
    names = np.add.reduceat(mix(x.astype(np.uint64), 2) * _POWER[place % 64], phrase)
    return mix(names, 3), np.flatnonzero(first[phrase])


def _fingerprints(texts: list[str]) -> list[np.ndarray]:
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = size.cumsum() - size
    kept: list[list[np.ndarray]] = [[] for _ in texts]
    for level in range(1, TOP + 1):
        x, starts = _parse(x, starts)
        ends = np.append(starts[1:], len(x))
        if level >= LEVEL:
            short = (x >> np.uint64(32)).astype(np.uint32)
            for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                kept[i].append(short[a:b])
    return [np.unique(np.concatenate(k))[:SIZE] for k in kept]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The fingerprint of each text as sorted numbers."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
    group, held = [], 0
    for i, t in enumerate(texts):
        if t:
            group.append(i)
            held += len(t)
        if group and (held >= CHUNK or i + 1 == len(texts)):
            for j, f in zip(group, _fingerprints([texts[j] for j in group]), strict=True):
                out[j] = f
            group, held = [], 0
    return out


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = np.flatnonzero(both[1:] == both[:-1])
    different = len(both) - len(twice)
    if different <= SIZE:
        return len(twice) / different
    # among the SIZE smallest different numbers, those that stand twice
    rank = np.cumsum(np.concatenate([[True], both[1:] != both[:-1]]))
    return int(np.sum(rank[twice] <= SIZE)) / SIZE


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, end, doc_id, text), each bucket within one partition and in order; ``end`` marks the copy of the next
    bucket's first document. Null ids count as the smallest."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text"))
    keys = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "th")
    total = keys.count()
    buckets = max(1, total // PER_BUCKET)
    share = min(1.0, SAMPLE / max(total, 1))
    seen = keys.where(F.pmod(F.xxhash64("k", "th", F.lit(10)), F.lit(1 << 20)) < share * (1 << 20)).toArrow()
    k, th = seen.column("k").to_numpy(), seen.column("th").to_numpy()
    order = np.lexsort((th, k))
    at = order[np.linspace(0, len(order), min(buckets, len(order)), endpoint=False).astype(int)[1:]] if len(order) else order
    bounds = docs.sparkSession.sparkContext.broadcast((k[at], th[at]))

    @F.pandas_udf("int")
    def bucket(k: pd.Series, th: pd.Series) -> pd.Series:
        bk, bt = bounds.value
        ids, hashes = np.concatenate([bk, k.to_numpy()]), np.concatenate([bt, th.to_numpy()])
        row = np.arange(len(ids)) >= len(bk)
        o = np.lexsort((row, hashes, ids))
        below = np.cumsum(~row[o])
        out = np.empty(len(ids), dtype=np.int32)
        out[o] = below
        return pd.Series(out[len(bk) :])

    placed = rows.withColumn("bucket", bucket(F.coalesce("doc_id", F.lit(-(1 << 63))), F.col("th")))
    heads = placed.groupBy("bucket").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "th")).alias("head"))
    there = heads.toArrow().to_pylist()  # a row for each bucket
    there.sort(key=lambda r: r["bucket"])
    before = {r["bucket"]: there[i - 1]["bucket"] for i, r in enumerate(there)}
    spark = docs.sparkSession
    ends = spark.createDataFrame([(r["bucket"], r["head"]["k"], r["head"]["th"], before[r["bucket"]]) for r in there], "b int, k long, h long, before int")
    on = (F.col("bucket") == F.col("b")) & (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("k")) & (F.col("th") == F.col("h"))
    both = placed.join(F.broadcast(ends), on, "left")
    copies = F.when(F.col("before").isNotNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("end")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("end")))).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("end"))))
    dealt = both.select(F.explode(copies).alias("to"), "doc_id", "th", "text").select("to.*", "doc_id", "th", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "end", F.col("doc_id").asc_nulls_first(), "th").select("bucket", "end", "doc_id", "text")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited one (second half from the next document), and their likeness."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches):
        last = None
        for part in batches:
            texts = filled(part.column(3)).to_pylist()
            pairs = []
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), texts, fingerprints(texts), strict=True):
                if last and last[0] == row[0]:
                    pairs.append((last, row))
                last = None if row[1] else row
            if not pairs:
                continue
            edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
            prints = fingerprints(edited)
            yield batch(
                schema,
                [a[2] for a, _ in pairs],
                [len(a[3]) for a, _ in pairs],
                [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                [as_text(a[4]) for a, _ in pairs],
                [as_text(f) for f in prints],
                [likeness(a[4], f) for (a, _), f in zip(pairs, prints, strict=True)],
                [likeness(a[4], b[4]) for a, b in pairs],
            )

    ordered = with_next(docs)
    return mapped(ordered, ordered.columns, run, SCHEMA)
