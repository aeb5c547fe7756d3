"""Helpers shared by the text operators: slices of bounded size, words, stable hashes, folds and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramlaw.session import prepare

SLICE_BYTES = 2 << 20
SPACE = "\\x20\\x09-\\x0D"  # the white space that separates words


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it. Only a local master, as in tests, may do without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = tempfile.mkdtemp(prefix="spark-text-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


WRITTEN: list[str] = []  # tables that ``cut`` wrote in this process and that ``release`` has not deleted


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later steps and lost executors never redo it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/text/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int) -> None:
    """Delete the tables written since, but for the newest, which no longer needs them. ``since`` counts ``WRITTEN``."""
    for path in WRITTEN[since:-1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del WRITTEN[since:-1]


CORE = ("doc_id", "text", "lang", "source", "n_chars")


def packed(docs: DataFrame) -> DataFrame:
    """The columns that operators know, and all others in one struct, so that no name can clash with a working column."""
    core = [c for c in docs.columns if c in CORE]
    return docs.select(*core, F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in CORE]).alias("_extra"))


def unpacked(out: DataFrame, like: DataFrame) -> DataFrame:
    return out.select(*[F.col(c) if c in CORE else F.col("_extra")[c].alias(c) for c in like.columns])


def mapped(df: DataFrame, columns: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over the named columns; ``fn`` sees slices of about ``SLICE_BYTES`` of text."""
    prepare(df.sparkSession)
    return df.select(*columns).mapInArrow(lambda batches: fn(sliced(batches)), schema)


def sliced(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches by the bytes of their string columns; a single longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = size.cumsum()
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def filled(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return pc.fill_null(texts, "")


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of each text: codes into a dictionary, the bounds of each text's words, the dictionary."""
    lists = pc.ascii_split_whitespace(filled(texts))
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    keep = full[codes] if len(codes) else np.zeros(0, dtype=bool)
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[bounds], coded.dictionary


_ALNUM = np.array([c > 127 or chr(c).isalnum() for c in range(256)])


@dataclass
class Terms:
    """Runs of letters, digits and characters beyond ASCII in texts: codes into a dictionary, the bounds of each text's
    terms, and where in its text each term starts and stops (bytes)."""

    codes: np.ndarray
    bounds: np.ndarray
    dictionary: pa.Array
    start: np.ndarray
    stop: np.ndarray


def terms(texts: pa.Array) -> Terms:
    """The maximal runs of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]``, lower-cased in A-Z only."""
    lower = pc.ascii_lower(filled(texts))
    raw = [s.as_buffer() for s in lower]
    ends = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)).cumsum()
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    inside = _ALNUM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = ends[:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())).dictionary_encode()
    bounds = np.concatenate([[0], np.searchsorted(start, ends)])
    begin = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(bounds))
    return Terms(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds, flat.dictionary, start - begin, stop - begin)


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string that is the same in every process."""
    return np.fromiter((xxhash.xxh3_64_intdigest(s) for s in strings.to_pylist()), dtype=np.uint64, count=len(strings))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection for each salt)."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def total_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts of equal keys."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Tally:
    """Counts of 64-bit keys within one task; hands them on when ``limit`` distinct ones have come together."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.keys, self.counts, self.held = limit, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts.astype(np.int64))
        self.held += len(keys)
        if self.held > self.limit and len(self.keys) > 1:
            self.merge()

    def merge(self) -> None:
        keys, counts = total_by(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.held = [keys], [counts], len(keys)

    def full(self) -> bool:
        return self.held > self.limit

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        if self.keys:
            self.merge()
        keys = self.keys[0] if self.keys else np.zeros(0, dtype=np.uint64)
        counts = self.counts[0] if self.counts else np.zeros(0, dtype=np.int64)
        self.keys, self.counts, self.held = [], [], 0
        return keys, counts


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
