"""Language identification by bit-sliced Bloom filters of character n-grams.

A model holds, for every n-gram length, an array of ``slots`` masks; bit l of a mask belongs to language l. An n-gram sets
the bit of its language in ``HASHES`` slots, and the AND of those slots gives all languages that hold it, in one lookup
whatever their number. A text's n-grams vote for all languages in their mask; from the votes of language l come off those
expected from false positives, whose rate is the filled share of l's bits to the power ``HASHES``:
(hits - n * rate) / (1 - rate). The most votes decide; n-grams of all languages do not count unless there are no others.

Training reads at most ``PER_LANGUAGE`` rows of each language (about; a hash of the id picks them, their whole texts
count), a bounded sample. An n-gram belongs to a language if it makes up at least ``MIN_SHARE`` of the language's n-grams,
so a language has at most 1/MIN_SHARE n-grams of each length, which bounds the model that the driver collects and
broadcasts. The number of languages must fit there, too.

Results for odd input: a null text or one without a letter is ``und`` with score 0. With no training rows everything is
``und``. Ties go to the language with more training n-grams, then to the smaller name. Null languages are not learned.
Repeated rows and null ids are judged alike, one by one. An empty table gives no rows. Other columns are not read by
``fit``; ``predict`` passes on those it is told to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramlaw.llm.text import Tally, batch, cut, filled, mapped, mix

LENGTHS, HASHES = (2, 3, 4), 3
PER_LANGUAGE, MIN_SHARE = 5_000, 2e-5
UNKNOWN = "und"
_FACTOR = (np.random.default_rng(77).integers(1 << 62, size=8, dtype=np.uint64) << np.uint64(1)) + np.uint64(1)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def grams(texts: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Whether each text has a letter; for each length the hashed n-grams of all texts and the bounds of each text's.

    Texts are lower-cased, everything but letters is one blank, and a blank stands at both ends.
    """
    lowered = [f" {t.lower()} " for t in filled(texts).to_pylist()]
    size = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters()[points]
    ends = size.cumsum()
    starts = ends - size
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the blank behind a letter
    keep[starts] = True
    codes = np.where(letter, points, 32)[keep].astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(keep)])
    bounds = np.append(at[starts], at[-1])
    has = np.add.reduceat(letter.astype(np.int32), starts) > 0 if len(starts) else np.zeros(0, dtype=bool)
    out = {}
    for n in LENGTHS:
        total = max(0, len(codes) - n + 1)
        h = np.zeros(total, dtype=np.uint64)
        for k in range(n):
            h += codes[k : k + total] * _FACTOR[k]
        first = np.minimum(bounds[:-1], total)
        out[n] = mix(h, n), np.stack([first, np.maximum(first, bounds[1:] - n + 1)])
    return has, out


@dataclass
class Model:
    languages: list[str]
    slots: int
    masks: dict[int, np.ndarray]  # by length: (planes, slots), each plane up to 8 languages
    rates: dict[int, np.ndarray]  # by length: false positives of each language
    order: np.ndarray  # languages by preference in ties


def _slots(h: np.ndarray, slots: int) -> list[np.ndarray]:
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(HASHES)]


def sample(train: DataFrame) -> DataFrame:
    """About ``PER_LANGUAGE`` rows of each language at most."""
    sizes = {r["lang"]: r["n"] for r in train.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train.where("false")
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, PER_LANGUAGE / n)))])
    picked = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) / float(1 << 20)
    return train.where(F.col("lang").isNotNull() & (picked < share[F.col("lang")]))


def counts(train: DataFrame) -> DataFrame:
    """(lang, length, gram, n) over whole texts, added up within tasks, then over them."""
    schema = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        tallies: dict[tuple[str, int], Tally] = {}

        def rows(key):
            keys, n = tallies[key].drain()
            return batch(schema, [key[0]] * len(keys), [key[1]] * len(keys), keys.view(np.int64), n)

        for part in batches:
            langs = np.array(part.column(1).to_pylist(), dtype=object)
            for lang in set(langs):
                _, by_length = grams(part.column(0).filter(pa.array(langs == lang)))
                for n, (h, bounds) in by_length.items():
                    inside = np.zeros(len(h) + 1, dtype=np.int64)
                    np.add.at(inside, bounds[0], 1)
                    np.add.at(inside, bounds[1], -1)
                    tally = tallies.setdefault((lang, n), Tally(200_000))
                    tally.add(h[np.cumsum(inside[:-1]) > 0])
                    if tally.full():
                        yield rows((lang, n))
        for key in tallies:
            yield rows(key)

    raw = mapped(train, ["text", "lang"], run, "lang string, length int, gram long, n long")
    return raw.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))


def fit(train: DataFrame) -> Model:
    table = cut(counts(sample(train)), "grams")
    totals = table.groupBy("lang", "length").agg(F.sum("n").alias("total"))
    kept = table.join(totals, ["lang", "length"]).where(F.col("n") >= MIN_SHARE * F.col("total")).select("lang", "length", "gram")
    found = kept.toArrow()
    weight = {r["lang"]: r["t"] for r in totals.groupBy("lang").agg(F.sum("total").alias("t")).collect()}
    languages = sorted(weight)
    names = np.array(found.column("lang").to_pylist(), dtype=object)
    lengths, keys = found.column("length").to_numpy(), found.column("gram").to_numpy().view(np.uint64)
    most = max([int(np.sum((names == x) & (lengths == n))) for x in languages for n in LENGTHS], default=1)
    slots = 1 << max(10, int(np.ceil(np.log2(8 * most + 1))))
    masks, rates = {}, {}
    for n in LENGTHS:
        planes = np.zeros((-(-len(languages) // 8), slots), dtype=np.uint8)
        rate = np.zeros(len(languages))
        for i, x in enumerate(languages):
            for at in _slots(keys[(names == x) & (lengths == n)], slots):
                planes[i // 8, at] |= np.uint8(1 << i % 8)
            rate[i] = np.mean((planes[i // 8] >> np.uint8(i % 8)) & 1) ** HASHES
        masks[n], rates[n] = planes, rate
    order = np.array(sorted(range(len(languages)), key=lambda i: (-weight[languages[i]], languages[i])), dtype=np.int64)
    return Model(languages, slots, masks, rates, order)


def judge(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and evidence (share of n-grams explained by that language) of each text."""
    has, by_length = grams(texts)
    n_lang = len(model.languages)
    if not n_lang:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    telling, plain, total = np.zeros((len(texts), n_lang)), np.zeros((len(texts), n_lang)), np.zeros(len(texts))
    for n, (h, (lo, hi)) in by_length.items():
        at = _slots(h, model.slots)
        hits = []
        for plane in model.masks[n]:
            mask = plane[at[0]]
            for a in at[1:]:
                mask = mask & plane[a]
            hits.append(mask)
        bits = [(hits[i // 8] >> np.uint8(i % 8)) & np.uint8(1) for i in range(n_lang)]
        everywhere = bits[0].copy()
        for b in bits[1:]:
            everywhere &= b
        common = np.concatenate([[0], np.cumsum(everywhere, dtype=np.int64)])
        size, shared = hi - lo, common[hi] - common[lo]
        for i, b in enumerate(bits):
            run = np.concatenate([[0], np.cumsum(b, dtype=np.int64)])
            rate = model.rates[n][i]
            fix = lambda x, of: np.maximum(0.0, (x - of * rate) / (1 - rate)) if rate < 1 else np.zeros(len(x))  # noqa: E731, B023
            plain[:, i] += fix(run[hi] - run[lo], size)
            telling[:, i] += fix(run[hi] - run[lo] - shared, size - shared)
        total += size
    votes = np.where(telling.sum(axis=1, keepdims=True) > 0, telling, plain)
    best = model.order[np.argmax(votes[:, model.order], axis=1)]
    rows = np.arange(len(texts))
    score = np.where(has, votes[rows, best] / np.maximum(votes.sum(axis=1), 1e-9), 0.0)
    evidence = np.where(has, plain[rows, best] / np.maximum(total, 1), 0.0)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)], np.clip(score, 0, 1), np.clip(evidence, 0, 1)


def predict(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys`` with lang_pred, score and evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("evidence", pa.float64())])

    def run(batches):
        for part in batches:
            lang, score, evidence = judge(shared.value, part.column(0))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(lang, pa.string()), pa.array(score), pa.array(evidence)], names=[*keys, *out.names])

    columns = docs.select(F.col("text").alias("_text"), *keys)
    judged = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType())]
    return mapped(columns, columns.columns, run, T.StructType([*columns.schema.fields[1:], *judged]))
