"""Quality by Bradley-Terry ranking: scores learned from preference pairs, cut at a quantile of the scores.

A document's strength is a linear function of measures of its text; document x is preferred to y with probability
sigmoid(strength(x) - strength(y)). Pairs take one document marked good and one marked bad, and Newton steps minimise the
logistic loss of the feature differences with a ridge. The cut is the quantile of the training strengths (on a fine grid
of levels) that classifies the training rows best, both classes weighing the same; the returned score is
sigmoid((strength - cut) / spread), so 0.5 is the cut.

The training rows are a bounded sample: a hash of the id picks about ``MAX_ROWS`` labelled rows of each class at most;
their measures (a row of numbers each) come to the driver, at most ``MAX_PAIRS`` pairs are drawn from them. Every row is
scored. Labels, languages, sources and ids are no inputs of a score.

Results for odd input: a null text is an empty one; all measures of an empty text are 0 and it is scored like any other.
Rows without a label or with a null one teach nothing; repeated labels of an id count once, at their smallest value.
Without rows of both classes all scores are 0.5. Repeated rows and null ids are scored one by one, alike. An empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlaw.llm.text import batch, filled, mapped, words

MAX_ROWS, MAX_PAIRS, RIDGE, STEPS = 20_000, 60_000, 1e-3, 30
MEASURES = ("words", "word_length", "symbols", "shouts", "capitals", "digits", "marks", "repeats", "distinct", "same_next", "bare_marks", "lines", "dup_lines")
_CLASS = np.zeros((5, 256), dtype=bool)
for _k, _chars in enumerate((b"#*$%&|<>", b"!?", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:'\"()-")):
    _CLASS[_k, list(_chars)] = True


def measures(texts: pa.Array) -> np.ndarray:
    """One row of ``MEASURES`` for each text."""
    texts = filled(texts)
    codes, bounds, dictionary = words(texts)
    lo, hi = bounds[:-1], bounds[1:]
    n = (hi - lo).astype(float)
    per = np.maximum(n, 1)
    run = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
    total = lambda x: (lambda r: r[hi] - r[lo])(run(x))
    length = pc.utf8_length(dictionary).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0)
    bare = pc.match_substring_regex(dictionary, "^[^\\p{L}\\p{N}]+$").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0)
    same = np.zeros(len(codes))
    same[:-1] = codes[:-1] == codes[1:]
    triples = np.zeros(len(codes), dtype=np.int64)
    if len(codes) > 2:
        triples[:-2] = (codes[:-2].astype(np.int64) * 1_000_003 + codes[1:-1]) * 1_000_003 + codes[2:]
    distinct, repeats = np.zeros(len(texts)), np.zeros(len(texts))
    for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
        if b > a:
            distinct[i] = len(np.unique(codes[a:b])) / (b - a)
        if b - a > 2:
            repeats[i] = 1 - len(np.unique(triples[a : b - 2])) / (b - a - 2)
    chars = np.maximum(total(length), 1)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(s.encode() for s in texts.to_pylist()), dtype=np.uint8)
    ends = np.concatenate([[0], sizes.cumsum()])
    counted = [(lambda r: r[ends[1:]] - r[ends[:-1]])(run(c[raw])) / chars for c in _CLASS]
    split = pc.split_pattern(texts, "\n")
    lines = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(float)
    coded = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], lines.cumsum()]).astype(int)
    dup = np.array([1 - len(np.unique(coded[a:b])) / max(b - a, 1) for a, b in zip(at[:-1], at[1:], strict=True)])
    out = np.stack([np.log1p(n), total(length) / per, *counted, repeats, distinct, total(same) / per, total(bare) / per, np.log1p(lines / per), dup], axis=1)
    out[n == 0] = 0
    return np.nan_to_num(out)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.cut) / self.spread, -30, 30)))


def learn(x: np.ndarray, good: np.ndarray) -> Model:
    """Fit strengths on pairs of a good and a bad row."""
    k = x.shape[1]
    if not good.any() or good.all():
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    up, down = z[good], z[~good]
    draw = np.random.default_rng(3)
    pairs = min(MAX_PAIRS, 4 * max(len(up), len(down)))
    over = lambda rows: rows[np.concatenate([draw.permutation(len(rows)) for _ in range(-(-pairs // len(rows)))])[:pairs]]
    diff = over(up) - over(down)
    w = np.zeros(k)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + RIDGE * np.eye(k), diff.T @ (1 - p) / pairs - RIDGE * w)
        w += step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    levels = np.unique(np.quantile(s, np.linspace(0, 1, 401)))
    places = np.concatenate([levels, (levels[1:] + levels[:-1]) / 2])
    fit = [(s[good] >= c).mean() + (s[~good] < c).mean() for c in places]
    best = np.flatnonzero(np.array(fit) >= max(fit) - 1e-12)
    cut = float(np.median(places[best]))
    return Model(mean, scale, w, cut, float(max(np.std(s), 1e-6) / 4))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """``docs``: training rows (doc_id, text); ``labels``: doc_id, quality."""
    marked = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return learn(np.zeros((0, len(MEASURES))), np.zeros(0, dtype=bool))
    share = F.create_map(*[x for q, n in sizes.items() for x in (F.lit(q), F.lit(min(1.0, MAX_ROWS / n)))])
    marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20) < share[F.col("quality")])
    schema = pa.schema([("quality", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for part in batches:
            x = measures(part.column(0))
            yield batch(schema, part.column(1), list(x))

    # about MAX_ROWS rows of two numbers for each class: small enough for every executor
    rows = docs.join(F.broadcast(marked.select("doc_id", F.col("quality").cast("long").alias("quality"))), "doc_id").select("text", "quality")
    found = mapped(rows, ["text", "quality"], run, "quality long, x array<double>").toArrow()
    quality = found.column("quality").to_numpy()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(MEASURES))
    order = np.lexsort((*x.T, quality))  # the same pairs however the rows came in
    return learn(x[order], quality[order] > 0)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for part in batches:
            yield batch(schema, part.column(0), shared.value.score(measures(part.column(1))))

    return mapped(docs, ["doc_id", "text"], run, "doc_id long, score double")
