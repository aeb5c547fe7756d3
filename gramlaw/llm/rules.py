"""Quality rules with thresholds that adapt to each language and source.

Every text gives a few measures (below), which are not negative. A quantile sketch of a measure counts the values that
fall into buckets of equal ratio, so a quantile read from it is within ``PRECISION`` of a true one. Sketches are sums of
counts: they are made in every map task, merge exactly, and are the same whatever the partitions, tasks and repeats. They
are built per (language, source) over the texts that pass the fixed rules; those of a language and of everything are
merged from them. In a group, ``SHARE`` of the texts lie beyond each of two edges; a fence lies ``REACH`` times as far
beyond an edge as this is from the median. Where edge and median are equal (most texts without any symbol) they tell no
scale, and the fence is the quantile beyond which ``TAIL`` of the group lie, when 1 / ``TAIL`` texts at the median are
added: it takes more than one unusual text to make it usual. A group's fences are shrunk towards those of
the language, and the language's towards those of everything, by the number of texts, with ``PRIOR`` texts of the wider
group added. No measure has constants of its own, so what is usual follows from each group. A small source of junk is
judged by its language; in one with more than ``SHARE`` of junk the junk is usual.

Documents join their fences (one row per language and source, replicated over salts so that a hot source is spread) and
are kept if they pass the two fixed rules and lie within all fences. Values at a fence, ties included, lie within.

Results for odd input: a null or empty text has no words and fails the fixed rule. Null languages and sources form
groups of their own. Repeated rows are judged one by one, alike. An empty table gives no rows. Measures are held under
one struct column, whose name the caller can choose; extra columns of the input pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlaw.llm.text import cut, let

WHITE = "\\x20\\x09-\\x0D"  # inside a character class
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Shares of a text, but for the mean length of a word.
MEASURES = ("symbols", "shouts", "capitals", "repeats", "dup_lines", "word_length")
COUNTED = {"symbols": SYMBOLS, "shouts": "!?", "capitals": "A-Z"}
SHARE, REACH, TAIL, PRIOR = 0.1, 4.0, 0.005, 50
PRECISION, SMALLEST = 0.005, 1e-6  # of a bucket's values; what is smaller counts as zero
RATIO = math.log((1 + PRECISION) / (1 - PRECISION))
SALTS = 16


def _without(text: Column, chars: str) -> Column:
    """The number of characters of ``text`` outside a class."""
    return F.char_length(F.regexp_replace(text, f"[{chars}]+", ""))


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice. Windows are compared by a 64-bit hash within their text."""
    n = F.size(words)
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, n - 2)

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(F.transform(s, lambda x, j: F.when((F.get(s, j + 1)["h"] == x["h"]) | (F.get(s, j - 1)["h"] == x["h"]), x["i"])), lambda p: p.isNotNull()))
        return let(F.sort_array(twice), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    return F.when(n < 3, F.lit(0)).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))).cast("long")


def measured(docs: DataFrame, name: str = "rules") -> DataFrame:
    """``docs`` with a struct ``name`` of counts and measures of the whole text."""
    t = lambda k: F.col(f"{name}__{k}")  # noqa: E731  steps of their own, so that words and lines are made once
    text = F.coalesce(F.col("text"), F.lit(""))
    steps = docs.withColumns(
        {
            f"{name}__words": F.array_remove(F.split(text, f"[{WHITE}]+"), ""),
            f"{name}__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WHITE}]")),
            f"{name}__bare": _without(text, WHITE),
            **{f"{name}__{k}": F.char_length(text) - _without(text, chars) for k, chars in COUNTED.items()},
        }
    )
    w, ln = t("words"), t("lines")
    steps = steps.withColumns(
        {
            f"{name}__n_words": F.size(w).cast("long"),
            f"{name}__n_lines": F.size(ln),
            f"{name}__dup": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
            f"{name}__rep": _repeated(w),
        }
    ).drop(f"{name}__words", f"{name}__lines")
    share = lambda a, of: F.coalesce(F.try_divide(t(a), t(of)), F.lit(0.0)).cast("double")
    measures = {"symbols": share("symbols", "bare"), "shouts": share("shouts", "bare"), "capitals": share("capitals", "bare"), "repeats": share("rep", "n_words"), "dup_lines": share("dup", "n_lines"), "word_length": share("bare", "n_words")}
    out = F.struct(
        t("n_words").alias("n_words"),
        t("bare").cast("long").alias("word_chars"),
        t("symbols").cast("long").alias("n_symbols"),
        t("dup").alias("n_dup_lines"),
        t("rep").alias("n_repeat_words"),
        ((t("n_words") < MIN_WORDS) | (100 * t("rep") > 50 * t("n_words"))).alias("base_failed"),
        F.struct(*[measures[m].alias(m) for m in MEASURES]).alias("m"),
    )
    return steps.withColumn(name, out).select(*docs.columns, name)


def sketch(table: DataFrame, name: str = "rules") -> DataFrame:
    """(lang, source, measure, bucket, n): the quantile sketches of texts that pass the fixed rules. Bucket 0 holds zero."""
    bucket = lambda m: F.when(F.col(name)["m"][m] < SMALLEST, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.log(F.col(name)["m"][m] / SMALLEST) / RATIO).cast("int")))
    each = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(m).alias("bucket")) for k, m in enumerate(MEASURES)])
    rows = table.where(~F.col(name)["base_failed"]).select("lang", "source", F.inline(each))
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: tuple[float, ...], added: dict[float, float] | None = None) -> DataFrame:
    """Per group and measure the number of texts and the quantiles ``q``: the upper end of the bucket that holds each.
    ``added`` is how many texts at the median are added for a quantile."""
    group = [*keys, "measure"]
    so_far = Window.partitionBy(*group).orderBy("bucket")
    counted = sketches.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))
    placed = counted.withColumns({"below": F.sum("n").over(so_far), "all": F.sum("n").over(Window.partitionBy(*group))})
    placed = placed.withColumn("past", F.col("below") >= 0.5 * F.col("all"))  # the bucket of the median, or one beyond

    def first(q: float) -> Column:
        more = (added or {}).get(q, 0.0)
        below = F.col("below") + F.when(F.col("past"), more).otherwise(0.0)
        return F.min(F.when(below >= F.lit(q) * (F.col("all") + more), F.col("bucket")))

    value = lambda b: F.when(b <= 0, 0.0).otherwise(SMALLEST * F.exp(b * RATIO))
    found = placed.groupBy(*group).agg(F.max("all").alias("n"), *[first(q).alias(f"_q{k}") for k, q in enumerate(at)])
    return found.select(*group, "n", F.array(*[value(F.col(f"_q{k}")) for k in range(len(at))]).alias("q"))


def thresholds(table: DataFrame, name: str = "rules") -> DataFrame:
    """(lang, source, fence): for each measure the fences ``lo`` and ``hi`` of its group."""
    sketches = cut(sketch(table, name), "sketches")

    def fences(keys: list[str]) -> DataFrame:
        found = quantiles(sketches, keys, (TAIL, SHARE, 0.5, 1 - SHARE, 1 - TAIL), {TAIL: 1 / TAIL, 1 - TAIL: 1 / TAIL})
        q = lambda k: F.col("q")[k]
        lo = F.when(q(1) < q(2), q(1) - REACH * (q(2) - q(1))).otherwise(q(0))
        hi = F.when(q(3) > q(2), q(3) + REACH * (q(3) - q(2))).otherwise(q(4))
        return found.select(*keys, "measure", "n", lo.alias("lo"), hi.alias("hi"))

    def shrunk(own: DataFrame, parent: DataFrame, same: Column) -> DataFrame:
        weight = F.col("n") / (F.col("n") + PRIOR)
        wide = parent.select(*[F.col(c).alias(f"_{c}") for c in parent.columns])
        mixed = {c: weight * F.col(c) + (1 - weight) * F.coalesce(f"_{c}", c) for c in ("lo", "hi")}
        return own.join(wide, same & (F.col("measure") == F.col("_measure")), "left").withColumns(mixed).select(*own.columns)

    by_lang = shrunk(fences(["lang"]), fences([]), F.lit(True))
    own = shrunk(fences(["lang", "source"]), by_lang, F.col("lang").eqNullSafe(F.col("_lang")))
    of = own.groupBy("lang", "source").agg(F.sort_array(F.collect_list(F.struct("measure", "lo", "hi"))).alias("f"))  # one struct a measure
    return of.select("lang", "source", F.struct(*[F.col("f")[k].alias(m) for k, m in enumerate(MEASURES)]).alias("fence"))


def judged(table: DataFrame, fences: DataFrame, name: str = "rules") -> DataFrame:
    """``table`` with the verdict in ``name.kept``; thresholds are joined over salts."""
    salted = fences.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "fence", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64("doc_id", F.col(name)["word_chars"], F.col(name)["n_words"]), F.lit(SALTS)).cast("int")
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")) & (salt == F.col("_salt"))
    passed = ~F.col(name)["base_failed"]
    for m in MEASURES:
        value, slack = F.col(name)["m"][m], 1 + 2 * PRECISION  # the width of a bucket: a fence between equal values holds both
        passed = passed & (value <= F.coalesce(F.col("fence")[m]["hi"] * slack, F.lit(math.inf))) & (value * slack >= F.coalesce(F.col("fence")[m]["lo"], F.lit(-math.inf)))
    return table.join(salted, on, "left").withColumn(name, F.col(name).withField("kept", passed)).drop("_lang", "_source", "_salt", "fence")
