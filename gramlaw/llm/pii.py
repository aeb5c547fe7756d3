"""Personal data by fixed forms, and by contexts that those forms teach (bootstrapped extraction).

1. Seeds: every email, ip, card and phone of the fixed forms, in code points of the whole text.
2. Patterns: the one word and the two words to the left of a seed, lower-cased. Kept if they introduce at least
   ``MIN_SEEDS`` different seeds, whatever the size of the table. Those of at least ``OFTEN`` of all seed rows, at most
   1 / OFTEN = 32,768, are sent everywhere; all others meet the words of the corpus in a join.
3. Graph: words of the corpus that follow a pattern, added up to (pattern, instance, n). An instance is a seed or an
   identifier (a word of ``MIN_LENGTH`` or more characters with a digit); of ordinary words only the number behind each
   pattern counts. Patterns with so many that they can never reach ``ACCEPT`` are left out, such as all common words.
4. Scores: a pattern's confidence is the mean score of what follows it; a seed scores 1, an ordinary word 0, an
   identifier the mean confidence of the patterns that introduce it. ``ROUNDS`` rounds of two joins and two sums.
5. Identifiers of score ``ACCEPT`` behind a pattern of confidence ``ACCEPT`` become spans of the kind ``id``.

Everything is DataFrame functions. Sums are made before shuffles, and the graph holds a row for each pattern and instance,
so neither a common pattern nor a common instance gathers raw rows in one task.

Results for odd input: a null text is an empty one without spans. Rows join by (doc_id, hash of the text), null-safe:
repeated rows and repeated ids get each their own spans. An empty table, or one without seeds, gives base spans only.
Extra columns pass through ``masked`` and are not read by ``spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlaw.llm.text import SPACE, cut, let

# The four forms. Possessive and anchored so that long texts need no backtracking; the matches are the same.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
KINDS = [*FORMS, "id"]

MIN_SEEDS, ACCEPT, ROUNDS, MIN_LENGTH = 3, 0.6, 3, 5
OFTEN, SALTS = 2.0**-15, 16
BLOCK = 64
SPAN = "array<struct<kind:int,start:int,end:int>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    d = lambda i: F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")  # noqa: E731  from the right
    one = lambda i: F.when(i % 2 == 0, d(i)).otherwise(2 * d(i) - F.when(d(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), lambda a, i: a + one(i)) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    """The checks that a match must pass beyond its form."""
    n = F.char_length(_digits(hit))
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(hit))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _hits(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(FORMS[kind]), 0)


def found(text: Column, kind: str) -> Column:
    """Valid spans of one kind in order. A start is the length of all before it: sums over blocks, then within one."""

    def spans(gaps: Column, hits: Column) -> Column:
        lengths = F.transform(hits, lambda h, i: F.char_length(F.get(gaps, i)) + F.char_length(h))
        add = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x)

        def placed(n: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(n), 6)), lambda b: add(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))

            def at(sums: Column, i: Column) -> Column:
                b = F.shiftright(i, 6)
                return add(F.slice(sums, F.lit(1), b)) + add(F.slice(n, b * BLOCK + 1, i - b * BLOCK)) + F.char_length(F.get(gaps, i))

            starts = let(blocks, lambda sums: F.transform(hits, lambda h, i: F.when(valid(kind, h), at(sums, i))))
            return let(starts, lambda s: F.transform(s, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x.alias("start"), (x + F.char_length(F.get(hits, i))).alias("end"))))

        return F.filter(let(lengths, placed), lambda x: x["start"].isNotNull())

    both = let(F.split(text, FORMS[kind], -1), lambda gaps: let(_hits(text, kind), lambda hits: spans(gaps, hits)))
    hint = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
    return F.when(hint, both.cast(SPAN)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All spans of the fixed forms by kind, then start."""
    return F.concat(*[found(text, k) for k in FORMS])


def as_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), f"[{SPACE}]+"), "")


def _bare(word: Column) -> Column:
    """Without quotes, brackets and punctuation around it."""
    return F.regexp_replace(word, r"^[\p{P}\p{S}&&[^+]]+|[\p{P}\p{S}]+$", "")


def _context(words: Column, i: Column, n: int) -> Column:
    """Hash of the ``n`` words before word ``i``; null where there are fewer."""
    return F.when(i >= n, F.xxhash64(F.lit(n), *[F.get(words, i - k) for k in range(n, 0, -1)]))


def seeds(base: DataFrame) -> DataFrame:
    """(context, value) of every base span; ``base`` has text and spans."""
    hit = base.select("text", F.explode("spans").alias("s"))
    # 128 characters hold two words but for very long ones, which are no usable pattern
    before = F.substring(F.col("text"), F.greatest(F.lit(1), F.col("s.start") - 127), F.least(F.lit(128), F.col("s.start")))
    value = F.xxhash64(F.lower(F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))))
    opened = F.regexp_replace(before, r"[\p{Ps}\p{Pi}\"'<]+$", "")
    near = hit.select(_word_list(opened).alias("w"), value.alias("value"), opened.rlike(f"(?:^|[{SPACE}])$").alias("apart")).where("apart")
    n = F.size("w")
    return near.select(F.explode(F.array(_context(F.col("w"), n, 1), _context(F.col("w"), n, 2))).alias("context"), "value").where("context is not null")


def patterns(seed_rows: DataFrame) -> DataFrame:
    """(context, often) of contexts with enough different seeds; ``often`` marks at most 1 / OFTEN of them."""
    pairs = seed_rows.groupBy("context", "value").agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("all"))
    kept = pairs.groupBy("context").agg(F.count("*").alias("values"), F.sum("n").alias("n")).where(F.col("values") >= MIN_SEEDS)
    return kept.join(F.broadcast(total)).select("context", (F.col("n") >= OFTEN * F.col("all")).alias("often"))


def _listed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("th"), _word_list(F.coalesce("text", F.lit(""))).alias("w"))


def _behind_often(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows with context hashes c1 and c2, once for each frequent pattern among them, as ``context``."""
    side = lambda c: F.broadcast(kept.where("often").select(F.col("context").alias(c), F.lit(True).alias(f"{c}_")))  # noqa: E731  at most 32,768 rows
    near = rows.join(side("c1"), "c1", "left").join(side("c2"), "c2", "left").where("c1_ or c2_")
    known = F.filter(F.array(F.when(F.col("c1_"), F.col("c1")), F.when(F.col("c2_"), F.col("c2"))), lambda c: c.isNotNull())
    return near.withColumn("context", F.explode(known)).drop("c1", "c2", "c1_", "c2_")


def _other(kept: DataFrame) -> DataFrame | None:
    """The patterns that are not sent everywhere, if any."""
    other = kept.where("not often").select("context")
    return None if other.isEmpty() else other


def _by_context(rows: DataFrame) -> DataFrame:
    return rows.withColumn("context", F.explode(F.filter(F.array("c1", "c2"), lambda c: c.isNotNull()))).drop("c1", "c2")


def totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(context, total): how many words of all kinds stand behind each pattern."""
    w = F.col("w")
    each = F.transform(w, lambda x, i: F.struct(_context(w, i, 1).alias("c1"), _context(w, i, 2).alias("c2")))
    flat = _listed(docs).select(F.explode(each).alias("x")).select("x.*")
    count = F.count("*").alias("total")
    out, other = _behind_often(flat, kept).groupBy("context").agg(count), _other(kept)
    if other is None:
        return out
    return out.unionByName(_by_context(flat).groupBy("context").agg(count).join(other, "context"))  # one row a context on both sides


def candidates(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Seeds and identifiers behind a pattern: (doc_id, th, at, context, instance, what), what is 1 for a seed and null
    for an identifier."""
    w = F.col("w")
    # five words hold a phone or card of four groups
    each = F.transform(w, lambda x, i: F.when(x.rlike("[0-9@]"), F.struct(i.alias("at"), _context(w, i, 1).alias("c1"), _context(w, i, 2).alias("c2"), F.array_join(F.slice(w, i + 1, F.lit(5)), " ").alias("tail"))))
    flat = _listed(docs).select("doc_id", "th", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("doc_id", "th", "x.*")
    first = _bare(F.regexp_extract("tail", f"^[^{SPACE}]+", 0))
    opened = F.regexp_replace("tail", r"^[\p{Ps}\p{Pi}\"'<]+", "")
    hit = lambda k: F.regexp_extract(opened, f"^(?:{FORMS[k]})", 0)
    is_seed = F.lit(False)
    for k in FORMS:
        is_seed = is_seed | ((hit(k) != "") & valid(k, hit(k)))
    what = F.when(is_seed, 1.0).when(first.rlike("[0-9]") & (F.char_length(first) >= MIN_LENGTH), F.lit(None).cast("double")).otherwise(0.0)
    near, other = _behind_often(flat, kept), _other(kept)
    if other is not None:  # a pattern of few seeds may stand before many words
        salted = _by_context(flat).withColumn("salt", F.pmod(F.xxhash64("doc_id", "th", "at"), F.lit(SALTS)))
        each_salt = other.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        near = near.unionByName(salted.join(each_salt, ["context", "salt"]).drop("salt").select(near.columns))
    rows = near.select("doc_id", "th", "at", "context", F.xxhash64(first).alias("instance"), what.alias("what"))
    return rows.where("what is null or what > 0")


def scored(graph: DataFrame) -> DataFrame:
    """(context, instance) of identifiers to be accepted. ``graph``: context, instance, what, n, total."""
    state = graph.select("context", "instance", "what", "n", "total", F.coalesce("what", F.lit(0.0)).alias("score"))
    for _ in range(ROUNDS):
        trust = state.groupBy("context").agg((F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("trust"))
        linked = state.drop("score", "trust").join(trust, "context")
        new = linked.where("what is null").groupBy("instance").agg((F.sum(F.col("n") * F.col("trust")) / F.sum("n")).alias("new"))
        state = linked.join(new, "instance", "left").withColumn("score", F.coalesce("what", "new")).drop("new")
    return state.where((F.col("trust") >= ACCEPT) & F.col("what").isNull() & (F.col("score") >= ACCEPT)).select("context", "instance")


def discovered(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, th, at): which words of which texts are identifiers found by their context."""
    kept = cut(patterns(seeds(base)), "patterns")
    rows = cut(candidates(docs, kept), "candidates")
    pairs = rows.groupBy("context", "instance", "what").agg(F.count("*").alias("n"))
    met = pairs.groupBy("context").agg(F.sum("n").alias("met"))
    viable = cut(met.join(totals(docs, kept), "context").where(F.col("met") >= ACCEPT * F.col("total")).select("context", "total"), "viable")
    graph = pairs.join(viable, "context")
    good = cut(scored(cut(graph, "graph")), "accepted")
    hits = rows.where("what is null").join(good, ["context", "instance"], "left_semi")
    return hits.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("at")).alias("at"))


def _parts(text: Column) -> Column:
    """Words, each with the white space behind it; white space before the first word is a part of its own."""
    return F.split(text, f"(?<=[{SPACE}])(?=[^{SPACE}])", -1)


def _shift(text: Column) -> Column:
    return text.rlike(f"^[{SPACE}]").cast("int")


def _word_spans(text: Column, at: Column, spans: Column) -> Column:
    """Spans of the words numbered in ``at``, without what surrounds them, unless they touch a base span."""

    def one(parts: Column, i: Column) -> Column:
        word = F.regexp_replace(F.get(parts, i + _shift(text)), f"[{SPACE}]+$", "")
        lead = F.char_length(F.regexp_extract(word, r"^[\p{P}\p{S}&&[^+]]*", 0))
        start = F.aggregate(F.slice(parts, F.lit(1), i + _shift(text)), F.lit(0), lambda a, p: a + F.char_length(p)) + lead
        return F.struct(F.lit(KINDS.index("id")).alias("kind"), start.alias("start"), (start + F.char_length(_bare(word))).alias("end"))

    placed = let(_parts(text), lambda parts: F.transform(at, lambda i: one(parts, i)))
    return F.filter(placed, lambda p: ~F.exists(spans, lambda s: (s["start"] < p["end"]) & (p["start"] < s["end"])))


def _with_words(docs: DataFrame, more: DataFrame) -> DataFrame:
    """``docs`` (with th) and the word numbers found in each text, null where none."""
    found_ = more.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("at").alias("_at"))
    return docs.join(found_, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").drop("_id", "_th")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): the spans of the fixed forms, and all."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    with_base = rows.withColumn("spans", base_spans(text))
    base = cut(with_base.select("doc_id", "th", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")), "spans")
    more = cut(discovered(docs, base.where("text is not null")), "found")
    hit = _with_words(rows, more).where("_at is not null").dropDuplicates(["doc_id", "th"])
    added = hit.withColumn("spans", base_spans(text)).select("doc_id", "th", _word_spans(F.col("text"), F.col("_at"), F.col("spans")).alias("at"))
    return _with_words(base.drop("text"), added).select("doc_id", F.col("spans").alias("base"), F.concat("spans", F.coalesce(F.col("_at").cast(SPAN), F.array().cast(SPAN))).alias("spans"))


def _merged(spans: Column) -> Column:
    """Overlapping spans as one, by start; each has the kind of the longest span in it."""
    kind = "array<struct<start:int,end:int,kind:int,n:int>>"
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), (s["end"] - s["start"]).alias("n"))))

    def add(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.when(s["n"] > last["n"], s["kind"]).otherwise(last["kind"]).alias("kind"), F.greatest(last["n"], s["n"]).alias("n"))
        return F.when(last["end"] > s["start"], F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(s))).cast(kind)

    return F.aggregate(ordered.cast(kind), F.array().cast(kind), add)


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of the disjoint ordered ``spans`` replaced by its kind. The text is cut into blocks, so that no
    piece between two spans is sought from the start of the text."""

    def filled(blocks: Column, s: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            near = F.array_join(F.slice(blocks, F.shiftright(a, 8) + 1, F.shiftright(b, 8) - F.shiftright(a, 8) + 1), "")
            return F.substring(near, a.bitwiseAND(F.lit(255)) + 1, b - a)

        ends = lambda i: F.coalesce(F.get(s, i - 1)["end"], F.lit(0))
        kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
        cuts = F.transform(s, lambda x, i: F.concat(piece(ends(i), x["start"]), F.get(kinds, x["kind"])))
        return F.concat(F.array_join(cuts, ""), piece(ends(F.size(s)), F.char_length(text)))

    return let(F.regexp_extract_all(text, F.lit("(?s).{1,256}"), F.lit(0)), lambda blocks: let(spans, lambda s: filled(blocks, s)))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; overlapping spans are one."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("th", F.xxhash64("text"))
    base = cut(docs.select("text", base_spans(text).alias("spans")).where(F.size("spans") > 0), "spans")
    more = cut(discovered(docs, base), "found")
    joined = _with_words(rows, more)

    def hidden(spans: Column) -> Column:
        words = F.when(F.col("_at").isNotNull(), _word_spans(F.col("text"), F.col("_at"), spans).cast(SPAN)).otherwise(F.array().cast(SPAN))
        both = F.concat(spans, words)
        return let(both, lambda b: F.when(F.size(b) > 0, _replaced(F.col("text"), _merged(b))).otherwise(F.col("text")))

    return joined.withColumn("text", let(base_spans(text), hidden)).select(*docs.columns)
