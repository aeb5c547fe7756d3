"""The registered queries of this subpackage and their SQL twins, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlaw.llm import automaton, bpe, context_tree, langid, lexical, licenses, minhash, packing, phrases, pii, ranking, rules, trie
from gramlaw.llm.text import cut, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 5-word shingle sets link at a similarity of 0.75 or more."""
    return minhash.near_duplicates(documents(spark, sf_dir)).drop("th", "component")


@query
def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and context-tree score of each text, learned outside the held-out tenth."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    chunks = cut(context_tree.chunked(docs, remainder("doc_id", 10) != 0), "chunks", "zstd")
    out = context_tree.scored_chunks(chunks, cut(context_tree.summed(chunks), "counts"))
    return out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), *out.columns[1:])


@query
def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores learned from pairs of good and bad documents outside the held-out third."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 3) != 1)
    out = ranking.scored(docs, ranking.fit(docs, labels))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each text and the text that they decode to, as digests."""
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are, as a whole, a known licence."""
    known = spark.createDataFrame(list(licenses.KNOWN.items()), "name string, text string")
    return licenses.matched(documents(spark, sf_dir), known)


ORACLES["op5_licenses"] = licenses.matched_sql()


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data: those of the fixed forms, and those found by contexts that these teach."""
    out = pii.spans(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(pii.FORMS)]
    return out.select("doc_id", *counts, F.sha2(pii.as_text("base"), 256).alias("base_sha256"), pii.as_text("spans").alias("spans"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each text and the verdict of fences adapted to its language and source."""
    table = cut(rules.measured(documents(spark, sf_dir).select("doc_id", "lang", "source", "text")).drop("text"), "rules")
    counts = [f"rules.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    return rules.judged(table, rules.thresholds(table)).select("doc_id", *counts)


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each text, learned from the documents outside the held-out quarter."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", remainder("doc_id", 4) == 2)
    return langid.predict(docs, langid.fit(docs.where("not held_out")), ["doc_id", "held_out"]).drop("evidence")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its edited form."""
    return phrases.fingerprinted(documents(spark, sf_dir))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = automaton.scanned(docs.select("doc_id", "text"), benchmark, ["doc_id"])
    n_hit = F.aggregate(F.arrays_zip("hits.starts", "hits.stops"), F.lit(0).cast("long"), lambda a, s: a + s["stops"] - s["starts"])
    out = hits.select("doc_id", "hits.n_words", n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"), F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text that stand in a window of a benchmark item."""
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op11_decontamination"] = r"""
WITH lower AS (SELECT doc_id, row_number() OVER () AS r, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
docs AS (SELECT doc_id, r, CASE WHEN t IS NULL THEN [] ELSE regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM lower),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
runs AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT d.r, d.w, s.k, unnest(range(1, len(d.w) - s.k + 2)) AS i FROM docs d, sizes s WHERE len(d.w) >= s.k)),
found AS (SELECT runs.r, runs.i, runs.k, windows.item FROM runs JOIN windows ON runs.k = windows.k AND runs.t = windows.t),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM found)) GROUP BY r),
met AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(met.n, 0)::BIGINT AS n_items,
  sha256(coalesce(met.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (r) LEFT JOIN met USING (r)
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared prefix of the rebuilt conversations."""
    return trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES["op12_prefix_trie"] = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(d ORDER BY turn NULLS FIRST, d, w) AS ds, list(w ORDER BY turn NULLS FIRST, d, w) AS ws FROM turns GROUP BY conv_id),
crc AS (
  SELECT conv_id, conv_id::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS c FROM own
  UNION ALL
  SELECT conv_id, s, i + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END
  FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(s, i // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM crc WHERE i < 8 * length(s))),
h AS (SELECT conv_id, xor(c, 4294967295::BIGINT) % 4 AS h FROM crc WHERE i = 8 * length(s)),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.ds[1:h.h], []), o.ds[h.h + 1:]) AS ds, list_concat(coalesce(b.ws[1:h.h], []), o.ws[h.h + 1:]) AS ws
  FROM own o JOIN h USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
prefixes AS (
  SELECT conv_id, d, array_to_string(ds[1:d], '') AS key, CASE WHEN d > 0 THEN array_to_string(ds[1:d - 1], '') END AS parent, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ds) AS ends
  FROM (SELECT conv_id, ds, ws, unnest(range(0, len(ds) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT key, any_value(d) AS depth, any_value(parent) AS parent, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends
  FROM prefixes GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
up AS (
  SELECT n.key[1:32 * k] AS key, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n.n - 1) * n.w) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM nodes) n LEFT JOIN children c ON c.key = n.key GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0) AS n_children,
  up.leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN up USING (key) LEFT JOIN nodes p ON p.key = n.parent LEFT JOIN children c ON c.key = n.key
"""


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents for each benchmark item."""
    return lexical.search(lexical.index(documents(spark, sf_dir).select("doc_id", "text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op13_lexical_search"] = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
long AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS l FROM long),
tf AS (
  SELECT r, t, count(*)::BIGINT AS tf
  FROM (SELECT r, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM docs) GROUP BY r, t),
asked AS (
  SELECT DISTINCT item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL)),
weight AS (
  SELECT t, floor(1000 * ln((2 * any_value(total.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, total WHERE t IN (SELECT t FROM asked) GROUP BY t),
scored AS (
  SELECT asked.item_id, long.r, any_value(long.doc_id) AS doc_id,
    sum(weight.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * long.n * total.n) // total.l))))::BIGINT AS score
  FROM asked JOIN weight USING (t) JOIN tf USING (t) JOIN long ON long.r = tf.r, total GROUP BY asked.item_id, long.r)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
