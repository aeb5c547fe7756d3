import random

import pyarrow as pa
from helpers import ODD, SCHEMA, shingles

from gramlaw.llm import minhash


def brute(rows):
    """Component (smallest id, nulls aside) of each row, by comparing all sets."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                group[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None] if sets[i] else [doc]
        best = min(ids, default=None) if ids != [None] else None
        out.append((doc, len(sets[i]), best, doc == best))
    return sorted(out, key=str)


def planted():
    """Groups copied from an original with edits, so that copies differ more from each other than from it."""
    draw = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, doc = [], 1000
    for size in (2, 3, 12, 40):
        base = [draw.choice(vocab) for _ in range(160)]
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randint(0, 6)):
                copy[draw.randrange(len(copy))] = draw.choice(vocab)
            rows.append((doc, " ".join(copy)))
            doc -= draw.randint(1, 3)
    shared = " ".join(draw.choice(vocab) for _ in range(60))
    rows += [(2000 + i, shared + " " + " ".join(draw.choice(vocab) for _ in range(60))) for i in range(30)]
    rows += [(3000 + i, "exactly the same words in every one of these") for i in range(20)]
    draw.shuffle(rows)
    return rows


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()], key=str)


def test_groups_equal_brute_force(spark):
    rows = planted() + [(r[0], r[1]) for r in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(minhash.near_duplicates(docs)) == brute(rows)


def test_one_row_of_each_group_stays(spark):
    rows = [(d, t, None, None, None) for d, t in planted()] + ODD
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [(r.doc_id, r.text) for r in minhash.deduplicated(docs).collect()]
    want = {(d, t) for (d, t), b in zip([(r[0], r[1]) for r in rows], [None] * len(rows)) if True}
    assert len(kept) == len(set(kept)) and set(kept) <= want
    first = {(d, c) for d, n, c, k in brute([(r[0], r[1]) for r in rows]) if k}
    assert sorted([k for k, _ in kept], key=str) == sorted([d for d, _ in first], key=str)


def test_empty(none):
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.deduplicated(none).columns == none.columns


def test_sketch_estimates_high_similarity(spark):
    base = [f"x{i}" for i in range(600)]
    near = base[:300] + ["new"] + base[300:]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"y{i}" for i in range(600)))]
    f = {r.doc_id: r for r in minhash.features(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def estimate(a, b):
        import math

        z = sum((p ^ q & (1 << 64) - 1).bit_count() if p ^ q >= 0 else ((p ^ q) + (1 << 64)).bit_count() for p, q in zip(f[a].sketch, f[b].sketch))
        return 1 + minhash.BITS / (4 * minhash.SAMPLES) * math.log(max(1e-9, 1 - 2 * z / minhash.BITS))

    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert abs(estimate(1, 2) - len(a & b) / len(a | b)) < 0.05
    assert estimate(1, 3) < 0.5


def test_sets_of_short_texts_differ():
    sets = list(minhash.shingle_sets(pa.array(["a b", "b a", "a b c d e", "a", None, "A B"])))
    assert [len(s) for s in sets] == [1, 1, 1, 1, 0, 1]
    assert len({s.tobytes() for s in sets[:4]}) == 4 and sets[0] == sets[5]


def test_texts_are_shuffled_once_to_drop_copies(spark):
    """The anti-join and the removal of repeated rows share one shuffle."""
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in planted()] + ODD, SCHEMA)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = minhash.deduplicated(docs)
        plan = out._jdf.queryExecution().executedPlan()
        found, open_ = [], [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
        while open_:
            node = open_.pop()
            if node.nodeName() == "Exchange":
                found.append([node.output().apply(k).dataType().simpleString() for k in range(node.output().length())])
            open_ += [node.children().apply(k) for k in range(node.children().length())]
        kept = [r.doc_id for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert found and sum("string" in types for types in found) == 1  # buffers of first(text) have names of their own
    assert sorted(kept, key=str) == sorted([d for d, _, _, k in set(brute([(r.doc_id, r.text) for r in docs.collect()])) if k], key=str)


def test_links_are_computed_once(spark):
    """Both directions of a link come from one pass over the links."""
    draw = random.Random(8)
    pairs = [(draw.randrange(60), draw.randrange(60, 90)) for _ in range(50)]
    old = {a: a - a % 3 for a in range(90)}
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for part in batches:
            seen.add(part.num_rows)
            yield part

    links = spark.createDataFrame(pairs, "x long, y long").mapInArrow(count, "x long, y long")
    got = {r.a: r.comp for r in minhash.components(spark.createDataFrame(list(old.items()), "a long, comp long"), links).collect()}
    group = dict(old)
    for _ in range(90):
        for x, y in [*pairs, *old.items()]:
            group[x] = group[y] = min(group[x], group[y])
    assert got == group
    assert seen.value == len(pairs)


def test_last_join_is_compiled(spark):
    """No function with a lambda, which Spark interprets, is evaluated for the pairs of a bucket."""
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = minhash.features(docs).where("n > 0").withColumnRenamed("doc_id", "rep").dropDuplicates(["a"]).cache()
    sets = minhash.full_sets(docs, classes, classes.select("a"))
    open_ = classes.selectExpr("a", "a as comp", "posexplode(bands) as (band, key)")
    out = minhash._across(open_, classes, sets)
    assert "lambda" not in out._jdf.queryExecution().toString()
    found = {tuple(sorted(r)) for r in out.collect()}
    text = {r.a: shingles(dict(rows)[r.rep]) for r in classes.collect()}
    alike = {(x, y) for x in text for y in text if x < y and 100 * len(text[x] & text[y]) >= 75 * len(text[x] | text[y])}
    assert alike and alike <= found and out.count() == len(found)
