import math
from collections import Counter

from helpers import ODD, SCHEMA, WORD

from gramlaw.llm import rules


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {k for k, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, x in enumerate(windows) if x in twice for j in range(3)}
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def texts():
    return [
        "a b c a b c d a b",
        "x x x x",
        "x y",
        "one\n one\none\n\n \none two\none",
        "a b c d e f g h i j " * 2 + "k l m",
        "é # 😀 $ |<>&%* \x1c\x85 z",
        " ".join(f"w{i}" for i in range(60)),
        " ".join(f"w{i % 45}" for i in range(60)),
        "the cat " * 40_000,
    ]


def test_counts_equal_brute_force(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts(), 50)] + ODD
    for r in rules.measured(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        x = r.rules
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(r.text), r.text[:80] if r.text else r.text


def verdicts(spark, rows, parts=3):
    table = rules.measured(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "kept").repartition(parts))
    return {r.doc_id: r.rules.kept for r in rules.judged(table, rules.thresholds(table)).collect()}


def plain(i, mark="", every=3):
    return " ".join(f"{'W' if k % (4 + i % 6) == 0 else 'w'}ord{i}x{k}{mark if k % every == 0 else ''}" for k in range(80 + i % 7))


def test_fences_follow_their_group(spark):
    rows = [(i, plain(i), "en", "prose", 0) for i in range(400)]
    rows += [(1000 + i, plain(i, "###"), "en", "prose", 0) for i in range(3)]  # unusual here
    rows += [(2000 + i, plain(i).upper() + " WOW!!!!!!!! " * 60, None, "junk", 0) for i in range(20)]  # a small source of junk only
    got = verdicts(spark, rows)
    assert all(got[i] for i in range(400)) and not any(v for k, v in got.items() if k >= 1000)


def test_groups_of_other_levels_judge_the_same_text_otherwise(spark):
    rows = [(i, plain(i), "en", "prose", 0) for i in range(600)]
    rows += [(1000 + i, plain(i, "#" * (4 + i % 2)), "en", "code", 0) for i in range(600)]
    rows += [(2000, plain(3, "####"), "en", "prose", 0), (2001, plain(3, "####"), "en", "code", 0)]
    rows += [(2002, plain(3, "#", 1000), "en", "code", 0)]  # far fewer than usual there: below the lower fence
    got = verdicts(spark, rows)
    assert not got[2000] and got[2001] and not got[2002]
    assert sum(got[i] for i in range(600)) == 600 and sum(got[1000 + i] for i in range(600)) >= 590


def test_same_fences_over_runs_and_partitions(spark):
    rows = [(i, plain(i, "!" * (i * 7 % 5), 2 + i % 9) + "\nLINE" * (i % 4), ["en", "de", None][i % 3], f"s{i % 5}", 0) for i in range(300)]
    fences = []
    for parts in (1, 2, 7, 7):
        table = rules.measured(spark.createDataFrame(rows[:: -1 if parts == 2 else 1], SCHEMA).repartition(parts))
        fences.append(sorted(map(str, rules.thresholds(table).collect())))
    assert fences[0] == fences[1] == fences[2] == fences[3]


def test_quantiles_of_sketches(spark):
    rows = [(i, plain(i, "#" * (i % 11), 1 + i % 5), "en", "s", 0) for i in range(500)]
    table = rules.measured(spark.createDataFrame(rows, SCHEMA))
    at = (0.01, 0.1, 0.5, 0.9, 1.0)
    own = {r.measure: r for r in rules.quantiles(rules.sketch(table), ["lang", "source"], at).collect()}
    passed = [r.rules.m for r in table.collect() if not r.rules.base_failed]
    for k, m in enumerate(rules.MEASURES):
        values = sorted(x[m] for x in passed)
        for q, got in zip(at, own[k].q):
            true = values[max(math.ceil(q * len(values)) - 1, 0)]
            assert own[k].n == len(values) and true - rules.SMALLEST <= got * (1 + 1e-9) and got <= true * (1 + 2.1 * rules.PRECISION) + rules.SMALLEST


def test_odd_rows(odd, none):
    table = rules.measured(odd)
    out = rules.judged(table, rules.thresholds(table))
    assert out.columns == [*odd.columns, "rules"] and out.count() == len(ODD) and out.where("rules.kept is null").count() == 0
    table = rules.measured(none)
    assert rules.judged(table, rules.thresholds(table)).count() == 0


def test_no_python_on_the_main_path(odd):
    table = rules.measured(odd)
    plan = rules.judged(table, rules.thresholds(table))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
