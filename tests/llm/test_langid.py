import random

import numpy as np
import pyarrow as pa
from helpers import ODD
from pyspark.sql import functions as F

from gramlaw.llm import langid

SYLLABLES = {"xa": ["ka", "to", "mi", "ra"], "xb": ["sch", "ung", "ver", "ein"], "xc": ["eau", "oi", "ille", "ment"]}


def prose(lang, seed, words=40):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(1, 3))) for _ in range(words))


def corpus(spark, n=30):
    return spark.createDataFrame([(1000 * k + i, prose(x, i), x) for k, x in enumerate(SYLLABLES) for i in range(n)], "doc_id long, text string, lang string")


def test_unseen_texts(spark):
    docs = corpus(spark)
    model = langid.fit(docs.where("doc_id % 4 != 2").union(docs.limit(3).withColumn("lang", F.lit(None))))
    assert model.languages == sorted(SYLLABLES)
    got = langid.predict(docs.where("doc_id % 4 = 2"), model, ["doc_id", "lang"]).collect()
    assert got and all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in got)


def test_masks_hold_every_frequent_gram(spark):
    docs = corpus(spark)
    model = langid.fit(docs)
    for i, x in enumerate(model.languages):
        _, by_length = langid.grams(pa.array([r.text for r in docs.where(F.col("lang") == x).collect()]))
        for n, (h, (lo, hi)) in by_length.items():
            h = np.concatenate([h[a:b] for a, b in zip(lo, hi)])
            kept, times = np.unique(h, return_counts=True)
            kept = kept[times >= langid.MIN_SHARE * len(h)]
            for at in langid._slots(kept, model.slots):
                assert np.all(model.masks[n][i // 8][at] >> np.uint8(i % 8) & 1)
            assert model.rates[n][i] < 0.05


def test_grams_stay_inside_their_text():
    one = langid.grams(pa.array(["abc de"]))[1]
    many = langid.grams(pa.array(["zz", "abc de", None, "--", "Abc, DE!"]))[1]
    for n in langid.LENGTHS:
        (h, b), (g, c) = one[n], many[n]
        assert list(h[b[0][0] : b[1][0]]) == list(g[c[0][1] : c[1][1]]) == list(g[c[0][4] : c[1][4]])
        assert b[1][0] - b[0][0] == len(" abc de ") - n + 1


def test_more_languages_than_a_byte_has_bits(spark):
    rows = [(i, " ".join([f"{chr(97 + i)}{chr(98 + i)}"] * 20), f"l{i:02}") for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    lang, _, _ = langid.judge(model, pa.array([t for _, t, _ in rows]))
    assert lang == [x for _, _, x in rows]


def test_odd_rows(odd, none, spark):
    model = langid.fit(odd)
    got = langid.predict(odd, model, odd.columns)
    assert got.columns == [*odd.columns, "lang_pred", "score", "evidence"] and got.count() == len(ODD)
    assert {r.doc_id for r in got.where("lang_pred = 'und'").collect()} == {1, 2, 3, 6}
    nothing = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(odd, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(none, model, ["doc_id"]).count() == 0


def test_ties_go_to_the_language_with_more_text(spark):
    rows = [(i, "same words here", x) for i, x in enumerate(["b", "b", "a"])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langid.judge(model, pa.array(["same words"]))[0] == ["b"]
