import textwrap

import duckdb
from helpers import ODD

from gramlaw.llm import licenses as L


def known(spark):
    return spark.createDataFrame(list(L.KNOWN.items()), "name string, text string")


def rows():
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 Some One\nAll rights reserved.\n\n" + textwrap.fill(L.KNOWN["MIT"].replace("sublicense", "sub-license"), 60)
    return [
        (20, mit.replace("\n", "\r\n")),
        (21, L.KNOWN["BSD-3-Clause"].upper().replace("3. NEITHER", "* Neither")),
        (22, L.KNOWN["ISC"] + "\nand more"),
        (23, "BSD 2-Clause License\n\nCopyright 2019, X\n\n" + L.KNOWN["BSD-2-Clause"]),
        (23, "# © 2001 Y\n" + L.KNOWN["Zlib"].replace("acknowledgment", "acknowledgement")),
        (24, "Released under the MIT License."),
        *[(r[0], r[1]) for r in ODD if "\x00" not in (r[1] or "")],
    ]


def test_forms_of_whole_licences(spark):
    got = [(r.doc_id, r.license) for r in L.matched(spark.createDataFrame(rows(), "doc_id long, text string"), known(spark)).collect() if r.license]
    assert sorted(got) == [(20, "MIT"), (21, "BSD-3-Clause"), (23, "BSD-2-Clause"), (23, "Zlib")]


def test_same_as_sql(spark):
    ours = L.matched(spark.createDataFrame(rows(), "doc_id long, text string"), known(spark)).collect()
    db = duckdb.connect()
    db.sql("create table documents(doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows())
    assert sorted(map(str, map(tuple, ours))) == sorted(map(str, db.sql(L.matched_sql()).fetchall()))


def test_empty_tables_and_ties(spark, none, odd):
    assert L.matched(none, known(spark)).count() == 0
    assert L.matched(odd, known(spark).where("false")).where("license is not null").count() == 0
    twice = spark.createDataFrame([("b", "Word"), ("a", "word!"), ("c", ""), ("d", None)], "name string, text string")
    assert {(r.doc_id, r.license) for r in L.matched(odd, twice).collect() if r.license} == {(4, "a")}


def test_long_licences(spark):
    texts = [(i, L.KNOWN[n].replace("\n", "\r\n").upper()) for i, n in enumerate(L.LONG)]
    docs = spark.createDataFrame([*texts, (99, "Licensed under the GPL-3. " + L.KNOWN["GPL-3"])], "doc_id long, text string")
    assert {r.doc_id: r.license for r in L.matched(docs, known(spark)).collect()} == {**dict(enumerate(L.LONG)), 99: None}
