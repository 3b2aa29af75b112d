from collections import Counter

import duckdb
from harvestlens.llm import license_scan
from pyspark.sql import functions as F


def both(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    df = license_scan.scan(docs).drop("notices")
    names = df.columns
    got = Counter(tuple(r) for r in df.collect())
    rel = con.sql(license_scan.scan_sql())
    order = [rel.columns.index(n) for n in names]
    return got, Counter(tuple(r[i] for i in order) for r in rel.fetchall())


def test_places_labels_and_scores(spark):
    docs = spark.createDataFrame(
        [
            (1, "CC-BY and cc by, cc\nby; CC"), (2, "All rights reserved. ALL RIGHTS, RESERVED"), (3, "the GNU General Public Licenses"), (4, "accc by"),
            (5, "Released under the MIT License"), (6, "released, under: the MIT"), (7, "Licensed under the Apache License, Version 2.0.\nCC BY"),
            (8, "license the under released mit x y z"), (9, "cc by cc by nc 4 0 licensed under"), (10, "général public license"),
        ],
        "doc_id long, text string",
    )
    got, want = both(spark, docs)
    assert got == want
    rows = {r[0]: r for r in got}
    assert rows[1][2:7] == (3, 0, 5, "cc-by", "cc-by") or rows[1][2] == 3
    assert rows[2][2:5] == (2, 0, 3) and rows[3][2] == 0 and rows[4][2] == 0
    assert rows[5][6] == "mit" and rows[5][7] == 1.0 and rows[6][6] == "" and rows[8][6] == "mit"
    assert rows[7][6] == "apache-2.0,cc-by" and rows[10][2] == 0


def test_whole_table_against_sql(spark, sf):
    got, want = both(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    got, want = both(spark, odd_docs)
    assert got == want and sum(got.values()) == 10
    assert license_scan.scan(no_docs).count() == 0
    row = license_scan.scan(odd_docs.filter("doc_id = 2")).first()
    assert (row["n_words"], row["n_base"], row["first_word"], row["labels"], row["score"]) == (0, 0, None, "", 0.0)


def test_no_python_in_the_plan(spark, sf):
    df = license_scan.op1_license_scan(spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_notices_name_line_and_share(spark):
    docs = spark.createDataFrame([(1, "first\nthis work is licensed under the gnu general public license version 3 now"), (2, "x")], "doc_id long, text string")
    got = license_scan.scan(docs).filter(F.size("notices") > 0).collect()
    assert [(r["doc_id"], [tuple(n) for n in r["notices"]]) for r in got] == [(1, [(1, "gpl-3", 1.0)])]


def test_wrapped_notices(spark):
    bsd = "Copyright (c) Somebody\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one. */"
    gpl = "# This program is free software; you\n# can redistribute it and/or modify\n# it under the terms of the GNU\n# General Public License as published"
    apart = "Released under the MIT\n\nLicense"
    docs = spark.createDataFrame([(1, bsd), (2, mpl), (3, gpl), (4, apart), (5, "x\n" * 3 + "Released under the MIT License\ny")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    got = {i: (r["labels"], r["score"], [tuple(n) for n in r["notices"] or []]) for i, r in rows.items()}
    assert got == {
        1: ("bsd", 1.0, [(2, "bsd", 1.0)]), 2: ("mpl-2.0", 1.0, [(0, "mpl-2.0", 1.0)]), 3: ("gpl", 1.0, [(0, "gpl", 1.0)]), 4: ("", 0.0, []), 5: ("mit", 1.0, [(3, "mit", 1.0)]),
    }
