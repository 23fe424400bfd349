import duckdb
import pandas as pd

from studyframe.llm import licenses
from studyframe.llm.work import table

MIT = """The MIT License (MIT)

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

Unless required by applicable law, software distributed under the License is distributed on an "AS IS" BASIS.
See the License for the specific language governing permissions and
limitations under the License."""

CASES = [
    (1, MIT, "MIT", "known"), (2, APACHE, "Apache-2.0", "known"), (3, None, "", "none"), (4, "", "", "none"), (5, "plain words only", "", "none"),
    (6, "x\nReleased under the MIT License.\ny\nLicensed under CC BY-NC 4.0.", "MIT,CC-BY-NC", "known"), (7, "All rights reserved.", "All-Rights-Reserved", "known"),
    (8, "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", "known"), (9, "I lost my driving license.", "", "unknown"),
    (10, "See the License for the specific language governing permissions and limitations under the License.", "", "partial"),
    (11, "// SPDX-License-Identifier: Apache-2.0\ncode", "Apache-2.0", "known"), (12, ("word " * 40_000) + ".\nReleased under the MIT License.", "MIT", "known"),
    (6, "Released under the MIT License. Released under the MIT License.", "MIT,MIT", "known"),
]


def test_known_texts(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in CASES], "doc_id long, text string, licenses string")
    got = sorted((r["doc_id"], r["licenses"], r["status"]) for r in licenses.scan(docs).collect())
    assert got == sorted((i, n, s) for i, _, n, s in CASES)
    assert licenses.scan(docs.limit(0)).count() == 0
    documents = pd.DataFrame([(i, t) for i, t, _, _ in CASES], columns=["doc_id", "text"])  # noqa: F841
    rows = duckdb.sql(licenses.sql()).fetchall()
    assert sorted((r[0], r[3], r[5]) for r in rows) == got


def test_documents_equal_the_sql(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = licenses.scan(docs)
    want = duckdb.sql(licenses.sql("'/root/testdata/sf0.01/documents.parquet'"))
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect())) == sorted(want.fetchall())
    plan = out._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
