import textwrap

import duckdb

from corpus import awkward, documents
from ledgerlens.llm import licenses
from ledgerlens.llm.oracle_sql import ORACLE_SQL


def test_spellings_case_and_copyright_lines(spark):
    mit = licenses.KNOWN_TEXTS["MIT"]
    rows = [(1, "MIT Licence\n\nCopyright (c) 2020 Somebody\n" + mit.upper()), (2, mit.replace(",", "").replace("\n\n", "\n")),
            (3, mit + " and more"), (4, "text\n  Released under the MIT Licence!  \nmore"), (5, "We saw the MIT License today."),
            (6, licenses.KNOWN_TEXTS["ISC"].replace("whether", "WHETHER")), (2, mit)]
    out = sorted((r.doc_id, r.licence, r.stated_licences, r.n_licence_lines) for r in licenses.scan(documents(spark, rows)).collect())
    assert out == [(1, "MIT", "", 0), (2, "MIT", "", 0), (2, "MIT", "", 0), (3, None, "", 0), (4, None, "MIT", 1), (5, None, "", 0), (6, "ISC", "", 0)]


def test_same_as_sql(spark):
    rows = [(i, t) for i, t in enumerate(awkward())] + [(None, "Licensed under CC BY-NC 4.0."), (50, licenses.KNOWN_TEXTS["0BSD"]),
                                                       (51, "Copyright 2020 X\nall rights reserved\nThis work is licenced under the GPLv3")]
    df = documents(spark, rows)
    out = licenses.scan(df).toPandas()
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    expected = con.sql(ORACLE_SQL["op6_license_scan"]).df()
    key = ["doc_id", "canonical_sha256", "licence", "stated_licences", "n_licence_lines"]
    norm = lambda d: sorted(map(str, d[key].astype(object).where(d[key].notna(), None).values.tolist()))
    assert [x.replace(".0", "") for x in norm(out)] == [x.replace(".0", "") for x in norm(expected)]
    assert licenses.scan(df.limit(0)).count() == 0


def test_no_python_on_the_way(spark):
    plan = licenses.scan(documents(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licences_as_they_are_wrapped_and_titled(spark):
    """Wherever the lines break, also before "copyright notice"; under common titles; holders in several forms."""
    fold = lambda key, width: "\n\n".join(textwrap.fill(p, width) for p in licenses.KNOWN_TEXTS[key].split("\n\n"))
    isc = licenses.KNOWN_TEXTS["ISC"].replace("above copyright notice", "above\ncopyright notice")
    rows = [(1, "ISC License\n\nCopyright (c) 2020, Some Body\n\n" + isc),
            (2, "The MIT License (MIT)\n\nCopyright (c) 2015 Some Body\n\n" + fold("MIT", 78)),
            (3, "The MIT License\n\nCopyright Some Body and others\n\n" + fold("MIT", 60)),
            (4, "The ISC License\n\n(c) 2019 Some Body\nAll rights reserved.\n\n" + isc.upper())]
    rows += [(10 + w, "Copyright 2020 X\n" + fold(k, w)) for k in ("MIT", "ISC", "0BSD") for w in range(50, 90)]
    expected = {1: "ISC", 2: "MIT", 3: "MIT", 4: "ISC"}
    df = documents(spark, rows)
    out = [(r.doc_id, r.canonical_sha256, r.licence) for r in licenses.scan(df).collect()]
    assert all(licence == expected[i] for i, _, licence in out if i < 10)
    assert all(licence is not None for _, _, licence in out)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    found = con.sql(ORACLE_SQL["op6_license_scan"]).fetchall()
    assert sorted(out) == sorted(r[:3] for r in found)


def test_full_texts_and_a_table_of_ones_own(spark):
    names = ["BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"]
    rows = [(i, "Copyright (c) 2021, Some Body\n\n" + " ".join(licenses.KNOWN_TEXTS[k].split("  "))) for i, k in enumerate(names)]
    df = documents(spark, rows)
    assert [r.licence for r in licenses.scan(df).orderBy("doc_id").collect()] == names
    own = spark.createDataFrame([("OWN-1", "You may  do\nas you like.")], "licence string, body string")
    found = licenses.scan(documents(spark, [(1, "Copyright 2020 X\nYou may do as you LIKE"), (2, rows[0][1])]), texts=own)
    assert [r.licence for r in found.orderBy("doc_id").collect()] == ["OWN-1", None]
