import duckdb
import pandas as pd
import pytest

from barspan.llm import licenses, warc
from barspan.llm.queries import ORACLES, QUERIES


def test_warc_round_trip_of_odd_pages(spark, tmp_path):
    rows = [(1, "http://a\n b", "x", 1), (2, None, "x", 1), (3, "u", None, None), (4, "u", "", 1), (None, "n", "x", 1), (None, "k", "zz", 1), (7, "é", "é" * 9, 1), (7, "é", "é" * 9, 1), (9, "w", "a\r\n\r\nb" * 5000, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, part int")
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w", roll_bytes=300, part_bytes=8)
    assert manifest.count() > 3
    back = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert len(back) == 9 and all(r.intact for r in back)
    by = {r.page_id: r for r in back if r.page_id is not None}
    assert by[1].refers_to == 2 and by[2].record_type == "response" and by[3].refers_to == 4
    assert by[9].payload == "a\r\n\r\nb" * 5000 and by[7].payload_bytes == 18 and by[1].uri == "http://a%0A%20b"
    assert by[4].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    small = warc.write_warc(pages, f"file://{tmp_path}/s", min_revisit_bytes=2)
    kinds = {r.page_id: r.record_type for r in warc.read_warc(spark, f"file://{tmp_path}/s").collect()}
    assert kinds[1] == kinds[3] == "response" and small.count() > 0


def test_warc_files_are_the_same_each_time_and_plain_gzip(spark, sf_dir, tmp_path):
    import gzip

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one = warc.write_warc(pages, f"file://{tmp_path}/a", part_bytes=1 << 17, roll_bytes=1 << 14)
    two = warc.write_warc(pages.repartition(5), f"file://{tmp_path}/b", part_bytes=1 << 17, roll_bytes=1 << 14)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    file = one.first().file
    assert gzip.decompress((tmp_path / "a" / file).read_bytes()).startswith(b"WARC/1.1\r\n")
    assert not list((tmp_path / "a" / "_temporary").iterdir())


def test_warc_of_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.write_warc(none, f"file://{tmp_path}/w").count() == 0
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 0


def test_licences_inherit_from_the_nearest_directory(spark):
    files = spark.createDataFrame(
        [
            ("a/LICENSE", "Released under the MIT License.\nMore words."),
            ("a/b/c/x.py", "no notice here"),
            ("a/b/LICENSE", "Licensed under CC BY-NC 4.0. Rest."),
            ("a/b/c/y.py", "First line.\nLicensed under the Apache License, Version 2.0. Then " + "more words follow here " * 9),
            ("a/z", None),
            ("top", ""),
            (None, "text"),
            ("a/z", None),
            ("ab/q", "a licence of another kind entirely, with many other words in it"),
        ],
        "path string, text string",
    )
    rows = licenses.scan(files.withColumn("how", files["path"])).collect()
    got = {r.path: (r.license, r.how, r.licensed_by) for r in rows}
    assert len(rows) == 9
    assert got["a/b/c/x.py"] == ("CC-BY-NC-4.0", "inherited", "a/b")
    assert got["a/b/c/y.py"] == ("Apache-2.0", "notice", None)
    assert got["a/z"] == ("MIT", "inherited", "a")
    assert got["top"] == got[None] == got["ab/q"] == (None, "none", None)
    assert licenses.scan(files.limit(0)).count() == 0


def test_wrapped_and_commented_licences_are_known(spark):
    import textwrap

    def wrapped(text, mark=""):
        return "\n".join(mark + line for line in textwrap.wrap(text, 72))

    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "https://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    )
    mit = (
        "The MIT License (MIT)",
        "Copyright (c) 2019 Some Person <some@example.org>",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    )
    bsd = (
        "Copyright 2011 Some Company. All rights reserved.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    )
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    title = "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.,\n51 Franklin Street\n\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed."
    files = [
        ("ap/LICENSE.txt", "\n\n".join(wrapped(x) for x in apache)),
        ("ap/src/a.c", "int a;"),
        ("ap/src/b.c", "/*\n * Copyright 2020 B\n *\n" + "\n *\n".join(wrapped(x, " * ") for x in apache) + "\n */\nint main() { return 0; }\n" + "int more;\n" * 400),
        ("m/LICENSE", "\n\n".join(wrapped(x) for x in mit)),
        ("b/COPYING", "\n\n".join(wrapped(x) for x in bsd)),
        ("b/x/y/z.py", "pass"),
        ("g/a.py", "# one\n#\n" + wrapped(gpl, "# ")),
        ("gb/b.py", "print('no permission')"),
        ("s/a.js", "// SPDX-License-Identifier: MPL-2.0\nlet a = 1;"),
        ("h/n.txt", "He asked for permission to leave.\nThe driver has a licence, and the copyright is with the author."),
        ("g2/COPYING", "\n\n" + title),
        ("proj/a.c", "/* " + gpl + " */\nint a;"),
        ("proj/b.c", "int b;"),
        ("proj/sub/c.c", "int c;"),
        ("z/doc/terms.txt", "Copyright (c) 2020 Z\n\n" + licenses._ZLIB),
        ("z/doc/d.c", "int d;"),
        ("bo/LICENSE_1_0.txt", licenses._BOOST + licenses._BOOST_END),
        ("bo/e.c", "// Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"),
        ("ep/LICENSE", "Eclipse Public License - v 2.0\n\n" + licenses._EPL_TITLE.format("2.0")[31:] + "\n\n" + "1. DEFINITIONS and many other words of the agreement. " * 80),
        ("ep/f.java", "class F {}"),
    ]
    got = {r.path: (r.license, r.how, r.licensed_by) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["ap/LICENSE.txt"] == got["ap/src/b.c"] == ("Apache-2.0", "notice", None)
    assert got["ap/src/a.c"] == ("Apache-2.0", "inherited", "ap")
    assert got["m/LICENSE"][0] == "MIT" and got["b/COPYING"][0] == "BSD-3-Clause" and got["g2/COPYING"][0] == "GPL-2.0"
    assert got["b/x/y/z.py"] == ("BSD-3-Clause", "inherited", "b")
    assert got["g/a.py"] == ("GPL-3.0", "notice", None) and got["s/a.js"] == ("MPL-2.0", "notice", None)
    assert got["gb/b.py"] == got["h/n.txt"] == (None, "none", None)
    # A header labels its own file; licence files, by name or as whole texts, label their directory.
    assert got["proj/a.c"] == ("GPL-3.0", "notice", None) and got["proj/b.c"] == got["proj/sub/c.c"] == (None, "none", None)
    assert got["z/doc/terms.txt"][0] == "Zlib" and got["z/doc/d.c"] == ("Zlib", "inherited", "z/doc")
    assert got["bo/LICENSE_1_0.txt"][0] == "BSL-1.0" and got["bo/e.c"] == ("BSL-1.0", "notice", None)
    assert got["ep/LICENSE"][0] == "EPL-2.0" and got["ep/f.java"] == ("EPL-2.0", "inherited", "ep")


def test_licences_keep_clashing_columns(spark):
    rows = [("d/LICENSE", "Released under the MIT License. " + "word " * 30_000, "u")] * 2 + [("d/x", None, "v")]
    names = ("uid", "dir", "best", "near", "row", "kind", "up", "own_license", "template", "units")
    files = spark.createDataFrame(rows, "path string, text string, c string")
    for name in names:
        files = files.withColumn(name, files["c"])
    got = licenses.scan(files).collect()
    assert sorted((r.path, r.license) for r in got) == [("d/LICENSE", "MIT"), ("d/LICENSE", "MIT"), ("d/x", "MIT")]
    assert all(r[name] == r.c for r in got for name in names)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want, got = db.sql(ORACLES[name]).df(), QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(df):
        return df[columns].astype(object).where(df[columns].notna(), None).astype(str).sort_values(columns).reset_index(drop=True).replace(r"\.0$", "", regex=True)

    pd.testing.assert_frame_equal(rows(got), rows(want))


def test_licences_leave_the_users_columns_alone(spark):
    files = spark.createDataFrame([("a/LICENSE", "Released under the MIT License."), ("a/b", "no notice " * 200_000)], "path string, text string")
    files = files.selectExpr("*", "1 AS best", "2 AS near", "3 AS uid", "4 AS dir", "5 AS row", "6 AS _uid")
    rows = licenses.scan(files).collect()
    assert {(r.path, r.license, r.best, r.near, r.uid, r.dir, r.row, r._uid) for r in rows} == {("a/LICENSE", "MIT", 1, 2, 3, 4, 5, 6), ("a/b", "MIT", 1, 2, 3, 4, 5, 6)}


def test_warc_parts_are_even_and_tasks_of_their_own(spark, tmp_path):
    pages = spark.range(4000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) AS page_id", "'u' AS url", "concat(id, repeat('x', 200)) AS html")
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w", part_bytes=1 << 16).groupBy("part").sum("records").toPandas()["sum(records)"]
    assert manifest.sum() == 4000 and len(manifest) == 13 and manifest.max() <= 2 * manifest.median()
