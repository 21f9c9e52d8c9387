"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

Whole texts, paragraphs (lines between lines without a letter or digit, so that comment marks and
wrapped lines do not matter) and their sentences and lines are compared with the templates: notices
in one sentence, standard file headers, titles of licence files and whole short licences.  A
document whose whole text is like a licence or its title, or that bears the name of a licence file and
holds a notice, is the licence file of its directory; a header labels its own file only.  Documents without
a notice of their own take the licence of the nearest ancestor directory that has one.  DataFrame
functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read_table

# Public licence notices, headers, titles and short licences by SPDX identifier.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_END = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
_APACHE_END = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_BOOST = (
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: '
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
)
_BOOST_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {} which is available at https://www.eclipse.org/legal/epl-{}/"
_EPL_TITLE = 'Eclipse Public License - v {} THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.'
_CDDL = "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_TITLE = "{} Version {} Copyright (C) {} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU = [
    ("GPL-3.0", "GNU General Public License", "3", "3, 29 June 2007", "2007"),
    ("GPL-2.0", "GNU General Public License", "2", "2, June 1991", "1989, 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "3, 29 June 2007", "2007"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "3, 19 November 2007", "2007"),
]
#: What a file says of itself.
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law the author has dedicated this work to the public domain under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose is granted under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} http://www.apache.org/licenses/LICENSE-2.0 {_APACHE_END}"),
    ("MIT", _MIT),
    ("BSD-3-Clause", _BSD_3),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"),
    ("BSL-1.0", _BOOST),
    *[(f"EPL-{v}", _EPL.format(v, v)) for v in ("1.0", "2.0")],
    ("CDDL-1.0", _CDDL),
    *[(spdx, _GPL.format(name, version)) for spdx, name, version, _, _ in _GNU],
    *[(spdx, f"SPDX-License-Identifier: {spdx}") for spdx in ("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "ISC", "Unlicense", "BSL-1.0", "Zlib", "EPL-1.0", "EPL-2.0", "CDDL-1.0")],
]
#: What licence files hold: whole short licences, and the titles of long ones.
TEXTS = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", f"The MIT License (MIT) Copyright (c) {_MIT}{_MIT_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) All rights reserved. {_BSD}{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c) All rights reserved. {_BSD}{_BSD_3}{_BSD_END}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003 {_BOOST}{_BOOST_END}"),
    ("Zlib", _ZLIB),
    *[(f"EPL-{v}", _EPL_TITLE.format(v)) for v in ("1.0", "2.0")],
    ("CDDL-1.0", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"),
    *[(spdx, _TITLE.format(name, dated, years)) for spdx, name, _, dated, years in _GNU],
]
NOTICES = HEADERS + TEXTS
ANCHOR = r"(?i)licen[sc]e|copyright|permission|redistribut|public domain"
FILE_NAME = r"(?i)(^|/)(un)?licen[sc]e([.-][^/]*)?$|(^|/)copying([.-][^/]*)?$"
BLANK = r"\n[^A-Za-z0-9\n]*\n"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _weights(spark) -> tuple[DataFrame, float]:
    """(token, idf, weights by template of unit length), and the idf of unknown tokens.

    The templates are a fixed list, so the table may be broadcast.
    """
    rows = [(k, text) for k, (_, text) in enumerate(NOTICES)]
    tf = spark.createDataFrame(rows, "template int, text string")
    tf = tf.select("template", F.explode(_tokens(F.col("text"))).alias("token")).groupBy("template", "token").agg(F.count("*").alias("tf"))
    n = len(NOTICES)
    idf = tf.groupBy("token").agg((F.log((F.lit(1.0) + n) / (1 + F.count("*"))) + 1).alias("idf"))
    raw = tf.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = raw.join(norm, "template").groupBy("token", "idf").agg(F.collect_list(F.struct("template", (F.col("w") / F.col("norm")).alias("weight"))).alias("units"))
    return unit, math.log(1.0 + n) + 1


def _cosines(pieces: DataFrame, keys: list[str], spark) -> DataFrame:
    """pieces(keys, text) -> (keys, template, cosine) of every template that shares a token.

    One pass: a piece's own square goes beside its products as template -1, and the rows of a
    piece, at most one a template, meet in one aggregation.
    """
    unit, unknown = _weights(spark)
    tf = pieces.select(*keys, F.explode(_tokens(F.col("text"))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("tf"))
    w = tf.join(F.broadcast(unit), "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    products = F.transform("units", lambda u: F.struct(u["template"].alias("template"), (F.col("w") * u["weight"]).alias("x")))
    own = F.array(F.struct(F.lit(-1).alias("template"), (F.col("w") * F.col("w")).alias("x")))
    parts = w.select(*keys, F.explode(F.when(F.col("units").isNull(), own).otherwise(F.concat(own, products))).alias("p"))
    sums = parts.groupBy(*keys, "p.template").agg(F.sum("p.x").alias("x"))
    met = sums.groupBy(*keys).agg(F.max(F.when(F.col("template") < 0, F.sqrt("x"))).alias("norm"), F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "x"))).alias("dots"))
    dots = met.select(*keys, "norm", F.explode("dots").alias("d"))
    return dots.select(*keys, F.col("d.template").alias("template"), F.round(F.col("d.x") / F.col("norm"), 6).alias("cosine"))


def scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text", notice_cosine: float = 0.8, file_cosine: float = 0.5) -> DataFrame:
    """One row per file: its columns and license, how, score, licensed_by.

    how: `notice` (best-matching part, from the whole text to one sentence or line), `inherited`
    (licensed_by names the ancestor directory) or `none`.  Of equal cosines the template listed
    first counts; of the licence files of a directory the best score, then the smallest path.  Long
    licences (Apache, GPL, MPL, EPL, CDDL) are known by headers and titles, not by their whole texts.
    Paths use '/'; a file without a directory lies in ''.  Null or empty texts have no notice and
    may inherit; null paths lie in '' as well.  Very long texts are read whole.  Rows that repeat
    path and text share their result.  Columns named as the results are replaced; all others stay.
    """
    spark = files.sparkSession
    files = files.drop("license", "how", "score", "licensed_by")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    uid = F.xxhash64(path, text)
    place = F.regexp_replace(path, "/?[^/]*$", "")
    body = files.filter(text.rlike(ANCHOR)).select(uid.alias("uid"), path.alias("path"), F.regexp_replace(text, r"^\s+", "").alias("text")).dropDuplicates(["uid", "path"])
    paragraphs = F.split("text", BLANK)
    lines = F.split(F.regexp_replace("text", r"([.!?;])\s+", "$1\n"), "\n")
    # A text of one paragraph is a whole text; the lines of a paragraph are also read as joined sentences.
    joined = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", BLANK, "\u0001"), "\n", " "), r"([.!?;])\s+|\u0001", "$1\u0001"), "\u0001")
    kinds = F.array(F.array(F.col("text")), F.when(F.size(paragraphs) > 1, paragraphs), lines, F.when(F.col("text").contains("\n"), joined))
    kind = body.select("uid", "path", F.posexplode(kinds).alias("kind", "parts")).select("uid", "path", "kind", F.posexplode("parts").alias("pos", "text"))
    pieces = kind.filter(F.col("text").rlike(ANCHOR))
    near = _cosines(pieces, ["uid", "path", "kind", "pos"], spark).filter((F.col("cosine") >= notice_cosine) | ((F.col("kind") == 0) & (F.col("cosine") >= file_cosine)))
    best = F.struct(F.col("cosine"), (-F.col("template")).alias("order"))  # of equal cosines the template listed first
    by_file = near.groupBy("uid", "path").agg(
        F.max(F.when(F.col("cosine") >= notice_cosine, best)).alias("best"),
        F.max(F.when((F.col("kind") == 0) & (F.col("template") >= len(HEADERS)), F.col("cosine"))).alias("alike"),
    )
    names = F.array(*[F.lit(lic) for lic, _ in NOTICES])
    notices = cut(by_file.filter("best is not null").select("uid", "path", F.col("best.cosine").alias("own_score"), F.element_at(names, 1 - F.col("best.order")).alias("own_license"), "alike"), "notices")
    licence_files = notices.filter((F.col("alike") >= file_cosine) | F.col("path").rlike(FILE_NAME)).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    first = F.min_by(F.struct("own_license", "own_score"), F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own_license").alias("l")))
    dir_licence = licence_files.groupBy("dir").agg(first.alias("m")).select(F.col("dir").alias("up"), F.col("m.own_license").alias("dir_license"), F.col("m.own_score").alias("dir_score"))
    every = files.select(F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("row"), uid.alias("uid"), path.alias("path"), place.alias("dir"))
    dirs = every.select("dir").distinct()
    steps = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("up"))
    nearest = ancestors.join(dir_licence, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "dir_license", "dir_score")).alias("near"))
    out = every.join(notices.select("uid", "path", "own_license", "own_score"), ["uid", "path"], "left").join(nearest.select("dir", "near"), "dir", "left")
    own = F.col("own_license").isNotNull()
    return out.select(
        "row.*",
        F.coalesce("own_license", "near.dir_license").alias("license"),
        F.when(own, "notice").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.coalesce("own_score", "near.dir_score").alias("score"),
        F.when(~own, F.col("near.up")).alias("licensed_by"),
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """documents as files: the path is source/lang/thousands of doc_id/doc_id."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text")).select("doc_id", "path", "license", "how", "score", "licensed_by")


def _oracle() -> str:
    quoted = lambda text: text.replace("'", "''")
    values = ", ".join(f"({k}, '{lic}', '{quoted(text)}')" for k, (lic, text) in enumerate(NOTICES))
    anchor, name = ANCHOR.removeprefix("(?i)"), FILE_NAME.removeprefix("(?i)")
    n = len(NOTICES)
    mark = "chr(1)"
    return f"""
WITH t(template, license, text) AS (VALUES {values}),
tt AS (SELECT template, license, token, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM t) GROUP BY ALL),
idf AS (SELECT token, ln({n + 1}.0::DOUBLE / (1 + count(*))) + 1 AS idf FROM tt GROUP BY token),
unit AS (SELECT template, license, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (token)),
f AS (SELECT doc_id, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), (doc_id // 1000)::VARCHAR, doc_id::VARCHAR) AS path, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, path, regexp_replace(text, '^\\s+', '') AS text FROM f WHERE regexp_matches(text, '{anchor}', 'i')),
k AS (SELECT doc_id, path, 0 AS kind, [text] AS parts FROM b
  UNION ALL SELECT doc_id, path, 1, regexp_split_to_array(text, '{BLANK}') FROM b WHERE regexp_matches(text, '{BLANK}')
  UNION ALL SELECT doc_id, path, 2, string_split(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(10), 'g'), chr(10)) FROM b
  UNION ALL SELECT doc_id, path, 3, string_split(regexp_replace(replace(regexp_replace(text, '{BLANK}', {mark}, 'g'), chr(10), ' '), '([.!?;])\\s+|' || {mark}, '\\1' || {mark}, 'g'), {mark}) FROM b WHERE contains(text, chr(10))),
s AS (SELECT doc_id, path, kind, unnest(parts) AS seg, unnest(range(len(parts))) AS pos FROM k),
st AS (SELECT doc_id, path, kind, pos, token, count(*) AS tf FROM (SELECT doc_id, path, kind, pos, unnest(regexp_extract_all(lower(seg), '[a-z0-9]+')) AS token FROM s WHERE regexp_matches(seg, '{anchor}', 'i')) GROUP BY ALL),
sw AS (SELECT doc_id, path, kind, pos, token, tf * coalesce(idf, ln({n + 1}.0::DOUBLE) + 1) AS w FROM st LEFT JOIN idf USING (token)),
sn AS (SELECT doc_id, kind, pos, sqrt(sum(w * w)) AS norm FROM sw GROUP BY ALL),
sc AS (SELECT sw.doc_id, path, sw.kind, sw.pos, template, license, round(sum(w * weight) / any_value(norm), 6) AS cosine FROM sw JOIN unit USING (token) JOIN sn ON sn.doc_id = sw.doc_id AND sn.kind = sw.kind AND sn.pos = sw.pos GROUP BY ALL),
own AS (SELECT doc_id, path, max(cosine) AS cosine, arg_max(license, (cosine, -template)) AS license FROM sc WHERE cosine >= 0.8 GROUP BY ALL),
wc AS (SELECT doc_id, max(cosine) AS alike FROM sc WHERE kind = 0 AND template >= {len(HEADERS)} GROUP BY doc_id),
lf AS (SELECT own.*, regexp_replace(path, '/?[^/]*$', '') AS dir FROM own LEFT JOIN wc USING (doc_id) WHERE alike >= 0.5 OR regexp_matches(path, '{name}', 'i')),
dl AS (SELECT dir, arg_min(license, path) AS dir_license, any_value(cosine) AS dir_score FROM (SELECT *, max(cosine) OVER (PARTITION BY dir) AS top FROM lf) WHERE cosine = top GROUP BY dir),
dd AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM f),
near AS (SELECT x.dir, arg_max(dl.dir_license, length(dl.dir)) AS dir_license, arg_max(dl.dir_score, length(dl.dir)) AS dir_score, arg_max(dl.dir, length(dl.dir)) AS up
  FROM (SELECT DISTINCT dir FROM dd) x JOIN dl ON x.dir = dl.dir OR starts_with(x.dir, dl.dir || '/') GROUP BY x.dir)
SELECT dd.doc_id, dd.path, coalesce(own.license, near.dir_license) AS license,
  CASE WHEN own.license IS NOT NULL THEN 'notice' WHEN near.dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  coalesce(own.cosine, near.dir_score) AS score, CASE WHEN own.license IS NULL THEN near.up END AS licensed_by
FROM dd LEFT JOIN own ON own.doc_id = dd.doc_id LEFT JOIN near ON near.dir = dd.dir
"""


ORACLE = _oracle()
