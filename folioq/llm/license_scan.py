"""Licence scan: TF-IDF cosine of headers, notices and licence files to licence templates, and licences inherited along paths.

The texts that are compared are a file's header (its leading block of comments), a licence
file as a whole, and notices: lines, and sentences over line ends, wherever they stand.
Only those with a MARKERS word are; every template has one. Headers and licence files are
compared with the full licence texts and with the usual notices, the others with notices.
A line or sentence that denies a licence ("not licensed under") is no notice. Document
frequencies are those of the templates, so what a file says doesn't hang on the other files.
Equal texts are scored once, so a notice that stands in many files costs a row there and no more.

Vectors are rows (text, word, weight): texts meet the templates' words in an equi-join and
sums of products give the cosines. The templates' words are fixed in number by the
templates and are broadcast. A file's licence is that of its header or, for licence
files, its whole text if that reaches the threshold, else of its notices.

A directory's licence is that of its licence files. A file without licence of its own
takes that of the nearest directory above it which has one: the distinct directories
are joined to their ancestors' licences, and files to their directory.

Defined results: null and blank texts have no licence of their own; a null path lies in
the root; of several templates the higher cosine counts, then the greater name; of several
licences in a directory the one most of its licence files name, then the name; repeated
rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, row_key, stored, table

THRESHOLD = 0.75
WORD = r"[^a-z0-9.+-]+"
SENTENCE_END = r"[.!?:;]+[\x20\x09-\x0D]"
COMMENT = r"^[ \t]*(//|#|\*|--|;|%)|^[ \t\r\x0B\x0C]*$"
#: Block comments that a header can be: how they begin and end.
COMMENT_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'))
#: Parts of words; a text without any of them is no notice.
MARKERS = ("licen", "copyright", "redistribut", "permission", "rights reserved", "proprietary", "public domain", "warrant")
#: A denial in a line or sentence, as its words joined by spaces (an apostrophe parts words).
DENIED = r"\b(not|never|no longer|n t|isn t|aren t|wasn t)( \S+)? (licensed|released|distributed|published|available|covered)( \S+)? under\b"
#: A header or licence file is a denial as a whole only if it is shorter.
DENIAL_CHARS = 400
FOLDER = Path(__file__).resolve().parent / "licence_texts"
#: Usual notices by SPDX name.
NOTICES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "ISC": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released into the public domain under CC0 1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-4-Clause": ["Licensed under the original BSD License.", "All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "0BSD": ["Licensed under the Zero-Clause BSD License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "Zlib": ["Licensed under the zlib License.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"],
    "EPL-2.0": ["Licensed under the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
#: The notices of the GNU licences differ in these names and versions.
GNU = {
    "GPL-2.0": ("program", "General Public License", "2"), "GPL-3.0": ("program", "General Public License", "3"), "AGPL-3.0": ("program", "Affero General Public License", "3"),
    "LGPL-2.1": ("library", "Lesser General Public License", "2.1"), "LGPL-3.0": ("library", "Lesser General Public License", "3"),
}
#: Fixed value: from section 13 of the GNU Affero General Public License.
AFFERO = """Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it
remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to
the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."""
SPDX_ONLY = ("CC-BY-NC-SA-4.0", "Artistic-2.0")


def notices() -> dict[str, list[str]]:
    out = {name: list(texts) for name, texts in NOTICES.items()}
    for name, (work, licence, version) in GNU.items():
        free = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {licence}"
        terms = f"{free} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        kind = licence.replace("General Public License", "").lower()
        rest = f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {licence} for more details. You should have received a copy of the GNU {licence} along with this {work}."
        out[name] = [f"This work is licensed under the GNU {licence}, version {version}.", f"Licensed under the {kind} {name[:-4]} version {version}", free, terms, f"{terms} {rest}"]
    for name in [*out, *SPDX_ONLY]:
        if name != "proprietary":
            spdx = [f"{name}-only", f"{name}-or-later"] if name in GNU else []
            out.setdefault(name, []).extend(f"SPDX-License-Identifier: {x}" for x in [name, *spdx])
    return out


@cache
def templates() -> tuple[tuple[str, bool, str], ...]:
    """(licence, whether it is a full text, text)."""
    full = {p.stem: p.read_text(encoding="utf-8") for p in sorted(FOLDER.glob("*.txt"))}
    # The Affero licence is the general one but for its name, its preamble and its section 13, which is on use over a network.
    affero = full["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("GNU General", "GNU Affero General")
    full["AGPL-3.0"] = f"{affero}\n{AFFERO}"
    short = [(name, False, x) for name, texts in notices().items() for x in texts]
    return (*short, *((name, True, text) for name, text in full.items()))


def _words(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(line), WORD), lambda w: F.btrim(w, F.lit(".+-"))), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _has_marker(text: Column) -> Column:
    def any_of(t: Column) -> Column:
        out = F.lit(False)
        for m in MARKERS:
            out = out | F.contains(t, F.lit(m))
        return out

    return _bound(F.lower(text), any_of)


def header(text: Column) -> Column:
    """The leading block comment, or the leading lines that are comments or blank."""
    begin = F.ltrim(F.translate(text, "\r\n\t", "   "))
    lines = F.split(text, "\n")
    first = lambda xs: F.array_position(F.transform(xs, lambda x: x.rlike(COMMENT)), False).cast("int")
    leading = _bound(lines, lambda xs: _bound(first(xs), lambda n: F.array_join(F.when(n == 0, xs).otherwise(F.slice(xs, 1, F.greatest(n - 1, F.lit(0)))), " ")))
    out = F.when(F.startswith(begin, F.lit(COMMENT_BLOCKS[0][0])), F.split_part(text, F.lit(COMMENT_BLOCKS[0][1]), F.lit(1)))
    out = out.when(F.startswith(begin, F.lit(COMMENT_BLOCKS[1][0])), F.split_part(text, F.lit(COMMENT_BLOCKS[1][1]), F.lit(1)))
    return out.when(F.startswith(begin, F.lit(COMMENT_BLOCKS[2][0])), F.split_part(text, F.lit(COMMENT_BLOCKS[2][1]), F.lit(2))).otherwise(leading)


def compared(text: Column, is_licence_file: Column) -> Column:
    """The texts of a file that are compared, as structs (whole, words): whole is true of headers and licence files."""

    def found(t: Column) -> Column:
        parts = F.concat(
            F.transform(F.split(t, "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("text"))),
            F.transform(F.split(t, SENTENCE_END), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("text"))),
            F.array(F.struct(F.lit(True).alias("whole"), header(t).alias("text"))),
            F.array(F.struct(F.lit(True).alias("whole"), F.when(is_licence_file, t).otherwise(F.lit("")).alias("text"))),
        )
        some = F.filter(parts, lambda p: _has_marker(p["text"]))
        spelled = F.transform(some, lambda p: F.struct(p["whole"].alias("whole"), F.array_join(_words(p["text"]), " ").alias("words")))
        return F.array_distinct(F.filter(spelled, lambda p: ~(F.rlike(p["words"], F.lit(DENIED)) & (~p["whole"] | (F.length(p["words"]) < DENIAL_CHARS)))))

    none = F.array().cast("array<struct<whole:boolean,words:string>>")
    return _bound(F.coalesce(text, F.lit("")), lambda t: F.when(_has_marker(t), found(t)).otherwise(none))


def template_words(spark: SparkSession) -> DataFrame:
    """Rows (nid, licence, full, word, n)."""
    listed = json.dumps([{"nid": i, "licence": name, "full": full, "text": text} for i, (name, full, text) in enumerate(templates())])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(listed), "array<struct<nid: int, licence: string, full: boolean, text: string>>")).alias("t")).select("t.*")
    return stored(rows.select("nid", "licence", "full", F.explode(_words(F.col("text"))).alias("word")).groupBy("nid", "licence", "full", "word").agg(F.count("*").alias("n")), "templates")


def own_licences(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """texts: (file, whole, words), file unique to a file. Rows (file, licence, cosine) of files with a text near a template."""
    spark = texts.sparkSession
    texts = texts.withColumn("text_id", F.md5("words"))
    distinct = texts.groupBy("text_id").agg(F.first("words").alias("words"), F.max("whole").alias("any_whole"))
    vectors = distinct.select("text_id", "any_whole", F.explode(F.split("words", " ")).alias("word")).groupBy("text_id", "any_whole", "word").agg(F.count("*").alias("tf"))
    vectors = stored(vectors, "vectors")
    known = template_words(spark)
    # Of the templates' words, whose number is fixed by the templates.
    idf = stored(known.groupBy("word").agg((F.log((1 + F.lit(len(templates()))) / (1 + F.count("*"))) + 1).alias("idf")), "idf")
    none = F.lit(math.log(1 + len(templates())) + 1)
    weighed = vectors.join(F.broadcast(idf), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", none))
    t = known.join(F.broadcast(idf), "word").withColumn("w", F.col("n") * F.col("idf"))
    lengths = t.groupBy("nid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    # The templates' words: their number is fixed by the templates.
    t = stored(t.join(F.broadcast(lengths), "nid").select("nid", "licence", "full", "word", (F.col("w") / F.col("length")).alias("t")), "weights")
    long = weighed.groupBy("text_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    met = weighed.join(F.broadcast(t), "word").where(~F.col("full") | F.col("any_whole"))
    sums = met.groupBy("text_id", "nid", "licence", "full").agg(F.sum(F.col("w") * F.col("t")).alias("dot")).join(long, "text_id")
    near = sums.withColumn("cosine", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("cosine") >= threshold)
    pick = lambda c: F.max(F.when(c, F.struct("cosine", "licence")))
    best = near.groupBy("text_id").agg(pick(F.lit(True)).alias("as_whole"), pick(~F.col("full")).alias("as_part"))
    found = texts.select("file", "whole", "text_id").join(best, "text_id").select("file", "whole", F.when(F.col("whole"), F.col("as_whole")).otherwise(F.col("as_part")).alias("b"))
    first = F.max(F.struct("whole", "b.cosine", "b.licence")).alias("best")
    return found.where("b is not null").groupBy("file").agg(first).select("file", "best.licence", "best.cosine")


def inherit(files: DataFrame) -> DataFrame:
    """files: (file, directory, licence, is_licence_file). Adds inherited and from_directory: the nearest ancestor directory's licence."""
    votes = files.where("is_licence_file and licence is not null").groupBy("directory", "licence").agg(F.count("*").alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("v"), F.col("licence").alias("l")))["l"]
    by_directory = votes.groupBy("directory").agg(best.alias("inherited")).withColumnRenamed("directory", "above")
    directories = files.select("directory").distinct()
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    lines = directories.select("directory", F.explode(F.array_distinct(above)).alias("above"))
    nearest = lines.join(by_directory, "above").groupBy("directory").agg(F.max_by(F.struct("inherited", F.col("above").alias("from_directory")), F.length("above")).alias("near"))
    return files.join(nearest.select("directory", "near.*"), "directory", "left")


def scan(files: DataFrame, path: str = "path", text: str = "text", file: str = "file", is_licence_file: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """files: file, path and text. Rows (file, path, own, cosine, licence, from_directory): licence is the own one or else the inherited one.

    is_licence_file tells the files whose licence holds for their directory; unset, it goes by the usual names.
    """
    named = F.lower(F.regexp_extract(F.col(path), r"([^/]*)$", 1)).rlike(r"^(licen[cs]e|copying|notice|unlicense)([.-].*)?$") if is_licence_file is None else is_licence_file
    rows = files.select(F.col(file).alias("file"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(text).alias("text"), F.coalesce(named, F.lit(False)).alias("is_licence_file"))
    # Null and repeated files stay apart by their texts. Texts are read once: what is compared of them is little.
    rows = rows.select("file", "path", "is_licence_file", row_key(F.col("file"), F.col("text")).alias("key"), compared(F.col("text"), F.col("is_licence_file")).alias("texts"))
    rows = stored(rows, "files")
    texts = rows.where(F.size("texts") > 0).groupBy("key").agg(F.first("texts").alias("texts")).select(F.col("key").alias("file"), F.explode("texts").alias("t")).select("file", "t.*")
    own = own_licences(texts, threshold).withColumnRenamed("file", "key")
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    placed = rows.drop("texts").join(own, "key", "left").withColumn("directory", directory)
    out = inherit(placed)
    return out.select("file", "path", F.col("licence").alias("own"), "cosine", F.coalesce("licence", "inherited").alias("licence"), F.when(F.col("licence").isNull(), F.col("from_directory")).alias("from_directory"))


def op9_licence_scan(spark, sf_dir):
    """Documents as files of a tree by source, language and hundred; of each hundred the documents of at most 50 words are its licence files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    few = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), SPACE)) <= 50
    out = scan(docs.withColumn("path", path).withColumn("few", few), file="doc_id", is_licence_file=F.col("few"))
    return out.select(F.col("file").alias("doc_id"), "path", "own", "cosine", "licence", "from_directory")


def _template_rows() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({i}, '{name}', {full}, {quoted(text)})" for i, (name, full, text) in enumerate(templates()))


def _any(text: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{m}')" for m in MARKERS) + ")"


_WORDS = "list_filter(list_transform(regexp_split_to_array(lower(%s), '[^a-z0-9.+-]+'), lambda w: trim(w, '.+-')), lambda w: w <> '')"
_BEGIN = "ltrim(translate(text, chr(13) || chr(10) || chr(9), '   '), ' ')"
_LEAD = f"list_position(list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, '{COMMENT}')), false)"
SQL = rf"""
WITH template_texts(nid, licence, is_full, text) AS (VALUES {_template_rows()}),
notices AS (SELECT nid, licence, is_full, word, count(*) AS n FROM (SELECT nid, licence, is_full, unnest({_WORDS % "text"}) AS word FROM template_texts) GROUP BY ALL),
files AS (
  SELECT doc_id, concat_ws('/', source, lang, floor(doc_id / 100)::BIGINT::VARCHAR, doc_id::VARCHAR) AS path, coalesce(text, '') AS text,
         len(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+')) <= 50 AS few FROM documents),
gated AS (SELECT * FROM files WHERE {_any("text")}),
headers AS (
  SELECT doc_id, CASE WHEN starts_with({_BEGIN}, '/*') THEN split_part(text, '*/', 1) WHEN starts_with({_BEGIN}, '<!--') THEN split_part(text, '-->', 1)
    WHEN starts_with({_BEGIN}, repeat(chr(34), 3)) THEN split_part(text, repeat(chr(34), 3), 2)
    ELSE array_to_string(CASE WHEN coalesce({_LEAD}, 0) = 0 THEN string_split(text, chr(10)) ELSE string_split(text, chr(10))[1:{_LEAD} - 1] END, ' ') END AS part FROM gated),
parts AS (
  SELECT doc_id, false AS whole, unnest(string_split(text, chr(10))) AS part FROM gated
  UNION ALL SELECT doc_id, false, unnest(regexp_split_to_array(text, '{SENTENCE_END}')) FROM gated
  UNION ALL SELECT doc_id, true, part FROM headers
  UNION ALL SELECT doc_id, true, text FROM gated WHERE few),
spelled AS (SELECT DISTINCT doc_id, whole, array_to_string({_WORDS % "part"}, ' ') AS words FROM parts WHERE {_any("part")}),
texts AS (SELECT * FROM spelled WHERE NOT (regexp_matches(words, '{DENIED}') AND (NOT whole OR length(words) < {DENIAL_CHARS}))),
vectors AS (SELECT words, word, count(*) AS tf FROM (SELECT words, unnest(string_split(words, ' ')) AS word FROM (SELECT DISTINCT words FROM texts)) GROUP BY ALL),
total AS (SELECT count(*) AS total FROM template_texts),
idf AS (SELECT word, ln((1 + any_value(total)) / (1 + count(*))) + 1 AS idf FROM notices CROSS JOIN total GROUP BY word),
rated AS (SELECT words, word, tf, tf * coalesce(idf, ln(1 + total) + 1) AS w FROM vectors LEFT JOIN idf USING (word) CROSS JOIN total),
lengths AS (SELECT words, sqrt(sum(w ** 2)) AS length FROM rated GROUP BY words),
weighed AS (SELECT nid, licence, is_full, word, n * idf AS w FROM notices JOIN idf USING (word)),
weights AS (SELECT nid, licence, is_full, word, w / sqrt(sum(w ** 2) OVER (PARTITION BY nid)) AS t FROM weighed),
cosines AS (
  SELECT v.words, w.nid, w.licence, w.is_full, round(sum(v.w * w.t) / any_value(l.length), 6) AS cosine
  FROM rated v JOIN weights w USING (word) JOIN lengths l ON l.words = v.words GROUP BY ALL),
own AS (
  SELECT doc_id, licence AS own, cosine FROM texts t JOIN cosines c ON c.words = t.words AND (t.whole OR NOT c.is_full) WHERE cosine >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY whole DESC, cosine DESC, licence DESC) = 1),
placed AS (SELECT f.doc_id, path, own, cosine, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, few FROM files f LEFT JOIN own USING (doc_id)),
votes AS (SELECT directory AS above, own AS inherited, count(*) AS votes FROM placed WHERE few AND own IS NOT NULL GROUP BY ALL),
by_directory AS (SELECT above, inherited FROM votes QUALIFY row_number() OVER (PARTITION BY above ORDER BY votes DESC, inherited) = 1),
ancestors AS (SELECT DISTINCT directory, unnest(list_transform(range(0, len(string_split(directory, '/')) + 1), lambda i: array_to_string(string_split(directory, '/')[1:i], '/'))) AS above FROM placed),
nearest AS (SELECT directory, inherited, above AS from_directory FROM ancestors JOIN by_directory USING (above) QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, own, cosine, coalesce(own, inherited) AS licence, CASE WHEN own IS NULL THEN from_directory END AS from_directory
FROM placed LEFT JOIN nearest USING (directory)
"""
