"""Licence scans: TF-IDF cosine of statements to templates, then inheritance from the nearest directory above.

Only DataFrame functions: rows without a licence word never leave the scan, the others are split into their
words and joined with the postings of the templates.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlog.llm.base import stored

#: SPDX names with statements by which files declare them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]
#: A statement holds one of these; words of a statement; names of licence files; cosine from which a template counts.
LICENCE_WORD = r"(?i)licen[cs]e|public domain"
WORD = r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
LEAST = 0.6
#: Share of it from which a window is looked at more closely.
COARSE = 0.75


#: An SPDX tag, whose expression is the licence.
TAG = r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9.+-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(?[A-Za-z0-9.+-]+\)?)*)"
#: Standard headers and short licences as wholes; ``licence_texts`` holds the long ones.
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as
published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have
received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."""
AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. """
NO_ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """
SHORT = [
    ("GPL-3.0", GNU.format("General Public License", "3")),
    ("GPL-2.0", GNU.format("General Public License", "2")),
    ("LGPL-3.0", GNU.format("Lesser General Public License", "3")),
    ("LGPL-2.1", GNU.format("Lesser General Public License", "2.1")),
    ("AGPL-3.0", GNU.format("Affero General Public License", "3")),
    ("BSD-2-Clause", BSD + AS_IS),
    ("BSD-3-Clause", BSD + NO_ENDORSEMENT + AS_IS),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
]


@lru_cache(1)
def wholes() -> list[tuple[str, list[str]]]:
    """(SPDX name, words) of whole headers and licence texts."""
    long = [(p.stem, p.read_text()) for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))]
    return [(name, re.findall(WORD, text.lower())) for name, text in SHORT + long]


def postings() -> tuple[list[tuple[str, int, float, float]], float]:
    """((word, template, weight in it, idf), idf of words in no template): weights are tf x idf over unit length."""
    words = [re.findall(WORD, t.lower()) for _, t in TEMPLATES]
    df = {w: sum(w in x for x in words) for x in words for w in x}
    idf = {w: math.log((1 + len(words)) / (1 + n)) + 1 for w, n in df.items()}
    out = []
    for i, x in enumerate(words):
        length = math.sqrt(sum((x.count(w) * idf[w]) ** 2 for w in set(x)))
        out += [(w, i, x.count(w) * idf[w] / length, idf[w]) for w in sorted(set(x))]
    return out, math.log(1 + len(words)) + 1


def statements(files: DataFrame) -> DataFrame:
    """(file, unit, at): every line, and every two lines that follow each other, in which a licence word stands."""
    lines = F.split("text", "\r?\n")
    pairs = F.transform("lines", lambda x, i: F.when(i + 1 < F.size("lines"), F.concat(x, F.lit(" "), F.element_at("lines", (i + 2).cast("int")))))
    held = files.where(F.col("text").rlike(LICENCE_WORD)).select("file", lines.alias("lines"))
    units = held.select("file", F.posexplode(F.concat("lines", pairs)).alias("at", "unit"))
    return units.where(F.col("unit").rlike(LICENCE_WORD))


def matches(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(file, name, score): the template nearest to any statement of a file, if its cosine is ``least`` or more.

    Ties go to the smallest SPDX name. files: (file, text).
    """
    table, other = postings()
    idf = F.coalesce(F.create_map(*[F.lit(x) for w, v in {w: v for w, _, _, v in table}.items() for x in (w, v)])[F.col("word")], F.lit(other))
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(i).alias("template"), F.lit(v).alias("share")) for w, i, v, _ in table])).alias("p")
    known = files.sparkSession.range(1).select(rows).select("p.*")
    words = statements(files).select("file", "at", F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(WORD), 0)).alias("word"))
    counted = words.groupBy("file", "at", "word").agg(F.count("*").alias("tf")).withColumn("weight", F.col("tf") * idf)
    lengths = counted.groupBy("file", "at").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    dots = counted.join(F.broadcast(known), "word").groupBy("file", "at", "template").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    names = F.element_at(F.array(*[F.lit(n) for n, _ in TEMPLATES]), F.col("template") + 1)
    cosines = dots.join(lengths, ["file", "at"]).select("file", names.alias("name"), F.round(F.col("dot") / F.col("length"), 6).alias("score"))
    best = cosines.where(F.col("score") >= least).groupBy("file", "name").agg(F.max("score").alias("score"))
    return best.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b")).select("file", "b.name", (-F.col("b.s")).alias("score"))


def whole_matches(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(file, name, score): templates of whole headers and texts that a window of a file's words comes near to, and SPDX tags.

    Windows have a template's length and start at every quarter of it, and around the best of these at every
    32nd part; lines and licence words play no part.
    idf is of document frequencies over all files; a word in no template counts as in no other file. A window's
    cosine is at most the root of the squared shares of those template words that the file holds, so files whose
    bound is below ``least`` are passed over exactly. files: (file, text).
    """
    spark = files.sparkSession
    templates = wholes()
    rows = [(w, i, x.count(w)) for i, (_, x) in enumerate(templates) for w in sorted(set(x))]
    known = F.broadcast(spark.createDataFrame(rows, "word string, template int, tf int"))
    vocabulary = F.broadcast(spark.createDataFrame([(w,) for w in sorted({r[0] for r in rows})], "word string"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)
    held = stored(files.select("file", F.explode(F.array_distinct(words)).alias("word")).join(vocabulary, "word"))
    total = files.count()
    df = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w, _, _ in rows}
    other = math.log(1 + total) + 1
    length = [math.sqrt(sum((x.count(w) * idf[w]) ** 2 for w in set(x))) for _, x in templates]
    shares = F.broadcast(spark.createDataFrame([(w, i, n * idf[w] / length[i], idf[w]) for w, i, n in rows], "word string, template int, share double, idf double"))
    bound = held.join(shares, "word").groupBy("file", "template").agg(F.sum(F.col("share") * F.col("share")).alias("s"))
    near = bound.where(F.col("s") >= least * least - 1e-9).select("file", "template")
    steps = [(i, len(x), max(1, len(x) // 4), -(-len(x) // max(1, len(x) // 4))) for i, (_, x) in enumerate(templates)]
    near = stored(near.join(F.broadcast(spark.createDataFrame(steps, "template int, length int, step int, parts int")), "template"))
    some = files.join(near.select("file").distinct(), "file", "left_semi").dropDuplicates(["file", "text"])
    spots = some.select("file", F.xxhash64("text").alias("th"), F.posexplode(words).alias("pos", "word")).join(near, "file")
    everywhere = F.broadcast(spark.createDataFrame(sorted(idf.items()), "word string, i double"))

    def scored(windows: DataFrame, least: float) -> DataFrame:
        counted = windows.groupBy("file", "th", "template", "start", "word").agg(F.count("*").alias("tf"))
        weighed = counted.join(shares, ["word", "template"], "left").join(everywhere, "word", "left").withColumn("weight", F.col("tf") * F.coalesce("i", F.lit(other)))
        sums = weighed.groupBy("file", "th", "template", "start").agg(F.sum(F.col("weight") * F.coalesce("share", F.lit(0.0))).alias("dot"), F.sum(F.col("weight") * F.col("weight")).alias("l"))
        return sums.select("file", "th", "template", "start", F.round(F.col("dot") / F.sqrt("l"), 6).alias("score")).where(F.col("score") >= least)

    last = F.floor(F.col("pos") / F.col("step"))
    at = F.explode(F.sequence(F.greatest(last - F.col("parts") + 1, F.lit(0).cast("long")), last))
    coarse = stored(scored(spots.withColumn("at", at).withColumn("start", F.col("at") * F.col("step")), COARSE * least))
    best = coarse.groupBy("file", "th", "template").agg(F.max_by("start", F.struct("score", -F.col("start"))).alias("near"))
    fine = F.explode(F.expr("transform(sequence(-8, 8), i -> greatest(0L, near + cast(floor(i * step / 8) as bigint)))"))
    around = spots.join(best, ["file", "th", "template"]).where("pos >= near - step and pos < near + step + length").withColumn("start", fine).where("pos >= start and pos < start + length")
    around = around.dropDuplicates(["file", "th", "template", "start", "pos"])
    names = F.broadcast(spark.createDataFrame([(i, name) for i, (name, _) in enumerate(templates)], "template int, name string"))
    scores = coarse.where(F.col("score") >= least).union(scored(around, least)).join(names, "template").select("file", "name", "score")
    tags = files.select("file", F.regexp_extract("text", TAG, 1).alias("name")).where("name <> ''").select("file", "name", F.lit(1.0).alias("score"))
    return scores.union(tags)


def nearest_match(*parts: DataFrame) -> DataFrame:
    """(file, name, score): the best of all matches of a file; ties go to the smallest name."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b")).select("file", "b.name", (-F.col("b.s")).alias("score"))


def parent(path: Column) -> Column:
    """The directory of a path; the topmost one is the empty string."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def scan_licences(files: DataFrame, least: float = LEAST, id: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """(id, path, declared, score, inherited, licence) of every file.

    declared is what a statement anywhere in the file's own text says, or a whole header, licence text or SPDX
    tag in it, whichever scores best; inherited, for files that declare
    nothing, what the licence file (by its name) of the nearest directory on the way up says, the best score
    counting and ties going to the smallest name; licence is either. A null or empty text declares nothing, a
    null path lies in the topmost directory. Ids need not be distinct: rows are told apart while they are
    joined by id and path, and rows with both equal share their best statement.
    """
    own = F.coalesce(F.col(path).cast("string"), F.lit(""))
    rows = files.select(F.col(id).alias("id"), own.alias("path"), F.col(text).cast("string").alias("text"))
    file = F.struct(F.col("id"), F.col("path"))
    texts = rows.select(file.alias("file"), "text")
    found = nearest_match(matches(texts, least), whole_matches(texts, least))
    found = found.select(F.col("file.id").alias("fid"), F.col("file.path").alias("fpath"), "name", "score")
    listed = rows.select("id", "path").join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("path") == F.col("fpath")), "left")
    listed = listed.select("id", "path", parent(F.col("path")).alias("dir"), F.col("name").alias("declared"), "score")

    notices = found.where(F.col("fpath").rlike(LICENCE_FILE)).groupBy(parent(F.col("fpath")).alias("above"))
    notices = notices.agg(F.min(F.struct((-F.col("score")).alias("s"), "name"))["name"].alias("name"))
    parts = F.split("dir", "/")
    ways = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = listed.select("dir").distinct().select("dir", F.explode(F.array_distinct(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(ways))).alias("above"))
    nearest = dirs.join(notices, "above").groupBy("dir").agg(F.max_by("name", F.length("above")).alias("near"))
    out = listed.join(nearest, "dir", "left")
    inherited = F.when(F.col("declared").isNull(), F.col("near"))
    return out.select(F.col("id").alias(id), F.col("path").alias(path), "declared", "score", inherited.alias("inherited"), F.coalesce("declared", "near").alias("licence"))


def shelved(docs: DataFrame) -> DataFrame:
    """Documents as files (doc_id, path, text) of a tree: source / hundred ids / language / id.

    A document that ends in a licence statement stands for the notice of its hundred.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    shelf = F.concat_ws("/", named("source"), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("_")))
    ends = F.coalesce(F.element_at(F.split(F.rtrim("text"), "\n"), -1).rlike(r"(?i)licen[cs]e"), F.lit(False))
    name = F.when(ends, F.concat(F.lit("/COPYING."), named("doc_id"))).otherwise(F.concat(F.lit("/"), named("lang"), F.lit("/"), named("doc_id")))
    return docs.select("doc_id", F.concat(shelf, name).alias("path"), "text")


def sql() -> str:
    """The scan of documents as DuckDB SQL."""
    table, other = postings()
    rows = ", ".join(f"('{w}', {i}, '{TEMPLATES[i][0]}', {v!r}, {f!r})" for w, i, v, f in table)
    word, licence = WORD, LICENCE_WORD.replace("(?i)", "")
    return f"""
WITH known(word, template, name, share, idf) AS (VALUES {rows}),
idfs AS (SELECT DISTINCT word, idf FROM known),
files AS (SELECT doc_id, text, coalesce(source, '_') || '/' || coalesce(CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR), '_') ||
    CASE WHEN coalesce(regexp_matches(list_extract(string_split(rtrim(text, ' '), chr(10)), -1), '(?i)licen[cs]e'), false) THEN '/COPYING.' || coalesce(CAST(doc_id AS VARCHAR), '_')
         ELSE '/' || coalesce(lang, '_') || '/' || coalesce(CAST(doc_id AS VARCHAR), '_') END AS path FROM documents),
held AS (SELECT doc_id, path, string_split_regex(text, '\\r?\\n') AS lines FROM files WHERE regexp_matches(text, '{licence}', 'i')),
units AS (SELECT doc_id, path, pos, unit FROM (
    SELECT doc_id, path, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS unit FROM held
    UNION ALL SELECT doc_id, path, n + pos, lines[pos] || ' ' || lines[pos + 1] FROM (SELECT doc_id, path, lines, len(lines) AS n, unnest(range(1, len(lines))) AS pos FROM held))
    WHERE regexp_matches(unit, '{licence}', 'i')),
words AS (SELECT doc_id, path, pos, unnest(regexp_extract_all(lower(unit), '{word}')) AS word FROM units),
counted AS (SELECT doc_id, path, pos, word, count(*) * coalesce(any_value(idf), {other!r}) AS weight FROM words LEFT JOIN idfs USING (word) GROUP BY ALL),
lengths AS (SELECT doc_id, path, pos, sqrt(sum(weight * weight)) AS length FROM counted GROUP BY ALL),
cosines AS (SELECT doc_id, path, name, round(sum(weight * share) / any_value(length), 6) AS score
    FROM counted JOIN known USING (word) JOIN lengths USING (doc_id, path, pos) GROUP BY doc_id, path, pos, template, name),
best AS (SELECT doc_id, path, name, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC, name) AS k FROM cosines WHERE score >= {LEAST}) WHERE k = 1),
listed AS (SELECT f.doc_id, f.path, regexp_replace(f.path, '/[^/]*$', '') AS dir, b.name AS declared, b.score FROM files f LEFT JOIN best b ON f.path = b.path AND f.doc_id IS NOT DISTINCT FROM b.doc_id),
notices AS (SELECT above, name FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS above, name, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, name) AS k
    FROM best WHERE regexp_matches(path, '(^|/)(licen[cs]e|copying|notice)[^/]*$', 'i')) WHERE k = 1),
nearest AS (SELECT dir, arg_max(name, length(above)) AS near FROM (SELECT DISTINCT dir FROM listed) d JOIN notices n ON d.dir = n.above OR starts_with(d.dir, n.above || '/') GROUP BY dir)
SELECT doc_id, path, declared, score, CASE WHEN declared IS NULL THEN near END AS inherited, coalesce(declared, near) AS licence FROM listed LEFT JOIN nearest USING (dir)
"""
