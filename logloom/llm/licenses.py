"""Licences of files: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by folder.

A file is scored in units, and its best unit counts:

1. Every line with a licence word, against the one-line ``TEMPLATES``. Term weights come from all such lines of the
   corpus: a term in n of N lines weighs its count times ln((1 + N) / (1 + n)) + 1.
2. The same lines, every paragraph with a word of ``MARK``, the leading comment block with one, and the whole of a
   licence file, against full texts, standard headers and short statements (``known_forms``). Here a term that occurs
   c times weighs 1 + ln(c) times its inverse frequency among the forms, so common words of a long text weigh little
   and scores do not depend on the corpus. All words of a unit count, on whatever line they stand.
3. Identifiers behind SPDX-License-Identifier are looked up; a known one scores 1.

A unit's licence is the one with the largest cosine, from ``LEAST_COSINE`` on. A file without one inherits from
the licence file (LICENSE, COPYING, NOTICE, ...) in its nearest ancestor folder, by a join of folder prefixes.

Only DataFrame operations. Units are made distinct before they are scored, so a line in a third of all files is
scored once; inheritance is settled per folder, not per file; the terms of the templates and forms, fixed tables, are
the only broadcasts.

The SQL answer covers part 1 only; it agrees where all licences are stated in such lines, as in the test tables.

Edge cases: a NULL text has no header; a NULL path stands in the root folder; of equal cosines the alphabetically
first licence wins, of several licence files in one folder the best match, then the first path; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Scratch

LEAST_COSINE = 0.6
FOLDER_DOCS = 256
# Licence statements.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
HEADER = "licen[cs]e|copyright|spdx|redistribution"
TERM = "[a-z]+|[0-9]+([.][0-9]+)*"
LICENCE_FILE = "^(LICEN[CS]E|COPYING|NOTICE)"
# Words of which a paragraph or comment block that grants a licence has at least one.
MARK = HEADER + "|permission|permitted|warrant|liabilit|public domain|creative commons|creativecommons|free software|mozilla public|[^a-z][al]?gpl"
SPDX = "spdx-license-identifier:([^\n]*)"
# A blank line may hold comment marks.
BLANK = r"\n[^\p{L}\p{N}]*\n"
COMMENT = r"^\s*(#|//|/[*]|[*]|--|;|%|<!--|!|\.\.|@?rem |dnl |$)"
TEXTS = Path(__file__).parent / "licence_texts"
_GPL = "the terms of the GNU {} as published by the Free Software Foundation, {}"
_GPL_HEADER = (
    "This program is free software{}you can redistribute it and/or modify it under " + _GPL + ". This program is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
)
_KEPT_NOTICE = " You should have received a copy of the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>."
_GNU = {
    "GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "LGPL-2.1": ("Lesser General Public License", "2.1"),
    "LGPL-3.0": ("Lesser General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3"),
}
_CC = {
    "CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-ND-4.0": "Attribution-NoDerivatives",
    "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike", "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives",
}
_SHORT = {
    "MIT": ["MIT License", "The MIT License (MIT)", "Licensed under the MIT license.", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."],
    "Apache-2.0": [
        "Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "Licensed under the Apache License 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "Licensed under the BSD 3-Clause License."],
    "ISC": ["ISC License", "The ISC License", "Licensed under the ISC license."],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0", "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "Released under CC0 1.0.", "http://creativecommons.org/publicdomain/zero/1.0/"],
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _terms(line: Column) -> Column:
    return F.regexp_extract_all(_lower(line), F.lit(TERM), 0)


def _weighted(units: DataFrame, key: str, idf: DataFrame, unseen: float) -> DataFrame:
    """(key, term, weight) with unit length per key."""
    counts = units.select(key, F.explode(_terms(F.col("line"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    weights = counts.join(idf, "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weights.join(norms, key).select(key, "term", (F.col("weight") / F.col("norm")).alias("weight"))


def header_licences(headers: DataFrame) -> DataFrame:
    """(line, license, score) of the distinct header lines (line, n occurrences) that match a template."""
    total = headers.agg(F.sum("n")).first()[0] or 0
    seen = headers.select("n", F.explode(F.array_distinct(_terms(F.col("line")))).alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    idf = seen.select("term", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf"))
    unseen = math.log(1 + total) + 1
    templates = headers.sparkSession.createDataFrame(list(TEMPLATES.items()), "license string, line string")
    known = _weighted(templates, "license", idf, unseen).withColumnRenamed("weight", "known")
    pairs = _weighted(headers, "line", idf, unseen).join(F.broadcast(known), "term")  # some dozens of rows
    cosine = pairs.groupBy("line", "license").agg(F.round(F.sum(F.col("weight") * F.col("known")), 6).alias("score"))
    best = cosine.filter(F.col("score") >= LEAST_COSINE).groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"))
    return best.select("line", "best.license", (-F.col("best.minus")).alias("score"))


@cache
def known_forms() -> list[tuple[str, str]]:
    """(licence, wording): the one-line templates, full texts, standard headers and short statements.

    The AGPL is the GPL's text under its own name, and the CC variants without a text here are that of CC BY-SA under
    theirs: what differs otherwise is a few hundredths of the text.
    """
    texts = {f.stem: f.read_text() for f in sorted(TEXTS.glob("*.txt"))}
    texts["AGPL-3.0"] = texts["GPL-3.0"].replace("GNU Affero General", "GNU General").replace("GENERAL PUBLIC", "AFFERO GENERAL PUBLIC").replace("GNU General", "GNU Affero General")
    for name, title in _CC.items():
        if name not in texts:
            body = texts["CC-BY-SA-4.0"].replace("Attribution-ShareAlike", title)
            texts[name] = body if "ShareAlike" in title else re.sub("ShareAlike|Share Alike", "", body)
    forms = [*TEMPLATES.items(), *texts.items(), *((k, w) for k, words in _SHORT.items() for w in words)]
    for name, (title, version) in _GNU.items():
        later = f"either version {version} of the License, or (at your option) any later version"
        only = f"version {version}"
        for when, sign in ((later, ": "), (only, "; ")):
            forms.append((name, _GPL_HEADER.format(sign, title, when, title)))
            forms.append((name, _GPL_HEADER.format(sign, title, when, title) + _KEPT_NOTICE.format(title)))
            forms.append((name, "under " + _GPL.format(title, when)))
        forms += [(name, f"GNU {title} Version {version}"), (name, f"This work is licensed under the GNU {title}, version {version}."), (name, f"Licensed under the {name.split('-')[0]} v{version}.")]
    for name, title in _CC.items():
        short = name.removesuffix("-4.0").replace("CC-", "CC ")
        forms += [
            (name, f"This work is licensed under a Creative Commons {title} 4.0 International License."), (name, f"Creative Commons {title} 4.0 International Public License"),
            (name, f"Licensed under {short} 4.0."), (name, f"https://creativecommons.org/licenses/{short[3:].lower()}/4.0/"),
        ]
    return forms


def spdx_ids() -> list[tuple[str, str]]:
    """(identifier in lower case, licence)."""
    names = {name for name, _ in known_forms()}
    ends = {name: ("-only", "-or-later", "+") if name in _GNU else () for name in names}
    return sorted((f"{name}{end}".lower(), name) for name in names for end in ("", *ends[name]))


@cache
def form_terms() -> tuple[list[tuple[int, str, str, float]], list[tuple[str, float]], float]:
    """(form, licence, term, weight) with unit length per form, (term, idf), and the idf of other terms."""
    counts = [(name, Counter(m.group() for m in re.finditer(TERM, text.translate(str.maketrans(_UPPER, _LOWER))))) for name, text in known_forms()]
    held = Counter(t for _, c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in held.items()}
    rows = []
    for number, (name, c) in enumerate(counts):
        weights = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        rows += [(number, name, t, w / norm) for t, w in weights.items()]
    return rows, sorted(idf.items()), math.log(1 + len(counts)) + 1


def form_licences(units: DataFrame) -> DataFrame:
    """(unit, license, score) of the distinct units (unit, line) that match a known form."""
    spark, (rows, idf, unseen) = units.sparkSession, form_terms()
    known = spark.createDataFrame(rows, "form int, license string, term string, known double")
    weight_of = spark.createDataFrame(idf, "term string, idf double")
    counts = units.select("unit", F.explode(_terms(F.col("line"))).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    weights = counts.join(F.broadcast(weight_of), "term", "left").withColumn("weight", (1 + F.log("tf")) * F.coalesce("idf", F.lit(unseen)))
    norms = weights.groupBy("unit").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
        F.sqrt(F.sum(F.when(F.col("idf").isNotNull(), F.col("weight") * F.col("weight")).otherwise(0.0))).alias("shared"),
    )
    # No cosine exceeds the part of the unit's length that lies on terms of the forms.
    near = norms.filter(F.col("shared") >= (LEAST_COSINE - 1e-6) * F.col("norm")).select("unit", "norm")
    pairs = weights.filter("idf IS NOT NULL").join(near, "unit").join(F.broadcast(known), "term")
    cosine = pairs.groupBy("unit", "license", "form").agg(F.round(F.sum(F.col("weight") * F.col("known") / F.col("norm")), 6).alias("score"))
    best = cosine.filter(F.col("score") >= LEAST_COSINE).groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"))
    return best.select("unit", "best.license", (-F.col("best.minus")).alias("score"))


def _leading_block(text: Column) -> Column:
    """The comment that a text opens with; nothing if it opens otherwise."""
    lines = F.split(text, "\n")
    stop = F.array_position(F.transform(lines, lambda line: _lower(line).rlike(COMMENT)), False).cast("int")
    run = F.when(stop == 0, text).otherwise(F.array_join(F.slice(lines, 1, F.greatest(stop - 1, F.lit(0))), "\n"))
    opening = F.ltrim(text)
    return (
        F.when(opening.startswith("/*"), F.substring_index(text, "*/", 1)).when(opening.startswith("<!--"), F.substring_index(text, "-->", 1))
        .when(opening.startswith('"""'), F.substring_index(text, '"""', 2)).when(opening.startswith("'''"), F.substring_index(text, "'''", 2)).otherwise(run)
    )


def _units(text: Column, whole: Column) -> Column:
    """Paragraphs and the leading block with a word of ``MARK``, and the text of a licence file."""
    marked = F.filter(F.concat(F.split(text, BLANK), F.array(_leading_block(text))), lambda u: _lower(u).rlike(MARK))
    return F.array_distinct(F.concat(F.when(_lower(text).rlike(MARK), marked).otherwise(F.array().cast("array<string>")), F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))))


def license_scan(files: DataFrame) -> DataFrame:
    """Files (doc_id, path, text) to doc_id, path, license, origin, score, licence_path.

    ``origin`` is own, inherited or none; ``licence_path`` the file inherited from.
    """
    scratch = Scratch(files.sparkSession, "licenses")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = files.select(
        F.col("doc_id").cast("bigint"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), text.alias("text"),
        F.xxhash64(text).alias("text_key"),
    )
    marked = keyed.filter(_lower(F.col("text")).rlike(HEADER))
    lines = marked.select("path", "text_key", F.explode(F.split("text", "\n")).alias("line")).filter(_lower(F.col("line")).rlike(HEADER))
    lines = scratch.save(lines, "lines")
    matched = header_licences(lines.groupBy("line").agg(F.count("*").alias("n")))
    named = F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_FILE)
    parts = keyed.select("path", "text_key", F.explode(_units(F.col("text"), named)).alias("line"))
    parts = parts.union(lines.select("path", "text_key", "line")).withColumn("unit", F.md5("line"))
    parts = scratch.save(parts, "units")
    formed = parts.join(form_licences(parts.select("unit", "line").dropDuplicates(["unit"])), "unit").select("path", "text_key", "license", "score")
    ids = parts.select("path", "text_key", F.explode(F.regexp_extract_all(_lower(F.col("line")), F.lit(SPDX), 1)).alias("ids"))
    ids = ids.select("path", "text_key", F.explode(F.regexp_extract_all("ids", F.lit("[a-z0-9.+-]+"), 0)).alias("id"))
    spdx = ids.join(F.broadcast(files.sparkSession.createDataFrame(spdx_ids(), "id string, license string")), "id")
    found = lines.join(matched, "line").select("path", "text_key", "license", "score").union(formed)
    own = found.union(spdx.select("path", "text_key", "license", F.lit(1.0))).groupBy("path", "text_key").agg(
        F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best")
    )
    own = scratch.save(own.select("path", "text_key", "best.license", (-F.col("best.minus")).alias("score")), "own")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    granted = own.filter(named).withColumn("folder", folder)
    granted = granted.groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("minus"), "path", "license")).alias("given"))
    all_files = keyed.select("doc_id", "path", "text_key").withColumn("folder", folder)
    folders = all_files.select("folder").distinct()
    parts = F.split("folder", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = folders.select(F.col("folder").alias("at"), F.posexplode(prefixes).alias("depth", "folder"))
    inherited = above.join(granted, "folder").groupBy("at").agg(F.max(F.struct("depth", "given")).alias("near"))
    inherited = inherited.select(F.col("at").alias("folder"), F.col("near.given.license").alias("from_license"), F.col("near.given.path").alias("from_path"))
    out = all_files.join(own, ["path", "text_key"], "left").join(inherited, "folder", "left")
    has, heir = F.col("license").isNotNull(), F.col("from_license").isNotNull()
    result = out.select(
        "doc_id", "path", F.coalesce("license", "from_license").alias("license"),
        F.when(has, "own").when(heir, "inherited").otherwise("none").alias("origin"),
        "score", F.when(~has, F.col("from_path")).alias("licence_path"),
    )
    return scratch.save(result, "scanned")


def as_files(docs: DataFrame, folder_docs: int = FOLDER_DOCS) -> DataFrame:
    """Lay documents out as files (doc_id, path, text): source/language/number range, as the table has no paths.

    A document that opens with a header stands for the licence file of its folder.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    opens = _lower(F.substring_index(text, "\n", 1)).rlike(HEADER)
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    folder = F.concat_ws(
        "/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")),
        F.coalesce(F.floor(F.col("doc_id") / folder_docs).cast("string"), F.lit("none")),
    )
    name = F.when(opens, F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number, F.lit(".txt")))
    return docs.select(F.col("doc_id").cast("bigint"), F.concat_ws("/", folder, name).alias("path"), F.col("text").cast("string"))


_LOW = "translate({}, '" + _UPPER + "', '" + _LOWER + "')"
SQL = f"""
with files as (
  select doc_id, coalesce(text, '') as text,
    concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), coalesce(cast(cast(floor(doc_id / {FOLDER_DOCS}.0) as bigint) as varchar), 'none')) as folder,
    case when regexp_matches({_LOW.format("split_part(coalesce(text, ''), chr(10), 1)")}, '{HEADER}')
      then 'LICENSE-' || coalesce(cast(doc_id as varchar), 'none') else coalesce(cast(doc_id as varchar), 'none') || '.txt' end as name
  from documents
), paths as (select *, folder || '/' || name as path from files),
lines as (
  select path, text, line from (select path, text, unnest(string_split(text, chr(10))) as line from paths)
  where regexp_matches({_LOW.format("line")}, '{HEADER}')
), headers as (select line, count(*) as n from lines group by line),
total as (select coalesce(sum(n), 0) as total from headers),
idf as (
  select term, ln((1 + any_value(total)) / (1 + sum(n))) + 1 as idf
  from (select n, unnest(list_distinct(regexp_extract_all({_LOW.format("line")}, '{TERM}'))) as term from headers), total group by term
), templates(license, line) as (values {", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())}),
units as (select line as key, 'h' as kind, line from headers union all select license, 't', line from templates),
counts as (
  select key, kind, term, count(*) as tf
  from (select key, kind, unnest(regexp_extract_all({_LOW.format("line")}, '{TERM}')) as term from units) group by key, kind, term
), weights as (
  select key, kind, term, tf * coalesce(idf, ln(1 + total) + 1) as weight from counts left join idf using (term), total
), norms as (select key, kind, sqrt(sum(weight * weight)) as norm from weights group by key, kind),
scaled as (select key, kind, term, weight / norm as weight from weights join norms using (key, kind)),
cosines as (
  select h.key as line, t.key as license, round(sum(h.weight * t.weight), 6) as score
  from scaled h join scaled t on h.term = t.term and h.kind = 'h' and t.kind = 't' group by h.key, t.key
), matched as (
  select line, license, score from cosines where score >= {LEAST_COSINE}
  qualify row_number() over (partition by line order by score desc, license) = 1
), own as (
  select path, text, license, score from lines join matched using (line)
  qualify row_number() over (partition by path, text order by score desc, license) = 1
), granted as (
  select folder, license, path from (select distinct o.*, p.folder, p.name from own o join paths p on o.path = p.path and o.text = p.text)
  where regexp_matches(name, '{LICENCE_FILE}')
  qualify row_number() over (partition by folder order by score desc, path, license) = 1
), inherited as (
  select f.folder, g.license, g.path from (select distinct folder from paths) f
  join granted g on f.folder = g.folder or starts_with(f.folder, g.folder || '/')
  qualify row_number() over (partition by f.folder order by length(g.folder) desc) = 1
)
select p.doc_id, p.path, coalesce(o.license, i.license) as license,
  case when o.license is not null then 'own' when i.license is not null then 'inherited' else 'none' end as origin,
  o.score, case when o.license is null then i.path end as licence_path
from paths p left join own o on p.path = o.path and p.text = o.text left join inherited i on p.folder = i.folder
"""
