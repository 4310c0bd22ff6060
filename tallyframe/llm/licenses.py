"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

A file's candidates are its header (the lines before its first blank one), its lines that name a license, each alone, with the line after it and with three lines after it (notices are wrapped), their
sentences, and, of a licence file, the whole text, so that it meets the licences' full texts. A header counts if it names a license. Every candidate and every template is a sparse vector of TF-IDF weights: term counts times log((1 + templates) / (1 + templates with the term)) + 1. Candidates meet templates in a join on terms; dot products
are sums over the shared terms. A candidate's licence is that of the template with the largest cosine, if it reaches ``least``; a file's licence is
that of its best candidate (ties: the licence's name). An SPDX tag names its licence itself, so its expression is taken from the line, whatever the
identifier, with cosine 1 (-only is left out, + is -or-later); a cosine would give an unknown identifier to its neighbour.

A licence file (LICENSE, LICENCE, COPYING or NOTICE, any ending, or any file whose whole text is a licence's: cosine ``WHOLE`` or more) speaks for its directory. A file without a licence of its own inherits from the
nearest ancestor directory that has one: each file emits its ancestor directories, these are joined with the licensed directories, and the longest wins.

Everything is DataFrame functions; the table of template terms is a constant, a licence file's directory meets only paths below it in an equi-join.
Nulls: a null text has no candidates; a null path has no directory and inherits nothing. Repeated rows (paths) each get a row; equal cosines go to the licence's
name. Texts of any length are read whole. Other columns are kept whatever their names, but for the five that are added. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_text, cut

LEAST = 0.5
#: A file that is a licence's text from end to end is a licence file under any name.
WHOLE = 0.9
#: Usual notices of the licences, long and short.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    *((f"{short}-{v}.0-or-later", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {long}General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.") for short, long, v in (("GPL", "", 2), ("GPL", "", 3), ("LGPL", "Lesser ", 3), ("AGPL", "Affero ", 3))),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Released under the ISC License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Use of this source code is governed by the Simplified BSD License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
)
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_BSD_NAMES = '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Full texts of the short licences, without their copyright lines.
TEMPLATES += (
    ("MIT", 'MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY),
    ("BSD-2-Clause", f"BSD 2-Clause License. {_BSD} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"BSD 3-Clause License. {_BSD} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("ISC", 'ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "zlib License. This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
_NAMED = r"(?i)licen[cs]e|copyright|spdx|public domain|permission is hereby granted|redistribut|free software|creative commons|unencumbered|permission to use|provided as.is|accompanying materials"
_SPDX_ID = r"[(]*[A-Za-z0-9][A-Za-z0-9.+:-]*[)]*"
_SPDX = rf"(?i)spdx-licen[cs]e-identifier:\s*({_SPDX_ID}(?:\s+(?:with|or|and)\s+{_SPDX_ID})*)"
_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
_SPLIT = r"[^a-z0-9.]+|\.(?![0-9])"


def _terms(text: str) -> list[str]:
    return [x for x in re.split(_SPLIT, text.lower()) if x]


def _template_terms() -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """Rows (template, licence, term, weight of unit length), the terms' IDFs, and the IDF of a term in no template."""
    counts = [Counter(_terms(t)) for _, t in TEMPLATES]
    found = Counter(x for c in counts for x in c)
    idf = {x: log((1 + len(counts)) / (1 + n)) + 1 for x, n in found.items()}
    rows = []
    for k, ((name, _), c) in enumerate(zip(TEMPLATES, counts)):
        size = sqrt(sum((n * idf[x]) ** 2 for x, n in c.items()))
        rows += [(k, name, x, n * idf[x] / size) for x, n in sorted(c.items())]
    return rows, idf, log(1 + len(counts)) + 1


def _tagged(lines: DataFrame) -> DataFrame:
    """(key, licence, cosine 1) of the SPDX tags in ``lines`` (key, lines)."""
    tag = lines.select("key", F.explode("lines").alias("line")).select("key", F.regexp_extract("line", _SPDX, 1).alias("licence")).where("licence <> ''")
    plain = F.regexp_replace(F.regexp_replace("licence", r"(?i)-only\b", ""), r"\+(?=[\s)]|$)", "-or-later")
    return tag.where("lower(licence) not in ('none', 'noassertion')").select("key", plain.alias("licence"), F.lit(1.0).alias("cosine"))


#: Directories with a licence to inherit that are broadcast; beyond, each directory's files are dealt in so many shares.
BROADCAST_ROWS, SHARES = 500_000, 32
#: Where a candidate comes from; those of lines have three or more.
WHOLE_TEXT, HEADER, LINES = 0, 1, 3


def header_licences(files: DataFrame, least: float = LEAST) -> DataFrame:
    """``files`` (path, text, key) to (key, licence, cosine, whole) of each key with a candidate that reaches ``least``.

    ``whole``: the cosine of the text from end to end, if it was a candidate.
    """
    spark = files.sparkSession
    rows, idf, rare = _template_terms()
    templates = spark.createDataFrame(rows, "template int, licence string, term string, weight double")
    known = spark.createDataFrame(list(idf.items()), "term string, idf double")
    naming = cut(files.where(F.col("text").rlike(_NAMED)).select("key", "path", "text"), "naming")  # few texts, of which several kinds of candidates are taken
    lines = naming.select("key", F.split("text", "\n").alias("lines"))
    places = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(_NAMED))
    heads = lines.select("key", F.posexplode(F.transform(places, lambda i: F.array(F.get("lines", i), *[F.array_join(F.slice("lines", i + 1, n), " ") for n in (2, 4)]))).alias("place", "both"))
    heads = heads.select("key", "place", F.posexplode("both").alias("lines", "head"))
    # A notice within a line of prose: the sentences that name a license are candidates, too.
    sentence = F.posexplode(F.filter(F.split("head", r"(?<=[.!?])\s+(?=\p{Lu})"), lambda s: s.rlike(_NAMED)))
    inner = heads.where("lines = 0").select("key", "place", sentence.alias("lines", "head")).withColumn("lines", F.col("lines") + 3)
    heads = heads.unionByName(inner).withColumn("lines", F.col("lines") + LINES)
    # The header, and the whole text of a licence file or of a text that is its own header.
    top = F.split(F.regexp_replace("text", r"^\s+", ""), r"\n[^\S\n]*\n", 2)[0]
    short = F.length("text") <= 2 * max(len(t) for _, t in TEMPLATES)
    header = naming.select("key", top.alias("head"), "text", (F.coalesce(F.col("path").rlike(_FILE), F.lit(False)) | short).alias("file"))
    whole = header.where("file").select("key", F.lit(-1).alias("place"), F.lit(WHOLE_TEXT).alias("lines"), F.col("text").alias("head"))
    header = header.where(F.col("head").rlike(_NAMED)).select("key", F.lit(-1).alias("place"), F.lit(HEADER).alias("lines"), "head")
    heads = heads.unionByName(whole).unionByName(header)
    terms = heads.select("key", "place", "lines", F.explode(F.filter(F.split(F.lower("head"), _SPLIT), lambda x: x != "")).alias("term"))
    counted = terms.groupBy("key", "place", "lines", "term").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(known), "term", "left")
    counted = counted.withColumn("own", F.col("n") * F.coalesce("idf", F.lit(rare)))
    sizes = counted.groupBy("key", "place", "lines").agg(F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("size"))
    dots = counted.where("idf is not null").join(F.broadcast(templates), "term").groupBy("key", "place", "lines", "template", "licence").agg(F.sum(F.col("own") * F.col("weight")).alias("dot"))
    scored = dots.join(sizes, ["key", "place", "lines"]).select("key", "lines", "licence", F.round(F.col("dot") / F.col("size"), 6).alias("cosine")).where(F.col("cosine") >= least)
    scored = scored.unionByName(_tagged(lines).withColumn("lines", F.lit(LINES)))
    whole = F.max(F.when(F.col("lines") == WHOLE_TEXT, F.col("cosine"))).alias("whole")
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("order"), "licence")).alias("b"), whole)
    return best.select("key", "b.licence", (-F.col("b.order")).alias("cosine"), "whole")


def _folders(path: Column) -> Column:
    """All ancestor directories of a path, the nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licences(files: DataFrame, least: float = LEAST) -> DataFrame:
    """path, own_licence, cosine, inherited_licence, inherited_from and licence of every row of ``files`` (path, text, and key columns kept)."""
    made = ("own_licence", "cosine", "inherited_licence", "inherited_from", "licence")
    kept = [c for c in files.columns if c != "text" and c not in made]
    packed = F.struct(*[F.col(c) for c in kept]).alias("_row")  # whatever the other columns are called
    keyed = files.select(packed, "path", blank_text().alias("text"), F.xxhash64(F.coalesce("path", F.lit("")), blank_text()).alias("key"))
    own = header_licences(keyed, least)
    small = cut(keyed.drop("text"), "files").join(own.select("key", F.col("licence").alias("own_licence"), "cosine", "whole"), "key", "left")
    speaks = small.where((F.col("path").rlike(_FILE) | (F.col("whole") >= WHOLE)) & F.col("own_licence").isNotNull())
    folders = cut(speaks.groupBy(_folders(F.col("path"))[0].alias("folder")).agg(F.min("own_licence").alias("folder_licence")), "folders")
    # Files of one directory inherit alike, so directories meet the licensed ones, and a directory of many files is one row. What all directories have in
    # common, the root, would be one key of the join: its licence is a single value.
    here = F.when(F.col("path").isNotNull(), _folders(F.col("path"))[0]).alias("here")
    lone = small.where("own_licence is null and path is not null").select(here).distinct()
    up = F.posexplode(F.filter(F.concat(F.array("here"), _folders(F.col("here"))), lambda f: f != "")).alias("up", "folder")
    near = lone.select("here", up).join(folders.where("folder <> ''"), "folder")
    nearest = near.groupBy("here").agg(F.min(F.struct("up", "folder", "folder_licence")).alias("f"))
    root = folders.where("folder = ''").agg(F.max("folder_licence")).first()[0]
    nearest = lone.join(nearest, "here", "left").select(
        "here", F.coalesce("f.folder", F.lit(None if root is None else "")).alias("inherited_from"), F.coalesce("f.folder_licence", F.lit(root)).cast("string").alias("inherited_licence")
    )
    # A directory of a third of all files is a join with one row: a broadcast where that is proven small, else shares of each directory.
    nearest = cut(nearest.where("inherited_licence is not null"), "directories")
    placed = small.withColumn("here", here)
    if nearest.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = placed.join(F.broadcast(nearest), "here", "left")
    else:
        dealt = nearest.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        joined = placed.withColumn("share", F.pmod(F.xxhash64("key", "_row"), F.lit(SHARES)).cast("int")).join(dealt, ["here", "share"], "left")
    inherits = F.col("own_licence").isNull()
    return joined.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in kept],
        "own_licence",
        "cosine",
        F.when(inherits, F.col("inherited_licence")).alias("inherited_licence"),
        F.when(inherits, F.col("inherited_from")).alias("inherited_from"),
        F.coalesce("own_licence", "inherited_licence").alias("licence"),
    )
