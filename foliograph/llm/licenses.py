"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance down the directories.

Built-in functions only. A line, or a block of lines up to an empty one, is a header if its cosine to a template is
high enough, or an SPDX line names it; a whole text is a licence file if its cosine to one of TEXTS is, if one of its
blocks is a licence's title, or if it is named like a licence file and states a licence as a whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, let

# Notices by which texts state a licence, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD-3-Clause": ("Licensed under the 3-Clause BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
}
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_NO_LIABILITY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
# Whole licence texts, for files that hold one.
TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (f"MIT License Copyright (c) {_GRANT} {_AS_IS}",),
    "BSD-2-Clause": (f"BSD 2-Clause License Copyright (c) All rights reserved. {_TWO} {_NO_LIABILITY}",),
    "BSD-3-Clause": (f"BSD 3-Clause License Copyright (c) All rights reserved. {_TWO} {_THIRD} {_NO_LIABILITY}",),
    "ISC": ("ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",),
}
# The titles of the longer licences, as the block that begins their text.
TITLES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International Public License",),
}
#: The least cosine that counts, and that of a title.
THRESHOLD, TITLE_THRESHOLD = 0.75, 0.9
#: Names of files whose notice is the licence of their directory.
NAMED = "(?i)(^|/)(licen[cs]e|copying|copyright|unlicense)([.-][^/]*)?$"
#: An SPDX line; what follows the first identifier of an expression isn't looked at.
SPDX = "SPDX-License-Identifier:[ \\t]*[(]?([A-Za-z0-9.+-]+)"
SPLIT = "[^\\p{L}\\p{N}.+-]+"


def tokens(text: Column) -> Column:
    """Words in lower case, of letters, digits and inner . + -"""
    parts = F.transform(F.split(F.lower(text), SPLIT), lambda w: F.btrim(w, F.lit(".+-")))
    return F.filter(parts, lambda w: w != "")


def tokens_of(text: str) -> list[str]:
    return [w for w in (x.strip(".+-") for x in re.split(r"[^\w.+-]+|_", text.lower())) if w]


def _list(values: list[str]) -> Column:
    return F.split(F.lit("\n".join(values)), "\n")


def vectors(templates: Mapping[str, tuple[str, ...]], idf: Mapping[str, float]) -> list[dict]:
    """For each template the weights of its words, scaled to length 1."""
    out = []
    for name, forms in templates.items():
        for form in forms:
            w = {t: n * idf[t] for t, n in Counter(tokens_of(form)).items()}
            size = math.sqrt(sum(x * x for x in w.values()))
            out.append({"license": name, "weights": {t: x / size for t, x in w.items()}})
    return out


def needed(made: list[dict], idf: Mapping[str, float], threshold: float) -> list[str]:
    """Words of which every match has one at least: the others can't reach the threshold together for any template."""
    free: set[str] = set()
    for t in sorted(idf, key=idf.__getitem__):
        if any(math.sqrt(sum(x * x for w, x in v["weights"].items() if w in free | {t})) >= threshold for v in made):
            break
        free.add(t)
    return sorted(set(idf) - free)


def _column(values: Iterable[object], kind: str) -> Column:
    return F.split(F.lit("\n".join(map(str, values))), "\n").cast(f"array<{kind}>")


def _matches(units: DataFrame, made: list[dict], idf: Mapping[str, float], unseen: float, key: list[str], threshold: float) -> DataFrame:
    """(key, license, score): the best template of every unit with a score of threshold or more; units have key and ws.

    Words that no template has weigh as much as a word seen nowhere. Ties go to the first name.
    """
    one = units.sparkSession.range(1)
    words = units.select(*key, F.explode("ws").alias("w")).groupBy(*key, "w").agg(F.count("*").alias("tf"))
    # both tables have as many rows as the templates have words
    idfs = one.select(F.inline(F.arrays_zip(_column(idf, "string").alias("w"), _column(idf.values(), "double").alias("idf"))))
    flat = [(k, v["license"], t, x) for k, v in enumerate(made) for t, x in v["weights"].items()]
    table = one.select(F.inline(F.arrays_zip(*(_column([row[i] for row in flat], kind).alias(name) for i, (name, kind) in enumerate((("template", "int"), ("license", "string"), ("w", "string"), ("weight", "double")))))))
    weighed = words.join(F.broadcast(idfs), "w", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.where("idf IS NOT NULL").join(F.broadcast(table), "w").groupBy(*key, "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, key).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold)
    return scored.groupBy(*key).agg(F.max(F.struct("score", F.struct((-F.col("template")).alias("first"), "license").alias("t"))).alias("m")).select(*key, F.col("m.t.license").alias("license"), F.col("m.score").alias("score"))


def _blocks(text: Column) -> Column:
    """array<struct<line, text>>: every line, and every run of two or more lines that aren't blank, under its first line's number."""

    def of(lines: Column) -> Column:
        full = lambda i: F.coalesce(F.get(lines, i), F.lit("")).rlike("[\\p{L}\\p{N}]")
        where = F.sequence(F.lit(0), F.size(lines) - 1)
        runs = F.arrays_zip(F.filter(where, lambda i: full(i) & ~full(i - 1)).alias("a"), F.filter(where, lambda i: full(i) & ~full(i + 1)).alias("b"))
        longer = F.transform(F.filter(runs, lambda r: r["b"] > r["a"]), lambda r: F.struct(r["a"].alias("line"), F.array_join(F.slice(lines, r["a"] + 1, r["b"] - r["a"] + 1), " ").alias("text")))
        return F.concat(F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("text"))), longer)

    return let(F.split(text, "\n"), of)


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, texts: Mapping[str, tuple[str, ...]] = TEXTS, titles: Mapping[str, tuple[str, ...]] = TITLES) -> DataFrame:
    """(id_col, path_col, header, header_score, header_line, file, file_score, inherited, inherited_from, license), a row for each row of df.

    header: the licence of the best line or block of lines, the first of equals (header_line, its first line, counts
    from 0); an SPDX line has score 1 and names its first identifier, without -only, -or-later or +. file: that of the
    whole text by texts, of a block that is a licence's title, or, in a file whose name says so (NAMED), of the whole
    text by templates; a notice in any other file speaks for that file alone. A row with a file licence gives it to its directory; the best score names it if there are several, then the least name.
    inherited: what the nearest directory above, the row's own first, has. license: header, else file, else inherited.
    Null and empty texts state nothing; a null path has no directories; a null id is an id like others. Rows alike in
    id, path and text get equal results, columns of df beside these three don't matter, an empty df gives no rows, and
    a text of any length is matched whole. IDF is that of df's rows; a word's is ln((1 + rows) / (1 + rows with it)) + 1.
    """
    text, path, own_id = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{path_col}`"), F.col(f"`{id_col}`")
    whole = {name: (*templates.get(name, ()), *texts.get(name, ())) for name in dict.fromkeys([*templates, *texts])}
    vocabulary = sorted({t for group in (whole, titles) for forms in group.values() for form in forms for t in tokens_of(form)})
    # names a row by what it holds, nulls included, and is itself never null
    name = lambda seed: F.xxhash64(F.lit(seed), own_id.isNull(), own_id, path.isNull(), path, text)
    docs = df.select(name(1).alias("h1"), name(2).alias("h2"), own_id.alias("id"), path.alias("path"), text.alias("text"))
    key = ["h1", "h2"]
    held = docs.select(F.array_intersect(tokens(F.col("text")), _list(vocabulary)).alias("f"))
    rows = held.select(F.explode(F.concat("f", F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()  # a row for each word of the templates
    seen = {r["w"]: r["count"] for r in rows}
    n = seen.pop("", 0)
    idf = {t: math.log((1 + n) / (1 + seen.get(t, 0))) + 1 for t in vocabulary}
    made, made_texts, made_titles = (vectors(x, idf) for x in (templates, texts, titles))
    must = _list(sorted({*needed(vectors(whole, idf), idf, threshold), *needed(made_titles, idf, TITLE_THRESHOLD)}))
    unseen = math.log(1 + n) + 1

    tagged = F.col("text").contains("SPDX-License-Identifier:")
    hopeful = cut(docs.where(tagged | F.arrays_overlap(tokens(F.col("text")), must)).dropDuplicates(key).select(*key, "text", F.coalesce(F.col("path").rlike(NAMED), F.lit(False)).alias("named")))
    blocks = hopeful.select(*key, F.explode(_blocks(F.col("text"))).alias("b")).select(*key, "b.line", F.octet_length("b.text").alias("size"), tokens(F.col("b.text")).alias("ws")).where(F.arrays_overlap("ws", must))
    by_block = _matches(blocks, made, idf, unseen, [*key, "line", "size"], threshold)
    spdx = hopeful.where(tagged).select(*key, F.posexplode(F.split("text", "\n")).alias("line", "x")).withColumn("said", F.regexp_extract("x", SPDX, 1)).where("said <> ''")
    spdx = spdx.select(*key, "line", F.octet_length("x").alias("size"), F.regexp_replace("said", "(?i)(-only|-or-later|[+])$", "").alias("license"), F.lit(1.0).alias("score"))
    by_block = by_block.join(spdx.select(*key, "line"), [*key, "line"], "left_anti").unionByName(spdx)
    header = by_block.groupBy(*key).agg(F.max(F.struct("score", (-F.col("line")).alias("first"), "license")).alias("m")).select(*key, F.col("m.license").alias("header"), F.col("m.score").alias("header_score"), (-F.col("m.first")).alias("header_line"))
    titled = _matches(blocks, made_titles, idf, unseen, [*key, "line", "size"], TITLE_THRESHOLD).select(*key, "license", "score")
    wholes = hopeful.select(*key, "named", tokens(F.col("text")).alias("ws"))
    matched = _matches(wholes, made_texts, idf, unseen, key, threshold).union(_matches(wholes.where("named"), made, idf, unseen, key, threshold))
    files = matched.union(titled).groupBy(*key).agg(F.max("score").alias("file_score"), F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("file"))
    own = cut(docs.select(*key, "id", "path").join(header, key, "left").join(files, key, "left"))

    def above(p: Column) -> Column:
        """The directories of a path, the root "" first; none for null."""
        parts = F.split(p, "/")
        return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))

    folder = F.element_at(above(F.col("path")), -1)
    stated = own.where("file IS NOT NULL AND path IS NOT NULL").groupBy(folder.alias("dir"), "file").agg(F.max("file_score").alias("s"))
    best = stated.groupBy("dir").agg(F.max("s").alias("s"))
    least = stated.join(best, ["dir", "s"]).groupBy("dir").agg(F.min("file").alias("given"))
    folders = own.where("path IS NOT NULL").select(folder.alias("at")).distinct()
    steps = folders.select("at", F.posexplode(above(F.concat("at", F.lit("/")))).alias("depth", "dir"))
    nearest = steps.join(least, "dir").groupBy("at").agg(F.max(F.struct("depth", "dir", "given")).alias("m")).select("at", F.col("m.given").alias("inherited"), F.col("m.dir").alias("inherited_from"))
    out = own.withColumn("at", folder).join(nearest, "at", "left")
    return out.select(F.col("id").alias(id_col), F.col("path").alias(path_col), "header", "header_score", F.col("header_line").cast("long").alias("header_line"), "file", "file_score", "inherited", "inherited_from", F.coalesce("header", "file", "inherited").alias("license"))

