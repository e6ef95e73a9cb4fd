"""License scans: TF-IDF cosine of the passages of files to templates, then inheritance from the nearest ancestor directory.

Only DataFrame operations. A passage is a window of as many words as the template has, from each word of the whole text
that is one of the template's, and across its lines (up to the end where the text is shorter). So notices within a
sentence, headers wrapped over commented lines and licence texts are each one vector. Document frequencies are counted
over all files, and every word has its own. A short notice counts only with its licence's name in the window.

The scan is a sparse join. Postings (word, file) meet postings (word, template): a file stays for a template only if it
has one of the template's rarest words, without which no window can reach the threshold, and if the words they share
can. Where the template's words stand in such a file, running sums give the product of every window with the template
and a lower bound of its length; only windows whose bound reaches the threshold, and the best score found in the file
for its most promising window of each template, are scored in full.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.session import cut_lineage

_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU_COPY = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU_HEADER = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program."


def _gnu(name: str, short: str, version: str, dated: str, title: str) -> list[str]:
    """Notices, the header of files, and the opening of the licence file of a GNU licence."""
    return [
        f"Licensed under the {name}, version {version}.", f"This work is licensed under the {name}, version {version}.", f"Released under the terms of the {name} version {version} or later.",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name}, version {version}.", f"Licensed under the {short} version {version}.", f"Licensed under {short}v{version.removesuffix('.0')}.",
        f"SPDX-License-Identifier: {short}-{dated}", f"This program {_GNU_HEADER.format(name.removeprefix('GNU '), version)}", title,
    ]


def _creative(name: str, short: str) -> list[str]:
    return [f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"Creative Commons {name} 4.0 International Public License", f"SPDX-License-Identifier: CC-{short}-4.0"]


#: Notices, headers and texts by which files and licence files name their licence. Of licences of many
#: pages the opening of the licence file stands for it, which is a passage of that file.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 License.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    ],
    "GPL-2.0": _gnu("GNU General Public License", "GPL", "2", "2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_GNU_COPY}"),
    "GPL-3.0": _gnu("GNU General Public License", "GPL", "3", "3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_GNU_COPY} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "LGPL", "2.1", "2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_GNU_COPY}"),
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        *_gnu("GNU Lesser General Public License", "LGPL", "3", "3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_GNU_COPY} This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ],
    "AGPL-3.0": _gnu("GNU Affero General Public License", "AGPL", "3", "3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_GNU_COPY} Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    ],
    "BSD-2-Clause": ["Licensed under the 2-clause BSD License.", "SPDX-License-Identifier: BSD-2-Clause", f"{_BSD_2} {_AS_IS}"],
    "BSD-3-Clause": ["Licensed under the 3-clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_AS_IS}"],
    "CC-BY-4.0": _creative("Attribution", "BY"),
    "CC-BY-SA-4.0": _creative("Attribution-ShareAlike", "BY-SA"),
    "CC-BY-NC-4.0": _creative("Attribution-NonCommercial", "BY-NC"),
    "CC-BY-ND-4.0": _creative("Attribution-NoDerivatives", "BY-ND"),
    "CC-BY-NC-SA-4.0": _creative("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    "CC-BY-NC-ND-4.0": _creative("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication"],
}
#: The words of which a short notice's window must have one of each group.
NAMES = {
    "MIT": ["mit"], "ISC": ["isc"], "Apache-2.0": ["apache", "2.0"], "GPL-2.0": ["gnu gpl gplv2", "2 2.0 gplv2"], "GPL-3.0": ["gnu gpl gplv3", "3 3.0 gplv3"],
    "LGPL-2.1": ["lesser lgpl lgplv2.1", "2.1 lgplv2.1"], "LGPL-3.0": ["lesser lgpl lgplv3", "3 3.0 lgplv3"], "AGPL-3.0": ["affero agpl agplv3", "3 3.0 agplv3"], "MPL-2.0": ["mozilla mpl", "2.0"],
    "BSD-2-Clause": ["bsd", "2"], "BSD-3-Clause": ["bsd", "3"], "CC0-1.0": ["cc0"], "CC-BY-4.0": ["by attribution", "4.0"], "CC-BY-SA-4.0": ["sa sharealike", "4.0"], "CC-BY-NC-4.0": ["nc noncommercial", "4.0"],
    "CC-BY-ND-4.0": ["nd noderivatives", "4.0"], "CC-BY-NC-SA-4.0": ["nc noncommercial", "sa sharealike", "4.0"], "CC-BY-NC-ND-4.0": ["nc noncommercial", "nd noderivatives", "4.0"],
}
#: Templates of fewer words are notices; words of every text, which weigh least whatever the files' language.
NOTICE_WORDS = 30
WORD_BLOCK = 64
COMMON = frozenset("a an and any are as at be by for from in is it its of on or that the this to under with".split())
_TOKEN = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:\.\d+)*", text.lower())


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _idf(seen: int, total: int) -> float:
    return math.log((1 + total) / (1 + seen)) + 1


def _postings(notices: list[tuple[str, Counter]], idf: dict[str, float], threshold: float) -> tuple[list[tuple], list[tuple]]:
    """(t, word, part, mass, anchor) of each word of each template, and (t, licence, size, least, named) of each template.

    part: what an occurrence of the word adds to the cosine's product; mass: the word's share of the squared length.
    No vector without an anchor, or with words of a smaller mass than ``least``, reaches the threshold.
    """
    words, templates = [], []
    for t, (name, counts) in enumerate(notices):
        mass = {w: (n * idf[w]) ** 2 for w, n in counts.items()}
        total, size = sum(mass.values()), sum(counts.values())
        rest, anchors = total, set()
        for w in sorted(counts, key=lambda w: (-idf[w], w)):
            if rest < threshold**2 * total - 1e-9:
                break
            anchors.add(w)
            rest -= mass[w]
        words += [(t, w, n * idf[w] ** 2 / math.sqrt(total), mass[w] / total, w in anchors) for w, n in counts.items()]
        groups = [[w for w in group.split() if w in counts] or group.split() for group in NAMES.get(name, [])] if size < NOTICE_WORDS else []
        templates.append((t, name, size, threshold**2 - 1e-9, groups))
    return words, templates


def _running(rows: DataFrame, keys: list[str], value: Column, into: str) -> DataFrame:
    return rows.withColumn(into, F.sum(value).over(W.partitionBy(*keys).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)))


def _windows(hits: DataFrame, lengths: DataFrame, threshold: float) -> DataFrame:
    """(f, t, at, n, dot) of the windows whose bound reaches the threshold, from hits (f, t, at, size, part, square).

    A window begins at a hit. Sums over all hits before its end, less those before its begin, are its own; the words that
    are no hits weigh 1 at least.
    """
    begins = hits.select("f", "t", "at", F.lit(1).alias("kind"), F.col("at").alias("begin"), "part", "square", F.lit(1).alias("one"))
    ends = hits.select("f", "t", (F.col("at") + F.col("size")).alias("at"), F.lit(0).alias("kind"), F.col("at").alias("begin"), F.lit(0.0).alias("part"), F.lit(0.0).alias("square"), F.lit(0).alias("one"))
    events = begins.unionByName(ends)
    for column in ("part", "square", "one"):
        events = _running(events, ["f", "t"], F.col(column), f"all_{column}")
    inside = [(F.max(F.when(F.col("kind") == 0, F.col(f"all_{c}"))) - F.max(F.when(F.col("kind") == 1, F.col(f"all_{c}") - F.col(c)))).alias(c) for c in ("part", "square", "one")]
    summed = events.groupBy("f", "t", F.col("begin").alias("at")).agg(*inside).join(lengths, "f").join(hits.select("t", "size").distinct(), "t")
    n = F.least("size", F.col("length") - F.col("at")).cast("long")
    bound = F.col("part") / F.sqrt(F.col("square") + n - F.col("one"))
    return summed.where(bound >= threshold - 1e-9).select("f", "t", "at", n.alias("n"), F.col("part").alias("dot"))


def _scored(windows: DataFrame, words: DataFrame, templates: DataFrame) -> DataFrame:
    """The windows (f, t, at, n, dot) that have their template's names, with their cosine."""
    each = windows.select("f", "t", F.col("at").alias("begin"), "dot", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at"))
    told = each.join(words.select("f", "at", "word", "idf"), ["f", "at"]).groupBy("f", "t", "begin", "dot", "word").agg(F.count("*").alias("times"), F.first("idf").alias("idf"))
    length = F.sqrt(F.sum((F.col("times") * F.col("idf")) ** 2))
    named = [F.coalesce(F.max(F.array_contains(F.get("named", F.lit(k)), F.col("word"))), F.lit(True)).alias(f"named{k}") for k in range(3)]
    found = told.join(templates.select("t", "named"), "t").groupBy("f", "t", "begin", "dot").agg(length.alias("length"), *named)
    return found.where("named0 and named1 and named2").select("f", "t", F.round(F.least(F.lit(1.0), F.col("dot") / F.col("length")), 9).alias("score"))


def scan_licences(files: DataFrame, templates: dict[str, list[str]] | None = None, path: str = "path", text: str = "text", threshold: float = 0.6) -> DataFrame:
    """(path, licence, score): of each file with a passage of cosine ``threshold`` or more to a template, the best one.

    Ties go to the smaller licence name. Null and empty texts, and files without such a passage, give no row. Rows
    repeating a path are one file, though their texts are compared one by one; very long texts are compared whole, in
    rows of one word each; other columns of ``files`` may have any name.
    """
    spark = files.sparkSession
    notices = [(name, Counter(_tokens(t))) for name, texts in sorted((templates or TEMPLATES).items()) for t in texts]
    vocabulary = sorted({t for _, c in notices for t in c})
    found = F.regexp_extract_all(F.col("text"), F.lit(_TOKEN), 0)
    lowered = files.select(F.col(path).alias("path"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    known = lowered.select("path", "text", F.array_intersect(_strings(vocabulary), found).alias("known"))
    # texts without a word that only some texts have are not looked at again
    telling = F.arrays_overlap("known", _strings([w for w in vocabulary if w not in COMMON]))
    known = cut_lineage(known.select(F.monotonically_increasing_id().alias("f"), "path", "known", F.when(telling, F.col("text")).alias("text")))
    counted = known.select(F.explode("known").alias("t")).groupBy("t").count().collect()  # a row per word of the vocabulary
    seen, total = {r["t"]: r["count"] for r in counted}, known.count()
    idf = {t: 1.0 if t in COMMON else _idf(seen.get(t, 0), total) for t in vocabulary}
    rows, each = _postings(notices, idf, threshold)
    # a row per word of each template, and a row per template, whatever the files
    sizes = {t: size for t, _, size, _, _ in each}
    postings = F.broadcast(spark.createDataFrame([(*r, sizes[r[0]]) for r in rows], "t int, word string, part double, mass double, anchor boolean, size int"))
    table = F.broadcast(spark.createDataFrame(each, "t int, licence string, size int, least double, named array<array<string>>"))
    anchors = _strings(sorted({w for _, w, _, _, anchor in rows if anchor}))
    asked = known.where(F.col("text").isNotNull() & F.arrays_overlap("known", anchors))
    shared = asked.select("f", "known", F.explode("known").alias("word")).join(postings, "word").groupBy("f", "t").agg(F.sum("mass").alias("mass"), F.max("anchor").alias("anchor"), F.first("known").alias("known"))
    named = F.forall("named", lambda group: F.arrays_overlap(group, F.col("known")))
    pairs = cut_lineage(shared.where("anchor").join(table, "t").where((F.col("mass") >= F.col("least")) & named).select("f", "t", "size"))
    told = cut_lineage(asked.join(pairs.select("f").distinct(), "f", "left_semi").select("f", F.posexplode(found).alias("at", "word")))
    # a window that counts has an anchor, so it lies in the stretch of its template's size around one or in a neighbour of it
    stretch = F.floor(F.col("at") / F.col("size"))
    anchored = told.join(postings.where("anchor").select("t", "word", "size"), "word").join(pairs.select("f", "t"), ["f", "t"])
    near = cut_lineage(anchored.select("f", "t", "size", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch")).distinct())
    block = lambda at: F.floor(at / WORD_BLOCK)
    blocks = near.select("f", F.explode(F.sequence(block(F.col("stretch") * F.col("size")), block((F.col("stretch") + 1) * F.col("size") - 1))).alias("block")).distinct()
    words = cut_lineage(told.withColumn("block", block(F.col("at"))).join(blocks, ["f", "block"], "left_semi").select("f", "at", "word"))
    hits = words.join(postings.select("t", "word", "part", "size"), "word").withColumn("stretch", stretch).join(near.drop("size"), ["f", "t", "stretch"])
    weights = F.broadcast(spark.createDataFrame([(w, x * x) for w, x in idf.items()], "word string, square double"))
    lengths = told.groupBy("f").agg(F.count("*").alias("length"))
    windows = cut_lineage(_windows(hits.join(weights, "word").select("f", "t", "at", "size", "part", "square"), lengths, threshold))
    # the weight of every word around such a window, counted over all files
    needed = words.join(windows.select("f").distinct(), "f", "left_semi")
    others = needed.select("word").distinct().join(weights, "word", "left_anti")
    # counted before they meet the few that are needed, so that tasks send each word once
    in_files = lowered.select(F.explode(F.array_distinct(found)).alias("word")).groupBy("word").agg(F.count("*").alias("seen")).join(others, "word")
    own = in_files.select("word", (F.log((1 + F.lit(total)) / (1 + F.col("seen"))) + 1).alias("idf")).unionByName(weights.select("word", F.sqrt("square").alias("idf")))
    weighed = needed.join(own, "word").withColumn("kind", F.lit(0))
    weighed = cut_lineage(_running(weighed, ["f"], F.col("idf") ** 2, "all_squares"))
    # bounds anew with the weight of every word; they are exact where no word repeats
    first = weighed.select("f", "at", (F.col("all_squares") - F.col("idf") ** 2).alias("before"))
    last = weighed.select("f", F.col("at").alias("last"), "all_squares")
    limited = windows.join(first, ["f", "at"]).withColumn("last", (F.col("at") + F.col("n") - 1).cast("int")).join(last, ["f", "last"])
    limited = limited.select("f", "t", "at", "n", "dot", (F.col("dot") / F.sqrt(F.col("all_squares") - F.col("before"))).alias("bound"))
    limited = cut_lineage(limited.where(F.col("bound") >= threshold - 1e-9))
    best = F.max_by(F.struct("at", "n", "dot"), F.struct("bound", -F.col("at")))
    top = limited.groupBy("f", "t").agg(best.alias("w")).select("f", "t", "w.*")
    reached = cut_lineage(_scored(top, weighed, table))
    floor = reached.groupBy("f").agg(F.max("score").alias("floor"))
    rest = limited.join(floor, "f", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - 1e-9).drop("floor", "bound")
    scores = reached.unionByName(_scored(rest, weighed, table)).where(F.col("score") >= threshold)
    named_scores = scores.join(table.select("t", "licence"), "t").join(known.select("f", "path"), "f")
    rank = F.struct(-F.col("score"), F.col("licence"))
    return named_scores.groupBy("path").agg(F.min_by("licence", rank).alias("licence"), F.max("score").alias("score"))


def _ancestors(path: Column) -> Column:
    """Directories above a path, each with its depth: a/b/c.txt -> (a/b, 2), (a, 1), ('', 0)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("directory"), k.alias("depth")))


def inherit_licences(files: DataFrame, scanned: DataFrame, path: str = "path", is_licence_file: Column | None = None) -> DataFrame:
    """(path, own_licence, score, licence, inherited_from) for each path of ``files``.

    A file without a licence of its own has that of the nearest directory above it with a licence file: a file that
    ``is_licence_file`` marks (default: named LICENSE, LICENCE or COPYING, with any ending) and in which a licence was
    found. Two licence files of one directory: the smaller path counts. Files without path are left out.
    """
    marked = is_licence_file if is_licence_file is not None else F.col(path).rlike(r"(?i)(^|/)(licen[sc]e|copying)[^/]*$")
    named = files.where(F.col(path).isNotNull())
    every = named.select(F.col(path).alias("path"), marked.alias("_marked")).groupBy("path").agg(F.max("_marked").alias("_marked"))
    own = cut_lineage(every.join(scanned, "path", "left"))
    directory = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    offered = own.where("_marked and licence is not null").groupBy(directory.alias("directory")).agg(F.min_by("licence", "path").alias("offer"))
    asking = own.where("licence is null").select("path", F.explode(_ancestors(F.col("path"))).alias("a")).select("path", "a.*")
    nearest = asking.join(cut_lineage(offered), "directory").groupBy("path").agg(F.max_by("offer", "depth").alias("offer"), F.max_by("directory", "depth").alias("inherited_from"))
    return own.join(nearest, "path", "left").select("path", F.col("licence").alias("own_licence"), "score", F.coalesce("licence", "offer").alias("licence"), "inherited_from")
