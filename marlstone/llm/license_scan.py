"""Licence scan: windows of a text against licence notices and short licence texts, by Dice coefficient over word bigrams.

Everything is DataFrame expressions. A text is normalised as a whole (lower case, anything but ASCII letters and digits becomes
one space), so line breaks and comment marks do not matter, and becomes a sequence of words and of bigrams. It is compared
with a template in windows as long as the template. A window has score 2 d / (b + n): b distinct bigrams of the template, d of them
in the window, n the size of the window, which is d and the bigrams that the template does not have, each as often as it stands.

Size bounds prune the templates: a window can only reach threshold t if it shares t b / (2 - t) bigrams with a template of b,
so it has one at least of any b - t b / (2 - t) + 1 bigrams of it. The longest ones, which are the rarest in prose, are taken; texts
without any of them are dropped where they are read. In the other texts, a bigram that stands once in a template and once or more
in the text lays the template at a place in the text; places with enough of such votes are scored. The templates are a short
fixed list, so their bigrams are broadcast; texts are never shuffled, only the bigrams that they share with templates.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

_SOFTWARE = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."
# Licence id and the wording of its notice or text.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_SOFTWARE}'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", _GPL.format(kind="General", n=3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", _GPL.format(kind="General", n=2)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GPL.format(kind="Lesser General", n=3)),
    ("AGPL-3.0", _GPL.format(kind="Affero General", n=3)),
    ("BSD-3-Clause", _BSD_START),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_TWO} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_TWO} {_BSD_THIRD} {_BSD_END}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]
THRESHOLD = 0.8
#: Words at each end in which two matches may overlap, at most.
EDGE = 3
#: A place in a text is scored if at least this share of a template's bigrams votes for it (one vote at least).
VOTES = 0.1


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")


def compiled(templates, threshold: float):
    """(bigrams, facts, needed): rows (t, bigram, offset or None if it is repeated), rows (t, license, positions, distinct, least votes),
    and the bigrams of which a text must have one to be compared at all."""
    grams, facts, needed = [], [], set()
    for t, (name, notice) in enumerate(templates):
        words = normal_words(notice)
        every = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        places: dict[str, list[int]] = {}
        for k, g in enumerate(every):
            places.setdefault(g, []).append(k)
        if not places:
            continue
        grams += [(t, g, at[0] if len(at) == 1 else None) for g, at in places.items()]
        facts.append((t, name, len(every), len(places), max(1, math.floor(VOTES * len(places)))))
        least = math.ceil(threshold * len(places) / (2 - threshold) - 1e-9)
        rare = sorted(places, key=lambda g: (-len(g), g))
        needed.update(rare[: len(places) - least + 1])
    return grams, facts, sorted(needed)


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct id: id, licenses (sorted ids joined by commas, '' for none), best_score, n_matches.

    Windows that reach the threshold and overlap are one match, whose licence is that with the most shared bigrams, then of the best
    score (all, if they tie). n_matches counts matches; best_score is the largest score of a match, 0 for none. Null and empty texts match nothing, nor does a text
    of one word. Rows that share an id (null included) are one document whose matches add up, repeated rows included.
    An empty table gives no rows. Other columns of `docs` are ignored, whatever their names. Whole texts are compared.
    """
    spark = docs.sparkSession
    grams, facts, needed = compiled(templates or TEMPLATES, threshold)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("txt"))
    every = d.select("id", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("ls"), F.lit(0).alias("m"))
    if grams:
        words = F.split(F.trim(F.regexp_replace(F.lower("txt"), "[^a-z0-9]+", " ")), " ")
        # The words are bound once as a lambda's variable; a column would be computed anew wherever it is used.
        both = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        texts = d.where(F.col("txt").isNotNull()).select("id", F.get(F.transform(F.array(words), both), F.lit(0)).alias("b"))
        texts = texts.where(F.arrays_overlap("b", F.array(*[F.lit(g) for g in needed])))
        template = F.broadcast(spark.createDataFrame(grams, "t int, bigram string, offset int"))
        numbered = texts.select("id", "b", F.monotonically_increasing_id().alias("row"))
        placed = numbered.select("id", "row", F.size("b").alias("size"), F.posexplode("b").alias("pos", "bigram"))
        # Written out, since places and scores both read them and rows are numbered as they are read.
        hits = checkpointed(placed.join(template, "bigram"))
        every = every.unionByName(_matches(hits, facts, threshold))
    out = every.groupBy("id").agg(
        F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_set("ls"))))).alias("licenses"),
        F.round(F.max("score"), 6).alias("best_score"),
        F.sum("m").cast("long").alias("n_matches"),
    )
    return out.withColumnRenamed("id", id_col)


def _matches(hits: DataFrame, facts: list, threshold: float) -> DataFrame:
    """(id, score, ls, m) of the matches, from the bigrams (id, row, size, pos, bigram, t, offset) that texts share with templates."""
    facts = F.broadcast(hits.sparkSession.createDataFrame(facts, "t int, license string, n int, b int, votes int"))
    places = hits.where("offset IS NOT NULL").groupBy("row", "t", (F.col("pos") - F.col("offset")).alias("at"))
    places = places.agg(F.count("*").alias("v"), F.first("id").alias("id"), F.first("size").alias("size")).join(facts, "t").where("v >= votes")
    begin, end = F.greatest("at", F.lit(0)), F.least(F.col("at") + F.col("n"), F.col("size"))
    places = places.select("id", "row", "t", "license", "n", "b", begin.alias("begin"), end.alias("end")).distinct()
    # A window lies in two stretches of its template's length at most, so it meets only the bigrams near it.
    stretch = lambda x: F.floor(x / F.col("n")).cast("int")
    windows = places.withColumn("stretch", F.explode(F.sequence(stretch(F.col("begin")), stretch(F.greatest(F.col("begin"), F.col("end") - 1)))))
    near = hits.join(facts.select("t", "n"), "t").select(F.col("row").alias("r"), F.col("t").alias("u"), "pos", "bigram", stretch(F.col("pos")).alias("s"))
    on = (F.col("row") == F.col("r")) & (F.col("t") == F.col("u")) & (F.col("stretch") == F.col("s")) & (F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("end"))
    own = ["id", "row", "t", "license", "b", "begin", "end"]
    counts = windows.join(near, on).groupBy(*own, "bigram").agg(F.count("*").alias("c")).groupBy(*own).agg(F.count("*").alias("d"), F.sum("c").alias("h"))
    score = 2.0 * F.col("d") / (F.col("b") + F.col("end") - F.col("begin") - F.col("h") + F.col("d"))
    found = counts.withColumn("score", score).where(F.col("score") >= threshold)
    # Windows of one template whose middle halves overlap are one place, the best of them; ties go to the first.
    quarter = F.floor((F.col("end") - F.col("begin")) / 4)
    found = _runs(found, ["row", "t"], F.col("begin") + quarter, F.col("end") - quarter)
    best = F.max_by(F.struct("id", "license", "begin", "end", "d", "score"), F.struct("score", -F.col("begin")))
    found = found.groupBy("row", "t", "run").agg(best.alias("w")).select("row", "t", "w.*")
    # Places that overlap, but for a few words, are one match: that with the most shared bigrams, then of the best score.
    edge = F.least(F.lit(EDGE), F.floor((F.col("end") - F.col("begin")) / 4))
    found = _runs(found, ["row"], F.col("begin") + edge, F.col("end") - edge)
    best = found.groupBy("id", "row", "run").agg(F.max(F.struct("d", "score")).alias("top"), F.collect_set(F.struct(F.struct("d", "score").alias("rank"), "license")).alias("all"))
    names = F.transform(F.filter("all", lambda x: x["rank"] == F.col("top")), lambda x: x["license"])
    return best.select("id", F.col("top.score").alias("score"), F.array_sort(F.array_distinct(names)).alias("ls"), F.lit(1).alias("m"))


def _runs(rows: DataFrame, by: list[str], low, high) -> DataFrame:
    """The rows with `run`, which numbers the stretches of overlapping intervals [low, high) within `by`."""
    rows = rows.withColumn("low", low).withColumn("high", high)
    order = Window.partitionBy(*by).orderBy("low", "high", "t", "begin")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(before.isNull() | (F.col("low") >= before), 1).otherwise(0))
    return rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def oracle(templates=None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for scan_licenses over `documents`; every text is compared with every template, without the prefix bound."""
    grams, facts, _ = compiled(templates or TEMPLATES, threshold)
    gram_rows = ", ".join(f"({t}, '{g}', {'NULL' if o is None else o})" for t, g, o in grams)
    fact_rows = ", ".join(f"({t}, '{name}', {n}, {b}, {v})" for t, name, n, b, v in facts)
    return f"""
WITH g(t, bigram, o) AS (VALUES {gram_rows}),
f(t, license, n, b, votes) AS (VALUES {fact_rows}),
s1 AS (SELECT doc_id, row_number() OVER () AS r, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
s2 AS MATERIALIZED (SELECT doc_id, r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS x FROM s1 WHERE len(w) >= 2),
s3 AS (SELECT doc_id, r, len(x) AS size, unnest(x) AS bigram, unnest(range(0, len(x))) AS pos FROM s2),
h AS MATERIALIZED (SELECT doc_id, r, size, pos, bigram, t, o FROM s3 JOIN g USING (bigram)),
p AS (SELECT r, t, pos - o AS at, any_value(doc_id) AS doc_id, any_value(size) AS size, count(*) AS v FROM h WHERE o IS NOT NULL GROUP BY r, t, pos - o),
q AS (SELECT DISTINCT p.doc_id, p.r, p.t, f.license, f.b, greatest(p.at, 0) AS lo, least(p.at + f.n, p.size) AS hi FROM p JOIN f USING (t) WHERE p.v >= f.votes),
c AS (SELECT q.doc_id, q.r, q.t, q.license, q.b, q.lo, q.hi, count(DISTINCT h.bigram) AS d, count(*) AS k FROM q JOIN h ON h.r = q.r AND h.t = q.t AND h.pos >= q.lo AND h.pos < q.hi GROUP BY ALL),
m AS (SELECT *, 2.0::DOUBLE * d / (b + hi - lo - k + d) AS score FROM c),
n AS (SELECT *, lo + (hi - lo) // 4 AS low, hi - (hi - lo) // 4 AS high FROM m WHERE score >= {threshold}),
a0 AS (SELECT *, max(high) OVER (PARTITION BY r, t ORDER BY low, high, lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM n),
a1 AS (SELECT *, sum(CASE WHEN upto IS NULL OR low >= upto THEN 1 ELSE 0 END) OVER (PARTITION BY r, t ORDER BY low, high, lo ROWS UNBOUNDED PRECEDING) AS place FROM a0),
a2 AS (SELECT * EXCLUDE (low, high, upto), lo + least({EDGE}, (hi - lo) // 4) AS low, hi - least({EDGE}, (hi - lo) // 4) AS high FROM a1 QUALIFY row_number() OVER (PARTITION BY r, t, place ORDER BY score DESC, lo) = 1),
i0 AS (SELECT *, max(high) OVER (PARTITION BY r ORDER BY low, high, t, lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM a2),
i1 AS (SELECT *, sum(CASE WHEN upto IS NULL OR low >= upto THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY low, high, t, lo ROWS UNBOUNDED PRECEDING) AS match FROM i0),
i2 AS (SELECT *, rank() OVER (PARTITION BY r, match ORDER BY d DESC, score DESC) AS k1 FROM i1),
l AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses FROM (SELECT DISTINCT doc_id, license FROM i2 WHERE k1 = 1) GROUP BY doc_id),
e AS (SELECT doc_id, max(score) AS score, count(DISTINCT (r, match)) AS n FROM i2 WHERE k1 = 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.licenses, '') AS licenses, round(coalesce(e.score, 0)::DOUBLE, 6) AS best_score, coalesce(e.n, 0)::BIGINT AS n_matches
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN l USING (doc_id) LEFT JOIN e USING (doc_id)
"""
