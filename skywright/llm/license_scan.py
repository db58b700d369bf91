"""License scans: base phrases by position, and notices by an exact set-similarity join of text blocks with license templates.

A block is any run of words, as long as the template and a quarter more, wherever lines are wrapped and comment signs stand. A template
is found in a text if one of its blocks holds at least `threshold` of the template's words, counted as often as they occur there. One scan
of the corpus finds which of all templates' words each text has; the words are then ordered by the number of texts with them, rarest first,
and a block with the needed overlap must hold one of the template's first n - need + 1 words in that order (prefix filter). Texts are joined
with the templates on these words; pairs go where the text is too short or has too few of the template's words (length filter). Only texts
left are read again: a block can start at a word of the template only, and only if as many of its words as needed follow within the
block's length (positional filter); then the overlap is counted. Templates of different labels with so many words in common that a block of one
passes for the other are rivals. Every block with the needed overlap is found; of overlapping blocks of one template the best one is kept
(largest overlap, then one that begins as the template does, then the shortest, then the first), and of overlapping blocks of rivals the one
that does not begin as its template does yields, or else the one with the smaller share, or else of the shorter template. Blocks yield for themselves, so a label stays if one of its blocks does. The template side of each
join is small by the caller's list, which is checked.

Defined cases: a null or empty text has no words, labels or blocks (score 0); the same words found twice count twice in n_base and
once in labels; of a label's blocks the one with the largest share is listed, of equal ones the first; templates without words are left
out; rows that share id and text share their result; very long texts are read whole; an empty table gives no rows; without templates only the
base stays; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR_CLASS, ascii_lower, let, materialize, once

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Common notices and license texts, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    *[(f"cc-{kind}", f"Licensed under CC {kind.upper()} 4.0") for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")],
    *[(f"cc-{kind}", f"This work is licensed under a Creative Commons {name} 4.0 International License") for kind, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))],
]
THRESHOLD = 0.9
#: Words of a block for each word of the template.
STRETCH = 1.25
#: The template side is broadcast; more words than this in all templates together are refused.
MOST_TEMPLATE_WORDS = 200_000

_SEPARATORS = "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def plain_words(text: str) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)


def words_of(low: Column) -> Column:
    """Words of an already lower-cased text."""
    trimmed = F.btrim(low, F.lit(_SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SEPARATOR_CLASS}+"))


def _places(w: Column) -> Column:
    """(label, start) of every base phrase."""

    def at(x: Column, i: Column) -> Column:
        out = None
        for phrase, label in PHRASES.items():
            *before, last = phrase.split(" ")
            cond = x == last
            for k, word in enumerate(reversed(before), 1):
                cond = cond & F.get(w, i - k).eqNullSafe(F.lit(word))
            found = F.struct(F.lit(label).alias("label"), (i - len(before)).cast("long").alias("start"))
            out = F.when(cond, found) if out is None else out.when(cond, found)
        return out

    return F.filter(F.transform(w, at), lambda x: x.isNotNull())


def need_of(n: int, threshold: float) -> int:
    return max(1, -int(-(threshold * n - 1e-9) // 1))


def span_of(n: int) -> int:
    return int(STRETCH * n + 0.999999)


def prepared(templates: list[tuple[str, str]], threshold: float) -> list[tuple[int, str, dict[str, int], int, int, int, str]]:
    """(number, label, words with their counts, words in all, needed overlap, words of a block, first word) of every template with words."""
    out = []
    for label, text in templates:
        if words := plain_words(text):
            count = {w: words.count(w) for w in sorted(set(words))}
            out.append((len(out), label, count, len(words), need_of(len(words), threshold), span_of(len(words)), words[0]))
    return out


def rivals_of(sets: list[tuple]) -> dict[int, list[int]]:
    """For every template those of other labels with so many of the same words that a block of one can pass for the other."""
    common = lambda a, b: sum(min(c, b[w]) for w, c in a.items() if w in b)
    return {k: [j for j, other, words_j, _, need_j, *_ in sets if other != label and common(words, words_j) >= min(need, need_j)] for k, label, words, _, need, *_ in sets}


MATCHES = "array<struct<label:string,containment:double,start:bigint,end:bigint>>"
#: Texts with candidate templates are sent to all executors up to this many, counted first; more are joined with a shuffle.
MOST_BROADCAST = 100_000


def _blocks(words: Column, tw: Column, tc: Column, need: Column, span: Column, first: Column) -> Column:
    """(overlap n, start, end, begins: with the template's first word) of every block of a template (words tw, counts tc) with the needed overlap; words: all of the text.

    A block starts at a word of the template and ends with the last word that counts, so what merely follows is not in it.
    """
    hits = F.filter(F.transform(words, lambda w, p: F.struct(p.alias("p"), F.array_position(tw, w).cast("int").alias("r"))), lambda x: x["r"] > 0)

    def counted(inside: Column) -> Column:
        """Of each template word in a block: how often it counts, and where for the last time."""
        ranks = F.array_distinct(F.transform(inside, lambda y: y["r"]))
        most = lambda own, r: F.least(F.size(own), F.element_at(tc, r))
        return F.transform(ranks, lambda r: let(F.filter(inside, lambda y: y["r"] == r), lambda own: F.struct(most(own, r).alias("n"), F.element_at(own, most(own, r))["p"].alias("last"))))

    def of_hits(m: Column) -> Column:
        def block(x: Column, k: Column) -> Column:
            inside = F.filter(F.slice(m, k + 1, span), lambda y: y["p"] < x["p"] + span)
            total = lambda c: F.aggregate(c, F.lit(0), lambda a, y: a + y["n"])
            end = lambda c: F.array_max(F.transform(c, lambda y: y["last"])) + 1
            found = let(let(inside, counted), lambda c: F.struct(total(c).alias("n"), x["p"].alias("start"), end(c).alias("end"), (F.get(words, x["p"]) == first).alias("begins")))
            return F.when(F.get(m, k + need - 1)["p"] < x["p"] + span, found)

        return F.filter(F.transform(m, block), lambda b: b["n"] >= need)

    return let(hits, of_hits)


def _unbeaten(blocks: DataFrame, beats: Column, width: int) -> DataFrame:
    """blocks (a) without those that overlap a block (b) of the same text which beats them; width: most words of a block.

    Blocks meet in stretches of `width` words of their text, each in two at most, so a text with very many notices makes no pairs of all.
    """
    rows = blocks.withColumn("place", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.place") == F.col("b.place"))
    overlap = (F.col("b.start") < F.col("a.end")) & (F.col("a.start") < F.col("b.end"))
    lost = rows.alias("a").join(rows.alias("b"), same & overlap & beats, "left_semi").select("id", "h", "template", "start").distinct()
    mine = F.col("a.id").eqNullSafe(F.col("l.id"))
    for c in ("h", "template", "start"):
        mine = mine & (F.col(f"a.{c}") == F.col(f"l.{c}"))
    return blocks.alias("a").join(lost.alias("l"), mine, "left_anti")


def _ahead(keys: list[tuple[str, int]]) -> Column:
    """Is block b ahead of block a by these columns, one after the other (1: larger is better, -1: smaller is)?"""
    out = F.lit(False)
    for c, sign in reversed(keys):
        x, y = F.col(f"b.{c}") * sign, F.col(f"a.{c}") * sign
        out = (x > y) | ((x == y) & out)
    return out


#: Of overlapping blocks of one template the best stays; of overlapping blocks of rivals too.
_MAXIMAL = [("overlap", 1), ("begins", 1), ("size", -1), ("start", -1)]
_BETTER = [("begins", 1), ("containment", 1), ("n", 1)]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, places (base), matches (label, containment and words of its best block), in the order of labels."""
    spark = docs.sparkSession
    sets = prepared(templates, threshold)
    vocab = sorted({w for _, _, count, *_ in sets for w in count})
    if len(vocab) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have over {MOST_TEMPLATE_WORDS} words; split the list and scan once for each part")
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    endings = sorted({p.split(" ")[-1] for p in PHRASES})
    maybe = lambda low: F.greatest(*[F.instr(low, e) for e in [*endings, endings[0]]]) > 0
    none = F.array().cast("array<struct<label:string,start:bigint>>")
    known = F.array(*map(F.lit, vocab)) if vocab else F.array().cast("array<string>")
    row = let(ascii_lower(F.col("t")), lambda low: let(words_of(low), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.when(maybe(low), _places(w)).otherwise(none).alias("places"), F.array_intersect(w, known).alias("seen"))))
    base = docs.select("id", F.xxhash64("t").alias("h"), once(row).alias("r")).select("id", "h", "r.*")
    if not sets:
        return base.select(F.col("id").alias(id_col), "n_words", "places", F.array().cast(MATCHES).alias("matches"))
    base = materialize(base, "license-words")
    count = {r["w"]: r["count"] for r in base.select(F.explode("seen").alias("w")).groupBy("w").count().collect()}  # a row for each template word at most
    rows, rivals = [], rivals_of(sets)
    for k, label, words, n, need, span, first in sets:
        left = n - need + 1
        for w in sorted(words, key=lambda w: (count.get(w, 0), w)):
            rows.append((w, k, label, list(words), list(words.values()), n, need, span, first, rivals[k]))
            left -= words[w]
            if left <= 0:
                break
    side = spark.createDataFrame(rows, "w string, template int, label string, tw array<string>, tc array<int>, n int, need int, span int, first string, rivals array<int>")
    rare = F.array(*map(F.lit, sorted({r[0] for r in rows})))
    firsts = base.select("id", "h", "n_words", "seen", F.explode(F.array_intersect("seen", rare)).alias("w"))
    pairs = firsts.join(F.broadcast(side), "w").where(F.col("n_words") >= F.col("need"))
    most = F.aggregate(F.zip_with("tw", "tc", lambda w, c: F.when(F.array_contains("seen", w), c).otherwise(0)), F.lit(0), lambda a, x: a + x)
    pairs = pairs.where(most >= F.col("need")).select("id", "h", "template").distinct()
    pairs = materialize(pairs.groupBy("id", "h").agg(F.collect_list("template").alias("templates")), "license-pairs")  # the caller's templates at most
    if pairs.count() <= MOST_BROADCAST:
        pairs = F.broadcast(pairs)
    again = docs.withColumn("h", F.xxhash64("t")).alias("d").join(pairs.alias("p"), F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.h") == F.col("p.h")))
    again = again.select("d.id", "d.h", once(words_of(ascii_lower(F.col("t")))).alias("words"), F.explode("templates").alias("template"))
    again = again.join(F.broadcast(side.drop("w").dropDuplicates(["template"])), "template")
    found = again.select("id", "h", "template", "label", "rivals", "n", F.explode(once(_blocks(F.col("words"), F.col("tw"), F.col("tc"), F.col("need"), F.col("span"), F.col("first")))).alias("b"))
    size = (F.col("b.end") - F.col("b.start")).alias("size")
    found = found.select("id", "h", "template", "label", "rivals", "n", F.col("b.n").alias("overlap"), (F.col("b.n") / F.col("n")).alias("containment"), F.col("b.begins").cast("int").alias("begins"), size, F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("end"))
    found, width = materialize(found, "license-blocks"), max(s[5] for s in sets)
    found = materialize(_unbeaten(found, (F.col("a.template") == F.col("b.template")) & _ahead(_MAXIMAL), width), "license-maximal")
    best = _unbeaten(found, F.array_contains("a.rivals", F.col("b.template")) & _ahead(_BETTER), width)
    best = best.groupBy("id", "h", "label").agg(F.max(F.struct("containment", (-F.col("start")).alias("at"), "end")).alias("m"))
    entry = F.struct("label", F.col("m.containment").alias("containment"), (-F.col("m.at")).alias("start"), F.col("m.end").alias("end"))
    best = best.groupBy("id", "h").agg(F.sort_array(F.collect_list(entry)).alias("matches"))  # a label each, of the caller's templates
    best = materialize(best, "license-found")
    if best.count() <= MOST_BROADCAST:
        best = F.broadcast(best)
    out = base.alias("b").join(best.alias("f"), F.col("b.id").eqNullSafe(F.col("f.id")) & (F.col("b.h") == F.col("f.h")), "left")
    return out.select(F.col("b.id").alias(id_col), "n_words", "places", F.coalesce("matches", F.array().cast(MATCHES)).alias("matches"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of query op4 from scan()'s."""
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    base, more = F.transform("places", lambda x: x["label"]), F.transform("matches", lambda x: x["label"])
    starts = F.transform("places", lambda x: x["start"])
    score = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0)))
    return found.select(id_col, "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"), score.alias("score"))


def oracle() -> str:
    """DuckDB SQL for query op4: the blocks from every template word of every text on, against all templates."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rx = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    upper, lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
    sets = prepared(TEMPLATES, THRESHOLD)
    temps = ", ".join(f"({k}, {q(label)}, {n}, {need}, {span}, {q(first)})" for k, label, _, n, need, span, first in sets)
    words = ", ".join(f"({k}, {q(w)}, {c})" for k, _, count, *_ in sets for w, c in count.items())
    rivals = ", ".join(f"({k}, {j})" for k, js in rivals_of(sets).items() for j in js)
    cases = " ".join("WHEN " + " AND ".join(f"w[i + {k}] = {q(x)}" for k, x in enumerate(p.split(" "))) + f" THEN {q(label)}" for p, label in PHRASES.items())
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {upper}, {lower}), {rx}) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
p AS (SELECT doc_id, i - 1 AS start, CASE {cases} END AS label FROM i),
b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM p WHERE label IS NOT NULL GROUP BY doc_id),
t(k, label, n, need, span, first) AS (VALUES {temps}),
v(k, word, c) AS (VALUES {words}),
rival(k, j) AS (VALUES {rivals}),
h AS (SELECT doc_id, k, i, word, c FROM (SELECT doc_id, i, w[i] AS word FROM i) JOIN v USING (word)),
x AS (SELECT doc_id, k FROM (SELECT doc_id, k, least(count(*), max(c)) AS most FROM h GROUP BY doc_id, k, word) JOIN t USING (k) GROUP BY doc_id, k HAVING sum(most) >= max(need)),
o AS (SELECT s.doc_id, s.k, s.i, e.word, least(count(*), max(e.c)) AS n, list_sort(list(e.i))[least(count(*), max(e.c))] AS z FROM h s JOIN x ON x.doc_id = s.doc_id AND x.k = s.k JOIN t ON t.k = s.k
  JOIN h e ON e.doc_id = s.doc_id AND e.k = s.k AND e.i >= s.i AND e.i < s.i + t.span GROUP BY s.doc_id, s.k, s.i, e.word),
c AS (SELECT doc_id, k, i AS a, sum(n) AS n, max(z) + 1 AS z FROM o GROUP BY doc_id, k, i),
e AS (SELECT c.doc_id, c.k, label, t.n, c.n / t.n AS containment, a, z, CAST(w[a] = first AS INTEGER) AS begins, (c.n, CAST(w[a] = first AS INTEGER), a - z, -a) AS rank FROM c JOIN t USING (k) JOIN w ON w.doc_id = c.doc_id WHERE c.n >= need),
f AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.doc_id = e.doc_id AND b.k = e.k AND b.a < e.z AND e.a < b.z AND b.rank > e.rank)),
m AS (SELECT doc_id, max(containment) AS c, list(DISTINCT label) AS labels FROM f WHERE NOT EXISTS (SELECT 1 FROM f b JOIN rival ON rival.j = b.k
  WHERE b.doc_id = f.doc_id AND rival.k = f.k AND (b.begins, b.containment, b.n) > (f.begins, f.containment, f.n) AND b.a < f.z AND f.a < b.z) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(m.c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)"""
