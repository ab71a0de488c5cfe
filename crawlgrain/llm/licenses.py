"""Licence scan: segments of a normalised text against licence templates by the Dice coefficient of word bigrams.

A text is lower-cased and every run of signs other than ASCII letters, digits and line ends becomes one space. Segments
are its lines, its paragraphs and the whole text. A template is compared with a segment only if their bigram counts allow
the wanted coefficient at all. Everything is one projection of built-in functions: no join and no shuffle.

Defined cases: a null or empty text, or one without two words in any segment, has no licence (``license`` and ``dice``
null, ``licenses`` empty). Equal segments of a text count once. Of several licences the one with the largest coefficient
is named, of equal ones the first by name. Repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from crawlgrain.llm.common import kept_columns, read_table

#: Notices by which public licences are usually named in a text.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Least Dice coefficient in hundredths.
LEAST = 80


def normalise(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def bigrams(text: str) -> list[str]:
    words = normalise(text).split(" ")
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: int = LEAST, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) plus ``license``, ``dice`` and ``licenses`` found in ``text``."""
    grams = {name: bigrams(text) for name, text in sorted((templates or TEMPLATES).items())}
    grams = {name: own for name, own in grams.items() if own}
    if not grams:
        raise ValueError("no template has two words")
    sizes = [len(own) for own in grams.values()]
    # 2 * min(n, m) / (n + m) >= least / 100 bounds a segment's n by a template's m.
    lo, hi = (lambda m: -(-m * least // (200 - least))), (lambda m: m * (200 - least) // least)
    # Repeated bigrams make a segment longer in words than in bigrams, so words bound it from below only.
    fewest = min(map(lo, sizes)) + 1
    rows = ", ".join(f"named_struct('name', {_quoted(name)}, 'grams', array({', '.join(map(_quoted, own))}))"
                     for name, own in grams.items())
    made = ("license", "dice", "licenses")
    kept = [f"`{c}`" for c in kept_columns(docs, made) if keep is None or c in keep]
    # Runs of blanks become one space; line ends stay, with the blanks around them cut off.
    base = docs.selectExpr(*kept, "regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' '), ' ?\\n ?', '\\n') AS __text")
    parts = base.selectExpr(
        *kept, "array_distinct(transform(concat(split(__text, '\\n'), transform(split(__text, '\\n\\n+'), p -> replace(p, '\\n', ' ')),"
               " array(replace(__text, '\\n', ' '))), s -> trim(regexp_replace(s, ' +', ' ')))) AS __segments")
    sized = parts.selectExpr(
        *kept, f"filter(__segments, s -> length(s) - length(replace(s, ' ', '')) + 1 >= {fewest}) AS __segments")
    grammed = sized.selectExpr(
        *kept, "transform(transform(__segments, s -> split(s, ' ')), w -> array_distinct(transform(sequence(1, size(w) - 1),"
               " i -> concat(w[i - 1], ' ', w[i])))) AS __grams")
    near = grammed.selectExpr(
        *kept, f"filter(__grams, g -> size(g) BETWEEN {min(map(lo, sizes))} AND {max(map(hi, sizes))}) AS __grams")
    scored = near.selectExpr(
        *kept, f"""array_sort(flatten(transform(__grams, g -> filter(
            transform(filter(array({rows}), t -> {200 - least} * size(g) >= {least} * size(t.grams)
                                                 AND {200 - least} * size(t.grams) >= {least} * size(g)),
                      t -> named_struct('less', -2.0D * size(array_intersect(g, t.grams)) / (size(g) + size(t.grams)),
                                        'name', t.name, 'two', 2 * size(array_intersect(g, t.grams)), 'all', size(g) + size(t.grams))),
            x -> 100 * x.two >= {least} * x.all)))) AS __found""")
    return scored.selectExpr(
        *kept, "get(__found, 0).name AS license", "round(-get(__found, 0).less, 6) AS dice",
        "array_join(array_sort(array_distinct(transform(__found, x -> x.name))), ',') AS licenses")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def oracle(templates: dict[str, str] = TEMPLATES, least: int = LEAST) -> str:
    """The same by joins over exploded segments and bigrams, without any pruning."""
    rows = ", ".join(f"({_quoted(name)}, {_quoted(gram)})" for name, text in templates.items() for gram in bigrams(text))
    return rf"""
WITH templates(name, gram) AS (VALUES {rows}), m AS (SELECT name, count(*) AS m FROM templates GROUP BY name),
n AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS t FROM documents),
c AS (SELECT r, regexp_replace(t, ' ?\n ?', chr(10), 'g') AS t FROM n),
s AS (SELECT r, unnest(list_distinct(list_transform(list_concat(list_concat(string_split(t, chr(10)),
             list_transform(regexp_split_to_array(t, '\n\n+'), lambda p: replace(p, chr(10), ' '))), [replace(t, chr(10), ' ')]),
             lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))))) AS s FROM c),
w AS (SELECT r, s, string_split(s, ' ') AS w FROM s),
g AS (SELECT DISTINCT r, s, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT r, s, w, unnest(range(1, len(w))) AS i FROM w)),
k AS (SELECT r, s, count(*) AS n FROM g GROUP BY r, s),
hits AS (SELECT g.r, g.s, name, count(*) AS common FROM g JOIN templates USING (gram) GROUP BY ALL),
f AS (SELECT r, name, max(2.0 * common / (n + m)) AS dice FROM hits JOIN k USING (r, s) JOIN m USING (name)
      WHERE 200 * common >= {least} * (n + m) GROUP BY r, name),
best AS (SELECT r, first(name ORDER BY dice DESC, name) AS license, round(max(dice), 6) AS dice,
                string_agg(name, ',' ORDER BY name) AS licenses FROM f GROUP BY r)
SELECT doc_id, license, CAST(dice AS DOUBLE) AS dice, coalesce(licenses, '') AS licenses FROM n LEFT JOIN best USING (r)
"""
