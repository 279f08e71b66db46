"""Licence scans: Dice coefficient over word bigrams against licence templates.

Units of a document are its runs of consecutive lines (blank ones don't count) of at most
``most_words`` words, the largest size that can match; so a notice is found in a line, wrapped
over lines, or set in paragraphs, whatever stands around it.  A unit is normalised (lower case;
anything but a-z and 0-9 is a space) and compared with each template by
``2 * shared / (a + b)`` over the sets of word bigrams, where ``a`` and ``b`` are the sizes of
the sets.  As that is at most ``2 * min(a, b) / (a + b)``, a template is a candidate only for
units whose size is in [b * t / (2 - t), b * (2 - t) / t] for threshold t.

A second bound prunes units and loses nothing either: a match shares more than
b * t / (2 - t) bigrams of the template, so it can't miss every word of a set of words that
touches the rest of them; units without any such word are left out before bigrams are made.

Only DataFrame functions are used, and rows are handled by themselves: no shuffle.  A line is
in few units, as their words are bounded, so the work grows with the text.

Defined results: null, empty and one-word texts match nothing; a notice within a longer line
matches as far as the line's other words allow; repeated rows each match; ties between
templates are all reported; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: licence notices and permission texts
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0-notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "Licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised template, in order."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def required_words(bigrams: list[str], threshold: float) -> set[str]:
    """Words of which a match must hold one: too many bigrams touch them for all to be missing."""
    most_missing = len(bigrams) - len(bigrams) * threshold / (2 - threshold)
    left, chosen = list(bigrams), set()
    words = {w for b in bigrams for w in b.split()}
    while len(bigrams) - len(left) <= most_missing:
        # long words occur in few documents
        best = max(sorted(words - chosen), key=lambda w: (sum(w in b.split() for b in left) > 0, len(w)))
        chosen.add(best)
        left = [b for b in left if best not in b.split()]
    return chosen


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _bounds(grams: dict[str, list[str]], threshold: float) -> dict[str, tuple[float, float]]:
    """Least and most bigrams of a unit that can match each template."""
    return {name: (len(g) * threshold / (2 - threshold) - 1e-9, len(g) * (2 - threshold) / threshold + 1e-9) for name, g in grams.items()}


def most_words(grams: dict[str, list[str]], threshold: float) -> int:
    """Words of the largest unit: one more than the most bigrams that can match."""
    return 1 + int(max(most for _, most in _bounds(grams, threshold).values()))


def scan(docs: DataFrame, *, threshold: float = 0.8, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each document and template that match: doc_id, license, dice (the largest)."""
    grams = {name: template_bigrams(text) for name, text in templates.items()}
    bounds = _bounds(grams, threshold)
    needed = sorted(set().union(*(required_words(g, threshold) for g in grams.values())))
    smallest, largest = min(b[0] for b in bounds.values()), max(b[1] for b in bounds.values())
    most = most_words(grams, threshold)
    every = F.array(*(F.lit(g) for g in sorted({g for own in grams.values() for g in own})))
    required = F.array(*(F.lit(w) for w in needed))
    strings, numbers = F.array().cast("array<string>"), F.array().cast("array<int>")
    lines = F.filter(F.transform(F.split(_lowered(F.coalesce("text", F.lit(""))), "\n"), lambda u: F.regexp_extract_all(u, F.lit("[a-z0-9]+"), F.lit(0))), lambda w: F.size(w) > 0)
    has = F.col("text").rlike("(?i)" + "|".join(needed))  # most texts have none of these words, not even within others

    def run(line: Column, at: Column) -> Column:
        """The words from a line on, up to ``most``, and after how many of them a line ends."""
        empty = F.struct(strings.alias("words"), numbers.alias("ends"), F.lit(True).alias("open"))

        def more(acc: Column, w: Column) -> Column:
            fits = acc["open"] & (F.size(acc["words"]) + F.size(w) <= most)
            return F.struct(
                F.when(fits, F.concat(acc["words"], w)).otherwise(acc["words"]).alias("words"),
                F.when(fits, F.concat(acc["ends"], F.array(F.size(acc["words"]) + F.size(w)))).otherwise(acc["ends"]).alias("ends"),
                fits.alias("open"),
            )

        return F.aggregate(F.slice("_lines", at + 1, F.lit(most)), empty, more)

    with_lines = docs.filter(has).select("doc_id", lines.alias("_lines"))
    # the outer forms, as for the others Spark would compute the arrays once more to test for rows
    runs = F.filter(F.transform("_lines", run), lambda r: F.arrays_overlap(r["words"], required))
    started = with_lines.select("doc_id", F.explode_outer(runs).alias("r")).filter("r is not null")
    units = F.filter(F.transform(F.filter(F.col("r.ends"), lambda e: e > smallest), lambda e: F.slice(F.col("r.words"), F.lit(1), e)), lambda w: F.arrays_overlap(w, required))
    bigrams = F.transform(units, lambda w: F.array_distinct(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda v, i: F.concat_ws(" ", F.get(w, i), v))))
    shared = F.transform(bigrams, lambda g: F.struct(F.size(g).alias("n"), F.array_intersect(g, every).alias("bigrams")))
    likely = F.filter(shared, lambda h: (h["n"] >= smallest) & (h["n"] <= largest) & (F.size(h["bigrams"]) >= smallest))
    sized = started.select("doc_id", F.explode_outer(likely).alias("u")).filter("u is not null").select("doc_id", "u.n", "u.bigrams")
    compared = F.array(
        *(
            F.struct(
                F.lit(name).alias("license"),
                F.when(
                    (F.col("n") >= bounds[name][0]) & (F.col("n") <= bounds[name][1]),
                    2.0 * F.size(F.array_intersect("bigrams", F.array(*(F.lit(g) for g in own)))) / (F.col("n") + F.lit(len(own))),
                )
                .otherwise(0.0)
                .alias("dice"),
            )
            for name, own in grams.items()
        )
    )
    return (
        sized.select("doc_id", F.explode(F.filter(compared, lambda c: c["dice"] >= threshold)).alias("m"))
        .groupBy("doc_id", F.col("m.license").alias("license"))
        .agg(F.round(F.max("m.dice"), 6).alias("dice"))
    )


def oracle(threshold: float = 0.8, templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL of the same rows; units are pruned by their size in words only."""
    grams = {name: template_bigrams(text) for name, text in templates.items()}
    rows = ", ".join(f"('{name}', {own!r})" for name, own in grams.items())
    least = int(min(b[0] for b in _bounds(grams, threshold).values()))
    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(license, grams)),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(x, '[a-z0-9]+') AS ws, string_split(x, chr(10)) AS ls FROM d),
l AS (SELECT r, ix, n, sum(n) OVER (PARTITION BY r ORDER BY ix)::BIGINT AS last FROM (
      SELECT r, unnest(range(1, len(ls) + 1)) AS ix, unnest([len(regexp_extract_all(y, '[a-z0-9]+')) FOR y IN ls]) AS n FROM w) WHERE n > 0),
u AS (SELECT a.r, a.last - a.n + 1 AS first, b.last FROM l a JOIN l b ON a.r = b.r AND b.ix >= a.ix
      AND b.last - a.last + a.n BETWEEN {least + 1} AND {most_words(grams, threshold)}),
g AS (SELECT r, doc_id, list_distinct([v[i] || ' ' || v[i + 1] FOR i IN range(1, len(v))]) AS grams FROM (
      SELECT w.r, doc_id, ws[first:last] AS v FROM u JOIN w ON w.r = u.r)),
s AS (SELECT doc_id, license, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice FROM g, t
      WHERE 2.0 * least(len(g.grams), len(t.grams)) / (len(g.grams) + len(t.grams)) >= {threshold})
SELECT doc_id, license, round(max(dice), 6) AS dice FROM s WHERE dice >= {threshold} GROUP BY ALL"""
