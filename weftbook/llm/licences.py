"""Licence scan: text units compared with licence notices by the Dice coefficient over sets of word bigrams.

Column expressions only, one pass without a shuffle.  A unit (a line, or the whole text) with m bigrams can reach Dice t with a
template of n only if t / (2 - t) <= m / n <= (2 - t) / t; templates outside these bounds are never compared.

Passages are runs of words that begin and end anywhere, over line ends too.  A run can reach t only if it holds t / (2 - t) * n of the
template's bigrams, so only templates of which the whole text holds as many are sought; the best run begins and ends with a bigram
of the template, so only runs between two such are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = 0.8
WHOLE = -1
WORDS = r"[\p{L}\p{N}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Notices by which works name their licence.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
     "whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORDS), 0)


def _neighbours(found: Column) -> Column:
    many = F.greatest(F.size(found) - 1, F.lit(0))
    return F.zip_with(F.slice(found, F.lit(1), many), F.slice(found, F.lit(2), many), lambda a, b: F.concat_ws(" ", a, b))


def bigrams(found: Column) -> Column:
    """Distinct neighbouring pairs of a list of words."""
    return F.array_distinct(_neighbours(found))


def _template_column(templates: tuple[tuple[str, str], ...]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("licence"),
                bigrams(words(F.lit(text))).alias("pairs"),
                F.size(_neighbours(words(F.lit(text)))).alias("places"),
            )
            for name, text in templates
        ]
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _passages(template: Column, found: Column, least: float) -> Column:
    """Places of one template in the words of the lines that matched nothing: the best of runs that overlap, from left to right."""
    low, high = least / (2 - least), (2 - least) / least
    n = F.size(template["pairs"])
    need, span = F.ceil(n * F.lit(low) - 1e-9).cast("int"), F.floor(template["places"] * F.lit(high) + 1e-9).cast("int")
    gone = F.transform(found, lambda m: m["unit"])
    rest = F.flatten(F.transform("lines", lambda line, i: F.when(F.array_contains(gone, i), F.array(F.lit("\n"))).otherwise(line)))
    unit = F.flatten(
        F.transform("lines", lambda line, i: F.array_repeat(i, F.when(F.array_contains(gone, i), F.lit(1)).otherwise(F.size(line))))
    )

    def scored(pairs: Column, first: Column, last: Column) -> Column:
        less = _let(
            F.array_distinct(F.slice(pairs, first + 1, last - first + 1)),
            lambda run: F.lit(-2.0) * F.size(F.array_intersect(run, template["pairs"])) / (F.size(run) + n),
        )
        return F.struct(less.alias("less"), first.alias("first"), last.alias("last"))

    def runs(pairs: Column, hits: Column) -> Column:
        def from_hit(first: Column, k: Column) -> Column:
            ends = F.when(F.get(hits, k + need - 1) - first < span, F.slice(hits, k + need, span)).otherwise(F.slice(hits, 1, 0))
            return F.transform(F.filter(ends, lambda last: last - first < span), lambda last: scored(pairs, first, last))

        return F.filter(F.flatten(F.transform(hits, from_hit)), lambda r: r["less"] <= -least)

    def best(all_runs: Column) -> Column:
        # The last place may still be bettered; a run behind it opens the next.
        def step(places: Column, run: Column) -> Column:
            last = F.get(places, F.size(places) - 1)
            better = F.concat(F.slice(places, F.lit(1), F.size(places) - 1), F.array(run))
            opened = F.concat(places, F.array(run))
            return (
                F.when((F.size(places) == 0) | (run["first"] > last["last"]), opened)
                .when(run["less"] < last["less"], better)
                .otherwise(places)
            )

        return F.aggregate(all_runs, F.slice(all_runs, 1, 0), step)

    def sought(pairs: Column) -> Column:
        hits = F.filter(
            F.transform(pairs, lambda pair, i: F.when(F.array_contains(template["pairs"], pair), i)), lambda i: i.isNotNull()
        )
        return _let(hits, lambda h: _let(runs(pairs, h), best))

    places = _let(rest, lambda w: _let(_neighbours(w), sought))
    return _let(
        unit,
        lambda u: F.transform(
            places,
            lambda r: F.struct(r["less"].alias("less"), F.get(u, r["first"]).alias("unit"), template["licence"].alias("licence")),
        ),
    )


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = DICE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_units, n_matches, licence, dice, unit and all matches.

    Units are the lines of a text, numbered from 0, and the whole text (number -1) if it has more than one line; units without
    two words are no units.  Besides, passages of the lines that match nothing are matches, under the line in which they
    begin: a notice wrapped over lines, or within a longer line; not of a licence that the whole text matches.  The whole text is
    no further match of a licence that one of its lines matches.  licence, dice and unit are those of the best match (highest
    Dice, then first unit, then licence name) and null without one.  Null and empty texts have no unit; repeated rows and null ids are rows
    like any other; other columns are ignored; an empty table gives no rows.
    """
    low, high = least / (2 - least), (2 - least) / least
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), words)
    whole = F.when(
        F.size("lines") > 1, F.array(F.struct(F.lit(WHOLE).alias("unit"), bigrams(F.flatten("lines")).alias("pairs")))
    ).otherwise(F.expr("CAST(array() AS array<struct<unit:int,pairs:array<string>>>)"))
    single = F.transform("lines", lambda line, i: F.struct(i.alias("unit"), bigrams(line).alias("pairs")))

    def against(unit: Column) -> Column:
        size = F.size(unit["pairs"])
        near = F.filter(
            "templates",
            lambda t: (size >= F.size(t["pairs"]) * F.lit(low)) & (size <= F.size(t["pairs"]) * F.lit(high)),
        )
        scored = F.transform(
            near,
            lambda t: F.struct(
                (F.lit(-2.0) * F.size(F.array_intersect(unit["pairs"], t["pairs"])) / (size + F.size(t["pairs"]))).alias("less"),
                unit["unit"].alias("unit"),
                t["licence"].alias("licence"),
            ),
        )
        return F.filter(scored, lambda m: m["less"] <= -least)

    def within(pairs: Column) -> Column:
        """Templates that may stand somewhere in a text with these bigrams."""
        known = F.array_distinct(F.flatten(F.transform("templates", lambda t: t["pairs"])))
        return _let(
            F.array_intersect(pairs, known),
            lambda held: F.filter(
                "templates", lambda t: F.size(F.array_intersect(held, t["pairs"])) >= F.size(t["pairs"]) * F.lit(low) - F.lit(1e-9)
            ),
        )

    line_found = F.transform(F.filter("found", lambda m: m["unit"] != WHOLE), lambda m: m["licence"])

    def counted(match: Column) -> Column:
        return (match["unit"] != WHOLE) | ~F.array_contains(line_found, match["licence"])

    whole_found = F.transform(F.filter("found", lambda m: m["unit"] == WHOLE), lambda m: m["licence"])
    more = F.flatten(
        F.transform(
            F.filter("within", lambda t: ~F.array_contains(whole_found, t["licence"])), lambda t: _passages(t, F.col("found"), least)
        )
    )
    return (
        docs.select(F.col("doc_id").cast("long"), lines.alias("lines"))
        .select("doc_id", "lines", F.concat(single, whole).alias("units"), _template_column(templates).alias("templates"))
        .withColumn("within", within(F.element_at("units", -1)["pairs"]))
        .withColumn("units", F.filter("units", lambda u: F.size(u["pairs"]) > 0))
        .select(
            "doc_id", "lines", "within", F.size("units").cast("long").alias("n_units"),
            F.flatten(F.transform("units", against)).alias("found"),
        )
        .select("doc_id", "n_units", F.concat(F.filter("found", counted), more).alias("found"))
        .withColumn("best", F.array_min("found"))
        .select(
            "doc_id",
            "n_units",
            F.size("found").cast("long").alias("n_matches"),
            F.col("best.licence").alias("licence"),
            (-F.col("best.less")).alias("dice"),
            F.col("best.unit").cast("long").alias("unit"),
            F.transform(
                "found", lambda m: F.struct(m["unit"].alias("unit"), m["licence"].alias("licence"), (-m["less"]).alias("dice"))
            ).alias("matches"),
        )
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = DICE) -> str:
    """The scan's figures per document in DuckDB SQL, by lines and whole texts only: passages are not in it."""
    pairs = "list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])"
    cut = {x: f"regexp_extract_all(translate({x}, '{UPPER}', '{LOWER}'), '{WORDS}')" for x in ("t", "x", "line")}
    values = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in templates)
    return f"""
WITH t AS (
  SELECT licence, {pairs} AS tp FROM (SELECT licence, {cut['t']} AS w FROM (VALUES {values}) v(licence, t))
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents
), l AS (
  SELECT rid, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) - 1 AS unit FROM d
), u AS (
  SELECT rid, unit, {pairs} AS up FROM (
    SELECT rid, unit, {cut['line']} AS w FROM l
    UNION ALL SELECT rid, {WHOLE}, {cut['x']} FROM d WHERE contains(x, chr(10)))
), m AS (
  SELECT rid, unit, licence, 2.0::DOUBLE * len(list_intersect(up, tp)) / (len(up) + len(tp)) AS dice
  FROM u, t WHERE len(up) > 0 AND len(up) >= len(tp) * {low_bound(least)}::DOUBLE AND len(up) <= len(tp) * {high_bound(least)}::DOUBLE
), b AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, unit, licence) AS place, count(*) OVER (PARTITION BY rid) AS n
  FROM m WHERE dice >= {least}::DOUBLE AND NOT (unit = {WHOLE} AND EXISTS (
    SELECT 1 FROM m o WHERE o.rid = m.rid AND o.licence = m.licence AND o.unit <> {WHOLE} AND o.dice >= {least}::DOUBLE))
)
SELECT d.doc_id, coalesce(c.n, 0) AS n_units, coalesce(b.n, 0) AS n_matches, b.licence, b.dice, b.unit::BIGINT AS unit
FROM d LEFT JOIN (SELECT rid, count(*) AS n FROM u WHERE len(up) > 0 GROUP BY rid) c USING (rid)
LEFT JOIN b ON b.rid = d.rid AND b.place = 1"""


def low_bound(least: float) -> float:
    return least / (2 - least)


def high_bound(least: float) -> float:
    return (2 - least) / least
