"""Licence scans: lines and whole texts against licence templates by the Dice coefficient over word bigrams.

Normalised text: A-Z in lower case, everything but a-z, 0-9 and line ends as one space. A unit is a line, or a text of several
lines as a whole. Dice is ``2 * common / (unit + template)`` over distinct bigrams; it can reach a threshold t only if the unit
has between ``t / (2 - t)`` and ``(2 - t) / t`` times the template's bigrams, so a unit meets just the templates of its size.

Defined results: null or empty text and units of fewer than two words match nothing; a template matched by several units of a
document is one row, with the largest Dice and the number of units; rows that share a ``doc_id`` are one document; a null
``doc_id`` is kept as such; further columns do not matter; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Notices and opening texts of public licences.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 short notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 short notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense opening": "This is free and unencumbered software released into the public domain.",
}
MAX_TEMPLATE_BYTES = 1 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9\n]+", " ")


def bigrams(units: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``pairs``: the distinct word bigrams, as hashes, of each normalised ``unit`` of two words or more.

    The explode of one element is a fence: filters on its output stay above it, so each unit is cut and hashed once.
    """
    words = units.select(*keep, F.explode(F.array(F.filter(F.split("unit", "[ \n]+"), lambda w: w != ""))).alias("w")).filter(F.size("w") >= 2)
    pair = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))
    return words.select(*keep, F.explode(F.array(F.array_distinct(pair))).alias("pairs"))


def template_sizes(spark, templates: Mapping[str, str], threshold: float) -> DataFrame:
    """``n_unit, license, n_template, template``: each template under every unit size that can reach the threshold."""
    if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_BYTES} bytes are not broadcast")
    rows = spark.createDataFrame(list(templates.items()), "license string, body string")
    units = rows.select("license", normalised(F.col("body")).alias("unit"))
    sized = bigrams(units, "license").select("license", F.col("pairs").alias("template"), F.size("pairs").alias("n_template"))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    return sized.select(
        F.explode(F.sequence(F.greatest(F.lit(1), F.floor(F.col("n_template") * low).cast("int")), F.ceil(F.col("n_template") * high).cast("int"))).alias("n_unit"),
        "license", "n_template", "template",
    )


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """``doc_id, license, dice, n_units`` of every template that a unit of the document matches."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is at most 1")
    percent = math.ceil(threshold * 100)
    text = docs.select("doc_id", normalised(F.coalesce("text", F.lit(""))).alias("text"))
    lines = F.split("text", "\n")
    units = text.select("doc_id", F.explode(F.when(F.size(lines) > 1, F.concat(lines, F.array("text"))).otherwise(lines)).alias("unit"))
    near = bigrams(units, "doc_id").withColumn("n_unit", F.size("pairs")).join(F.broadcast(template_sizes(docs.sparkSession, templates, threshold)), "n_unit")
    common = F.size(F.array_intersect("pairs", "template"))
    hits = near.select("doc_id", "license", "n_unit", "n_template", common.alias("common")).filter(200 * F.col("common") >= percent * (F.col("n_unit") + F.col("n_template")))
    dice = 2.0 * F.col("common") / (F.col("n_unit") + F.col("n_template"))
    return hits.groupBy("doc_id", "license").agg(F.max(dice).alias("dice"), F.count(F.lit(1)).alias("n_units"))


def oracle(templates: Mapping[str, str] = TEMPLATES) -> str:
    """The same scan in DuckDB SQL at threshold 0.8, without size bounds."""
    quoted = ", ".join(f"('{k}', '{v}')" for k, v in templates.items())
    norm = f"regexp_replace(translate({{}}, '{UPPER}', '{LOWER}'), '[^a-z0-9' || chr(10) || ']+', ' ', 'g')"
    words = "list_filter(string_split_regex({}, '[ ' || chr(10) || ']+'), lambda w: w <> '')"
    pairs = "list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
        WITH templates(license, body) AS (VALUES {quoted}),
        t AS (SELECT license, {pairs} AS template FROM (SELECT license, {words.format(norm.format("body"))} AS w FROM templates) WHERE len(w) >= 2),
        n AS (SELECT doc_id, {norm.format("coalesce(text, '')")} AS text FROM documents),
        u AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM n
            UNION ALL SELECT doc_id, text FROM n WHERE contains(text, chr(10))
        ),
        s AS (SELECT doc_id, {pairs} AS pairs FROM (SELECT doc_id, {words.format("unit")} AS w FROM u) WHERE len(w) >= 2),
        c AS (SELECT doc_id, license, len(list_intersect(pairs, template)) AS common, len(pairs) + len(template) AS total FROM s, t)
        SELECT doc_id, license, max(2.0::DOUBLE * common / total) AS dice, count(*) AS n_units
        FROM c WHERE 200 * common >= 80 * total GROUP BY doc_id, license"""
