"""License scans by MinHash bands over overlapping text windows, in DataFrame operations only.

1. Words are ASCII-lower-cased runs of letters and digits; a shingle is five of them. Templates of similar length make
   a class. A class has windows of its longest template's length L plus a stride of L / 4, less one, at every stride,
   so every run of L words lies in a window whole.
2. A window that holds 80 % of a template's m shingles has a Jaccard similarity of at least
   0.8 m / (window shingles + 0.2 m) with it. Each class takes as many bands, of one MinHash value each, as make the
   chance that such a window agrees with the template in none of them less than MISS.
3. Windows of which a band value is one of the templates' are taken out of their documents and joined with the table of
   bands: that retrieves templates. They are verified: the window's distinct shingles, as words, are intersected with the
   template's. The best window of each template counts, the first of equally good ones.

A document that lacks a template's anchors can't hold 80 % of its shingles: anchors are words of which each covers the
shingles it is in, chosen until over 20 % are covered. Documents without any anchor are passed over by plain substring
search, windows without one are left out. All but the retrieved windows stays within its row, so no skew of the documents matters; of templates the plan
holds the band values and anchors alone. Their table is broadcast if it is smaller than BROADCAST bytes, joined by its
keys otherwise.

Null and empty texts match nothing. Each row of the table is scanned for itself, copies and repeated ids too. Extra
columns are ignored; an empty table gives no rows. Templates under five words are refused.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, NEED, MISS, BROADCAST = 5, 0.8, 1e-6, 4 << 20

#: Notices by which texts state a licence, by SPDX identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
    " the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    " You may obtain a copy of the License at",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,'
    " distribute, sublicense, and/or sell copies of the Software",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]

    @property
    def shingles(self) -> list[str]:
        return list(dict.fromkeys(" ".join(self.words[i : i + SHINGLE]) for i in range(len(self.words) - SHINGLE + 1)))

    @property
    def needed(self) -> int:
        """The least number of shared shingles that is 80 % of them."""
        return -(-len(self.shingles) * 8 // 10)


@dataclass(frozen=True)
class Class:
    templates: tuple[Template, ...]
    shortest: int
    longest: int

    @property
    def stride(self) -> int:
        return max(1, self.longest // 4)

    @property
    def window(self) -> int:
        return self.longest + self.stride - 1

    @property
    def bands(self) -> int:
        inside = self.window - SHINGLE + 1
        least = min(t.needed / (inside + len(t.shingles) - t.needed) for t in self.templates)
        return 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least))


def parse(templates: dict[str, str]) -> list[Template]:
    out = [Template(k, tuple(x for x in re.split(BETWEEN, v.translate(str.maketrans(UPPER, LOWER))) if x)) for k, v in templates.items()]
    if short := [t.name for t in out if len(t.words) < SHINGLE]:
        raise ValueError(f"templates of under {SHINGLE} words: {short}")
    return sorted(out, key=lambda t: (len(t.words), t.name))


def classes(templates: list[Template]) -> list[Class]:
    """Consecutive lengths up to a quarter more than the shortest."""
    groups: list[list[Template]] = []
    for t in templates:
        if groups and len(t.words) <= len(groups[-1][0].words) * 1.25:
            groups[-1].append(t)
        else:
            groups.append([t])
    return [Class(tuple(g), len(g[0].words), len(g[-1].words)) for g in groups]


def anchors(templates: list[Template]) -> list[str]:
    """Words of which every text with a match holds one."""
    chosen: list[str] = []
    spread = Counter(w for t in templates for w in set(t.words))
    for t in templates:
        hit: set[str] = set()

        def covered(word: str, t: Template = t) -> set[str]:
            return {s for s in t.shingles if word in s.split(" ")}

        for w in chosen:
            hit |= covered(w)
        while len(hit) <= len(t.shingles) - t.needed:
            best = max(set(t.words) - set(chosen), key=lambda w: (len(w) >= 7, len(covered(w) - hit) > 0, spread[w], len(w), w))
            chosen.append(best)
            hit |= covered(best)
    return chosen


def _hashed(k: int) -> Column:
    """The shingles' hashes under hash function k."""
    return F.transform("g", lambda x: F.xxhash64(F.lit(k), x))


def _holds_one(text: Column, words: list[str]) -> Column:
    """Whether the text, in lower case, holds one of the words; in an array of one it is lower-cased once."""

    def one(low: Column) -> Column:
        out = low.contains(words[0])
        for w in words[1:]:
            out = out | low.contains(w)
        return out

    return F.exists(F.array(F.lower(text)), one)


def _band_table(spark: SparkSession, grouped: list[Class]) -> DataFrame:
    """(class, band, value, template, shingles, needed) of all templates: MinHash values by the scan's own functions."""
    rows = [(number, c.bands, t.name, t.shingles, [s.split(" ") for s in t.shingles], t.needed) for number, c in enumerate(grouped) for t in c.templates]
    own = spark.createDataFrame(rows, "class int, bands int, template string, shingles array<string>, s array<array<string>>, needed int")
    own = own.withColumn("g", F.transform("s", lambda s: F.xxhash64(*(F.get(s, F.lit(k)) for k in range(SHINGLE)))))
    values = F.array(*(F.struct(F.lit(k).alias("band"), F.array_min(_hashed(k)).alias("value")) for k in range(max(c.bands for c in grouped))))
    return own.select("class", "template", "shingles", "needed", F.explode(F.filter(values, lambda x: x["band"] < F.col("bands"))).alias("x")).select("class", "x.*", "template", "shingles", "needed")


def _retrieved(number: int, c: Class, values: dict[tuple[int, int], list[int]]) -> Column:
    """The windows of a row of which a band value is that of a template of the class: an array of (class, i, v, words)."""
    inside, words = c.window - SHINGLE + 1, ", ".join(f"'{x}'" for x in anchors(list(c.templates)))
    # windows that hold an anchor: with an anchor at p, those that begin at so many strides
    first, last = f"greatest(0, (p - {c.window} + {c.stride}) div {c.stride})", f"least(p div {c.stride}, greatest(0, n - {c.shortest}) div {c.stride})"
    starts = f"array_distinct(flatten(transform(filter(sequence(0, n - 1), p -> get(w, p) in ({words})), p -> sequence({first}, {last}))))"
    least = f"array({', '.join(f'array_min(slice(h{k}, {c.stride} * s + 1, {inside}))' for k in range(c.bands))})"
    windows = F.expr(f"transform({starts}, s -> struct({c.stride} * s as i, {least} as v))")

    def agrees(x: Column) -> Column:
        out = x["v"][0].isin(values[number, 0])
        for k in range(1, c.bands):
            out = out | x["v"][k].isin(values[number, k])
        return out

    def taken(x: Column) -> Column:
        return F.struct(F.lit(number).alias("class"), x["i"].alias("i"), x["v"].alias("v"), F.slice("w", x["i"] + 1, F.lit(c.window)).alias("words"))

    return F.transform(F.filter(windows, agrees), taken)


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) and each template that one of its windows contains by 80 % or more:
    doc_id, template, start (the best window's first word), shared, n_shingles, containment."""
    parsed = parse(TEMPLATES if templates is None else templates)
    grouped = classes(parsed)
    spark = docs.sparkSession
    # a few rows for each template, made by the driver itself
    table = _band_table(spark, grouped)
    values: dict[tuple[int, int], list[int]] = {}
    for r in table.select("class", "band", "value").collect():
        values.setdefault((r["class"], r["band"]), []).append(r["value"])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    d = own.where(_holds_one(F.col("text"), anchors(parsed))).select("doc_id", "row", F.filter(F.split(F.translate("text", UPPER, LOWER), BETWEEN), lambda x: x != "").alias("w"))
    d = d.withColumn("n", F.size("w")).where(F.col("n") >= SHINGLE)
    d = d.withColumn("g", F.transform(F.sequence(F.lit(0), F.col("n") - SHINGLE), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(SHINGLE)))))
    d = d.select("*", *(_hashed(k).alias(f"h{k}") for k in range(max(c.bands for c in grouped))))
    windows = d.select("doc_id", "row", F.explode(F.concat(*(_retrieved(number, c, values) for number, c in enumerate(grouped)))).alias("x")).select("doc_id", "row", "x.class", "x.i", "x.words", F.posexplode("x.v").alias("band", "value"))
    size = sum(len(s) + 16 for t in parsed for s in t.shingles) * max(c.bands for c in grouped)
    met = windows.join(F.broadcast(table) if size < BROADCAST else table, ["class", "band", "value"])
    shingles = F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda j: F.array_join(F.slice("words", j + 1, SHINGLE), " "))
    held = F.size(F.array_intersect(F.when(F.size("words") >= SHINGLE, shingles), F.col("shingles")))
    hits = met.select("doc_id", "row", "template", "i", held.alias("shared"), F.size("shingles").alias("m"), "needed").where("shared >= needed")
    best = hits.groupBy("row", "doc_id", "template", "m").agg(F.max(F.struct("shared", (-F.col("i")).alias("i"))).alias("x"))
    return best.select("doc_id", "template", (-F.col("x.i")).cast("long").alias("start"), F.col("x.shared").cast("long").alias("shared"), F.col("m").cast("long").alias("n_shingles"), (F.col("x.shared") / F.col("m")).alias("containment"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _oracle() -> str:
    """Every window that shares a shingle, without bands."""
    rows = [(t.name, s, len(t.shingles), t.needed, c.stride, c.window - SHINGLE + 1, c.shortest) for c in classes(parse(TEMPLATES)) for t in c.templates for s in t.shingles]
    values = ", ".join(f"('{a}', '{b}', {c}, {d}, {e}, {f}, {g})" for a, b, c, d, e, f, g in rows)
    return f"""
WITH t(template, shingle, m, needed, stride, inside, least) AS (VALUES {values}),
w AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n, unnest(range(0, len(w) - {SHINGLE - 1})) AS p, w FROM w WHERE len(w) >= {SHINGLE}),
g AS (SELECT doc_id, n, p, array_to_string(w[p + 1 : p + {SHINGLE}], ' ') AS shingle FROM s),
m AS (SELECT doc_id, n, p, t.* FROM g JOIN t USING (shingle)),
i AS (SELECT *, unnest(range(greatest(0, (p - inside + stride) // stride) * stride, p + 1, stride)) AS start FROM m),
c AS (SELECT doc_id, template, m, needed, start, count(DISTINCT shingle) AS shared FROM i
      WHERE start <= greatest(0, n - least) AND start >= p - inside + 1 GROUP BY ALL),
b AS (SELECT doc_id, template, m, max(shared) AS shared, min(start) FILTER (shared = best) AS start
      FROM (SELECT *, max(shared) OVER (PARTITION BY doc_id, template) AS best FROM c WHERE shared >= needed) GROUP BY ALL)
SELECT doc_id, template, start, shared, m::BIGINT AS n_shingles, shared / m AS containment FROM b
"""


ORACLE = _oracle()
