"""Operator 8, license scans: MinHash bands over overlapping windows, then exact containment.

Words are runs of letters and digits in lower case, shingles are ``SHINGLE`` words. A template of n
shingles is looked up by windows of 1, 4 or 16 shingles, the longest size of which every intact copy
holds an aligned window. Windows of a document overlap (steps 1, 2 and 8); windows of a template
start at each of its shingles. A window's signature is the minimum of each of ``BANDS`` hash
functions, and each minimum is a band of one row: windows of resemblance s meet with probability
1 - (1 - s) ** BANDS, which is 0.9984 at 0.8 and 1 for equal windows. A match is accepted if at
least ``CONTAINMENT`` of the template's different shingles occur in the document near the place
that the window points to.

Everything runs as DataFrame expressions. Where the library is small (its values and bytes are counted, see
``SMALL_LIBRARY`` and ``SMALL_BYTES``), its minima are part of the plan: documents are not shuffled, and only hits are
joined with the templates. A larger library is a table: the windows' minima of documents and templates
are joined by level and band, and hits fetch shingles by row. Both ways give equal results.

Edge cases: a null text, and a text of fewer than five words, has no match; a repeated row has
matches of its own, under a row id that is dropped; several places with the same template give the
best one, the first of equals; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

SHINGLE = 5
BANDS = 4
CONTAINMENT = 0.8
SMALL_LIBRARY = 20_000
#: Bytes of windows and shingles that are broadcast.
SMALL_BYTES = 32 << 20
#: Window size in shingles, step in a document, least shingles of a template that uses it.
LEVELS = ((1, 1, 1), (4, 2, 5), (16, 8, 23))

# Public license notices (id, license, text).
TEMPLATES = [
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-licensed", "MIT", "Licensed under the MIT License."),
    ("mit-notice", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-line", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-line", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("bsd-notice", "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


def template_table(spark: SparkSession, templates: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    if isinstance(templates, DataFrame):
        return templates.select("template", "license", "text")
    rows = [F.struct(F.lit(a).alias("template"), F.lit(b).alias("license"), F.lit(c).alias("text")) for a, b, c in templates]
    return spark.range(1).select(F.inline(F.array(*rows)))


def with_shingles(df: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """``carry`` and ``sh``, the hash of each shingle in order (null where there is none)."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = df.select(*carry, F.transform(words, lambda w: F.xxhash64(w)).alias("__w"))
    run = F.transform(F.sequence(F.lit(0), F.size("__w") - SHINGLE), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(SHINGLE)]))
    return hashed.select(*carry, F.when(F.size("__w") >= SHINGLE, run).alias("sh"))


def _run(n: Column, size: int, step: int) -> Column:
    """Starts of the windows of ``size`` among ``n`` things."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))


def _seeded(j: int) -> Column:
    return F.transform("sh", lambda s: F.xxhash64(s, F.lit(j)))


def _least_of_four(array: str, starts: Column, apart: int) -> Column:
    return F.transform(starts, lambda i: F.least(*[F.get(array, i + k * apart) for k in range(4)]))


def with_minima(df: DataFrame, carry: list[str], steps: tuple[int, int]) -> DataFrame:
    """Minima of each hash function over windows: a1_0 (the shingle itself), a4_j and a16_j."""
    kept = [*carry, "sh"]
    out = df.select(*kept, *[_seeded(j).alias(f"h{j}") for j in range(BANDS)])
    out = out.select(*kept, *[_least_of_four(f"h{j}", _run(F.size(f"h{j}"), 4, steps[0]), 1).alias(f"a4_{j}") for j in range(BANDS)])
    # Sixteen shingles are four neighbouring windows of four.
    apart = 4 // steps[0]
    sixteen = [_least_of_four(f"a4_{j}", _run(F.size(f"a4_{j}"), 3 * apart + 1, steps[1] // steps[0]), apart).alias(f"a16_{j}") for j in range(BANDS)]
    return out.select(*kept, F.col("sh").alias("a1_0"), *[f"a4_{j}" for j in range(BANDS)], *sixteen)


def _arrays() -> list[tuple[int, int, int]]:
    """(level, band, step in a document) of each array of minima."""
    return [(size, j, step) for size, step, _ in LEVELS for j in range(1 if size == 1 else BANDS)]


def template_shingles(spark: SparkSession, templates: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """template, license, t_sh: a row for each template with a shingle."""
    base = with_shingles(template_table(spark, templates), "text", ["template", "license"])
    # Grouped before the filter, which else is pushed into the shingles' expressions and computes them for each word.
    return base.groupBy("template", "license").agg(F.first("sh").alias("t_sh")).filter("t_sh is not null")


def template_windows(shingles: DataFrame) -> DataFrame:
    """template, license, level, band, t_start, value, t_before: all windows of each template, a few dozen bytes each.

    ``t_before`` is the value of the window one document step earlier (null where there is none).
    """
    base = shingles.withColumnRenamed("t_sh", "sh")
    made = with_minima(base, ["template", "license"], (1, 1))
    n = F.size("sh")
    level = F.lit(LEVELS[0][0])
    for size, _, least in LEVELS[1:]:
        level = F.when(n >= least, size).otherwise(level)

    def listed(size: int, j: int, step: int) -> Column:
        a = f"a{size}_{j}"
        return F.transform(F.col(a), lambda v, i: F.struct(F.lit(size).alias("level"), F.lit(j).alias("band"), i.alias("t_start"), v.alias("value"), F.when(i >= step, F.get(a, i - step)).alias("t_before")))

    windows = [listed(*x) for x in _arrays()]
    return made.select("template", "license", level.alias("__level"), F.inline(F.concat(*windows))).filter("level = __level").drop("__level")


def _first_hits(hits: DataFrame) -> DataFrame:
    """Hits whose window does not go on from another hit: one that follows, window by window, points to the same place of the same template."""
    return hits.filter(~F.coalesce(F.col("before") == F.col("t_before"), F.lit(False)))


def _small_library(made: DataFrame, windows: DataFrame, shingles: DataFrame, arrays: list[tuple[int, int, int]], known: dict) -> DataFrame:
    """Hits (row, key, sh, and a template's window), the library's minima being literals of the plan."""
    literal = {x: F.array(*[F.lit(v) for v in sorted(known[x])]) for x in known}
    names = [f"a{size}_{j}" for size, j, _ in arrays]
    shared = [F.array_intersect(f"a{size}_{j}", literal[size, j]).alias(f"c{size}_{j}") for size, j, _ in arrays]
    made = made.select("__row", "__key", "sh", *names, *shared)
    none = F.expr("cast(array() as array<struct<level: int, band: int, start: int, value: bigint, before: bigint>>)")

    def hits(size: int, j: int, step: int) -> Column:
        a, c = f"a{size}_{j}", f"c{size}_{j}"
        places = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.array_contains(F.col(c), F.get(a, i)))
        found_here = F.transform(places, lambda i: F.struct(F.lit(size).alias("level"), F.lit(j).alias("band"), (i * step).alias("start"), F.get(a, i).alias("value"), F.when(i > 0, F.get(a, i - 1)).alias("before")))
        return F.when(F.size(c) > 0, found_here).otherwise(none)

    # Outer, so that no filter is inferred from the array, which would compute it twice.
    spread = made.select("__row", "__key", "sh", F.inline_outer(F.concat(*[hits(*x) for x in arrays])))
    return _first_hits(spread.join(F.broadcast(windows), ["level", "band", "value"])).join(F.broadcast(shingles), ["template", "license"])


def _large_library(made: DataFrame, windows: DataFrame, shingles: DataFrame, arrays: list[tuple[int, int, int]]) -> DataFrame:
    """The same hits by joins of tables; shingles are fetched for hits only."""
    made = materialize(made, "license-windows")

    def listed(size: int, j: int, step: int) -> Column:
        a = f"a{size}_{j}"
        return F.transform(F.col(a), lambda v, i: F.struct(F.lit(size).alias("level"), F.lit(j).alias("band"), (i * step).alias("start"), v.alias("value"), F.when(i > 0, F.get(a, i - 1)).alias("before")))

    spread = made.select("__row", F.explode(F.concat(*[listed(*x) for x in arrays])).alias("w")).select("__row", "w.*")
    hits = _first_hits(spread.join(windows, ["level", "band", "value"]))
    return hits.join(shingles, ["template", "license"]).join(made.select("__row", "__key", "sh"), "__row")


def scan_licenses(
    df: DataFrame, templates: list[tuple[str, str, str]] | DataFrame | None = None, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT, small_library: int = SMALL_LIBRARY
) -> DataFrame:
    """A row for each row of ``df`` and template found in it: key, template, license, containment, first_word.

    ``templates`` are rows or a table (template, license, text).
    """
    spark = df.sparkSession
    shingles = template_shingles(spark, TEMPLATES if templates is None else templates)
    windows = template_windows(shingles)
    numbered = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    made = with_minima(with_shingles(numbered, "__text", ["__row", "__key"]), ["__row", "__key"], (LEVELS[1][1], LEVELS[2][1]))
    # What would be broadcast is added up: 64 bytes a window, eight a shingle.
    values, rows = windows.agg(F.count_distinct("level", "band", "value"), F.count("*")).first()
    size = 64 * rows + 8 * (shingles.agg(F.sum(F.size("t_sh"))).first()[0] or 0)
    if values <= small_library * BANDS and size <= SMALL_BYTES:
        found = windows.groupBy("level", "band").agg(F.collect_set("value")).collect()
        known = {(r[0], r[1]): r[2] for r in found}
        joined = _small_library(made, windows, shingles, [x for x in _arrays() if x[:2] in known], known)
    else:
        joined = _large_library(made, materialize(windows, "license-templates"), shingles, _arrays())
    n = F.size("t_sh")
    room = F.greatest(F.lit(8), (n / 4).cast("int"))
    begin = F.greatest(F.col("start") - F.col("t_start") - room, F.lit(0))
    region = F.slice("sh", begin + 1, n + 2 * room)
    share = F.size(F.array_intersect("t_sh", region)) / F.size(F.array_distinct("t_sh"))
    placed = joined.select("__row", "__key", "template", "license", share.alias("containment"), F.greatest(F.col("start") - F.col("t_start"), F.lit(0)).alias("first_word"))
    best = placed.filter(F.col("containment") >= containment).groupBy("__row", "__key", "template", "license").agg(F.max(F.struct(F.col("containment"), (-F.col("first_word")).alias("back"))).alias("best"))
    return best.select(F.col("__key").alias(key), "template", "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).cast("long").alias("first_word"))
