"""License scans, wholly as DataFrame expressions.

A license has one or more wordings: statements, tags and notices. Texts and wordings become shingles of WORDS words;
a wording of fewer words is one shingle of its own width k. A wording of m shingles belongs to the class of the least
width c >= m in a series with ratio 1.25; texts are cut, for each (k, c) in use, into windows of 2 c shingles at every
c-th shingle, so that some window holds any passage as long as the wording in whole. Each window gets BANDS MinHash
bands of one row, which retrieve wordings by a join with the wordings' bands: a window that holds THRESHOLD of a
wording resembles it by at least 0.75 / 2.75, so all bands miss with a chance below (1 - 0.27) ** 32 = 4e-5.
The distinct shingles that window and wording share are then counted exactly.

A band can only agree where the window holds the wording's least shingle; windows (and texts) without any wording's
shingle are left out before hashing, which changes no result.

Defined cases: words are runs of letters and digits, lower-cased, so punctuation doesn't matter; texts of fewer than k
words hold no shingle of that width; null and empty texts match nothing; long texts are scanned whole; rows that
repeat an id count as one document; an empty table gives an empty table; other columns don't matter; wordings
without words are refused.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a shingle; MinHash bands of a window; least share of a wording; ratio of window classes; wordings' bytes at most.
WORDS, BANDS, THRESHOLD, RATIO, MAX_TEMPLATE_BYTES = 5, 32, 0.75, 1.25, 4 << 20

#: The wordings of each license.
Templates = Mapping[str, str | Sequence[str]]


def versions(name: str, *numbers: str) -> list[str]:
    """How statements name a version of a license; at most three shingles each, so that no other version will do."""
    return [f"{name}{joint}{n}" for n in numbers for joint in (" ", " version ", " v. ", " v")]


def creative_commons(parts: str, words: str, number: str) -> list[str]:
    return [f"under CC {parts} {number}", f"under a CC {parts} {number}", f"Commons {words} {number} International", f"Commons {words} {number} Unported"]


#: Statements and notices of public licenses. Versions are told by wordings of few shingles, which must be
#: there in whole; a notice that differs between versions by a word or two has a row of its own, without version.
LICENSES: dict[str, str | list[str]] = {
    "AGPL-3.0": versions("Affero General Public License", "3"),
    "AGPL-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "under the Apache License 2.0", "under the Apache 2.0 license"],
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "Artistic-2.0": versions("the Artistic License", "2.0"),
    "BSD-2-Clause": ["under the BSD 2-Clause License", "under the 2-Clause BSD License", "under the Simplified BSD License"],
    "BSD-3-Clause": ["under the BSD 3-Clause License", "under the 3-Clause BSD License", "under the New BSD License", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0": versions("the Boost Software License", "1.0"),
    "CC-BY-4.0": creative_commons("BY", "Attribution", "4.0"),
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", *creative_commons("BY-NC", "Attribution-NonCommercial", "4.0")],
    "CC-BY-NC-ND-4.0": creative_commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "4.0"),
    "CC-BY-NC-SA-4.0": creative_commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "4.0"),
    "CC-BY-ND-4.0": creative_commons("BY-ND", "Attribution-NoDerivatives", "4.0"),
    "CC-BY-SA-3.0": creative_commons("BY-SA", "Attribution-ShareAlike", "3.0"),
    "CC-BY-SA-4.0": creative_commons("BY-SA", "Attribution-ShareAlike", "4.0"),
    "CC0-1.0": ["under CC0 1.0 Universal", "the CC0 1.0 Universal Public Domain Dedication"],
    "EPL-2.0": versions("the Eclipse Public License", "2.0"),
    "GPL-2.0": versions("GNU General Public License", "2"),
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", *versions("GNU General Public License", "3")],
    "GPL-notice": "under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": ["under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": versions("Lesser General Public License", "2.1"),
    "LGPL-3.0": versions("Lesser General Public License", "3"),
    "LGPL-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": ["Released under the MIT License.", "under the MIT License", "The MIT License (MIT)"],
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": ["is subject to the terms of the Mozilla Public License", *versions("the Mozilla Public License", "2.0")],
    "Unlicense": ["under the Unlicense", "This is free and unencumbered software released into the public domain."],
    "Zlib": ["under the zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
# every license with a public identifier may be given by its tag alone
LICENSES = {name: words if name.endswith("-notice") else [*([words] if isinstance(words, str) else words), f"SPDX-License-Identifier: {name}"] for name, words in LICENSES.items()}


def shingle_hashes(text: Column, widths: Sequence[int]) -> Column:
    """An array of (k, shingles): the hashes of the text's shingles of each width, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def runs(k: int, h: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda at: F.xxhash64(*(F.get(h, at + i) for i in range(k))))
        return F.struct(F.lit(k).alias("k"), F.when(F.size(h) >= k, made).otherwise(F.array().cast("array<bigint>")).alias("shingles"))

    # the array is bound once, by a lambda, so that it isn't computed again for every shingle
    return F.get(F.transform(F.array(hashed), lambda h: F.array(*(runs(k, h) for k in widths))), 0)


def width_class(m: int) -> int:
    """The least width of the series that is at least m."""
    c = 1
    while c < m:
        c = max(c + 1, ceil(c * RATIO))
    return c


def band_hashes(shingles: Column) -> Column:
    """The MinHash bands of an array of shingle hashes."""

    def least(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(k))))

    return F.array(*(F.struct(F.lit(k).alias("band"), least(k).alias("least")) for k in range(BANDS)))


def wordings(templates: Templates) -> list[tuple[str, int, str]]:
    """(license, number of the wording, text), bounded by MAX_TEMPLATE_BYTES."""
    out = [(name, i, body) for name, bodies in templates.items() for i, body in enumerate([bodies] if isinstance(bodies, str) else bodies)]
    if sum(len(body.encode()) for *_, body in out) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_BYTES} bytes")
    return out


def template_table(spark, templates: Templates) -> DataFrame:
    """(license, wording, template, k, m, c) of each wording; bounded by MAX_TEMPLATE_BYTES."""
    rows = spark.createDataFrame(wordings(templates), "license string, wording int, body string")
    # the widest shingles that a wording has are those that count
    made = F.filter(shingle_hashes(F.col("body"), range(1, WORDS + 1)), lambda x: F.size(x.shingles) > 0)
    found = rows.select("license", "wording", F.get(made, F.size(made) - 1).alias("x")).collect()
    if empty := sorted({r["license"] for r in found if r["x"] is None}):
        raise ValueError(f"templates without words: {empty}")
    kept = [(r["license"], r["wording"], sorted(set(r["x"]["shingles"])), r["x"]["k"]) for r in found]
    return spark.createDataFrame([(*r, len(r[2]), width_class(len(r[2]))) for r in kept], "license string, wording int, template array<bigint>, k int, m int, c int")


def scan(docs: DataFrame, templates: Templates = LICENSES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, containment, n_windows, first_word): the licenses of which a document holds a wording by THRESHOLD or more.

    containment: the largest share in a window; n_windows: windows that hold one wording, of the wording with most;
    first_word: where the first window of any wording begins, from 0.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    rows = table.collect()
    # one literal each, however many shingles there are
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    known = constant(sorted({h for r in rows for h in r["template"]}), "array<bigint>")
    classes = constant([{"k": k, "c": c} for k, c in sorted({(r["k"], r["c"]) for r in rows})], "array<struct<k:int,c:int>>")
    bands = F.broadcast(table.withColumn("b", F.explode(band_hashes(F.col("template")))).select("license", "wording", "template", "m", "k", "c", "b.band", "b.least"))
    made = F.filter(shingle_hashes(F.col(text), sorted({r["k"] for r in rows})), lambda x: F.arrays_overlap(x.shingles, known))
    hit = docs.select(F.col(doc_id).alias("id"), F.explode(made).alias("x")).select("id", "x.k", "x.shingles")
    last = F.greatest(F.ceil((F.size("shingles") - 2 * F.col("c")) / F.col("c")), F.lit(0)).cast("int")
    windows = (
        hit.withColumn("c", F.explode(F.transform(F.filter(classes, lambda x: x.k == F.col("k")), lambda x: x.c)))
        .withColumn("j", F.explode(F.sequence(F.lit(0), last)))
        .select("id", "k", "c", "j", F.slice("shingles", F.col("j") * F.col("c") + 1, 2 * F.col("c")).alias("window"))
        .where(F.arrays_overlap("window", known))
    )
    candidates = (
        windows.withColumn("b", F.explode(band_hashes(F.col("window"))))
        .select("id", "k", "c", "j", "window", "b.band", "b.least")
        .join(bands, ["k", "c", "band", "least"])
        .withColumn("containment", F.size(F.array_intersect("template", "window")) / F.col("m"))
        .where(F.col("containment") >= THRESHOLD)
    )
    # several bands may bring the same wording to a window
    found = candidates.groupBy("id", "license", "wording", (F.col("j") * F.col("c")).alias("word")).agg(F.max("containment").alias("containment"))
    by_wording = found.groupBy("id", "license", "wording").agg(F.max("containment").alias("containment"), F.count("*").alias("n"), F.min("word").alias("word"))
    return by_wording.groupBy(F.col("id").alias(doc_id), "license").agg(F.max("containment").alias("containment"), F.max("n").alias("n_windows"), F.min("word").cast("long").alias("first_word"))


def oracle_sql(templates: Templates = LICENSES) -> str:
    """DuckDB SQL of the same rows, by counting the shared shingles of every window."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    bodies = wordings(templates)
    values = ", ".join(f"({quoted(name)}, {i}, {quoted(body)})" for name, i, body in bodies)
    widths = ", ".join(f"({m}, {width_class(m)})" for m in range(1, max(len(body.split()) for *_, body in bodies) + 50))
    words = r"[w FOR w IN regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+') IF w <> '']"
    return f"""
WITH t AS (SELECT license, wording, {words.format("body")} AS w FROM (VALUES {values}) v(license, wording, body)),
tk AS (SELECT *, least(len(w), {WORDS}) AS k FROM t),
d AS (SELECT doc_id, {words.format("text")} AS w FROM documents),
ts AS (SELECT DISTINCT license, wording, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s FROM tk),
tm AS (SELECT license, wording, k, count(*) AS m FROM ts GROUP BY license, wording, k),
tc AS (SELECT license, wording, k, tm.m, c FROM tm JOIN (VALUES {widths}) x(n, c) ON n = tm.m),
ds AS (SELECT doc_id, k, len(w) - k + 1 AS n, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s,
  unnest(range(0, len(w) - k + 1)) AS p FROM d JOIN (SELECT DISTINCT k FROM tk) ON len(w) >= k),
hits AS (SELECT doc_id, license, wording, m, c, s, p, n, greatest(cast(ceil((n - 2 * c) / c) AS BIGINT), 0) AS last FROM ds JOIN ts USING (k, s) JOIN tc USING (license, wording, k)),
placed AS (
  SELECT doc_id, license, wording, m, c, s, p // c AS j FROM hits WHERE p // c <= last
  UNION ALL SELECT doc_id, license, wording, m, c, s, p // c - 1 FROM hits WHERE p // c >= 1),
windows AS (SELECT doc_id, license, wording, j * c AS word, count(DISTINCT s) / any_value(m) AS containment FROM placed GROUP BY doc_id, license, wording, j, c HAVING count(DISTINCT s) / any_value(m) >= {THRESHOLD}),
worded AS (SELECT doc_id, license, wording, max(containment) AS containment, count(*) AS n, min(word) AS word FROM windows GROUP BY doc_id, license, wording)
SELECT doc_id, license, max(containment) AS containment, max(n) AS n_windows, cast(min(word) AS BIGINT) AS first_word FROM worded GROUP BY doc_id, license
"""
