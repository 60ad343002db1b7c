"""License scans: MinHash bands over overlapping windows, in DataFrame operations only.

Words are runs of ASCII letters and digits, lower-cased; shingles have five. Templates of similar length form
a class with windows of its own: class c (a power of two) has the templates of c to 2c - 1 shingles, and windows of
2c + s shingles that start every s = max(1, c / 4). A template that occurs lies within some window, and where three
quarters of its shingles do, window and template have a Jaccard similarity of at least 0.3. With ``BANDS`` = 32
bands of one row, such a pair collides in a band with probability 1 - 0.7 ** 32 > 0.99998. Colliding pairs are
retrieved through a broadcast table of the templates' bands, a fixed size, and verified by exact containment.

Only windows that could contain anything are looked at. Greedily chosen anchor words hit more than a quarter of
each template's shingles, so what has three quarters of them has an anchor word; texts without one are passed over by
plain substring tests, without loss. A text's shingles are hashed once, and windows are slices of the hashes.

Templates that resemble each other (versions of a license, a text that contains another) are verified in the same
place. So a license counts only if no other one is there that fits better: none whose place in a verified window (from its
first to its last shingle) overlaps that in its best window, with a larger containment, or an equal one and more shingles.

Defined results: null, empty and shorter texts have no shingle and give no row; texts are scanned whole; a
document with several licenses in different places gives a row for each; rows that share an id count as one document
(each text decides on its own places); an empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.llm._shared import checkpoint

SHINGLE = 5
CONTAINED = 0.75
BANDS = 32

# Notices by which texts declare their license, and the granting parts of short licenses.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    (
        "BSD-2-Clause-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    (
        "ISC-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(text: str) -> list[str]:
    return re.sub(r"[^A-Za-z0-9]+", " ", text).strip(" ").lower().split(" ")


def shingles_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))


def anchors(templates: list[list[str]]) -> list[str]:
    """Words such that whatever has ``CONTAINED`` of a template's shingles has one; long words are preferred, as rarer."""
    open_ = [[set(x.split()) for x in t] for t in templates]
    #: so many shingles of each may stay without an anchor
    spare = [-(-len(t) * int(100 * CONTAINED) // 100) - 1 for t in templates]
    out: list[str] = []
    while any(len(t) > n for t, n in zip(open_, spare, strict=True)):
        count: dict[str, int] = {}
        for t, n in zip(open_, spare, strict=True):
            for w in (x for s in t for x in s if len(t) > n):
                count[w] = count.get(w, 0) + 1
        best = max(count, key=lambda w: (min(len(w), 8), count[w], len(w), w))
        out.append(best)
        open_ = [[s for s in t if best not in s] for t in open_]
    return out


def size_class(n_shingles: int) -> int:
    return 1 << (n_shingles.bit_length() - 1)


def window_of(c: int) -> tuple[int, int]:
    """(shingles of a window, step) of a class."""
    step = max(1, c // 4)
    return 2 * c + step, step


def _bands(hashes: Column) -> Column:
    seeds = F.array(*(F.lit(k) for k in range(BANDS)))
    return F.transform(seeds, lambda k: F.xxhash64(k, F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, k)))))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document and license: doc_id, license, containment (of its best window), first_word (of the first such place)."""
    spark = docs.sparkSession
    usable = [(n, shingles_of(t)) for n, t in templates if shingles_of(t)]
    known = spark.createDataFrame([(n, size_class(len(s)), s) for n, s in usable], "license string, c int, s array<string>")
    known = known.select("license", "c", F.transform("s", lambda x: F.xxhash64(x)).alias("t"))
    known = F.broadcast(known.select("license", "c", "t", F.explode(_bands(F.col("t"))).alias("band")))
    classes = {c: anchors([s for _, s in usable if size_class(len(s)) == c]) for c in sorted({size_class(len(s)) for _, s in usable})}

    low = F.lower(F.col(f"`{text}`"))
    any_anchor = F.lit(False)
    for a in sorted({a for hits in classes.values() for a in hits}):
        any_anchor |= F.contains(low, F.lit(a))
    found = docs.where(any_anchor).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    words = F.split(F.trim(F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))), " ")
    # inline() makes a value once, however often it is used after it
    found = found.select("doc_id", F.xxhash64("text").alias("row"), F.inline(F.array(F.struct(words.alias("w"))))).withColumn("n", F.size("w") - (SHINGLE - 1)).where("n > 0")
    # by get(): slice() reads its whole array each time
    shingles = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get("w", i + k) for k in range(SHINGLE)))))
    places = [F.filter(F.transform("w", lambda x, i: F.when(x.isin(hits), i)), lambda i: i.isNotNull()).alias(f"at{c}") for c, hits in classes.items()]  # noqa: B023
    found = found.select("doc_id", "row", "n", F.inline(F.array(F.struct(shingles.alias("sh"), *places))))

    parts = []
    for c in classes:
        size, step = window_of(c)
        first = lambda p: F.greatest(F.lit(0), F.ceil((p - (SHINGLE - 1) - (size - 1)) / F.lit(step)).cast("int"))  # noqa: B023, E731
        last = lambda p: F.floor(F.least(p, F.col("n") - 1) / F.lit(step)).cast("int")  # noqa: B023, E731
        starts = F.array_distinct(F.flatten(F.transform(f"at{c}", lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p))).otherwise(F.array().cast("array<int>")))))  # noqa: B023
        parts.append(F.transform(starts, lambda k: F.struct(F.lit(c).alias("c"), (k * step).alias("from"), F.transform(F.sequence(k * step, F.least(k * step + size, F.col("n")) - 1), lambda i: F.get("sh", i)).alias("h"))))  # noqa: B023
    windows = found.select("doc_id", "row", F.inline(F.flatten(F.array(*parts))))
    banded = windows.select("*", F.explode(F.array_distinct(_bands(F.col("h")))).alias("band"))
    share = F.size(F.array_intersect("h", "t")) / F.size("t")
    fitting = banded.join(known, ["c", "band"]).withColumn("share", share).where(F.col("share") >= CONTAINED)
    # the place of a template: from its first to its last shingle in the window
    at = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("t", x), F.col("from") + i)), lambda i: i.isNotNull())
    verified = fitting.select("doc_id", "row", "license", "share", F.size("t").alias("size"), F.inline(F.array(F.struct(at.alias("at")))))
    verified = verified.select("doc_id", "row", "license", "share", "size", F.array_min("at").alias("from"), (F.array_max("at") + (SHINGLE - 1)).alias("to"))
    verified = checkpoint(verified.distinct())

    best = verified.groupBy("doc_id", "row", "license").agg(F.min(F.struct((-F.col("share")).alias("less"), "from", "to", "size")).alias("b"))
    mine = best.select("doc_id", "row", "license", "b.from", "b.to", "b.size", (-F.col("b.less")).alias("share")).alias("m")
    other = verified.alias("o")
    fits_better = F.expr("o.doc_id <=> m.doc_id and o.row = m.row and o.license <> m.license and o.from <= m.to and m.from <= o.to and (o.share > m.share or o.share = m.share and o.size > m.size)")
    kept = mine.join(other, fits_better, "left_anti")
    return kept.groupBy("doc_id", "license").agg(F.round(F.max("share"), 6).alias("containment"), F.min("from").cast("long").alias("first_word"))


def oracle(templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """DuckDB SQL for ``scan`` over ``documents``: every window against every template, without bands or anchors."""
    rows = ", ".join(f"('{n}', {size_class(len(shingles_of(t)))}, {len(shingles_of(t))}, '{s}')" for n, t in templates for s in shingles_of(t))
    sizes = ", ".join(f"({c}, {window_of(c)[0]}, {window_of(c)[1]})" for c in sorted({size_class(len(shingles_of(t))) for _, t in templates}))
    return f"""
WITH t(license, c, n, s) AS (VALUES {rows}), z(c, size, step) AS (VALUES {sizes}),
d AS (SELECT row_number() OVER () AS row, doc_id, string_split(trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), ' ') AS w FROM documents),
u AS (SELECT row, doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM d),
h AS (SELECT row, doc_id, p, {" || ' ' || ".join(f"lead(x, {k}) OVER o" for k in range(SHINGLE))} AS s FROM u WINDOW o AS (PARTITION BY row ORDER BY p)),
m AS (SELECT h.row, h.doc_id, h.p, t.license, t.c, t.n, t.s FROM h JOIN t USING (s)),
k AS (SELECT m.*, z.step, unnest(range(greatest(0, CAST(ceil((p - z.size + 1) / CAST(z.step AS DOUBLE)) AS BIGINT)), CAST(floor(p / CAST(z.step AS DOUBLE)) AS BIGINT) + 1)) AS k FROM m JOIN z USING (c)),
v AS (SELECT row, doc_id, license, n, k, min(p) AS f, max(p) + {SHINGLE - 1} AS e, count(DISTINCT s) / CAST(n AS DOUBLE) AS share FROM k GROUP BY row, doc_id, license, n, k),
g AS (SELECT * FROM v WHERE share >= {CONTAINED}),
b AS (SELECT *, row_number() OVER (PARTITION BY row, license ORDER BY share DESC, f, e) AS r FROM g),
x AS (SELECT * FROM b WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM g WHERE g.row = b.row AND g.license <> b.license AND g.f <= b.e AND b.f <= g.e AND (g.share > b.share OR g.share = b.share AND g.n > b.n)))
SELECT doc_id, license, round(max(share), 6) AS containment, CAST(min(f) AS BIGINT) AS first_word FROM x GROUP BY doc_id, license"""
