"""License scans with DataFrame functions only.

Texts become lower-case words of letters and digits, and 5-word shingles.  Windows as long as a
template overlap (a stride of an eighth of their length); MinHash bands of one row each retrieve the
templates that a window may hold; exact containment of the template's shingles in the window and a
stride on either side then decides (0.8 or more).  A window aligned to within half a stride with a
template of which 0.8 is there has a Jaccard similarity of at least 0.58, so 16 bands miss it with a
probability below 1e-6.

Only windows near an *anchor* are looked at.  A template's anchors are words such that less than 0.8
of its shingles are free of them, so every window that passes holds one; this leaves out nothing.

The templates are a parameter (a name and a text each; a fixed, small set).  Null and empty texts
have no license; rows of one id are one document; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
SHINGLE, LEAST, BANDS = 5, 0.8, 16

# Wording of common license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This program is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-notice": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def shingles_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))


def stride_of(n: int) -> int:
    return max(1, n // 8)


def anchors_of(shingles: list[str], least: float = LEAST) -> list[str]:
    """Longest words first, until fewer than the needed shingles are free of them."""
    free, out = list(shingles), []
    need = ceil(least * len(shingles) - 1e-9)
    for w in sorted({w for s in shingles for w in s.split()}, key=lambda w: (-len(w), w)):
        if len(free) < need:
            break
        if any(w in s.split() for s in free):
            out.append(w)
            free = [s for s in free if w not in s.split()]
    return out


def doc_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingle_hashes(words: Column) -> Column:
    last = F.size(words) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, SHINGLE), " ")))).otherwise(
        F.array().cast("array<bigint>")
    )


def _bands(hashes: Column) -> Column:
    """Band number and MinHash of each band."""
    return F.array(*[F.struct(F.lit(j).alias("band"), F.array_min(F.transform(hashes, _seeded(j))).alias("low")) for j in range(BANDS)])


def _seeded(j: int):
    return lambda x: F.xxhash64(F.lit(j), x)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, containment``: a row for each template that a document holds."""
    spark = docs.sparkSession
    known = [(name, sh, len(sh), anchors_of(sh, least)) for name, text in (TEMPLATES if templates is None else templates).items() if (sh := shingles_of(text))]
    words_near = sorted({w for *_, a in known for w in a})
    rows = docs.select(c(id_col).alias("doc_id"), c(text_col).alias("text"))
    low = F.lower("text")
    some = F.lit(False)
    for w in words_near:
        some = some | low.contains(w)
    worded = rows.filter(some).select("doc_id", doc_words(c("text")).alias("words"))
    anchored = worded.select("doc_id", "words", *[_positions(c("words"), [w for _, _, m, a in known if m == n for w in a]).alias(f"at{n}") for n in _classes(known)])
    windows = F.flatten(F.array(*[_windows(n) for n in _classes(known)])) if known else F.array().cast("array<struct<n:int,region:array<string>,skip:int>>")
    near = anchored.select("doc_id", F.explode(windows).alias("w")).select("doc_id", "w.n", "w.skip", _shingle_hashes(c("w.region")).alias("hashes"))
    core = F.slice("hashes", c("skip") + 1, c("n"))
    banded = near.select("doc_id", "n", "hashes", F.explode(_bands(core)).alias("b")).select("doc_id", "n", "hashes", "b.band", "b.low")
    # the template side is a fixed parameter: a few dozen rows
    base = spark.createDataFrame([(name, n, sh) for name, sh, n, _ in known], "license string, tn int, shingles array<string>")
    base = base.select("license", "tn", F.transform("shingles", lambda s: F.xxhash64(s)).alias("own"))
    stored = base.select("license", "tn", "own", F.explode(_bands(c("own"))).alias("t")).select("license", "tn", "own", c("t.band").alias("tband"), c("t.low").alias("tlow"))
    met = banded.join(F.broadcast(stored), (c("n") == c("tn")) & (c("band") == c("tband")) & (c("low") == c("tlow")))
    held = F.size(F.array_intersect("own", "hashes")) / c("tn")
    return met.select("doc_id", "license", held.alias("containment")).filter(c("containment") >= least - 1e-12).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def _classes(known) -> list[int]:
    return sorted({n for _, _, n, _ in known})


def _positions(words: Column, anchors: list[str]) -> Column:
    """Word positions of anchors."""
    one = F.array(*[F.lit(a) for a in sorted(set(anchors))])
    return F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(one, F.get(words, i)))).otherwise(F.array().cast("array<int>"))


def _windows(n: int) -> Column:
    """Windows of ``n`` shingles, at multiples of the stride, whose surroundings reach an anchor.

    ``region``: the words of the window and a stride on either side; ``skip``: its shingles before the window.
    """
    stride = stride_of(n)
    last = F.size("words") - SHINGLE
    first_start = lambda p: F.greatest(F.lit(0), F.ceil((p - (SHINGLE - 1) - n - stride + 1) / F.lit(stride))).cast("int")
    last_start = lambda p: F.floor(F.least(p + stride, F.greatest(last, F.lit(0))) / F.lit(stride)).cast("int")
    numbers = lambda p: F.when(first_start(p) <= last_start(p), F.sequence(first_start(p), last_start(p))).otherwise(F.array().cast("array<int>"))
    starts = F.array_distinct(F.flatten(F.transform(f"at{n}", numbers)))

    def window(k: Column) -> Column:
        start = k * stride
        begin = F.greatest(start - stride, F.lit(0))
        region = F.slice("words", begin + 1, start + n + stride + SHINGLE - 1 - begin)
        return F.struct(F.lit(n).alias("n"), region.alias("region"), (start - begin).alias("skip"))

    return F.transform(starts, window)


def oracle_sql(templates: dict[str, str] | None = None, least: float = LEAST) -> str:
    """The same result in DuckDB SQL, from all shingles of all documents, without MinHash or anchors."""
    known = [(name, sh) for name, text in (TEMPLATES if templates is None else templates).items() if (sh := shingles_of(text))]
    values = ", ".join(f"('{name}', {len(sh)}, {stride_of(len(sh))}, '{s}')" for name, sh in known for s in sh)
    return f"""
WITH t(license, n, stride, shingle) AS (VALUES {values}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(list_transform(range(0, greatest(len(words) - {SHINGLE} + 1, 0)), lambda i: {{p: i, shingle: array_to_string(words[i + 1 : i + {SHINGLE}], ' ')}}), recursive := true) FROM w),
h AS (SELECT doc_id, license, n, stride, p, shingle FROM s JOIN t USING (shingle)),
g AS (SELECT doc_id, license, n, shingle, unnest(range(greatest(0, CAST(ceil((p - n - stride + 1) / stride::DOUBLE) AS BIGINT)), CAST(floor((p + stride) / stride::DOUBLE) AS BIGINT) + 1)) AS k FROM h),
d AS (SELECT doc_id, license, k, count(DISTINCT shingle) / max(n)::DOUBLE AS containment FROM g GROUP BY ALL)
SELECT doc_id, license, max(containment) AS containment FROM d WHERE containment >= {least} - 1e-12 GROUP BY ALL"""
