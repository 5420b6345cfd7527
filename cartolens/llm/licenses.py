"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Texts and templates are lower-cased and cut into words of [a-z0-9]. A template's shingles have five words (a shorter template
is one shingle). A template of T shingles is sought in windows of M + step - 1 shingles that start every ``step`` = M / 4 (one at
least), M the least of 1, 2, 3, 4, 6, 8, 12, ... that reaches T: whatever lies in T consecutive shingles lies wholly in some window.
A window and a template meet in a band if the band's hash function has the same minimum over both, which has a probability of J,
their Jaccard similarity. A window with ``CONTAINMENT`` of the template's shingles has a J of at least n / (T + window - n),
n = ceil(CONTAINMENT T), and each template has as many bands as it takes to miss such a window with odds of ``MISS`` at most
(least_similarity() and bands_of() give both; between 1 and 50 bands). A retrieved pair counts if the window holds at least
``CONTAINMENT`` of the template's shingles, counted exactly.

The band join is read from the templates' side: a window whose minimum in a band is the template's holds the shingle that gives it
that minimum, so the windows to be hashed in a band are those around that shingle. This passes over no pair that meets in a band
(a test compares it with the minima of all windows), and makes an index of a few bands of a license of thousands of shingles.

The templates are ``NOTICES``, the whole license texts beside this module, and three passages of each long one; they are a fixed
list, so what is broadcast doesn't grow with the texts. Null, empty and short texts match nothing or short templates only; very
long texts are scanned whole; rows of equal doc_id and text are one document; extra columns are ignored. No matches, no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT, MISS = 0.75, 1e-9
#: Words of a passage of a long text, and from how many words on a text is long.
PASSAGE, LONG = 32, 400

#: Fixed values by SPDX id: short notices, opening clauses (-text), clauses of bodies (-body) and identifier lines (-spdx).
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("Apache-2.0-text", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("MPL-2.0-text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0-text", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("All-rights-reserved", "All rights reserved."),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-text", "under the terms of the GNU Lesser General Public License"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("AGPL-text", "under the terms of the GNU Affero General Public License"),
    ("AGPL-3.0-body", "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("BSD-2-Clause", "BSD 2-Clause"),
    ("BSD-3-Clause", "BSD 3-Clause"),
    ("BSD-2-Clause-body", "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY"),
    ("BSD-3-Clause-body", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "ISC License"),
    ("ISC-body", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MIT-body", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("Unlicense-text", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0-text", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0-text", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0-text", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("Apache-2.0-spdx", "License-Identifier: Apache-2.0"),
    ("GPL-2.0-spdx", "License-Identifier: GPL-2.0"),
    ("GPL-3.0-spdx", "License-Identifier: GPL-3.0"),
    ("LGPL-2.1-spdx", "License-Identifier: LGPL-2.1"),
    ("LGPL-3.0-spdx", "License-Identifier: LGPL-3.0"),
    ("AGPL-3.0-spdx", "License-Identifier: AGPL-3.0"),
    ("BSD-2-Clause-spdx", "License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause-spdx", "License-Identifier: BSD-3-Clause"),
    ("MPL-2.0-spdx", "License-Identifier: MPL-2.0"),
    ("CC0-1.0-spdx", "License-Identifier: CC0-1.0"),
    ("CC-BY-4.0-spdx", "License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA-4.0-spdx", "License-Identifier: CC-BY-SA-4.0"),
    ("CC-BY-NC-4.0-spdx", "License-Identifier: CC-BY-NC-4.0"),
    ("MIT-spdx", "License-Identifier: MIT"),
    ("ISC-spdx", "License-Identifier: ISC"),
    ("Unlicense-spdx", "License-Identifier: Unlicense"),
]


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


@cache
def templates() -> tuple[tuple[str, str], ...]:
    """(license_id, text) of all templates."""
    out = list(NOTICES)
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        words = words_of(path.read_text())
        out.append((f"{path.stem}-full", " ".join(words)))
        starts = [len(words) * i // 6 for i in (1, 3, 5)] if len(words) >= LONG else []
        out += [(f"{path.stem}-passage-{i + 1}", " ".join(words[at : at + PASSAGE])) for i, at in enumerate(starts)]
    return tuple(out)


def shape(template: str) -> tuple[int, int, int]:
    """(words of a shingle, step, shingles of a window) of a template."""
    n = len(words_of(template))
    if not n:
        raise ValueError("a template needs a word")
    k = min(SHINGLE, n)
    most = next(m for i in range(64) for m in (2**i, 3 * 2**i // 2) if m >= n - k + 1)
    step = max(1, most // 4)
    return k, step, most + step - 1


def distinct_shingles(template: str) -> int:
    words, k = words_of(template), shape(template)[0]
    return len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})


def least_similarity(template: str, containment: float = CONTAINMENT) -> float:
    """The least Jaccard similarity of a template and a window that holds so much of it."""
    size = distinct_shingles(template)
    need = math.ceil(containment * size)
    return need / (size + max(shape(template)[2], need) - need)


def bands_of(template: str, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    j = least_similarity(template, containment)
    return 1 if j >= 1 else math.ceil(math.log(miss) / math.log(1 - j))


def _words(text: Column) -> Column:
    """Hashes of a text's words, in order."""
    return F.transform(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(words: Column, k: int) -> Column:
    """Hash of the k words at each place, in order; empty if there are fewer. The words are bound once for all places."""
    at = lambda w: lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    each = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), at(w))).otherwise(F.array().cast("array<long>"))
    return F.get(F.transform(F.array(words), each), 0)


def minimum(shingles: Column, band: Column) -> Column:
    """The least of a band's hash function over the shingles."""
    return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, band)))


def known(spark: SparkSession, listed: Sequence[tuple[str, str]]) -> DataFrame:
    """license_id, k, step, width, bands, own (distinct shingles) of each template."""
    rows = [(name, text, *shape(text), bands_of(text)) for name, text in listed]
    df = spark.createDataFrame(rows, "license_id string, body string, k int, step int, width int, bands int").withColumn("words", _words(F.col("body")))
    own = F.lit(None)
    for k in sorted({r[2] for r in rows}):
        own = F.when(F.col("k") == k, F.array_distinct(_shingles(F.col("words"), k))).otherwise(own)
    return df.select("license_id", "k", "step", "width", "bands", own.cast("array<long>").alias("own"))


def retrieved(docs: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, text_hash, license_id, at (word where the window starts), window (its shingles): a row for each band in which a
    window and a template meet. ``index`` as from known()."""
    least = F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda b: F.struct(b.alias("band"),
        F.array_min(F.transform("own", lambda s: F.struct(F.xxhash64(s, b).alias("low"), s.alias("s")))).alias("m")))
    bands = index.select("license_id", "k", "step", "width", F.explode(least).alias("b")).select("license_id", F.col("k").alias("bk"), "step",
        "width", "b.band", "b.m.low", F.col("b.m.s").alias("bs"))
    keys: dict[int, list[int]] = {}
    for k, s in bands.select("bk", "bs").distinct().collect():
        keys.setdefault(k, []).append(s)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    texts = texts.select("doc_id", "text_hash", *[_shingles(F.col("words"), k).alias(f"s{k}") for k in sorted(keys)])

    def hits(k: int) -> Column:
        places = F.when(F.size(f"s{k}") > 0, F.sequence(F.lit(0), F.size(f"s{k}") - 1)).otherwise(F.array().cast("array<int>"))
        found = F.filter(places, lambda i: F.get(f"s{k}", i).isin(keys[k]))
        return F.transform(found, lambda i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.get(f"s{k}", i).alias("s"), F.col(f"s{k}").alias("all")))

    # outer, and then without the empty ones: Spark would else test the array before it, and so make the shingles twice
    met = texts.select("doc_id", "text_hash",
        F.explode_outer(F.concat(*[hits(k) for k in sorted(keys)])).alias("h")).filter("h IS NOT NULL").select("doc_id", "text_hash", "h.*")
    met = met.join(F.broadcast(bands), (F.col("k") == F.col("bk")) & (F.col("s") == F.col("bs")))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - F.col("width") + 1) / F.col("step")).cast("int") * F.col("step"))
    starts = F.sequence(first, F.floor(F.col("i") / F.col("step")).cast("int") * F.col("step"), F.col("step"))
    windows = F.transform(starts, lambda a: F.struct(a.alias("at"), F.slice("all", a + 1, F.col("width")).alias("window")))
    windows = F.filter(windows, lambda w: minimum(w["window"], F.col("band")) == F.col("low"))
    return met.select("doc_id", "text_hash", "license_id", F.explode_outer(windows).alias("w")).filter("w IS NOT NULL").select("doc_id", "text_hash", "license_id", "w.*")


def matches(docs: DataFrame, listed: Sequence[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, text_hash, license_id, at (word where the window starts), contained: every verified window."""
    index = known(docs.sparkSession, templates() if listed is None else listed)
    found = retrieved(docs, index).join(F.broadcast(index.select("license_id", "own")), "license_id")
    share = F.size(F.array_intersect("window", "own")) / F.size("own")
    return found.select("doc_id", "text_hash", "license_id", "at", share.alias("contained")).filter(F.col("contained") >= containment).distinct()


def report(docs: DataFrame, listed: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Per document and license that it holds: doc_id, license_id, n_windows, first_word, contained (the most of any window)."""
    return matches(docs, listed).groupBy("doc_id", "text_hash", "license_id").agg(
        F.count("*").alias("n_windows"), F.min("at").cast("long").alias("first_word"), F.max("contained").alias("contained")
    ).select("doc_id", "license_id", "n_windows", "first_word", "contained")


def sql(listed: Sequence[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL of report() over the view documents: shingles as strings joined to the templates', counted by window."""
    listed = templates() if listed is None else listed
    quoted = ", ".join("('{}', '{}', {}, {}, {})".format(n, " ".join(words_of(t)), *shape(t)) for n, t in listed)
    kinds = sorted({shape(t)[0] for _, t in listed})
    shingle = lambda k: " || ' ' || ".join(["word", *[f"lead(word, {j}) OVER o" for j in range(1, k)]])
    each = " UNION ALL ".join(f"SELECT rid, pos - 1 AS i, {k} AS k, {shingle(k)} AS sh FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)" for k in kinds)
    return f"""
WITH t AS (SELECT license_id, string_split(body, ' ') AS w, k, step, width FROM (VALUES {quoted}) v(license_id, body, k, step, width)),
l AS (SELECT license_id, k, step, width, list_distinct(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS own FROM t),
own AS (SELECT license_id, k, step, width, len(own) AS size, unnest(own) AS sh FROM l),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) q),
w AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
s AS ({each}),
h AS (SELECT rid, license_id, size, i, step, width, own.sh FROM s JOIN own ON s.k = own.k AND s.sh = own.sh),
u AS (SELECT rid, license_id, size, sh, i, width, i // step * step - unnest(range((width + step - 1) // step)) * step AS at_ FROM h),
m AS (SELECT rid, license_id, at_ AS pos, CAST(count(DISTINCT sh) AS DOUBLE) / size AS contained FROM u WHERE at_ >= 0 AND i < at_ + width GROUP BY rid, license_id, at_, size)
SELECT doc_id, license_id, count(*) AS n_windows, min(pos) AS first_word, max(contained) AS contained
FROM m JOIN d USING (rid) WHERE contained >= {containment} GROUP BY rid, doc_id, license_id
"""
