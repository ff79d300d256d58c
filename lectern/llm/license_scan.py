"""License scans: MinHash bands over overlapping text windows retrieve templates; exact containment verifies.

Words are runs of [a-z0-9] of the lower-cased text; a shingle is five words. For each template length n
texts are read in windows that step by n / 8 and are long enough to hold a template wherever it starts.
A window's MinHash has BANDS values, each a band of its own. Where a window holds at least `share` of a
template's shingles their Jaccard similarity is over 0.55, so one of 24 bands agrees with a chance above
0.99999999; windows retrieved are verified by exact containment of the template's shingles.

Every template shingle-set is so worded that windows without an anchor word can't reach `share`; that is
checked when templates are read, and only windows with an anchor are hashed.

A template of fewer than five words is one shingle as a whole; its MinHash agrees just where its words stand, so
there the words themselves are compared. Related licenses share passages: a text may contain several
templates by `share`, and the containment tells which is meant.

All steps are DataFrame expressions in one narrow pass and a sum by document and template, so no group
is collected; a window carries its own shingles only, so a text of n words costs in proportion to n. Templates are a fixed list, which bounds what is sent to the executors.

Defined cases: null or empty texts match nothing; a repeated row counts its windows again; a null id is
a document of its own; ties in containment take the first window; other columns are ignored; an empty
table gives an empty result. Whole texts are read, however long.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS = 5, 24

#: Notices and opening passages of public licenses.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one",
}
#: Words of which a match must hold one.
ANCHORS = ("license", "licensed", "permission", "redistribution", "redistributions", "copyright", "software", "distribute", "distributed", "warranties", "permitted", "modify", "redistribute", "reserved", "rights", "warranty")


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def least_without_anchor(template: str) -> float:
    """The share of a template's shingles that hold no anchor: no match may do with less than `share`."""
    w = words(template)
    grams = {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}
    return sum(not set(g) & set(ANCHORS) for g in grams) / len(grams)


def _grams(w: str):
    """Hashes of all shingles of the word column."""
    last = F.size(w) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def _bands(grams: str):
    return F.array(*[_band(grams, b) for b in range(BANDS)])


def _band(grams: str, b: int):
    return F.xxhash64(F.lit(b), F.array_min(F.transform(grams, lambda x: F.xxhash64(x, F.lit(b)))))


def scan(docs: DataFrame, share: float = 0.8, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word, windows) for each document and license found in it.

    containment: the largest share of the template's shingles in one window; first_word: where the
    first window with it begins; windows: how many windows match.
    """
    templates = TEMPLATES if templates is None else templates
    short = {k: words(t) for k, t in templates.items() if len(words(t)) < SHINGLE}
    templates = {k: t for k, t in templates.items() if k not in short}
    if bad := [k for k, t in templates.items() if least_without_anchor(t) >= share] + [k for k, t in short.items() if not set(t) & set(ANCHORS)]:
        raise ValueError(f"templates with too many shingles that hold no anchor: {bad}")
    spark = docs.sparkSession
    known = spark.createDataFrame([(k, words(t)) for k, t in templates.items()], "license string, w array<string>")
    known = known.select("license", F.array_distinct(_grams("w")).alias("grams")).withColumn("bands", _bands("grams"))
    known = known.select("license", F.col("grams").alias("want"), F.explode("bands").alias("band"))

    low = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("t"))
    low = low.where(F.col("t").rlike("|".join(sorted({a for a in ANCHORS if not any(b != a and b in a for b in ANCHORS)}))))
    df = low.select("doc_id", F.regexp_extract_all("t", F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    marked = F.transform("w", lambda x, i: F.when(x.isin(*ANCHORS), i))
    df = df.withColumn("at", F.filter(marked, lambda i: i.isNotNull()))
    df = df.where(F.size("at") > 0)
    phrases = _phrases(df, short)
    df = df.where(F.size("w") >= SHINGLE).withColumn("g", _grams("w"))
    # windows: starts on the grid of each template length from which an anchor is inside
    starts = []
    for n in sorted({len(words(t)) for t in templates.values()}):
        step = max(1, n // 8)
        starts.append(_starts(step, n + step - 1))
    df = df.withColumn("starts", F.array_distinct(F.flatten(F.array(*starts)))) if starts else df.withColumn("starts", F.expr("cast(array() as array<struct<first:int,wide:int>>)"))
    window = lambda s: F.struct(s["first"].alias("first"), F.slice("g", s["first"] + 1, s["wide"] - SHINGLE + 1).alias("have"))
    df = df.select("doc_id", F.explode(F.transform("starts", window)).alias("x"))  # a row carries its own window only
    df = df.select("doc_id", "x.first", F.array_distinct("x.have").alias("have"))
    df = df.where(F.size("have") > 0).withColumn("bands", _bands("have"))
    all_bands = F.array(*[F.lit(r[0]) for r in known.select("band").distinct().collect()])  # templates x BANDS at most
    df = df.where(F.arrays_overlap("bands", all_bands)).withColumn("band", F.explode("bands"))
    hits = df.join(F.broadcast(known), "band")  # bounded by the list of templates
    hits = hits.withColumn("containment", F.size(F.array_intersect("want", "have")) / F.size("want")).where(F.col("containment") >= share)
    hits = functools.reduce(DataFrame.unionByName, [x.select("doc_id", "license", "first", "containment") for x in (hits, *phrases)])
    once = hits.groupBy("doc_id", "license", "first").agg(F.max("containment").alias("containment"))
    best = F.max(F.struct("containment", (-F.col("first")).alias("back")))
    found = once.groupBy("doc_id", "license").agg(best.alias("best"), F.count(F.lit(1)).alias("windows"))
    return found.select("doc_id", "license", "best.containment", (-F.col("best.back")).cast("long").alias("first_word"), "windows")


def _phrases(df: DataFrame, short: dict[str, list[str]]) -> list[DataFrame]:
    """Where templates of fewer words than a shingle stand: (doc_id, license, first, containment)."""
    out = []
    for name, text in short.items():
        at = F.transform("w", lambda x, i: F.when(functools.reduce(lambda a, b: a & b, [F.get("w", i + k) == t for k, t in enumerate(text)]), i))  # noqa: B023
        out.append(df.select("doc_id", F.lit(name).alias("license"), F.explode(F.filter(at, lambda i: i.isNotNull())).alias("first"), F.lit(1.0).alias("containment")))
    return out


def _starts(step: int, wide: int):
    """Window starts, multiples of step, whose window of `wide` words holds an anchor and lies in the text where it can."""

    def around(a):
        first = F.greatest(F.lit(0), F.ceil((a - (wide - 1)) / step).cast("int") * step)
        last = F.floor(a / step).cast("int") * step
        return F.sequence(first, F.greatest(first, last), F.lit(step))

    return F.transform(F.array_distinct(F.flatten(F.transform("at", around))), lambda s: F.struct(s.alias("first"), F.lit(wide).alias("wide")))
