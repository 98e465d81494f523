"""License scans: MinHash bands over text windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.common import body

SHINGLE, CONTAINED = 5, 0.8
#: Bands of one MinHash value each.  A window that contains CONTAINED of a
#: template's shingles has a Jaccard similarity of a quarter at least, so it
#: shares a band with probability 1 - 0.75 ** BANDS > 0.9999.
BANDS = 36
TOKEN = r"[\p{L}\p{N}]+"

# Short statements and standard notices of common licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software"
        " is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the Software."
    )),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to"
        " in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY"
        " KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    )),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0"),
    ("GPL-3.0", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    )),
    ("GPL-2.0", (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    )),
    ("LGPL-2.1", (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
        " published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    )),
    ("MPL-2.0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with"
        " this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    )),
    ("BSD-2-Clause", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
        " following disclaimer in the documentation and/or other materials provided with the distribution."
    )),
    ("BSD-3-Clause", (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
        " from this software without specific prior written permission."
    )),
    ("AGPL-3.0", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    )),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License v3.0"),
    ("LGPL-3.0", (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
        " published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."
    )),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies."
    )),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingles(text: str) -> list[str]:
    """The different shingles of a template, in order."""
    w = tokens(text)
    return list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))


def step(text: str) -> int:
    """Windows of three steps, a step apart, contain every template of one to two steps."""
    return 1 << int(math.log2(len(shingles(text))))


def key_words(templates=TEMPLATES) -> list[str]:
    """Words of which every window that contains a template holds one.

    For each template words are picked, those that cover most shingles first,
    until more shingles hold one than a match may lack.
    """
    chosen: set[str] = set()
    for _, text in templates:
        left = shingles(text)
        spare = len(left) * (1 - CONTAINED)
        while True:
            bare = [s for s in left if chosen.isdisjoint(s.split())]
            if len(left) - len(bare) > spare:
                break
            words = sorted({w for s in bare for w in s.split()})
            chosen.add(max(words, key=lambda w: (len(w) > 5, sum(w in s.split() for s in bare), len(w))))
    return sorted(chosen)


def _bands(shingle_array: Column) -> Column:
    """array<long>: for each of BANDS hash functions its number and the least hash of the shingles, hashed."""
    hashes = F.transform(shingle_array, lambda s: F.xxhash64(s))
    return F.transform(F.array(hashes), lambda hs: F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.array_min(F.transform(hs, lambda h: F.xxhash64(h, b)))),
    ))[0]


def _shingled(words: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " ")
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, containment): licenses whose templates a text contains, and how far at best.

    The whole text is cut into tokens (letters and digits, lower case).  For
    each size of template, windows of three steps lie one step apart, so one of
    them contains each occurrence; windows without any of the templates' key
    words cannot contain a template and are left out.  Templates are looked up
    by (step, band): a window meets those that share a band with it, however
    many there are, and a template stays if the window holds CONTAINED of its
    shingles exactly.  Only what is found is shuffled, by id.

    Null, empty and short texts contain nothing; rows that share an id, a null
    one too, count as one document.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = [(n, name, step(t), shingles(t)) for n, (name, t) in enumerate(templates)]
    known = spark.createDataFrame(rows, "template int, license string, step int, wanted array<string>")
    by_band = known.select("step", "license", "wanted", F.explode(_bands(F.col("wanted"))).alias("band"))
    keys = key_words(templates)
    low = F.lower(body(text_col))
    cut_up = (
        docs.where(low.rlike("|".join(keys)))
        .select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)).alias("w"))
        .where(F.size("w") >= SHINGLE)
        .withColumn("last", F.size("w") - SHINGLE)
    )
    places = F.filter(
        F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains(F.array(*map(F.lit, keys)), F.element_at("w", i + 1))
    )

    def windows(places: Column, size: int) -> Column:
        def around(p):
            first = F.greatest(F.lit(0), F.floor((p - (SHINGLE - 1) - 3 * size) / size).cast("int") + 1)
            return F.sequence(first, F.greatest(first, F.floor(F.least(p, F.col("last")) / size).cast("int")))

        near = F.array_distinct(F.flatten(F.transform(places, around)))
        return F.transform(
            F.filter(near, lambda k: k * size <= F.col("last")), lambda k: F.struct(F.lit(size).alias("step"), (k * size).alias("at"))
        )

    sizes = sorted({r[2] for r in rows})
    found = (
        cut_up.withColumn("places", places)
        .select("doc_id", "w", F.explode(F.concat(*[windows(F.col("places"), s) for s in sizes])).alias("x"))
        .select("doc_id", "x.step", "x.at", F.array_distinct(_shingled(F.slice("w", F.col("x.at") + 1, F.col("x.step") * 3 + SHINGLE - 1))).alias("held"))
    )
    containment = (F.size(F.array_intersect("held", "wanted")) / F.size("wanted")).alias("containment")
    return (
        found.select("doc_id", "step", "held", F.explode(F.array_distinct(_bands(F.col("held")))).alias("band"))
        # BANDS rows for each template, whatever the documents
        .join(F.broadcast(by_band), ["step", "band"])
        .select("doc_id", "license", containment).where(F.col("containment") >= CONTAINED)
        .groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))
    )
