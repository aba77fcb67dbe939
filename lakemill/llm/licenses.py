"""License scans: MinHash bands over overlapping text windows, then exact shingle containment (operator 9). DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm.common import let, staged

# Notices of public licenses, in their customary words.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Licensed under the MIT license; see the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under Apache-2.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "AGPL-3.0", "LGPL-3.0", "MPL-2.0", "ISC", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense")),
)

#: Phrases that tell a license from its relatives. A match must hold those of its license that its template holds, word for word.
DECIDING = {
    "MIT": ("the mit license mit", "under the mit license", "identifier mit"),
    "Apache-2.0": ("apache license version 2 0", "licenses license 2 0", "apache license 2 0", "under apache 2 0", "identifier apache 2 0"),
    "GPL-3.0": ("gnu general public license", "public license version 3", "version 3 of the license", "identifier gpl 3 0"),
    "GPL-2.0": ("gnu general public license", "public license version 2", "version 2 of the license", "identifier gpl 2 0"),
    "AGPL-3.0": ("gnu affero general public license", "version 3 of the license", "identifier agpl 3 0"),
    "LGPL-3.0": ("gnu lesser general public license", "version 3 of the license", "identifier lgpl 3 0"),
    "MPL-2.0": ("mozilla public license v 2 0", "identifier mpl 2 0"),
    "ISC": ("with or without fee", "identifier isc"),
    "CC0-1.0": ("waived all copyright", "identifier cc0 1 0"),
    "CC-BY-4.0": ("cc by 4 0",),
    "CC-BY-NC-4.0": ("cc by nc 4 0",),
    "CC-BY-SA-4.0": ("cc by sa 4 0",),
    "BSD-3-Clause": ("endorse or promote products", "identifier bsd 3 clause"),
    "BSD-2-Clause": ("identifier bsd 2 clause",),
    "Unlicense": ("released into the public domain", "identifier unlicense"),
}

#: Words of a shingle: notices have as few as five words, so shingles of five would make some a single one.
SHINGLE = 2
#: (words of a window, words between the starts of two windows, words of a template from which this kind is used).
WINDOWS = ((4, 1, 0), (12, 4, 16))
#: Windows of a similarity of 0.8 meet in one of 6 bands of 2 MinHashes with probability 1 - (1 - 0.8^2)^6 = 0.998.
BANDS, ROWS = 6, 2
#: A passage has at most so many times the shingles of the template.
SPREAD = 2
#: The share of a template's shingles that a passage must hold, in percent.
PERCENT = 80

#: MinHash j of a set of 64-bit hashes is the least of hash XOR mask j.
_MASKS = [int(x) for x in np.random.default_rng(9).integers(-(2**63), 2**63, BANDS * ROWS)]


def shingles(text: Column) -> Column:
    """Hashes of the ``SHINGLE``-word shingles in order; words are runs of letters and digits, lower-cased."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def pairs(h: Column) -> Column:
        return F.when(F.size(h) < SHINGLE, F.array().cast("array<bigint>")).otherwise(
            F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b))
        )

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), pairs)


def _least(hashes: Column, j: int) -> Column:
    return F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(_MASKS[j]))))


def band_keys(own: Column, window: int, stride: int, kind: int, near: Column | None = None) -> Column:
    """Keys of all bands of all windows; the last window ends with the text, so no word is outside of all.

    With ``near``, windows that hold none of these shingles are passed over. If ``near`` has all of the text's shingles
    that templates have, this loses no collision: equal MinHashes mean that both windows hold the shingle of least hash.
    """
    width = window - SHINGLE + 1
    last = F.greatest(F.size(own) - width, F.lit(0)) + 1
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(stride)), F.array(last)))
    if near is not None:
        starts = F.filter(starts, lambda i: F.arrays_overlap(F.slice(own, i, width), near))

    def keys(i: Column) -> Column:
        return let(F.slice(own, i, width), lambda w: F.array(*(
            F.xxhash64(F.lit(kind * BANDS + b), *(_least(w, b * ROWS + r) for r in range(ROWS)))
            for b in range(BANDS)
        )))

    skipped = F.size(own) < width if near is None else (F.size(own) < width) | (F.size(near) == 0)
    return F.when(skipped, F.array().cast("array<bigint>")).otherwise(F.flatten(F.transform(starts, keys)))


def template_bands(spark: SparkSession, templates: Sequence[tuple[str, str]], deciding: Mapping[str, Sequence[str]] = DECIDING) -> tuple[DataFrame, DataFrame]:
    """(template, license, shingles, shingles of each deciding phrase) and (band, template). All offsets of a template have a window, so that one of a passage needs no alignment."""
    plain = lambda x: " ".join(re.findall(r"[^\W_]+", x.lower()))
    phrases = lambda name, text: [x for x in deciding.get(name, ()) if f" {plain(x)} " in f" {plain(text)} "]
    rows = spark.createDataFrame([(n, name, text, phrases(name, text)) for n, (name, text) in enumerate(templates)], "template int, license string, text string, phrases array<string>")
    rows = rows.select("template", "license", F.transform("phrases", shingles).alias("phrases"), F.array_distinct(shingles(F.col("text"))).alias("wanted"), shingles(F.col("text")).alias("own"))
    words = F.size("own") + SHINGLE - 1
    bands = None
    for kind, (window, _, least) in enumerate(WINDOWS):
        above = WINDOWS[kind + 1][2] if kind + 1 < len(WINDOWS) else 1 << 30
        part = rows.filter((words >= least) & (words < above)).select(F.explode(F.array_distinct(band_keys(F.col("own"), window, 1, kind))).alias("band"), "template")
        bands = part if bands is None else bands.union(part)
    return rows.drop("own"), bands.distinct()


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = PERCENT, deciding: Mapping[str, Sequence[str]] = DECIDING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, template (its number), license, n_template, n_found and containment (n_found / n_template) of each match.

    A document's windows retrieve templates by equal bands; a passage of at most SPREAD times the template's length must then
    hold ``percent`` percent of the distinct shingles of the template, counted exactly, and the phrases that decide its
    license, so words strewn over a text are no notice. Of a text's passages the best counts. The templates are a parameter,
    in memory already, so their bands are a literal and their table is broadcast. One pass, no shuffle before candidates.
    Null or empty texts match nothing, null ids stay, repeated rows are each scanned, very long texts are scanned whole,
    further columns don't matter, whatever their names, empty tables give no rows.
    """
    known, bands = template_bands(docs.sparkSession, templates, deciding)
    listed = bands.collect()  # bounded: templates' words times bands
    literal = F.array(*(F.lit(x) for x in sorted({x["band"] for x in listed}))).cast("array<bigint>")
    held = F.array(*(F.lit(x[0]) for x in known.select(F.explode("wanted").alias("x")).distinct().orderBy("x").collect())).cast("array<bigint>")
    rows = docs.select(F.col(id_col).alias("doc_id"), shingles(F.col(text_col).cast("string")).alias("own"))
    hits = let(F.col("own"), lambda own: let(F.array_intersect(own, held), lambda near: F.struct(
        F.array_intersect(F.concat(*(band_keys(own, w, s, kind, near) for kind, (w, s, _) in enumerate(WINDOWS))), literal).alias("bands"),
        own.alias("held"),
    )))
    found = staged(rows.select("doc_id", hits.alias("x")).select("doc_id", "x.bands", "x.held").filter(F.size("bands") > 0), "license-candidates")
    of_band: dict[int, list[int]] = {}
    for x in listed:
        of_band.setdefault(x["template"], []).append(x["band"])
    reached = F.filter(F.array(*(
        F.when(F.arrays_overlap("bands", F.array(*(F.lit(b) for b in sorted(own)))), F.lit(t)) for t, own in sorted(of_band.items())
    )), lambda t: t.isNotNull())
    pairs = found.select("doc_id", "held", F.explode(reached).alias("template")).join(F.broadcast(known), "template")
    # a bound by the whole text first, then by its best passage
    n = F.size("wanted")
    pairs = pairs.filter(100 * F.size(F.array_intersect("held", "wanted")) >= percent * n)
    width = F.ceil(n * SPREAD).cast("int")
    at = F.filter(F.transform("held", lambda x, i: F.when(F.array_contains("wanted", x), i + 1)), lambda i: i.isNotNull())
    passages = F.transform(at, lambda i: F.slice("held", i, width))
    inside = lambda own, p: F.exists(F.sequence(F.lit(1), F.greatest(F.size(own) - F.size(p) + 1, F.lit(1))), lambda i: F.slice(own, i, F.size(p)) == p)
    found_in = F.transform(passages, lambda own: F.when(F.forall("phrases", lambda p: inside(own, p)), F.size(F.array_intersect(own, F.col("wanted")))).otherwise(0))
    pairs = pairs.withColumn("n_found", F.array_max(found_in).cast("long")).withColumn("n_template", n.cast("long"))
    pairs = pairs.filter(100 * F.col("n_found") >= percent * F.col("n_template"))
    return pairs.select("doc_id", "template", "license", "n_template", "n_found", F.round(F.col("n_found") / F.col("n_template"), 6).alias("containment"))
