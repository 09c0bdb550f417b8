"""License scan: which license notices does a text carry?

Texts and templates are cut into five-word shingles. Only shingles that some template has can count, so those of a text are
intersected with that small set first; texts without any are done. For the others, overlapping windows (one and a half
times as long as the templates of a length class, a new one each half length, so that every occurrence lies whole inside one)
get MinHash signatures; equal bands retrieve templates, and exact shingle containment verifies them.

A window's set holds shingles of its own length class only. With 32 bands of one row, a window and a template of Jaccard
similarity 0.25 over these meet with probability 1 - 0.75^32 = 0.9999, at 0.5 with 1 - 2^-32: enough even where
several notices share a window.

Defined cases: null and short texts match nothing; repeated rows are documents of their own but give equal rows once per
identifier and text; a null identifier is an identifier; an empty table gives an empty result. Only DataFrame functions are
used; the template library is of fixed size: lines and notices, of the GNU licenses the sentence in which they differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import whole

SHINGLE, CONTAINMENT, BANDS, ROWS = 5, 0.8, 32, 1

#: Public license notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-line": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "GFDL-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-3-Clause-notice": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "BSL-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "BSL-1.0-notice": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "Zlib-notice": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "WTFPL-notice": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "OFL-1.1-line": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
}


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """Hashes of all n-word shingles, in order; [] for fewer words."""
    none = F.expr("cast(array() as array<bigint>)")

    def cut(h: Column) -> Column:
        return F.when(F.size(h) < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(n)])))

    return bound(words, cut)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once per row: an optimizer that pushes a filter down would write it out again at
    each place, in the lambda for each element too."""
    return F.transform(F.array(value), use)[0]


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, grams (distinct shingles), words, klass: the length class, templates of up to 8, 16, 32, ... words."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    t = rows.select("license", word_hashes(F.col("body")).alias("w")).select("license", F.size("w").alias("words"), F.array_distinct(shingles(F.col("w"))).alias("grams"))
    return t.withColumn("klass", F.greatest(F.lit(3), F.ceil(F.log2("words")).cast("int")))


def bands(grams: Column, count: int = BANDS, rows: int = ROWS) -> Column:
    """An array of (band, value) structs for a set of shingle hashes."""
    def least_of(k: int) -> Column:
        return F.array_min(F.transform(grams, lambda g: F.xxhash64(g, F.lit(k))))

    least = [least_of(k) for k in range(count * rows)]
    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*least[b * rows : (b + 1) * rows]).alias("value")) for b in range(count)])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = CONTAINMENT) -> DataFrame:
    """One row per text and license found: id_col, license, containment, first_word, last_word (0-based word positions of
    the best window's shingles)."""
    spark = docs.sparkSession
    known = template_table(spark, templates or TEMPLATES)
    library = known.collect()  # the templates: a fixed number
    universe = sorted({g for r in library for g in r["grams"]})
    classes = sorted({r["klass"] for r in library})
    literal = F.split(F.lit(",".join(map(str, universe))), ",").cast("array<bigint>")

    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text")).select("id", F.xxhash64("text").alias("tail"), word_hashes(F.col("text")).alias("w"))
    grams = rows.select("id", "tail", shingles(F.col("w")).alias("grams")).withColumn("common", F.array_intersect("grams", literal)).filter(F.size("common") > 0)
    at = bound(F.col("common"), lambda known_: F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("pos"), g.alias("gram"))), lambda x: F.array_contains(known_, x["gram"])))
    hits = grams.select("id", "tail", F.explode(at).alias("hit")).select("id", "tail", "hit.pos", "hit.gram")

    # Window k of a class with length L starts at word k*L/2 and is 3L/2 long: a position lies in up to three of them.
    half = F.expr("shiftleft(1, klass - 1)")
    last = F.floor(F.col("pos") / half).cast("int")
    def of_class(c: int) -> Column:
        own = sorted({g for r in library if r["klass"] == c for g in r["grams"]})
        return F.when(F.array_contains(F.split(F.lit(",".join(map(str, own))), ",").cast("array<bigint>"), F.col("gram")), F.lit(c))

    placed = hits.withColumn("klass", F.explode(F.array_compact(F.array(*map(of_class, classes))))).withColumn("window", F.explode(F.sequence(F.greatest(F.lit(0), last - 2), last)))
    windows = placed.groupBy("id", "tail", "klass", "window").agg(F.collect_set("gram").alias("have"), F.collect_set(F.struct("pos", "gram")).alias("places"))

    banded = windows.withColumn("b", F.explode(bands(F.col("have")))).select("id", "tail", "klass", "window", "have", "places", "b.band", "b.value")
    sought = known.withColumn("b", F.explode(bands(F.col("grams")))).select("license", F.col("klass").alias("k"), F.col("grams").alias("want"), F.col("b.band").alias("band"), F.col("b.value").alias("value"))
    pairs = banded.join(F.broadcast(sought), ["band", "value"]).filter(F.col("klass") == F.col("k"))  # BANDS rows per template
    share = F.size(F.array_intersect("have", "want")) / F.size("want")
    own = F.transform(F.filter("places", lambda p: F.array_contains(F.col("want"), p["gram"])), lambda p: p["pos"])
    sure = pairs.withColumn("containment", share).filter(F.col("containment") >= least)
    best = F.max(F.struct("containment", (-F.col("window")).alias("w"), F.array_min(own).alias("first_word"), (F.array_max(own) + SHINGLE - 1).alias("last_word")))
    found = sure.groupBy("id", "tail", "license").agg(best.alias("best"))
    return found.select(F.col("id").alias(id_col), "license", "best.containment", "best.first_word", "best.last_word")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _rows(templates: dict[str, str]) -> str:
    quoted = [tuple("'" + x.replace("'", "''") + "'" for x in item) for item in sorted(templates.items())]
    return ", ".join(f"({name}, {body})" for name, body in quoted)


#: Containment of every template in every window, counted outright.
SQL = rf"""
WITH known(license, body) AS (VALUES {_rows(TEMPLATES)}),
cut AS (SELECT license, list_filter(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM known),
want AS (SELECT DISTINCT license, greatest(3, CAST(ceil(log2(len(w))) AS INTEGER)) AS klass, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS gram FROM (SELECT license, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM cut)),
sizes AS (SELECT license, count(*) AS n FROM want GROUP BY license),
texts AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
grams AS (SELECT r, doc_id, i - 1 AS pos, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS gram FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM texts WHERE len(w) >= {SHINGLE})),
hits AS (SELECT *, pos // (1 << (klass - 1)) AS last FROM grams JOIN want USING (gram)),
windows AS (SELECT *, unnest(range(greatest(0, last - 2), last + 1)) AS k FROM hits),
shares AS (SELECT r, doc_id, license, k, count(DISTINCT gram) AS have, min(pos) AS first_word, max(pos) + {SHINGLE - 1} AS last_word FROM windows GROUP BY r, doc_id, license, k)
SELECT doc_id, license, have / n::DOUBLE AS containment, CAST(first_word AS INTEGER) AS first_word, CAST(last_word AS INTEGER) AS last_word
FROM shares JOIN sizes USING (license) WHERE have / n::DOUBLE >= {CONTAINMENT}
QUALIFY row_number() OVER (PARTITION BY r, license ORDER BY have DESC, k) = 1
"""
