"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Words are runs of letters and digits, in lower case; shingles are five words. A template of fewer words is one shingle
of its own length and is looked for among the document's runs of that length. Templates
with u/2 < q <= u distinct shingles (u a power of two) are looked for in windows of 2u shingles, one every u, so a
passage of up to u shingles lies whole in a window, and containment of 4/5 means a Jaccard similarity of 4/21 or more.
``BANDS`` one-row bands make such a pair collide with probability 0.9999. A band collides when window and template
have the same smallest value, so signatures are needed only for windows that hold a shingle which is smallest in a
template. A colliding template is verified by the share of its shingles among all shingles of the document.

Everything is a column expression over one document; no row is shuffled. Templates are literals of the expressions,
in blocks of ``BLOCK`` templates; the documents are read once per block.

Null texts and texts without letters or digits match nothing. Repeated rows match each, null ids are kept, ties cannot
arise: every matching template is reported. Templates without words are never found. Empty tables give empty results.
Other columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.tables import let

SHINGLE = 5
BANDS = math.ceil(math.log(1e-4) / math.log(1 - 4 / 21))
BLOCK = 200
FOUND_TYPE = "array<struct<license_id:string,n_shingles:bigint,n_shared:bigint>>"
TEMPLATE_TYPE = "array<struct<id:string,u:int,low:array<bigint>,own:array<bigint>>>"

#: The customary notices of public licences.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License"
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-licensed": "Licensed under the MIT License",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-2.0-header": "either version 2 of the License, or (at your option) any later version",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "ISC-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "EPL-2.0": "under the terms of the Eclipse Public License 2.0",
} | {
    f"SPDX-{name}": f"SPDX-License-Identifier: {name}"
    for name in (
        "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0",
        "EPL-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
    )
}

#: Under five words. The SQL below takes such a template for the whole text, so the query leaves them to ``scan``.
SHORT_NOTICES = {
    "All-rights-reserved": "All rights reserved.",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-ISC": "SPDX-License-Identifier: ISC",
    "SPDX-Unlicense": "SPDX-License-Identifier: Unlicense",
}


def notices(spark: SparkSession, short: bool = False) -> DataFrame:
    return spark.createDataFrame(list((NOTICES | (SHORT_NOTICES if short else {})).items()), "license_id string, text string")


def word_hashes(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    hashed = F.transform(F.split(plain, " "), lambda w: F.xxhash64(w))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(hashed)


def runs_of(h: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words, in order."""
    made = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    return F.when(F.size(h) >= n, made).otherwise(F.array().cast("array<bigint>"))


def banded(own: Column) -> Column:
    """Smallest value of every band over the shingles."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)), lambda band: F.array_min(F.transform(own, lambda s: F.xxhash64(s, band)))
    )


def template_rows(templates: DataFrame) -> DataFrame:
    """license_id, words of a shingle, shingles, size partition, band values, the shingle that is smallest in each band."""
    made = templates.select("license_id", word_hashes(F.col("text")).alias("h"))
    made = made.withColumn("n_words", F.least(F.size("h"), F.lit(SHINGLE))).filter("n_words > 0")
    own = F.coalesce(*[F.when(F.col("n_words") == n, runs_of(F.col("h"), n)) for n in range(1, SHINGLE + 1)])
    made = made.select("license_id", "n_words", F.array_distinct(own).alias("own"))
    made = made.withColumn("low", banded(F.col("own")))
    least = F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda band: F.array_min(F.transform("own", lambda s: F.struct(F.xxhash64(s, band).alias("h"), s.alias("s"))))["s"],
    )
    u = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("own").cast("double"))).cast("double"))
    return made.select("license_id", "n_words", "own", "low", F.array_distinct(least).alias("least"), u.cast("int").alias("u"))


def found_templates(runs: Column, block: list) -> Column:
    """The (license_id, n_shingles, n_shared) of the block's templates in a document's shingles."""
    told = [{"id": t["license_id"], "u": t["u"], "low": t["low"], "own": t["own"]} for t in block]
    table = F.from_json(F.lit(json.dumps(told)), TEMPLATE_TYPE)
    marks = sorted({s for t in block for s in t["least"]})

    def windows(at: Column, s: Column) -> Column:
        """Band values of the windows of each size that hold one of the places ``at``."""
        made = []
        for u in sorted({t["u"] for t in block}):
            near = F.flatten(
                F.transform(at, lambda i: F.array(F.floor(i / u), F.greatest(F.floor(i / u) - 1, F.lit(0).cast("long"))))
            )
            made.append(
                F.transform(
                    F.array_distinct(near),
                    lambda k: F.struct(
                        F.lit(u).alias("u"), banded(F.slice(s, (k * u + 1).cast("int"), F.lit(2 * u))).alias("low")
                    ),
                )
            )
        return F.concat(*made)

    def matches(s: Column, near: Column) -> Column:
        def retrieved(t: Column) -> Column:
            def collides(w: Column) -> Column:
                return (w["u"] == t["u"]) & F.exists(F.zip_with(w["low"], t["low"], lambda a, b: a == b), lambda x: x)

            return F.exists(near, collides)

        def verified(t: Column) -> Column:
            return F.struct(
                t["id"].alias("license_id"),
                F.size(t["own"]).cast("long").alias("n_shingles"),
                F.size(F.array_intersect(t["own"], s)).cast("long").alias("n_shared"),
            )

        told = F.transform(F.filter(table, retrieved), verified)
        return F.filter(told, lambda m: 5 * m["n_shared"] >= 4 * m["n_shingles"])

    def places(s: Column) -> Column:
        marked = F.filter(F.transform(s, lambda x, i: F.when(x.isin(marks), i)), lambda i: i.isNotNull())

        def search(at: Column) -> Column:
            return F.when(F.size(at) > 0, let(windows(at, s), lambda near: matches(s, near)))

        return let(marked, search)

    return let(runs, places)


def in_words(block: list):
    """The block's templates found in the hashes of a document's words."""

    def run(h: Column) -> Column:
        made = []
        for n in sorted({t["n_words"] for t in block}):
            found = found_templates(runs_of(h, n), [t for t in block if t["n_words"] == n])
            made.append(F.coalesce(found, F.array().cast(FOUND_TYPE)))
        return F.concat(*made)

    return run


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, license_id, n_shingles, n_shared and containment of every template found in a document."""
    spark = docs.sparkSession
    rows = template_rows(notices(spark) if templates is None else templates)
    # The library of templates is cut by the hash of the name; a block is what one expression holds.
    n_blocks = max(1, math.ceil(rows.count() / BLOCK))
    out = None
    for nth in range(n_blocks):
        block = rows.filter(F.pmod(F.xxhash64("license_id"), F.lit(n_blocks)) == nth).orderBy("license_id").collect()
        if block:
            found = docs.select("doc_id", F.explode(let(word_hashes(F.col("text")), in_words(block))).alias("m"))
            found = found.select(
                "doc_id", "m.*", (F.col("m.n_shared") / F.col("m.n_shingles")).cast("double").alias("containment")
            )
            out = found if out is None else out.unionByName(found)
    if out is None:
        schema = "doc_id long, license_id string, n_shingles long, n_shared long, containment double"
        return spark.createDataFrame([], schema)
    return out


def _value(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = f"""
WITH t(license_id, text) AS (VALUES {", ".join(f"({_value(k)}, {_value(v)})" for k, v in NOTICES.items())}),
d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w
  FROM documents),
tw AS (SELECT license_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM t),
ds AS (
  SELECT DISTINCT row_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT row_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE w[1] <> '')),
ts AS (
  SELECT DISTINCT license_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT license_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM tw)),
sizes AS (SELECT license_id, count(*) AS n_shingles FROM ts GROUP BY license_id),
shared AS (SELECT row_id, license_id, count(*) AS n_shared FROM ds JOIN ts USING (s) GROUP BY row_id, license_id)
SELECT doc_id, license_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (license_id) JOIN d USING (row_id)
WHERE 5 * n_shared >= 4 * n_shingles
"""
