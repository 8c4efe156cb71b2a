"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them.

A template of L shingles is looked for in windows of 2C shingles that begin at every C-th, where C is the step of a fixed
ladder next above L: any L shingles in a row lie within one window whole. The sketch of a window, and of a template, is
its BANDS smallest shingle hashes (bottom-k MinHash, one hash for each shingle); each value of it is a band of one
coordinate. All windows of all texts are hashed and their bands joined to those of a small table of templates.

Two sets of similarity J share none of k smallest hashes with probability (1 - J)^k at most. A window that holds three
quarters of a template has J of 0.24 or more (L is at least C / sqrt 2), so 32 bands retrieve it but for 1.5 times in
10,000; up to 16 shingles the sketch of a window is the window itself and retrieves all. What collides is verified on the
shingles themselves, as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, cut_lineage, table, words_of

#: Notices by which well-known licenses are applied to a work, and two whole license texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR"
        " DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT"
        " SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS"
        " OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH"
        " THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
        " \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING"
        " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
        " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
        " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
WIDTH, BANDS, CONTAINED = 5, 32, 0.75
#: Steps of windows: 16 and on by the square root of two.
LADDER = [round(16 * 2 ** (i / 2)) for i in range(40)]
#: Templates that may be broadcast: BANDS rows of each, about 2 MB in all.
MOST_TEMPLATES = 1000
#: Parts that the rows of one text are dealt to when they fetch its result, so that a common row is no hot key.
_PARTS = 16


def _shingles(words: Column, width: Column | int) -> Column:
    """The shingles of `width` words of an array of words, in order, as texts; none for fewer words."""
    last = F.size(words) - width + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, width), " "))


def _hashes(words: Column, width: int) -> Column:
    """Hashes of the shingles of an array of word hashes, in order."""
    last = F.size(words) - (width - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))


def _sketch(hashes: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, BANDS)


def _template_table(templates: DataFrame) -> DataFrame:
    """license, own (distinct shingles), length, width, step, sketch. A notice of fewer than five words is one shingle of
    all its words."""
    words = templates.select("license", words_of(ascii_lower(F.col("notice"))).alias("w")).where("size(w) > 0")
    wide = words.withColumn("width", F.least(F.size("w"), F.lit(WIDTH))).withColumn("own", F.array_distinct(_shingles(F.col("w"), F.col("width"))))
    long = wide.withColumn("length", F.size("own")).withColumn("step", F.array_min(F.filter(F.array(*map(F.lit, LADDER)), lambda c: c >= F.col("length"))))
    hashed = F.transform("own", lambda s: F.xxhash64(F.transform(F.split(s, " "), lambda w: F.xxhash64(w))))
    return long.select("license", "own", "length", "width", "step", _sketch(hashed).alias("sketch"))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | DataFrame | None = None
) -> DataFrame:
    """One row (doc_id, licenses) for each row of `docs`: an array of (license, window, found, containment) by name,
    one for each template that a window holds to three quarters; of several windows the fullest, then the first. A window
    is named by its number, counted in steps of its template.

    `templates`: notices or whole license texts by name, or a table (license, notice); one without words is found nowhere.
    Words are what stands between white space, A-Z as a-z. Null, empty and short texts hold nothing; very long ones are
    searched whole; rows that repeat an id or have none are rows of their own. An empty table gives no rows. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(sorted((TEMPLATES if templates is None else templates).items()), "license string, notice string")
    known = cut_lineage(_template_table(templates.select("license", "notice")))
    if known.count() > MOST_TEMPLATES:
        raise ValueError("more templates than may be broadcast")
    kinds = [(r.width, r.step) for r in known.select("width", "step").distinct().orderBy("width", "step").collect()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.xxhash64("doc_id", "t").alias("h1"), F.xxhash64(F.lit("row"), "doc_id", "t").alias("h2")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    hashed = rows.select(*key, words_of(ascii_lower(F.col("t"))).alias("w")).withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    hashed = hashed.select("h1", "h2", "w", *(_hashes(F.col("hw"), m).alias(f"s{m}") for m in sorted({m for m, _ in kinds})))

    def numbered(width: int, step: int) -> Column:
        count = F.ceil(F.size(f"s{width}") / step)
        numbers = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda k: F.struct(F.lit(width).alias("width"), F.lit(step).alias("step"), k.alias("window")))

    none = F.array().cast("array<struct<width: int, step: int, window: bigint>>")
    each = hashed.withColumn("x", F.explode(F.concat(none, *(numbered(*kind) for kind in kinds))))
    begin, span = (F.col("x.window") * F.col("x.step") + 1).cast("int"), 2 * F.col("x.step")
    own = F.lit(None).cast("array<bigint>")
    for m in {m for m, _ in kinds}:
        own = F.when(F.col("x.width") == m, F.col(f"s{m}")).otherwise(own)
    banded = each.withColumn("value", F.explode(_sketch(F.slice(own, begin, span))))
    offers = known.select("license", "width", "step", F.explode("sketch").alias("value"))
    named = banded.select("h1", "h2", "w", "value", "x.*", begin.alias("begin"), (span + F.col("x.width") - 1).alias("n_words"))
    met = named.join(F.broadcast(offers), ["width", "step", "value"]).select(
        "h1", "h2", "license", "window", F.array_join(F.slice("w", F.col("begin"), F.col("n_words")), " ").alias("words")
    )
    met = cut_lineage(met.groupBy("h1", "h2", "license", "window").agg(F.first("words").alias("words")))
    both = met.join(known.drop("sketch"), "license")
    found = F.size(F.array_intersect(_shingles(F.split("words", " "), F.col("width")), F.col("own"))).cast("long")
    held = both.select("h1", "h2", "license", "window", "length", found.alias("found")).withColumn(
        "containment", F.col("found") / F.col("length")
    ).where(F.col("containment") >= CONTAINED)
    first = Window.partitionBy("h1", "h2", "license").orderBy(F.desc("containment"), "window")
    best = held.withColumn("place", F.row_number().over(first)).where("place = 1")
    of_text = best.groupBy("h1", "h2").agg(
        F.array_sort(F.collect_list(F.struct("license", "window", "found", "containment"))).alias("licenses")
    ).withColumn("part", F.explode(F.array(*map(F.lit, range(_PARTS)))))
    nothing = F.array().cast(of_text.schema["licenses"].dataType)
    asked = rows.select("doc_id", *key, F.pmod(F.monotonically_increasing_id(), F.lit(_PARTS)).cast("int").alias("part"))
    return asked.join(of_text, ["h1", "h2", "part"], "left").select("doc_id", F.coalesce("licenses", nothing).alias("licenses"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["window"], x["found"])), ",").alias("windows"),
    )


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
_STEPS = ", ".join(f"({c})" for c in LADDER)
OP4_SQL = rf"""
WITH templates(license, notice) AS (
    VALUES {_TEMPLATE_ROWS}
), steps(step) AS (
    VALUES {_STEPS}
), texts AS (
    SELECT NULL AS license, doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT license, NULL, notice FROM templates
), words AS (
    SELECT license, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM texts
), shingles AS (
    SELECT license, doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s
    FROM words, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) t
), own AS (
    SELECT DISTINCT license, s FROM shingles WHERE license IS NOT NULL
), lengths AS (
    SELECT license, n, min(step) AS c FROM (SELECT license, count(*) AS n FROM own GROUP BY license) JOIN steps ON step >= n GROUP BY license, n
), hits AS (
    SELECT d.doc_id, o.license, n, c, d.pos, d.s FROM shingles d JOIN own o ON d.s = o.s JOIN lengths l ON l.license = o.license
    WHERE d.license IS NULL
), placed AS (
    SELECT doc_id, license, n, pos // c AS k, s FROM hits UNION ALL SELECT doc_id, license, n, pos // c - 1, s FROM hits
), held AS (
    SELECT doc_id, license, k, count(DISTINCT s) AS found,
           row_number() OVER (PARTITION BY doc_id, license ORDER BY count(DISTINCT s) DESC, k) AS r
    FROM placed WHERE k >= 0 GROUP BY doc_id, license, k, n HAVING count(DISTINCT s) >= 0.75 * n
)
SELECT d.doc_id, count(license) AS n_licenses, coalesce(string_agg(license, ',' ORDER BY license), '') AS licenses,
       coalesce(string_agg(k || ':' || found, ',' ORDER BY license), '') AS windows
FROM documents d LEFT JOIN held h ON h.doc_id = d.doc_id AND h.r = 1 GROUP BY d.doc_id
"""
