"""License scan by MinHash bands over overlapping word windows, in DataFrame operations only (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.shared import stored

SHINGLE = 5
#: Shingles of a window, and from one window to the next: every two shingles in a row are together in some window.
WINDOW, STRIDE = 4, 2
#: Bands of one row. A template of two shingles that a text holds is half of some window, so a band matches with
#: probability 1/2 or more, and none of 16 with less than 2 in 100,000; longer templates have whole windows in common.
BANDS = 16
#: Band keys up to which they are a literal of the plan; beyond, windows meet them by a join.
MOST_KEYS = 20_000
#: What separates words: all of ASCII but letters and digits.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Notices as their licences word them.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]


def word_hashes(text: str) -> Column:
    """Hash of each word of a text, lower-cased; null for null."""
    return F.transform(F.array_remove(F.split(F.lower(F.col(text)), BREAK), ""), lambda w: F.xxhash64(w))


def _masks() -> list[int]:
    """A number for each band: hashes are ordered by their difference (exclusive or) from it, and so in another order for each."""
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(BANDS):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x - 2**64 if x >= 2**63 else x)
    return out


def _band(mask: int) -> Column:
    """The least hash of a window's shingles in the order of a band."""
    m = F.lit(mask).cast("long")
    return F.least(*[F.col(f"s{j}").bitwiseXOR(m) for j in range(WINDOW)])


def windows(rows: DataFrame, key: list[str], text: str, stride: int) -> DataFrame:
    """key, at (first word) and s0, s1, ..., the shingles of a window; the first again for those past the end."""
    # the words' hashes are made once and not for each shingle
    h = rows.select(*key, word_hashes(text).alias("h"))
    one = lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(SHINGLE)])
    s = h.select(*key, F.when(F.size("h") >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size("h") - SHINGLE), one)).alias("s"))
    at = lambda i: F.struct(i.alias("at"), *[F.coalesce(F.get("s", i + j), F.get("s", i)).alias(f"s{j}") for j in range(WINDOW)])
    starts = F.sequence(F.lit(0), F.size("s") - 1, F.lit(stride))
    return s.select(*key, F.explode(F.when(F.col("s").isNotNull(), F.transform(starts, at))).alias("w")).select(*key, "w.*")


def template_tables(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Band keys (template, band, key) of windows at every word, and shingles (template, shingle, total).

    templates has the columns template and notice; notices of one name count as one.
    """
    every = windows(templates.select("template", "notice"), ["template"], "notice", 1)
    bands = F.array(*[_band(m) for m in _masks()])
    keys = every.select("template", F.posexplode(bands).alias("band", "key")).distinct()
    each = every.select("template", F.col("s0").alias("shingle")).distinct()
    total = each.groupBy("template").agg(F.count("*").alias("total"))
    return stored(keys, "template-keys"), stored(each.join(total, "template"), "template-shingles")


def scan(docs: DataFrame, templates: DataFrame | None = None, at_least: float = 0.8, key: str = "doc_id", text: str = "text", most_keys: int = MOST_KEYS) -> DataFrame:
    """Templates that a text holds: key, template, containment, n_shingles found, first_word and last_word of them.

    templates (template, notice) is a table of any size, TEMPLATES where none is given. Windows of every whole text
    whose bands meet a template's retrieve it; all shingles of the retrieved
    text are then compared with the template's: containment is the share of the
    template's distinct five-word shingles that the text has. A text of under
    five words holds none; a template of under five words is never found. Rows
    that repeat a key count as one text, rows without a key as one too. Null
    and empty texts and empty tables give no rows; ties can't occur. Other
    columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    if templates is None:
        templates = spark.createDataFrame(TEMPLATES, "template string, notice string")
    keys, wanted = template_tables(templates)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = windows(rows, ["k"], "t", STRIDE)
    if keys.count() <= most_keys:
        # most windows meet no template: they are dropped before their bands become rows
        known = [{r["key"] for r in keys.filter(F.col("band") == b).select("key").distinct().collect()} for b in range(BANDS)]  # at most most_keys
        hit = F.lit(False)
        for m, some in zip(_masks(), known):
            hit = hit | _band(m).isin(some)
        found = found.filter(hit)
    met = found.select("k", F.posexplode(F.array(*[_band(m) for m in _masks()])).alias("band", "key")).join(keys, ["band", "key"]).select("k", "template").distinct()
    met = stored(met, "licensed")
    texts = rows.join(met.select("k").distinct(), rows["k"].eqNullSafe(met["k"]), "left_semi")
    own = texts.select("k", word_hashes("t").alias("h"))
    one = lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(SHINGLE)])
    own = own.filter(F.size("h") >= SHINGLE).select("k", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("h") - SHINGLE), one)).alias("place", "shingle"))
    each = own.join(wanted, "shingle").groupBy("k", "template", "shingle").agg(F.first("total").alias("total"), F.min("place").alias("low"), F.max("place").alias("high")).groupBy("k", "template")
    out = each.agg((F.count("*") / F.first("total")).alias("containment"), F.count("*").alias("n_shingles"), F.min("low").cast("long").alias("first_word"), (F.max("high") + SHINGLE - 1).cast("long").alias("last_word"))
    out = out.filter(F.col("containment") >= at_least)
    kept = met.select(F.col("k").alias("mk"), F.col("template").alias("mt"))
    return out.join(kept, out["k"].eqNullSafe(kept["mk"]) & (out["template"] == kept["mt"]), "left_semi").withColumnRenamed("k", key)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "template", F.round("containment", 6).alias("containment"), "n_shingles", "first_word", "last_word")


def _sql_templates() -> str:
    return ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)


OP5_SQL = f"""
WITH t(template, notice) AS (VALUES {_sql_templates()}),
tw AS (SELECT template, list_filter(regexp_split_to_array(lower(notice), '{BREAK}'), lambda x: x <> '') AS w FROM t),
ts AS (SELECT DISTINCT template, array_to_string(w[i:i+4], ' ') AS shingle FROM tw, unnest(range(1, len(w) - 3)) AS u(i)),
tn AS (SELECT template, count(*) AS total FROM ts GROUP BY 1),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{BREAK}'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS place, array_to_string(w[i:i+4], ' ') AS shingle FROM dw, unnest(range(1, len(w) - 3)) AS u(i)),
m AS (SELECT doc_id, template, count(DISTINCT shingle) AS n_shingles, min(place) AS first_word, max(place) + 4 AS last_word
      FROM ds JOIN ts USING (shingle) GROUP BY 1, 2)
SELECT doc_id, template, round(n_shingles / total, 6) AS containment, n_shingles, first_word, last_word
FROM m JOIN tn USING (template) WHERE n_shingles / total >= 0.8
"""
