"""License scan with MinHash bands over text windows, in DataFrame functions only.

A text's words (lower case) make five-word shingles.  A window is four
consecutive shingles (eight words); windows begin at every second word.  Each
of ``BANDS`` bands has one row: the smallest of the window's shingles under a
seeded hash.  Windows and templates that agree in a band meet.  A document
whose best place has five consecutive shingles of a template holds one of its
windows whole, and equal windows agree in all bands, so it is always
retrieved; a window that shares a part s of its shingles (Jaccard) is with
probability 1 - (1 - s)**BANDS.  Templates of fewer than eight shingles are
retrieved by any of their shingles.

A retrieved document is verified exactly: the part of a template's distinct
shingles that it has must be ``PERCENT`` or more.  Containment of 75 % leaves
five consecutive shingles unless words are scattered one by one.

Nulls and texts of fewer than five words have no match.  Repeated rows are
judged each.  Extra columns are ignored.  All templates' band values are in the
plan as literals; there may be ``MAX_TEMPLATES`` at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE, ROWS_IN_WINDOW, STEP, BANDS, PERCENT = 5, 4, 2, 3, 75
MAX_TEMPLATES = 500

# Notices that licences ask to be put into files, and short forms in use.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def _words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _hashes(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))


def _shingles(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.concat_ws(" ", F.slice(words, i + 1, SHINGLE)))


def _bands(hashes: Column, step: int) -> list[Column]:
    """Of each band, the window minima; an array that is null for fewer shingles than a window's."""
    some = F.size(hashes) >= ROWS_IN_WINDOW
    at = F.sequence(F.lit(0), F.size(hashes) - ROWS_IN_WINDOW, F.lit(step))
    low = lambda k: lambda i: F.least(*[F.xxhash64(F.get(hashes, i + j), F.lit(k)) for j in range(ROWS_IN_WINDOW)])
    return [F.when(some, F.transform(at, low(k))) for k in range(BANDS)]


def _template_values(spark: SparkSession, templates: dict[str, str]) -> tuple[dict[str, list[str]], list[int], list[set[int]]]:
    """Shingles of each template; shingle hashes of short ones; band values of the others."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    t = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", _words(F.col("text")).alias("w"))
    t = t.where(F.size("w") >= SHINGLE).select("name", F.array_distinct(_shingles(F.col("w"))).alias("s"), _hashes(F.col("w")).alias("h"))
    shingles, short, bands = {}, set(), [set() for _ in range(BANDS)]
    for r in t.select("name", "s", "h", *[b.alias(f"b{k}") for k, b in enumerate(_bands(F.col("h"), 1))]).collect():
        shingles[r["name"]] = list(r["s"])
        if len(r["h"]) < 2 * ROWS_IN_WINDOW:
            short |= set(r["h"])
        else:
            for k in range(BANDS):
                bands[k] |= set(r[f"b{k}"])
    return shingles, sorted(short), bands


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc_id, retrieved, licenses (names, ascending, comma-joined), n_licenses for each document."""
    shingles, short, bands = _template_values(docs.sparkSession, TEMPLATES if templates is None else templates)
    worded = docs.select(F.col(doc_id).alias("doc_id"), _words(F.col(text)).alias("__w"))
    hashed = worded.select("doc_id", "__w", F.when(F.size("__w") >= SHINGLE, _hashes(F.col("__w"))).alias("__h"))
    known = lambda values: lambda x: x.isin(list(values)) if values else F.lit(False)
    meet = F.exists("__h", known(short))
    for k, b in enumerate(_bands(F.col("__h"), STEP)):
        meet = meet | F.coalesce(F.exists(b, known(bands[k])), F.lit(False))
    found = hashed.select("doc_id", "__w", F.coalesce(meet, F.lit(False)).alias("retrieved"))
    own = F.when(F.col("retrieved"), F.array_distinct(_shingles(F.col("__w"))))
    checked = found.select("doc_id", "retrieved", own.alias("__s"))
    names = [
        F.when(F.size(F.array_intersect(F.array(*map(F.lit, s)), F.col("__s"))) * 100 >= len(s) * PERCENT, F.lit(n)) for n, s in sorted(shingles.items())
    ]
    names = F.when(F.col("retrieved"), F.array_compact(F.array(*names))).otherwise(F.array().cast("array<string>"))
    return checked.select("doc_id", "retrieved", names.alias("__n")).select(
        "doc_id", "retrieved", F.concat_ws(",", "__n").alias("licenses"), F.size("__n").cast("long").alias("n_licenses")
    )
