"""License notices in documents: MinHash bands over overlapping windows, then exact containment.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.text import let, window_hashes

SHINGLE = 5  # words
CONTAINMENT = 0.8
# A window holds under 4.2 times the shingles of its template, so one that contains 0.8 of them has a
# similarity above 0.19 to it, and misses all bands of one hash with a chance below 0.81 ** 64 = 1.4e-6.
BANDS = 64

# Short public license notices.
TEMPLATES: Mapping[str, str] = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction"
    ),
    "Apache-2.0-notice": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    ),
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation"
    ),
}


def notice_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    none = F.array().cast("array<string>")
    spaced = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return let(spaced, lambda t: F.when(t == "", none).otherwise(F.split(t, " ")))


def template_shingles(spark: SparkSession, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """license, shingles, stride: the power of two that is the next to the number of shingles."""
    listed = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in templates.items()])
    shingles = F.array_distinct(window_hashes(notice_words(F.col("t.text")), SHINGLE))
    rows = spark.range(1).select(F.explode(listed).alias("t")).select("t.license", shingles.alias("shingles"))
    return rows.withColumn("stride", F.ceil(F.log2(F.size("shingles").cast("double"))).cast("int")).withColumn(
        "stride", F.expr("shiftleft(1, stride)")
    )


def signature(window: Column) -> Column:
    """(band, value) per hash function: the least hash of the window's shingles."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.struct(
            i.alias("band"), F.array_min(F.transform(window, lambda x: F.xxhash64(x, i))).alias("value")
        ),
    )


def license_matches(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment, first_word, last_word of every notice found in a row of docs.

    Shingles are runs of five words (lower-cased letters and digits). For
    templates of up to s shingles, s a power of two, a document is cut into
    windows of 2 s shingles, a new one every s: any passage of s shingles lies
    whole in one of them. Windows that share a MinHash band with a template are
    compared exactly: a notice is found where a window holds at least 0.8 of
    the template's shingles. Of several windows the one with most, then the
    first, is reported, with the places of the first and last word it shares.

    Only windows with at least one shingle of some template get a signature.
    That loses nothing: a band that a window shares with a template is the hash
    of a shingle of the template. Templates are parameters, held on the driver;
    each needs five words.

    NULL, empty and shorter texts match nothing. Repeated rows are reported one
    by one. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    known = template_shingles(spark, templates).collect()
    if short := [t["license"] for t in known if not t["shingles"]]:
        raise ValueError(f"templates of under {SHINGLE} words: {short}")
    anywhere = sorted({x for t in known for x in t["shingles"]})
    strides = sorted({t["stride"] for t in known})

    rows = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_"),
        window_hashes(notice_words(F.col("text")), SHINGLE).alias("h"),
    )
    at = F.filter(
        F.transform("h", lambda x, i: F.when(x.isin(anywhere), i)), lambda i: i.isNotNull()
    )
    rows = rows.withColumn("at", at).where(F.size("at") > 0)

    def windows(stride: int) -> Column:
        numbers = F.flatten(F.transform("at", lambda p: F.array(F.floor(p / stride), F.floor(p / stride) - 1)))
        numbers = F.array_distinct(F.filter(numbers, lambda w: w >= 0))
        return F.transform(
            numbers,
            lambda w: F.struct(
                F.lit(stride).alias("stride"),
                (w * stride).cast("int").alias("begin"),
                F.slice("h", (w * stride + 1).cast("int"), 2 * stride).alias("window"),
            ),
        )

    cut = rows.select("doc_id", "row_", F.explode(F.concat(*[windows(s) for s in strides])).alias("w"))
    signed = cut.select("doc_id", "row_", "w.*", F.explode(signature(F.col("w.window"))).alias("s"))
    marks = template_shingles(spark, templates).select(
        "license", "stride", "shingles", F.explode(signature(F.col("shingles"))).alias("s")
    )
    met = signed.withColumns({"band": F.col("s.band"), "value": F.col("s.value")}).join(
        F.broadcast(marks.select("license", "stride", "shingles", "s.band", "s.value")),  # the parameter
        ["stride", "band", "value"],
    )
    shared = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
    places = F.filter(
        F.transform("window", lambda x, i: F.when(F.array_contains("shingles", x), i)), lambda i: i.isNotNull()
    )
    checked = met.select("doc_id", "row_", "license", "begin", shared.alias("containment"), places.alias("places")).where(
        F.col("containment") >= CONTAINMENT
    )
    span = F.struct(
        F.col("containment").alias("containment"),
        (-F.col("begin")).alias("from_end"),
        (F.col("begin") + F.array_min("places")).alias("first_word"),
        (F.col("begin") + F.array_max("places") + SHINGLE - 1).alias("last_word"),
    )
    best = checked.groupBy("row_", "license").agg(F.first("doc_id").alias("doc_id"), F.max(span).alias("b"))
    return best.select("doc_id", "license", "b.containment", "b.first_word", "b.last_word")
