"""License scans by diagonal voting (DataFrame functions only).

All rolling word k-grams of the texts join the k-grams of license templates.
A hit at word p of a text and position q of a template votes for diagonal
p - q: the place where the template would begin. Votes are counted per diagonal;
neighbouring diagonals (a word more or less in the text) are merged; a span
counts when enough of the template's k-grams stand in it. The join compares
the words themselves, and a short phrase must be there in full.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pozo.llm.frames import row_key
from pozo.llm.license_texts import BODIES

K = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False          # a phrase that must stand in full
    coverage: float = 0.8       # share of the template's k-grams a span must hold


# Phrases whose places are counted.
BASE = [Template("mit", "under the mit license", True), Template("apache-2", "apache license version 2", True),
        Template("cc-by-nc", "cc by nc", True)]

# Passages that public licenses and their notices use, and whole bodies of short ones.
PASSAGES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
             "compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
             "that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("gpl", "licensed under the gnu general public license version", coverage=0.6),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
             "the free software foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by", "licensed under a creative commons attribution", coverage=1.0),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved", coverage=1.0),
    *[Template(label, body) for label, body in BODIES.items()],
]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def text_words(c: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _table(spark: SparkSession, templates: list[Template], k: int) -> DataFrame:
    """One row per template position: bounded by the templates' own length."""
    rows = []
    for t, template in enumerate(templates):
        words = template_words(template.text)
        if len(words) < k:
            raise ValueError(f"a template needs at least {k} words: {template.text!r}")
        n = len(words) - k + 1
        rows += [(t, template.label, template.base, 1.0 if template.base else template.coverage, n, q, *words[q:q + k])
                 for q in range(n)]
    names = [f"w{i}" for i in range(k)]
    schema = "t int, label string, base boolean, need double, grams int, q int, " + ", ".join(f"{w} string" for w in names)
    return spark.createDataFrame(rows, schema).withColumn("gram", F.xxhash64(*names))


def spans(docs: DataFrame, templates: list[Template], k: int = K, slack: int = 2) -> DataFrame:
    """Verified and other spans of rows with (_k1, _k2, text): (_k1, _k2, t, label, base, need, start, last, share)."""
    names = [f"w{i}" for i in range(k)]
    table = F.broadcast(_table(docs.sparkSession, templates, k))
    words = docs.select("_k1", "_k2", text_words(F.col("text")).alias("w")).where(F.size("w") >= k)
    zipped = F.arrays_zip(*[F.slice("w", i + 1, F.greatest(F.size("w") - (k - 1), F.lit(0))).alias(n) for i, n in enumerate(names)])
    grams = (words.select("_k1", "_k2", F.posexplode(zipped).alias("p", "g"))
             .select("_k1", "_k2", "p", *[F.col("g")[n].alias(n) for n in names])
             .withColumn("gram", F.xxhash64(*names)))
    hits = grams.join(table, ["gram", *names])
    votes = (hits.groupBy("_k1", "_k2", "t", "label", "base", "need", "grams", (F.col("p") - F.col("q")).alias("diagonal"))
             .agg(F.collect_set("q").alias("qs"), F.min("p").alias("lo"), F.max("p").alias("hi")))
    # Neighbouring diagonals of one passage; a phrase that must be complete has only its own.
    line = Window.partitionBy("_k1", "_k2", "t").orderBy("diagonal")
    fresh = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > slack, F.lit(True))
    grouped = votes.withColumn("run", F.sum(fresh.cast("int")).over(line))
    merged = grouped.groupBy("_k1", "_k2", "t", "label", "base", "need", "grams", "run").agg(
        F.min("diagonal").alias("start"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))
    share = F.size("qs") / F.col("grams")
    return merged.select("_k1", "_k2", "t", "label", "base", "need", "start", "lo", (F.col("hi") + k - 1).alias("last"),
                         F.least(share, F.lit(1.0)).alias("share"))


def scan(docs: DataFrame, base: list[Template] | None = None, passages: list[Template] | None = None, k: int = K,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, found) for every row.

    ``n_base`` counts the places of the base phrases, ``first_word`` and
    ``last_word`` their smallest and largest start (null without any);
    ``labels`` adds the labels of passages whose share of k-grams in a span
    reaches the template's ``coverage``; ``score`` is the largest share of any
    template, 0 to 1; ``found`` lists the verified spans. Null and empty texts
    have no words and no labels; equal rows get equal results; null or
    repeated ids are rows of their own; other columns are ignored. The
    template table is the only thing broadcast; its size is that of the lists.
    """
    templates = (BASE if base is None else base) + (PASSAGES if passages is None else passages)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    rows = rows.select("_id", *row_key("_id", "text"), "text")
    got = spans(rows, templates, k)
    good = F.col("share") >= F.col("need")
    place = F.when(F.col("base") & good, F.col("start"))
    facts = got.groupBy("_k1", "_k2").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        F.collect_set(F.when(F.col("base") & good, F.col("label"))).alias("base_set"),
        F.collect_set(F.when(good, F.col("label"))).alias("all_set"), F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(good, F.struct("lo", "last", "label", "share")))).alias("found"))
    words = rows.select("_id", "_k1", "_k2", F.size(text_words(F.col("text"))).cast("long").alias("n_words"))
    out = words.join(facts, ["_k1", "_k2"], "left")
    joined = lambda c: F.concat_ws(",", F.array_sort(F.coalesce(c, F.array().cast("array<string>"))))
    return out.select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        joined(F.col("base_set")).alias("base_labels"), joined(F.col("all_set")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "found")
