"""Licences in texts by diagonal voting, in DataFrame operations only.

A text's words are hashed, and a rolling window of k words makes a hash at each place. All of these are joined with the places of the same k-grams in
the templates, a fixed list of short texts whose size is checked before it is sent to all tasks. A hit at place p of a text and t of a template
votes for the diagonal p - t; hits are counted by text, template and diagonal before and after their shuffle. Neighbouring diagonals of a template,
apart by at most a fifth of its length, are one occurrence with words left out, put in or changed. Its span, from the first to the last hit, is verified: the k-grams themselves were compared,
not just their hashes, and the template's distinct k-grams found must be `least` of the larger of those that the template and the span have.

Base phrases are found where their words stand one after the other. Each text also sends one row of its own figures through the same
join, so texts are read and cut once, and what is shuffled is that row and the hits.

Defined results: a null or empty text has no words, phrases or labels (empty strings, score 0); null and repeated ids and repeated rows are each answered; of templates with
one label the best score counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What lies between words: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases of the contract, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# What well-known licences ask to be written beside a work, and short forms that are common; with their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license. You may obtain a copy of the license at http www apache org licenses LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("mpl-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case."""
    lowered = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _here(text: str) -> list[str]:
    """words_of for the fixed lists."""
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(ascii_uppercase, ascii_lowercase))) if w]


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is worked out once a row, however often it is used: a generator makes it, which no later projection folds in."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def gram_hashes(words: Column, k: int) -> Column:
    """The hash of each window of k words, by its first word's place. words is a column, not an expression."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words) - k + 1
    rolled = F.transform(F.array(hashes), lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)])))
    return F.get(rolled, F.lit(0))


def phrase_starts(words: Column, phrase: list[str]) -> Column:
    """Places at which all words of a phrase follow each other."""
    places = F.sequence(F.lit(0), F.size(words) - len(phrase))
    found = F.filter(places, lambda i: F.forall(F.array(*[F.get(words, i + j) == w for j, w in enumerate(phrase)]), lambda x: x))
    likely = F.size(words) >= len(phrase)
    for w in phrase:
        likely = likely & F.array_contains(words, w)
    return F.when(likely, found).otherwise(F.array().cast("array<int>"))


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...], k: int, most: int = 1_000_000) -> DataFrame:
    """(template, label, t, grams, gram, key): the places of all templates' k-grams. The list is the caller's, so its size is known; a larger one isn't sent to every task."""
    parted = [(n, label, _here(text)) for n, (label, text) in enumerate(templates)]
    if any(len(w) < k for _, _, w in parted):
        raise ValueError(f"a template has fewer than {k} words")
    if sum(len(w) for _, _, w in parted) > most:
        raise ValueError(f"templates of over {most} words are no list to send to every task")
    listed = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.array(*map(F.lit, w)).alias("words")) for n, label, w in parted])
    rows = spark.range(1).select(F.explode(listed).alias("x")).select("x.*").where(F.size("words") >= k)
    places = rows.select("template", "label", (F.size("words") - k + 1).alias("grams"), "words", F.posexplode(gram_hashes(F.col("words"), k)).alias("t", "key"))
    return places.select("template", "label", "grams", "t", "key", F.slice(F.col("words"), F.col("t") + 1, F.lit(k)).alias("gram"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = 3, least: float = 0.6) -> DataFrame:
    """One row per document: n_words, the base phrases' starts and labels, and spans, the verified occurrences of templates, by start."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = _once(rows, "words", words_of(F.col("text"))).drop("text")
    named = [(label, phrase_starts(F.col("words"), _here(p))) for p, label in phrases.items()]
    base = F.array(*[F.struct(F.lit(label).alias("label"), starts.alias("starts")) for label, starts in named])
    rows = rows.withColumn("base", F.filter(base, lambda x: F.size(x["starts"]) > 0))
    # Place -1 is the text's own row, which has no key.
    keys = F.array_prepend(gram_hashes(F.col("words"), k), F.lit(None).cast("long"))
    grams = rows.select("row", "doc_id", "words", "base", F.posexplode(keys).alias("p", "key")).withColumn("p", F.col("p") - 1)
    known = F.broadcast(template_grams(spark, templates, k))
    same = grams["key"] == known["key"]
    for j in range(k):
        same = same & (F.get(grams["words"], F.col("p") + j) == F.get(F.col("gram"), F.lit(j)))
    hits = grams.join(known, same, "left").where("p < 0 OR template IS NOT NULL")
    own = F.col("p") < 0
    hits = hits.select("row", F.when(own, F.struct("doc_id", F.size("words").cast("long").alias("n_words"), "base")).alias("own"), "template", "label", "grams", "p", "t", (F.col("p") - F.col("t")).alias("diagonal"))
    votes = hits.groupBy("row", "template", "diagonal").agg(F.first("own", ignorenulls=True).alias("own"), F.first("label").alias("label"), F.first("grams").alias("grams"), F.collect_set("t").alias("ts"), F.min("p").alias("low"), F.max("p").alias("high"))
    # A text's diagonals of one template: as many as that text is long, at most.
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.greatest(F.lit(1), F.floor((F.col("grams") + k - 1) / 5))
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= near, 0).otherwise(1)
    merged = votes.withColumn("_new", new).withColumn("band", F.sum("_new").over(order))
    merged = merged.groupBy("row", "template", "band").agg(F.first("own", ignorenulls=True).alias("own"), F.first("label").alias("label"), F.first("grams").alias("grams"), F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"))
    score = F.col("hits") / F.greatest(F.col("grams"), F.col("high") - F.col("low") + 1)
    span = F.struct(F.col("low").cast("long").alias("start"), (F.col("high") - F.col("low") + k).cast("long").alias("length"), "label", "template", score.alias("score"))
    verified = F.when(F.col("template").isNotNull() & (score >= least), span)
    out = merged.groupBy("row").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list(verified)).alias("spans"))
    shown = F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in ("label", "template", "start", "length", "score")]))
    return out.select("own.doc_id", "own.n_words", "own.base", shown.alias("spans"))


def labels(docs: DataFrame, **options) -> DataFrame:
    """scan as figures: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan(docs, **options)
    starts = F.flatten(F.transform("base", lambda x: x["starts"]))
    base = F.transform("base", lambda x: x["label"])
    joined = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"),
    )
