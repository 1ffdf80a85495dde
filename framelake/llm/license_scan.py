r"""License scans by an exact set-similarity join of text blocks with license templates.

Words are runs of digits, lowered letters a-z and characters beyond ASCII. A template is a text with a label; its set
are its distinct words. Texts are cut into blocks that suit a template's length: with ``step`` the power of two that
holds the template, blocks of 2 * step words start at every step words, so a template that stands in a text lies
within one block. A block and a template match if the block holds at least ``threshold`` of the template's set.

The join is exact. Words of templates are ordered by how often they stand in all documents, rare ones first. A block
that holds ``need`` of a template's n words holds one of its first n - need + 1 (prefix); of a block's m words in that
order, the first common one is among its first m - need + 1, m is need at least (length), and with the template's i-th
and the block's j-th word as the first common one, 1 + min(n - i, m - j) reaches need (position). What passes is counted
word by word.

Beside the templates, PHRASES are found wherever their words stand one after another (base labels).

A null text is empty: no words, no labels, score 0. Texts of any length count whole. Rows that share a doc_id have each
the labels of their own text, repeated rows the same; a null doc_id is scanned like any other. Ties of words by count
are ordered by the word, which changes no result. Templates without words match nothing; equal templates match alike.
No rows give no rows; columns beyond doc_id and text are not looked at. Everything is DataFrame functions. Templates are
a parameter: TEMPLATE_WORDS distinct words in all at most, else ValueError, so their words, counts and prefixes are
small enough for every task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, spaced_words, spaces, split_words, text_key, write_table

#: Characters between words (of lowered text), as a class.
BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Fixed phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Fixed notices of common licenses: label and text.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.75
TEMPLATE_WORDS = 50_000


def template_words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(f"[^{BETWEEN}]+", lowered)


def _step(words: list[str]) -> int:
    """The power of two that holds a template of ``words``."""
    return 1 << (len(words) - 1).bit_length()


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), spaced_words(ascii_lower(text), BETWEEN).alias("spaced"))


def _ordered(texts: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """The rank of every template word by its number of places in all documents, rare first."""
    known = F.filter(split_words(F.col("spaced")), lambda w: w.isin(*vocabulary))
    count = {r["word"]: r["n"] for r in texts.select(F.explode(known).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}


def _blocks(words: Column, prefixes: dict[int, set[str]], vocabularies: dict[int, set[str]], least: dict[int, int]) -> Column:
    """array<struct<step, block, words>> of the blocks that hold a prefix word and template words enough."""
    every = set().union(*prefixes.values())

    def cut(words: Column, places: Column, step: int) -> Column:
        mine = F.filter(places, lambda i: F.get(words, i).isin(*prefixes[step]))
        last = F.transform(mine, lambda i: F.floor(i / step).cast("int"))
        starts = F.filter(F.array_distinct(F.concat(last, F.transform(last, lambda b: b - 1))), lambda b: b >= 0)
        # Word by word: a slice would read the whole array for each block.
        held = lambda b: F.transform(F.sequence(b * step, (b + 2) * step - 1), lambda i: F.get(words, i))
        known = F.transform(starts, lambda b: F.struct(F.lit(step).alias("step"), b.alias("block"), F.array_distinct(F.filter(held(b), lambda w: w.isin(*vocabularies[step]))).alias("words")))
        return F.filter(known, lambda b: F.size(b["words"]) >= least[step])

    def near(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*every), i)), lambda i: i.isNotNull())
        return let(places, lambda places: F.concat(*[cut(words, places, step) for step in sorted(prefixes)]))

    return let(words, near)


def _places(phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of ``phrase`` among the words of ``spaced``, and the words before the first and the last."""
    padded, sought = F.concat(F.lit(" "), "spaced", F.lit(" ")), f" {phrase} "
    there = padded.contains(sought)
    first = F.when(there, spaces(F.substring_index(padded, sought, 1)))
    after = spaces(F.substring_index(padded, sought, -1))
    last = F.when(there, F.col("n_words") - after - len(phrase.split()))
    count = F.when(there, F.regexp_count(padded, F.lit(f"(?={re.escape(sought)})"))).otherwise(0)
    return count.cast("long"), first.cast("long"), last.cast("long")


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str | None]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``documents`` and ``blocks``.

    documents, one row for each of ``docs``: doc_id, key (text_key), n_words, n_base, first_word, last_word (smallest and
    largest start of a phrase), base_labels and labels (sorted arrays), score (1 with a phrase, else the largest
    containment of a block that matches, else 0). blocks: doc_id, key, template (its place in the list), label,
    first_word and n_block (the block's words), n_found, containment of every block that matches.
    """
    spark = docs.sparkSession
    listed = [(t, label, words) for t, (label, text) in enumerate(templates) if (words := template_words(text))]
    vocabulary = {w for _, _, words in listed for w in words}
    if len(vocabulary) > TEMPLATE_WORDS:
        raise ValueError(f"templates have {len(vocabulary)} distinct words, at most {TEMPLATE_WORDS} are taken")
    texts = _texts(docs)
    rank = _ordered(texts, vocabulary) if listed else {}

    prefixes: dict[int, set[str]] = {}
    vocabularies: dict[int, set[str]] = {}
    least: dict[int, int] = {}
    sets, probes = [], []
    for t, label, words in listed:
        step, order = _step(words), sorted(set(words), key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(order) - 1e-9))
        vocabularies.setdefault(step, set()).update(order)
        prefixes.setdefault(step, set()).update(order[: len(order) - need + 1])
        least[step] = min(need, least.get(step, need))
        sets.append((t, label, len(order), need, [rank[w] for w in order]))
        probes += [(step, t, i, rank[w]) for i, w in enumerate(order[: len(order) - need + 1], 1)]

    none = F.array().cast("array<struct<step:int,block:int,words:array<string>>>")
    blocks = _blocks(split_words(F.col("spaced")), prefixes, vocabularies, least) if listed else none
    counted = texts.withColumn("n_words", F.when(F.col("spaced") == "", 0).otherwise(spaces(F.col("spaced")) + 1).cast("long"))
    found = [_places(p) for p in phrases]
    base = F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for (n, _, _), label in zip(found, phrases.values(), strict=True)])) if phrases else F.array()
    total = sum((n for n, _, _ in found), F.lit(0).cast("long"))
    first = F.least(*[f for _, f, _ in found], F.lit(None).cast("long")) if phrases else F.lit(None).cast("long")
    last = F.greatest(*[x for _, _, x in found], F.lit(None).cast("long")) if phrases else F.lit(None).cast("long")
    scanned = write_table(
        counted.select(
            "doc_id", "key", "n_words", total.alias("n_base"), first.alias("first_word"), last.alias("last_word"),
            F.sort_array(F.array_distinct(base.cast("array<string>"))).alias("base_labels"), blocks.alias("blocks"),
        ),
        "scanned",
    )

    ranks = spark.createDataFrame(list(rank.items()), "word string, rank int")
    held = scanned.select("doc_id", "key", "n_words", F.explode("blocks").alias("b")).select("doc_id", "key", "n_words", "b.step", "b.block", F.explode("b.words").alias("word"))
    held = held.join(F.broadcast(ranks), "word").groupBy("doc_id", "key", "n_words", "step", "block").agg(F.sort_array(F.collect_set("rank")).alias("held"))
    probe = spark.createDataFrame(probes, "step int, template int, i int, rank int")
    known = spark.createDataFrame(sets, "template int, label string, n int, need int, ranks array<int>")
    each = held.select("*", F.size("held").alias("m"), F.posexplode("held").alias("j", "rank")).withColumn("j", F.col("j") + 1)
    met = each.join(F.broadcast(probe.join(F.broadcast(known), "template")), ["step", "rank"])
    met = met.where((F.col("m") >= F.col("need")) & (1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= F.col("need")))
    # One row for each block and template: that of their first common word.
    both = met.withColumn("common", F.array_intersect("ranks", "held")).where((F.get("common", 0) == F.col("rank")) & (F.size("common") >= F.col("need")))
    start = (F.col("block") * F.col("step")).cast("long")
    matches = write_table(
        both.select(
            "doc_id", "key", "template", "label", start.alias("first_word"), F.least(F.col("n_words") - start, 2 * F.col("step")).cast("long").alias("n_block"),
            F.size("common").cast("long").alias("n_found"), (F.size("common") / F.col("n")).alias("containment"),
        ),
        "licenses",
    )
    more = matches.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = scanned.drop("blocks").join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    labels = F.sort_array(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    documents = joined.select("doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
    return documents, matches


def digest(documents: DataFrame) -> DataFrame:
    """The first table of ``scan_licenses`` without key and with labels comma-joined."""
    return documents.drop("key").withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
