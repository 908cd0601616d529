"""Licence scan with DataFrame functions only.

A multinomial logistic regression over sparse word n-grams (one and two words) names the licence
family of a paragraph: a line of the text, or neighbouring lines where a notice is wrapped (blank
lines aside). It is fitted on the driver from the notices below and
variants made of them, and from plain sentences that use the same words; nothing is taken from
the corpus. A held-out share of the variants sets the temperature, so that probabilities are
calibrated; the unknown class wins below ``LEAST``. A prediction stands only if a template of the
family confirms it: ``CONFIRM`` of the template's word pairs, version numbers aside, must occur; one of fewer
than ``SHORT`` words must also end the paragraph, as its few words occur in other sentences.
Runs of lines are taken around every key word as long as the lines between first and last hold fewer
than ``REACH`` words, more than any template. Of overlapping ones the most similar stands, then the shortest; a
single line only gives way to a run of its own family.

Key words follow from the templates: of each, the longest words that leave fewer word pairs without one than a
confirmation needs. So a paragraph without any of them can't be confirmed, and is left out before any work on
words, without loss. No shuffle moves text: only the scores of n-grams that
occur are summed for each paragraph, and only paragraphs with enough pairs of templates are kept.

Edge cases: null or empty text has no paragraph; repeated paragraphs are each reported; rows with
null ids are scanned like others; two rows alike in id and text are reported once; of ties in similarity the
shorter run stands, then the earlier, then the family first by name; other columns have no part; an empty
table gives an empty result.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import written

LEAST = 0.5
CONFIRM = 0.6
SHORT = 4
#: Family notices, and plain sentences.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "This project is licensed under the MIT License"),
    "Apache": ("Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later", "You should have received a copy of the GNU General Public License along with this program"),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-only"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Distributed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC", "Released under the ISC License."),
    "Public domain": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide"),
    "Proprietary": ("All rights reserved.", "Proprietary and confidential. All rights reserved.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential"),
}
PLAIN = (
    "she lost her driving licence last week", "the company asked the city for a new licence to sell food", "he gave permission to enter the garden", "with permission of the owner they crossed the field",
    "human rights were discussed at the meeting", "voting rights and equal rights for all citizens", "the domain of the function is the real line", "a domain name was registered in spring", "creative writing classes start on monday",
    "a creative answer to a common question", "the gnu is a large antelope", "apache helicopters flew over the valley", "the apache people lived in the south", "students at mit study physics", "the warranty covers two years of repairs",
    "no warrant was needed for the search", "copyright law is taught in the second year", "a question of copyright came up in court", "licensed drivers only", "a fishing license costs ten dollars", "they redistributed the land among farmers",
    "wealth was redistributed by new taxes", "the public domain of roads and squares", "cc the manager on every message", "permission slips are due on friday", "his licence was revoked in may", "water rights of the village",
)
#: Words too usual to search for, if others do.
USUAL = frozenset("a an any are as at be by for from if in is it may not of on or that the this to under with you".split())
FAMILIES = ("unknown", *TEMPLATES)
#: Half as many words again as the longest template has.
REACH = 3 * max(len(t.split()) for v in TEMPLATES.values() for t in v) // 2
_CUT = r"[^a-z0-9]+"
def tokens(text: str) -> list[str]:
    """Lower-cased words; digits count as 0."""
    return [re.sub(r"\d+", "0", w) for w in re.split(_CUT, text.lower()) if w]


def _need(words: list[str]) -> int:
    """How many of a template's distinct word pairs confirm it."""
    return int(np.ceil(CONFIRM * len({*zip(words, words[1:])})))


def key_words() -> list[str]:
    """Words of the templates such that every paragraph that can be confirmed holds one."""
    out: set[str] = set()
    for words in (tokens(t) for v in TEMPLATES.values() for t in v):
        pairs = {*zip(words, words[1:])}
        for w in sorted({w for w in words if w.isalpha()}, key=lambda w: (w not in out, w in USUAL, -len(w), w)):
            if sum(not out & {*p} for p in pairs) < _need(words):
                break
            out.add(w)
    return sorted(out)


_FOUND = "(?i)(?<![a-z0-9])(?:" + "|".join(key_words()) + ")(?![a-z0-9])"


def features(words: list[str]) -> set[str]:
    """One- and two-word n-grams of a paragraph."""
    return {*words, *map(" ".join, zip(words, words[1:]))}


def _variants(text: str, rng: random.Random, n: int) -> list[list[str]]:
    """The words of a notice, whole, with words lost, with text around it, and cut short."""
    words, filler = tokens(text), "see the file for more about it and its authors in this project".split()
    out = [words]
    for _ in range(n):
        kept = [w for w in words if rng.random() > 0.12] or words
        lead, tail = (rng.choices(filler, k=rng.randrange(5)) for _ in range(2))
        out.append(lead + kept[: max(3, int(len(kept) * rng.uniform(0.7, 1.0)))] + tail)
    return out


@lru_cache(maxsize=1)
def model(rounds: int = 400, seed: int = 7) -> tuple[tuple[str, ...], np.ndarray, np.ndarray, float]:
    """(n-grams, weights by family, intercepts, temperature)."""
    rng = random.Random(seed)
    rows: list[tuple[set[str], int, bool]] = []
    for label, texts in [(FAMILIES.index(k), v) for k, v in TEMPLATES.items()] + [(0, PLAIN)]:
        for text in texts:
            for k, words in enumerate(_variants(text, rng, 24 if label else 8)):
                rows.append((features(words), label, k % 4 == 3))
    rows += [(set(), 0, False)] * 40
    grams = tuple(sorted(set().union(*(x for x, _, held in rows if not held))))
    place = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams)))
    for r, (found, _, _) in enumerate(rows):
        x[r, [place[g] for g in found if g in place]] = 1
    y = np.array([label for _, label, _ in rows])
    held = np.array([h for _, _, h in rows])
    w, b = np.zeros((len(grams), len(FAMILIES))), np.zeros(len(FAMILIES))
    xt, hot = x[~held], np.eye(len(FAMILIES))[y[~held]]
    for _ in range(rounds):
        z = xt @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 4.0 * (xt.T @ (p - hot) / len(xt) + 2e-5 * w)
        b -= 4.0 * (p - hot).mean(0)
    z, yh = x[held] @ w + b, y[held]

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(s)), yh]).mean())

    return grams, w.round(4), b.round(4), min((k / 20 for k in range(6, 80)), key=loss)


def _words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), _CUT), ""), lambda w: F.regexp_replace(w, r"\d+", "0"))


def _pairs(words: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1))))


def _runs(docs: DataFrame) -> DataFrame:
    """doc_id, uid, and first line, last line and words of every run of lines that may hold a notice."""
    keyed = lambda words: F.array_join(words, " ").rlike(_FOUND)
    inked = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), _words(x).alias("words"))), lambda x: F.size(x["words"]) > 0)
    held = docs.where(F.col("text").rlike(_FOUND)).select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), inked.alias("lines"))
    near_key = F.filter(F.transform("lines", lambda x, i: F.when(keyed(x["words"]), i)), lambda i: i.isNotNull())
    hot = held.select("doc_id", "uid", "lines", F.explode(near_key).alias("k"))

    def reach(part: Column) -> Column:
        """How many lines come before REACH words are full."""
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
        return F.aggregate(part, start, lambda s, x: F.when(s["words"] < REACH, F.struct((s["words"] + F.size(x["words"])).alias("words"), (s["lines"] + 1).alias("lines"))).otherwise(s))["lines"]

    before = F.slice("lines", F.greatest(F.lit(1), F.col("k") + 1 - REACH), F.least(F.col("k"), F.lit(REACH)))
    around = hot.withColumn("left", reach(F.reverse(before))).withColumn("right", reach(F.slice("lines", F.col("k") + 2, F.lit(REACH))))
    around = around.select("doc_id", "uid", "left", "right", F.slice("lines", F.col("k") + 1 - F.col("left"), F.col("left") + F.col("right") + 1).alias("near"))
    inner = lambda i, j: F.aggregate(F.slice("near", i + 2, F.greatest(j - i - 1, F.lit(0))), F.lit(0), lambda s, x: s + F.size(x["words"]))
    ends = lambda i: F.filter(F.sequence(F.col("left"), F.col("left") + F.col("right")), lambda j: inner(i, j) < REACH)
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.col("left")), lambda i: F.transform(ends(i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    runs = around.select("doc_id", "uid", "near", F.explode(spans).alias("span")).select("doc_id", "uid", F.slice("near", F.col("span.i") + 1, F.col("span.j") - F.col("span.i") + 1).alias("run"))
    return runs.select("doc_id", "uid", F.get("run", F.lit(0))["at"].alias("paragraph"), F.element_at("run", -1)["at"].alias("last"), F.size("run").alias("n_lines"), F.flatten(F.transform("run", lambda x: x["words"])).alias("words"))


def _apart(hits: Column) -> Column:
    """The hits that no better one overlaps, best first; a single line only gives way to its own family."""
    meets = lambda x, y: (x["paragraph"] <= y["last"]) & (y["paragraph"] <= x["last"]) & ((x["n_lines"] > 1) | (x["family"] == y["family"]))
    return F.aggregate(hits, F.slice(hits, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: meets(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def scan(docs: DataFrame) -> DataFrame:
    """Confirmed licence paragraphs: doc_id, paragraph (its first line, from 0), family, probability, similarity."""
    spark = docs.sparkSession
    grams, w, b, heat = model()
    weights = spark.createDataFrame([(g, [float(v) for v in row]) for g, row in zip(grams, w)], "gram string, weight array<double>")
    pairs = [(k, sorted({" ".join(p) for p in zip(t, t[1:])}), " ".join(t) if len(t) < SHORT else None) for k, v in TEMPLATES.items() for t in map(tokens, v)]
    templates = spark.createDataFrame(pairs, "family string, pairs array<string>, ending string")
    known, least = F.array(*map(F.lit, sorted({p for _, x, _ in pairs for p in x}))), min(_need(t) for v in TEMPLATES.values() for t in map(tokens, v))
    rows = _runs(docs).withColumn("own", _pairs(F.col("words"))).where(F.size(F.array_intersect("own", known)) >= least)
    key = ["uid", "paragraph", "last"]
    rows = written(rows.dropDuplicates(key), "paragraphs")
    found = rows.select(*key, F.explode(F.array_union("own", F.array_distinct("words"))).alias("gram")).join(F.broadcast(weights), "gram")  # the model's n-grams, some hundreds
    sums = found.groupBy(*key).agg(F.array(*(F.sum(F.col("weight")[k]) + float(b[k]) for k in range(len(FAMILIES)))).alias("z"))
    top = F.array_max("z")
    share = F.transform("z", lambda v: F.exp((v - top) / heat))
    named = sums.select(*key, F.get(F.array(*map(F.lit, FAMILIES)), (F.array_position("z", top) - 1).cast("int")).alias("family"), (1 / F.aggregate(share, F.lit(0.0), lambda s, v: s + v)).alias("probability"))
    named = named.where((F.col("probability") >= LEAST) & (F.col("family") != "unknown"))
    tail = F.concat(F.lit(" "), F.array_join(F.slice("words", F.greatest(F.lit(1), F.size("words") - (SHORT - 1)), F.lit(SHORT)), " "))
    both = rows.select("doc_id", *key, "n_lines", "own", tail.alias("tail")).join(named, key).join(F.broadcast(templates), "family")  # some dozens
    both = both.where(F.col("ending").isNull() | F.endswith("tail", F.concat(F.lit(" "), F.col("ending"))))
    alike = F.size(F.array_intersect("own", "pairs")) / F.size("pairs")
    best = both.groupBy("doc_id", *key, "n_lines", "family", "probability").agg(F.max(alike).alias("similarity")).where(F.col("similarity") >= CONFIRM)
    hits = best.groupBy("doc_id", "uid").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("order"), "n_lines", "paragraph", "last", "family", "probability"))).alias("hits"))
    out = hits.select("doc_id", F.explode(_apart(F.col("hits"))).alias("x"))
    return out.select("doc_id", "x.paragraph", "x.family", F.round("x.probability", 6).alias("probability"), F.round(-F.col("x.order"), 6).alias("similarity"))
