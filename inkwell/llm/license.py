"""License scans: a trained paragraph classifier, in DataFrame operations only.

Features are word n-grams (1 to 3 words) that hold a word of licence language, of granting or "not". A paragraph, line or
window without an anchor word of licence language is unknown by definition and never looked at further. A multinomial logistic regression
over licence families and "unknown" is fitted at start-up, on the driver, on variations of the families' own statements, on
their negations and on other sentences. Its probabilities are calibrated by a temperature fitted on whole statements and
sentences that a first model wasn't trained on; a prediction below `least` is unknown. A prediction counts only if confirmed
by comparison with the family's templates: at least `overlap` of a template statement's word pairs occur in the paragraph.
A negation is seen where it stands in the same line or window as what it negates.

Paragraphs end at blank lines. What is classified are a paragraph's lines and, as notices are often wrapped or stand in
long lines, overlapping windows over its joined words, of which one holds any template as a whole. A unit with too few of
the templates' word pairs to be confirmed is left out before scoring; that is exact, too.

Scoring is one row-wise expression: split, filter, n-grams, weight look-up, sums. Nothing is shuffled, and every
paragraph of every text is looked at.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import Packed

UNKNOWN = "unknown"

#: Short statements by which the families' own texts ask to be referred to.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is distributed under the Apache 2.0 license",
    ),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "This software is licensed under the terms of the MIT license",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL version 2 or later",
        "Licensed under the GPLv3",
        "License: GPLv3",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Distributed under the terms of the LGPL version 3",
        "Licensed under the LGPLv3",
        "License: LGPLv3",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL version 3",
        "Licensed under the AGPLv3",
        "License: AGPLv3",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the 3-clause BSD license",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "This text is available under the Creative Commons Attribution license",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
        "Text is available under the Creative Commons Attribution-NonCommercial License",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
        "This work is dedicated to the public domain under CC0 1.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
        "Licensed under the ISC license",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
        "Licensed under the Eclipse Public License, version 2.0",
    ),
    "EUPL": (
        "Licensed under the European Union Public Licence, version 1.2",
        "SPDX-License-Identifier: EUPL-1.2",
        "Licensed under the EUPL, Version 1.2 or later",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "SPDX-License-Identifier: Unlicense",
        "Released under the Unlicense",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the copyright owner",
        "Copyright, all rights reserved",
        "Proprietary and confidential; unauthorized copying of this file is strictly prohibited",
    ),
}

#: Words of licence language.
ANCHORS: tuple[str, ...] = (
    "affero", "agpl", "apache", "attribution", "bsd", "by", "cc", "cc0", "clause", "commons", "confidential", "copyright",
    "creative", "domain", "eclipse", "epl", "eupl", "gnu", "gpl", "isc", "lesser", "lgpl", "license", "licensed", "licenses", "licensing", "mit", "mozilla", "mpl", "nc",
    "noncommercial", "permission", "permitted", "proprietary", "redistribute", "redistribution", "reserved", "sa",
    "sharealike", "spdx", "unauthorized", "unencumbered", "unlicense",
)

#: Words before which a "not" turns a statement round.
GRANTS = ("licensed", "released", "distributed", "available", "governed", "dedicated", "granted", "permitted")
#: Words of which a feature has at least one; a unit is looked at only if it holds an anchor, too.
MARKED = (*ANCHORS, *GRANTS, "not")

#: Sentences with anchor words that name no licence.
OTHERS: tuple[str, ...] = (
    "He lost his driving license by the river", "The permission of the neighbours was not asked for", "by and by the rain stopped",
    "Students of the MIT came by train", "She was creative and by no means lazy", "The house of commons met again", "Seats are reserved for members",
    "It was written by hand and sent by post", "The clause was struck from the contract", "An apache helicopter flew by", "He is licensed to drive a bus",
    "Parking is permitted by the gate", "The king's domain was large", "Her copyright case went to court", "This is a confidential talk", "step by step",
    "The lesser of two evils", "A gnu ran by", "The word was cc and nobody knew why", "They asked permission to leave", "Tables are reserved by phone",
    "This code is compatible with the MIT license", "The GPL and the Apache license differ in patents", "Read more about the GNU General Public License", "Is the MIT license better than the BSD license",
    "A comparison of Creative Commons licenses", "a total eclipse was seen", "the public domain is a wide field", "free software released by the union",
    "The redistribution of land took years", "unauthorized persons keep out", "by the", "of by in", "the license", "by", "sa", "nc", "cc", "mit", "mit der", "er kam mit dem Zug", "sa mère", "sa maison par la mer",
)


#: (words, steps) of the windows over a paragraph: each of size - step words or fewer in a row is in one of them as a whole.
WINDOWS = ((48, 16), (24, 8))

#: British forms, and versions written into the name.
SPELLINGS = ((r"(?<![a-z0-9])licenc(e[sd]?|ing)(?![a-z0-9])", "licens{}1"), (r"(?<![a-z0-9])([al]?gpl)v([0-9])(?![0-9a-z])", "{}1 version {}2"))


def words_of(text: str) -> list[str]:
    text = text.lower()
    for found, written in SPELLINGS:
        text = re.sub(found, written.replace("{}", "\\"), text)
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text).split(" ") if w]


def features_of(words: list[str]) -> list[str]:
    grams = [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]
    return sorted({g for g in grams if not _MARKED_SET.isdisjoint(g.split(" "))})


_MARKED_SET = frozenset(MARKED)


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is UNKNOWN
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float


def _negated(words: list[str]) -> list[str]:
    """The words with a "not" before the first that grants; nothing if none does."""
    at = next((k for k, w in enumerate(words) if w in GRANTS), None)
    return [] if at is None else [*words[:at], "not", *words[at:]]


def _variations(words: list[str], rng: random.Random, n: int) -> list[list[str]]:
    """The words as they are, and with some left out, put in front or added."""
    padding = ("project", "code", "notice", "see", "file", "the", "und", "les", "data", "version")
    out = [words]
    for _ in range(n):
        kept = [w for w in words if w == "not" or rng.random() > 0.08] or words
        out.append(rng.choices(padding, k=rng.randrange(4)) + kept + rng.choices(padding, k=rng.randrange(6)))
    return out


def _rows(templates: dict[str, Sequence[str]], others: Sequence[str], families: tuple[str, ...]) -> list[tuple[list[str], int]]:
    """Features and family of what a model is fitted on."""
    rng = random.Random(7)
    rows = []
    for family, texts in templates.items():
        for words in map(words_of, texts):
            rows += [(features_of(v), families.index(family)) for v in _variations(words, rng, 6)]
            if against := _negated(words):
                rows += [(features_of(v), len(families) - 1) for v in _variations(against, rng, 4)]
    return rows + [(features_of(v), len(families) - 1) for t in others for v in _variations(words_of(t), rng, 4)]


def _fitted(rows: list[tuple[list[str], int]], n: int, steps: int, ridge: float) -> tuple[dict[str, tuple[float, ...]], tuple[float, ...]]:
    """Weights by feature and biases of n families: full-batch multinomial logistic regression; features of a row weigh 1 / sqrt(their number)."""
    import numpy as np

    names = sorted({f for found, _ in rows for f in found})
    number = {f: k for k, f in enumerate(names)}
    x, y = np.zeros((len(rows), len(names))), np.zeros((len(rows), n))
    for k, (found, label) in enumerate(rows):
        x[k, [number[f] for f in found]] = 1 / math.sqrt(len(found) or 1)
        y[k, label] = 1
    weights, bias = np.zeros((len(names), n)), np.zeros(n)
    bias[-1] = 1.0
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        scores = x @ weights + bias
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        miss = p / p.sum(axis=1, keepdims=True) - y
        slope = x.T @ miss / len(rows) + ridge * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights -= 0.2 * (1 - t / (steps + 1)) * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        bias[:-1] -= 0.5 * miss.mean(axis=0)[:-1]
    kept = {f: tuple(round(float(w), 4) for w in weights[k]) for f, k in number.items() if np.abs(weights[k]).max() >= 0.02}
    return kept, tuple(round(float(b), 4) for b in bias)


@lru_cache(maxsize=1)
def trained(steps: int = 300, ridge: float = 1e-5) -> Model:
    """Fit on the fixed statements; the same model in every run.

    The temperature is that at which a model that knows neither the last statement of each family nor every third of the
    other sentences gives those the highest likelihood.
    """
    families = (*TEMPLATES, UNKNOWN)
    part = _rows({f: texts[:-1] for f, texts in TEMPLATES.items()}, [t for k, t in enumerate(OTHERS) if k % 3], families)
    held = [(features_of(words_of(texts[-1])), families.index(f)) for f, texts in TEMPLATES.items()]
    held += [(features_of(words_of(t)), len(families) - 1) for t in OTHERS[::3]]
    weights, bias = _fitted(part, len(families), steps, ridge)
    loss = {}
    for tenths in range(3, 41):
        loss[tenths / 10] = -sum(math.log(max(_softmax([s / (tenths / 10) for s in _scores(weights, bias, found)])[label], 1e-12)) for found, label in held)
    whole, bias = _fitted(_rows(TEMPLATES, OTHERS, families), len(families), steps, ridge)
    return Model(families, whole, bias, min(loss, key=lambda t: (loss[t], t)))


def _scores(weights, bias, found: list[str]) -> list[float]:
    scale = 1 / math.sqrt(len(found) or 1)
    out = list(bias)
    for f in found:
        if f in weights:
            out = [a + scale * b for a, b in zip(out, weights[f], strict=True)]
    return out


def _softmax(scores: list[float]) -> list[float]:
    top = max(scores)
    powers = [math.exp(s - top) for s in scores]
    return [p / sum(powers) for p in powers]


def classified(text: str, model: Model, least: float = 0.6, overlap: float = 0.6) -> tuple[str, float, float]:
    """Family, probability and template overlap of one paragraph: the same as the Columns below, for tests."""
    words = words_of(text)
    found = features_of(words)
    p = _softmax([s / model.temperature for s in _scores(model.weights, model.bias, found)])
    best = max(range(len(p)), key=lambda k: (p[k], -k))
    family = model.families[best]
    pairs = set(zip(words, words[1:], strict=False))
    similar = max((len(pairs & t) / len(t) for t in _template_pairs(family)), default=0.0)
    return (family if p[best] >= least and similar >= overlap else UNKNOWN, p[best], similar)


def _template_pairs(family: str) -> list[set[tuple[str, str]]]:
    return [set(zip(w, w[1:], strict=False)) for w in (words_of(t) for t in TEMPLATES.get(family, ()))]


def _spelled(text: Column) -> Column:
    """In lower case, with one spelling."""
    text = F.lower(text)
    for found, written in SPELLINGS:
        text = F.regexp_replace(text, found, written.replace("{}", "$"))
    return text


def _split(spelled: Column) -> Column:
    return F.filter(F.split(spelled, "[^a-z0-9]+"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    """n-grams that hold a marked word."""
    if n == 1:
        return F.filter(words, lambda w: w.isin(*MARKED))
    places = F.sequence(F.lit(1), F.size(words) - (n - 1))
    window = lambda k: F.slice(words, k, n)
    grams = F.transform(F.filter(places, lambda k: F.exists(window(k), lambda w: w.isin(*MARKED))), lambda k: F.array_join(window(k), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def paragraphs(text: Column) -> Column:
    """What blank lines separate, blank pieces included: each line feed before a blank line is left out, all others stay."""
    return F.split(F.coalesce(text, F.lit("")), r"\n(?=[ \t\r\f\x0b]*\n)")


def _anchored(spelled: Column) -> Column:
    return F.rlike(spelled, F.lit("(?<![a-z0-9])(?:" + "|".join(ANCHORS) + ")(?![a-z0-9])"))


def _window(x: Column, most: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(x["at"].alias("at"), F.element_at(x["of"], s).alias("line"), F.slice(x["words"], s, most).alias("words"))


def _units(x: Column) -> Column:
    """The lines of a paragraph (at, lines, words, of), and the windows over its words: (at, line within it, words)."""
    n = F.size(x["words"])
    units = [F.transform(x["lines"], lambda words, k: F.struct(x["at"].alias("at"), k.cast("bigint").alias("line"), words.alias("words")))]
    for k, (most, step) in enumerate(WINDOWS):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - most + step), F.lit(step))
        # the first kind joins short wrapped lines, too
        wanted = (n > most) | ((F.size(x["lines"]) > 1) & (n > 0)) if k == 0 else n > most
        units.append(F.when(wanted, F.transform(starts, _window(x, most))).otherwise(F.array().cast("array<struct<at:bigint,line:bigint,words:array<string>>>")))
    return F.filter(F.concat(*units), lambda u: F.exists(u["words"], lambda w: w.isin(*ANCHORS)))


def scanned(docs: DataFrame, *, text: str = "text", least: float = 0.6, overlap: float = 0.6, model: Model | None = None) -> DataFrame:
    """docs (without its text) and n_paragraphs, candidates, licences: array of (line, family, probability, overlap) of confirmed paragraphs.

    Paragraphs are what blank lines separate. candidates: paragraphs with features. A paragraph has one entry for each of its
    families, the most probable, with the number of the line where that line or window begins. Null and blank
    texts have no paragraphs. Each row is scanned by itself, repeated rows alike; columns called like the results, in whatever
    case, are replaced, others may have any names. Texts of any length are scanned whole; an empty table gives an empty table.
    """
    known = model or trained()
    zero = F.array(*[F.lit(float(b)) for b in known.bias])
    # tables as one constant each, which the optimiser folds
    table = F.from_json(F.lit(json.dumps(known.weights)), "map<string,array<double>>")
    pairs = F.from_json(F.lit(json.dumps([{"family": f, "pairs": sorted(map(" ".join, t))} for f in TEMPLATES for t in _template_pairs(f) if t])), "array<struct<family:string,pairs:array<string>>>")
    families = F.array(*[F.lit(f) for f in known.families])
    every = [t for f in TEMPLATES for t in _template_pairs(f) if t]
    common = sorted({" ".join(p) for t in every for p in t})
    fewest = min(math.ceil(overlap * len(t) - 1e-9) for t in every)

    # one small transform for each step: a field of the step before is computed once, an expression in a lambda each time
    def lined(x: Column) -> Column:
        return F.struct(x["at"].alias("at"), F.transform(F.split(x["text"], "\n"), _split).alias("lines"))

    def joined(x: Column) -> Column:
        of = F.flatten(F.transform(x["lines"], lambda words, k: F.array_repeat(k.cast("bigint"), F.size(words))))
        return F.struct(x["at"].alias("at"), x["lines"].alias("lines"), F.flatten(x["lines"]).alias("words"), of.alias("of"))

    def paired(x: Column) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x["words"]) - 1, F.lit(1))), lambda k: F.array_join(F.slice(x["words"], k, 2), " "))
        return F.struct(x["at"].alias("at"), x["line"].alias("line"), x["words"].alias("words"), F.array_distinct(F.filter(own, lambda p: p.isin(*common))).alias("own"))

    head = lambda x: (x["at"].alias("at"), x["line"].alias("line"), x["own"].alias("own"))

    def featured(x: Column) -> Column:
        found = F.array_distinct(F.concat(*[_grams(x["words"], n) for n in (1, 2, 3)]))
        return F.struct(*head(x), found.alias("found"))

    def weighed(x: Column) -> Column:
        rows = F.filter(F.transform(x["found"], lambda g: F.try_element_at(table, g)), lambda w: w.isNotNull())
        return F.struct(*head(x), (1 / F.sqrt(F.greatest(F.size(x["found"]), F.lit(1)).cast("double"))).alias("scale"), rows.alias("rows"))

    def judged(x: Column) -> Column:
        scores = F.aggregate(x["rows"], zero, lambda total, w: F.zip_with(total, w, lambda a, b: a + x["scale"] * b))
        return F.struct(*head(x), F.transform(scores, lambda s: s / known.temperature).alias("scores"))

    def decided(x: Column) -> Column:
        top = F.array_max(x["scores"])
        best = F.element_at(families, F.array_position(x["scores"], top).cast("int"))
        total = F.aggregate(x["scores"], F.lit(0.0), lambda a, s: a + F.exp(s - top))
        alike = F.transform(F.filter(pairs, lambda t: t["family"] == best), lambda t: F.size(F.array_intersect(t["pairs"], x["own"])) / F.size(t["pairs"]))
        return F.struct(x["at"].alias("at"), x["line"].alias("line"), best.alias("family"), (1 / total).alias("probability"), F.coalesce(F.array_max(alike), F.lit(0.0)).alias("overlap"))

    def placed(x: Column) -> Column:
        before = F.aggregate(F.slice("__parts", F.lit(1), x["at"].cast("int")), F.lit(0).cast("bigint"), lambda n, part: n + F.size(F.split(part, "\n")))
        return F.struct((before + x["line"]).alias("line"), x["family"].alias("family"), x["probability"].alias("probability"), x["overlap"].alias("overlap"))

    packed = Packed(docs, without=(text, "n_paragraphs", "candidates", "licences"))
    rows = packed.rows(None, paragraphs(packed.column(text)).alias("__parts"))
    rows = rows.withColumn("n_paragraphs", F.size(F.filter("__parts", lambda p: F.rlike(p, F.lit(r"\S")))).cast("bigint"))
    spelled = F.transform("__parts", lambda p, k: F.struct(k.cast("bigint").alias("at"), _spelled(p).alias("text")))
    rows = rows.withColumn("__hits", F.filter(spelled, lambda x: _anchored(x["text"])))
    rows = rows.withColumn("candidates", F.size("__hits").cast("bigint"))
    units = F.transform(F.flatten(F.transform(F.transform(F.transform("__hits", lined), joined), _units)), paired)
    units = F.filter(units, lambda u: F.size(u["own"]) >= fewest)
    rows = rows.withColumn("__hits", F.transform(F.transform(F.transform(units, featured), weighed), judged))
    confirmed = F.filter(F.transform("__hits", decided), lambda x: (x["family"] != UNKNOWN) & (x["probability"] >= least) & (x["overlap"] >= overlap))
    rows = rows.withColumn("__hits", confirmed)
    rank = lambda x: F.struct(x["probability"].alias("p"), (-x["line"]).alias("line"), x["overlap"].alias("overlap"))
    first = lambda x, y: (x["at"] == y["at"]) & (x["family"] == y["family"]) & (rank(y) > rank(x))
    best = F.array_distinct(F.filter("__hits", lambda x: ~F.exists("__hits", lambda y: first(x, y))))
    return rows.withColumn("licences", F.transform(best, placed)).select(*packed.columns(), "n_paragraphs", "candidates", "licences")
