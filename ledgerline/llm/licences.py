"""Licence scans: a trained paragraph classifier with a calibrated unknown class, confirmed by template comparison.

Training: multinomial logistic regression over the presence of word n-grams (1 to 3) of the templates below, fitted on
the driver to the templates, their sentences and thinned variants. The unknown class has everyday sentences, near misses written by hand
and, from a bounded sample of the corpus, sentences with and without the words of licences that agree with no template. A
temperature and a threshold are calibrated on what two models say of the templates (whole ones, with their variants) and unknown examples that were
held out from them: the threshold is the probability that UNKNOWN_NAMED of the unknown ones reach.

Scan (DataFrame functions only, no shuffle): paragraphs are parted by blank lines and their wrapped lines joined; they are scored sentence by
sentence, and long sentences by overlapping windows of WINDOW words. The likeliest family counts if its calibrated probability
reaches the threshold and one of that family's templates confirms it: most of the template's word pairs are there, or most of what is there
lies inside the template; and a word that licences go by (KEYS) must be there, so that pieces of text without one are unknown by
definition and need no arithmetic. A paragraph names a family once.

Cases: null and empty texts have no paragraphs; equal paragraphs are listed one by one, in order; repeated rows are scanned one
by one; a text without line breaks is one paragraph, in which notices of several families count each; an empty corpus leaves
the written unknown examples. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents whose sentences serve as examples of the unknown class, and the most sentences of them of each kind (with a key, without).
SAMPLE_DOCS = 200
SAMPLE_SENTENCES = 1000
#: Words of a window of a long sentence, and from one window's first word to the next one's.
WINDOW, STEP = 96, 32
#: Share of held-out unknown examples that may reach the threshold, and the threshold's bounds.
UNKNOWN_NAMED = 0.01
THRESHOLDS = (0.1, 0.9)
#: Agreement with a template that confirms a prediction, and the fewest word pairs of a line that may lie inside a template.
AGREEMENT = 0.8
LEAST_PAIRS = 4

#: The family names and wordings of widely used licence notices.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under the CC0 1.0 Universal license.",
        "This is free and unencumbered software released into the public domain without license conditions.",
    ],
}
#: Short names of the families, as headers, tags and remarks give them.
NAMES: dict[str, list[str]] = {
    "mit": ["MIT", "MIT License", "The MIT License"],
    "apache": ["Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0"],
    "gpl": ["GPL-3.0", "GPL-2.0-or-later", "GNU GPL v3", "GNU General Public License", "GPL"],
    "lgpl": ["LGPL-3.0", "LGPL-2.1-or-later", "GNU LGPL v3", "GNU Lesser General Public License", "LGPL"],
    "agpl": ["AGPL-3.0", "AGPL-3.0-only", "GNU AGPL v3", "GNU Affero General Public License", "AGPL"],
    "bsd": ["BSD-3-Clause", "BSD-2-Clause", "BSD License", "3-Clause BSD License"],
    "isc": ["ISC", "ISC License"],
    "mpl": ["MPL-2.0", "Mozilla Public License 2.0", "MPL"],
    "cc-by": ["CC-BY-4.0", "CC BY 4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0", "CC BY-SA 4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0", "CC BY-NC 4.0"],
    "public-domain": ["CC0-1.0", "CC0 1.0", "Unlicense"],
}
#: How a short name is said to be the licence; {} stands for it.
SAYINGS = ["SPDX-License-Identifier: {}", "License: {}", "Lizenz: {}", "Licence: {}", "This file is licensed under the {}.", "Licensed under {}", "Released under the {}", "under the terms of the {}"]
#: Everyday sentences with the words of licences, for the unknown class.
EVERYDAY = [
    "She lost her driving license on the way to the station.",
    "The pub was granted a license to sell beer until midnight.",
    "Copyright law is taught in the second year of the course.",
    "He asked for permission to leave the room.",
    "The restaurant license expired in the summer of that year.",
    "The warranty covers parts and labour for two years.",
    "The fishing license costs ten pounds for a season.",
    "A software license can be bought for each seat.",
    "The author holds the copyright in the photographs.",
    "License plates of cars are read by the camera at the gate.",
    "The council may grant permission to build on this land.",
    "All rights reserved by the publisher of the novel.",
    "Food was redistributed to the villages after the storm.",
    "The public license office is open on weekdays.",
    "The apache helicopter is licensed to fly in version two of the game.",
    "He studied at MIT and was released under bail.",
    "The general public is licensed to visit the park.",
    "The work was licensed to a creative agency under terms of four years.",
    "The license of the pub is displayed under the sign.",
    "This software is sold under a commercial license that has to be renewed each year.",
    "Licensed under a proprietary agreement between both parties.",
    "All content is licensed to our partners and may not be copied.",
    "The band released the record under a new label.",
    "Released under the terms of a settlement, the documents were sealed again.",
    "The general terms of the public tender are listed below.",
    "Permission is granted to visitors of the museum to take photographs without a flash.",
    "Use of this hall is permitted provided that the following rules are observed.",
    "The foundation published a version of its annual report.",
    "He works on the Apache server for a firm of lawyers.",
    "Die Lizenz zum Fischen gilt bis zum Jahresende.",
    "License: expired", "License number: 4711-A", "SPDX-License-Identifier: LicenseRef-Proprietary", "Licence: see contract",
    "This file is licensed under the terms of your contract.",
    "Copyright (c) 2019 The authors. All rights reserved.",
]
#: Fixed value: what licences go by; every template and every form of a short name holds one.
KEYS = r"(?i)li[cz]en[cszt]|copyright|warrant|redistribut|permission|public domain|creative commons|released under|under the terms|\bspdx\b"
#: Ends of paragraphs, and of sentences inside them.
PARAGRAPH_END = r"\r?\n[\x20\t]*\r?\n\s*"
SENTENCE_END = r"(?<=[.!?;])\s+"


def all_templates() -> dict[str, list[str]]:
    """The notices of each family and its short names in every saying."""
    return {family: [*TEMPLATES[family], *[x.format(n) for n in NAMES[family] for x in SAYINGS], *[n for n in NAMES[family] if " License" in n]] for family in TEMPLATES}


def tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def grams(words: list[str], sizes=(1, 2, 3)) -> set[str]:
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


class Model(NamedTuple):
    families: list[str]
    vocabulary: list[str]
    weights: np.ndarray  # (features, families + 1), the unknown class last
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        known = {g: i for i, g in enumerate(self.vocabulary)}
        logit = self.bias + sum((self.weights[known[g]] for g in grams(tokens(text)) if g in known), np.zeros(len(self.bias)))
        e = np.exp((logit - logit.max()) / self.temperature)
        return e / e.sum()


def variants(text: str) -> list[str]:
    """A template, its sentences, and itself without every k-th word and in parts."""
    words = text.split()
    parts = [text, *[x for x in re.split(r"(?<=[.;:]) ", text) if len(x.split()) > 4]]
    if len(words) > 7:
        parts += [" ".join(w for i, w in enumerate(words) if i % step != at) for step in (5, 7) for at in range(step)]
    parts += [" ".join(words[i : i + 12]) for i in range(0, len(words) - 12, 6)]
    return list(dict.fromkeys(parts))


def agreement(text: str, template: str) -> float:
    """The larger share of the word pairs that text and template have in common: of the template's, and of the text's if it has enough."""
    own, other = (grams(tokens(x), (2,)) for x in (text, template))
    both = len(own & other)
    return max(both / len(other) if other else 0.0, both / len(own) if len(own) >= LEAST_PAIRS else 0.0)


def fit(negatives: list[str], steps: int = 300, l2: float = 1e-3) -> Model:
    """The model, with unknown examples beside the written ones; those that agree with a template are left out."""
    texts = all_templates()
    families = list(texts)
    unknown = [x for x in dict.fromkeys([*EVERYDAY, *negatives]) if not any(agreement(x, t) >= AGREEMENT for ts in texts.values() for t in ts)]
    # (text, class, fold): a template and its variants share a fold
    rows = [(v, k, i % 2) for k, ts in enumerate(texts.values()) for i, t in enumerate(ts) for v in variants(t)]
    rows += [(x, len(families), i % 2) for i, x in enumerate(unknown)]
    vocabulary = sorted(set().union(*(grams(tokens(t)) for ts in texts.values() for t in ts)))
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for r, (text, _, _) in enumerate(rows):
        x[r, [place[g] for g in grams(tokens(text)) if g in place]] = 1
    y, fold = (np.array([r[i] for r in rows]) for i in (1, 2))

    def train(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        xs, one = x[part], np.eye(len(families) + 1, dtype=np.float32)[y[part]]
        share = np.bincount(y[part], minlength=one.shape[1])
        each = ((1 / np.maximum(1, share))[y[part]] / one.shape[1]).astype(np.float32)  # classes weigh the same
        w, b = np.zeros((len(vocabulary), one.shape[1]), np.float32), np.zeros(one.shape[1], np.float32)
        mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
        for t in range(1, steps + 1):
            z = xs @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - one) * each[:, None]
            for v, g, m, s in ((w, xs.T @ d + l2 * w / 10, mw, vw), (b, d.sum(axis=0), mb, vb)):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        return w, b

    z = np.zeros((len(rows), len(families) + 1))
    for k in (0, 1):
        w, b = train(fold != k)
        z[fold == k] = x[fold == k] @ w + b

    def calibrated(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=lambda t: -np.log(calibrated(t)[np.arange(len(y)), y] + 1e-12).mean())
    p = calibrated(temperature)[:, :-1].max(axis=1)
    threshold = float(np.clip(np.quantile(p[y == len(families)], 1 - UNKNOWN_NAMED), *THRESHOLDS))
    w, b = train(np.ones(len(rows), bool))
    return Model(families, vocabulary, np.round(w.astype(float), 6), np.round(b.astype(float), 6), temperature, threshold)


def sample_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = SAMPLE_DOCS, most: int = SAMPLE_SENTENCES) -> list[str]:
    """Sentences of the whole texts of at most most_docs documents, chosen by a hash of their ids: at most most with a key and most without."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    found = picked.select(F.explode(F.split("text", f"{SENTENCE_END}|{PARAGRAPH_END}")).alias("x")).filter(F.length(F.trim("x")) > 0).distinct()
    rows = [found.filter(F.col("x").rlike(KEYS) == keyed).orderBy(F.xxhash64("x"), "x").limit(most) for keyed in (True, False)]
    return sorted(r.x for r in rows[0].union(rows[1]).collect())


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _constant(value, kind: str) -> Column:
    """A folded literal; written as JSON, since literals of thousands of parts slow the planner down."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _word_grams(words: Column, n: int) -> Column:
    at = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), at)).otherwise(F.array().cast("array<string>"))


def _pairs_of_templates() -> Column:
    """Of each family, and last of the unknown class, the word pairs of its templates."""
    sets = [[sorted(grams(tokens(t), (2,))) for t in texts] for texts in all_templates().values()]
    return _constant([*sets, [[]]], "array<array<array<string>>>")


def classified(words: Column, model: Model) -> Column:
    """struct(family, probability, agreement) of lower-case words; family is null where it is unknown or unconfirmed."""
    unknown = len(model.families)
    weights = _constant({g: w.tolist() for g, w in zip(model.vocabulary, model.weights)}, "map<string,array<double>>")

    def verdict(words: Column) -> Column:
        shown = F.array_intersect(F.concat(words, _word_grams(words, 2), _word_grams(words, 3)), _constant(model.vocabulary, "array<string>"))
        logits = F.aggregate(shown, _constant(model.bias.tolist(), "array<double>"), lambda s, g: F.zip_with(s, weights[g], lambda a, b: a + b))
        pairs = F.array_distinct(_word_grams(words, 2))

        def decide(z: Column) -> Column:
            e = F.transform(z, lambda v: F.exp((v - F.array_max(z)) / model.temperature))
            p = F.try_divide(F.array_max(e), F.aggregate(e, F.lit(0.0), lambda s, v: s + v))
            best = F.array_position(z, F.array_max(z)).cast("int")

            def agreement(own: Column) -> Column:
                share = lambda t: _let(F.size(F.array_intersect(own, t)), lambda n: F.greatest(F.try_divide(n, F.size(t)), F.when(F.size(own) >= LEAST_PAIRS, F.try_divide(n, F.size(own)))))
                return F.coalesce(F.array_max(F.transform(F.element_at(_pairs_of_templates(), best), share)), F.lit(0.0))

            agrees = _let(pairs, agreement)
            named = F.element_at(_constant([*model.families, ""], "array<string>"), best)
            return _let(agrees, lambda a: F.struct(F.when((best <= unknown) & (p >= model.threshold) & (a >= AGREEMENT), named).alias("family"), F.round(p, 6).alias("probability"), F.round(a, 6).alias("agreement")))

        return _let(logits, decide)

    return _let(words, verdict)


def _pieces(sentence: Column) -> Column:
    """The lower-case words of a sentence with a key: all, or in overlapping windows where it is long; windows without a key are left out."""
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - WINDOW + STEP - 1), F.lit(STEP))
    windows = lambda w: F.filter(F.transform(starts(w), lambda i: F.slice(w, i + 1, F.lit(WINDOW))), lambda x: F.array_join(x, " ").rlike(KEYS))
    return _let(F.regexp_extract_all(F.lower(sentence), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.when(F.size(w) <= WINDOW, F.array(w)).otherwise(windows(w)))


def licences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, n_scored, n_licences, families, paragraphs) for each row.

    n_scored counts the pieces with a key, n_licences the families that paragraphs name; families are distinct and ordered, paragraphs
    are paragraph:family:probability (its highest), by the paragraph's number from 0 and family.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    sentences = lambda x: F.filter(F.split(x, SENTENCE_END), lambda y: y.rlike(KEYS))
    verdicts = lambda x, i: F.transform(F.flatten(F.transform(sentences(x), _pieces)), lambda w: F.struct(i.alias("paragraph"), classified(w, model).alias("v")))
    parts = F.filter(F.split("text", PARAGRAPH_END), lambda x: x.rlike("\\S"))
    none = F.array().cast("array<struct<paragraph:int,v:struct<family:string,probability:double,agreement:double>>>")
    scored = _let(parts, lambda ps: F.struct(F.size(ps).cast("long").alias("n"), F.flatten(F.transform(ps, lambda x, i: F.when(x.rlike(KEYS), verdicts(x, i)).otherwise(none))).alias("s")))
    rows = rows.select("doc_id", scored.alias("scored"))

    def named(s: Column) -> Column:
        """The families of each paragraph, with their highest probability, ordered."""
        found = F.transform(F.filter(s, lambda x: x["v"]["family"].isNotNull()), lambda x: F.struct(x["paragraph"], x["v"]["family"].alias("family"), x["v"]["probability"].alias("probability")))
        last = lambda xs: F.filter(xs, lambda x, i: F.coalesce((F.get(xs, i + 1)["paragraph"] != x["paragraph"]) | (F.get(xs, i + 1)["family"] != x["family"]), F.lit(True)))
        return _let(F.array_sort(found), last)

    shown = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"], F.format_number(x["probability"], 4))))
    result = lambda s: _let(named(s["s"]), lambda xs: F.struct(s["n"].alias("n_paragraphs"), F.size(s["s"]).cast("long").alias("n_scored"), F.size(xs).cast("long").alias("n_licences"), F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["family"])))).alias("families"), shown(xs).alias("paragraphs")))
    return rows.select("doc_id", _let(F.col("scored"), result).alias("r")).select("doc_id", "r.*")


def op1_licences(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return licences(docs, fit(sample_sentences(docs)))
