import re
import textwrap

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import licences
from tests.llm.helpers import awkward, empty


@pytest.fixture(scope="module")
def model():
    return licences.fit([])


def test_every_template_holds_a_key_and_a_word_pair():
    for texts in licences.all_templates().values():
        assert all(re.search(licences.KEYS, t) and licences.grams(licences.tokens(t), (2,)) for t in texts)


def plain_piece(words, model):
    """The verdict on a piece in plain Python."""
    text = " ".join(words)
    p = model.probabilities(text)
    best = int(p.argmax())
    if best == len(model.families) or p[best] < model.threshold:
        return None
    found = max(licences.agreement(text, t) for t in licences.all_templates()[model.families[best]])
    return (model.families[best], float(p[best])) if found >= licences.AGREEMENT else None


def plain(text, model):
    """(n_paragraphs, n_scored, n_licences, families) of a text."""
    parts = [x for x in re.split(r"\r?\n[\x20\t]*\r?\n\s*", text or "") if re.search(r"\S", x)]
    scored, named = 0, set()
    for i, part in enumerate(parts):
        for sentence in re.split(r"(?<=[.!?;])\s+", part):
            if not re.search(licences.KEYS, sentence):
                continue
            words = re.findall("[a-z0-9]+", sentence.lower())
            pieces = [words] if len(words) <= 96 else [w for w in (words[k : k + 96] for k in range(0, len(words) - 96 + 32, 32)) if re.search(licences.KEYS, " ".join(w))]
            scored += len(pieces)
            named |= {(i, v[0]) for w in pieces if (v := plain_piece(w, model))}
    return len(parts), scored, len(named), ",".join(sorted({f for _, f in named}))


def scan(spark, texts, model):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.n_paragraphs, r.n_scored, r.n_licences, r.families) for r in licences.licences(df, model).orderBy("doc_id").collect()]


FILLER = "The ship left the harbour in the morning. Nobody knew where it was bound for."
#: Notices as they stand in files, and the one family of each.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at the address below.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above notice.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


@pytest.mark.parametrize("width", [50, 72, 10_000])
def test_wrapped_notices_name_one_family_each(spark, model, width):
    texts = [f"{FILLER}\n\n{textwrap.fill(t, width)}\n\n{FILLER}" for t in NOTICES.values()]
    got = scan(spark, texts, model)
    assert [x[2:] for x in got] == [(1, f) for f in NOTICES] and got == [plain(t, model) for t in texts]


SHORT = {
    "This file is licensed under the LGPL.": "lgpl", "SPDX-License-Identifier: Apache-2.0": "apache", "Lizenz: GNU GPL v3": "gpl", "// SPDX-License-Identifier: MIT": "mit", "License: MPL-2.0": "mpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Licensed under CC BY 4.0.": "cc-by",
    "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "Lorem ipsum dolor. Released under the MIT license. Sit amet": "mit", "SPDX-License-Identifier: AGPL-3.0-only": "agpl", "Released under the BSD 3-Clause License": "bsd",
}
#: Texts that took no part in training and name no licence.
UNKNOWN = [
    "his fishing license was taken from him by the warden", "he asked for permission to copy the keys", "Copyright is a bundle of rights in works of the mind", "", "licensed", "The club was licensed for dancing under the old law.", "The MIT professor renewed her driving license in May.",
    "Permission to land was refused by the tower.", "A public license hearing will be held in the town hall.", "The warranty does not cover water damage.", "Her apache helmet was sold under licence to a museum.", "Copyright notice: no part of this book may be reproduced.", "License plates must be clean.",
]


def test_short_forms_and_unknowns(spark, model):
    texts = [*SHORT, *UNKNOWN]
    got = scan(spark, texts, model)
    assert [x[3] for x in got] == [*SHORT.values(), *[""] * len(UNKNOWN)] and got == [plain(t, model) for t in texts]


def test_a_text_of_one_line_names_every_family(spark, model):
    long = " ".join(f"word{i}" for i in range(300))
    texts = [f"{long} licensed under the Apache License Version 2.0 {long} released under the MIT License {long}", f"{NOTICES['mit']} {FILLER} {NOTICES['gpl']}"]
    got = scan(spark, texts, model)
    assert [x[3] for x in got] == ["apache,mit", "gpl,mit"] and got == [plain(t, model) for t in texts]


def test_whole_templates_held_out(monkeypatch):
    """Wordings that no template of the fitted model has, told apart; and the calibration does something."""
    tests = {"apache": "You may use this file under the Apache License version 2.0 only", "gpl": "Redistributed under the terms of version 2 of the GNU General Public License", "mpl": "The contents are subject to the Mozilla Public License Version 2.0", "cc-by-sa": "This text is available under the Creative Commons Attribution-ShareAlike License", "isc": "Distributed under the ISC license"}
    model = licences.fit([])
    assert {f: model.families[int(model.probabilities(t)[:-1].argmax())] for f, t in tests.items()} == {f: f for f in tests}
    low, high = licences.THRESHOLDS
    assert low <= model.threshold <= high
    monkeypatch.setattr(licences, "UNKNOWN_NAMED", 0.5)
    assert licences.fit([]).threshold <= model.threshold


def test_whole_table_equals_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = licences.fit(licences.sample_sentences(docs))
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = licences.licences(docs, fitted).collect()
    print("temperature", fitted.temperature, "threshold", fitted.threshold)
    assert sum(r.n_licences for r in rows) > 10
    for r in rows:
        assert (r.n_paragraphs, r.n_scored, r.n_licences, r.families) == plain(text[r.doc_id], fitted), r.doc_id
    told = {"GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache"}
    for r in rows:
        assert set(filter(None, r.families.split(","))) >= {f for x, f in told.items() if x in (text[r.doc_id] or "")}


def test_awkward_rows(spark, model):
    assert licences.licences(awkward(spark), model).count() == 11 and licences.licences(empty(spark), model).count() == 0
    assert licences.sample_sentences(empty(spark)) == []
    same = spark.createDataFrame([(1, "License: MIT\n\nLicense: MIT"), (1, "License: MIT\n\nLicense: MIT")], "doc_id long, text string")
    assert [r.paragraphs.replace(":", " ").split(",")[1][:5] for r in licences.licences(same, model).select(F.col("paragraphs")).collect()] == ["1 mit"] * 2
