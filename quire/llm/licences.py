"""Licence scans by a positional rare-token index, with DataFrame functions only (operator 3).

A template is a piece of a licence's text with its label. Its index entries are its words of highest inverse document
frequency over all templates and the words of its mandatory key phrase, each with its position. A file's words that
the index holds as anchors - the rarest word of each key phrase - are looked up; each posting puts its template at the file
position less the template position, and the other entries of the template must then stand at their relative places.
A template counts where all words of its key phrase agree and at least ``SHARE`` of its entries do. The base phrases are
templates whose every word is mandatory. All of it happens within a row, so nothing is shuffled.

Cases: a null or empty text has no words and no label; repeated rows repeat the answer; a null doc_id is kept; texts
are whole; further columns are ignored whatever their names; no documents give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.decontaminate import words_of

# The base phrases with their labels, then opening words of public licences, a label and a key phrase each.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
NOTICES = (
    ("mit", "permission is hereby granted", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("bsd", "redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache", "licensed under the apache license", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("gpl", "gnu general public license", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "gnu lesser general public license", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("agpl", "gnu affero general public license", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by-sa", "creative commons attribution sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "waived all copyright and related or neighboring rights", "The person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("zlib", "provided as is without any express or implied warranty", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "boost software license", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt"),
    ("epl", "eclipse public license", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("ofl", "sil open font license", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("unlicense", "released into the public domain", "This is free and unencumbered software released into the public domain"),
)
RARE, SHARE = 12, 0.75
#: Words of the index are ASCII, and this sign is the only other character that lower() makes a letter of ASCII; so
#: that A-Z alone are lower-cased, it gives way to a sign that never does.
KELVIN, ANGSTROM = "\u212a", "\u212b"


@dataclass(frozen=True)
class Entry:
    word: str
    template: int
    position: int
    mandatory: bool
    anchor: bool = False


@dataclass(frozen=True)
class Template:
    label: str
    base: bool
    entries: int
    mandatory: int


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def build_index(phrases=PHRASES, notices=NOTICES, rare: int = RARE) -> tuple[list[Template], list[Entry]]:
    texts = [_words(p) for p, _ in phrases] + [_words(t) for _, _, t in notices]
    df = Counter(w for t in texts for w in set(t))
    templates, entries = [], []
    for k, words in enumerate(texts):
        base = k < len(phrases)
        key = words if base else _words(notices[k - len(phrases)][1])
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        must = set(range(at, at + len(key)))
        idf = sorted(range(len(words)), key=lambda i: (-math.log(len(texts) / df[words[i]]), i))
        own, anchor = sorted(must | set(idf[:rare])), next(i for i in idf if i in must)
        entries += [Entry(words[i], k, i, i in must, i == anchor) for i in own]
        templates.append(Template(phrases[k][1] if base else notices[k - len(phrases)][0], base, len(own), len(must)))
    return templates, entries


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE, index=None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest share of a template's entries that agree where its key phrase stands, 0 without one.
    """
    templates, entries = index or build_index()
    postings = F.array(*[F.struct(F.lit(e.word).alias("word"), F.lit(e.template).alias("template"), F.lit(e.position).alias("position")) for e in entries if e.anchor])
    own = lambda t: F.array(*[F.struct(F.lit(e.word).alias("word"), F.lit(e.position).alias("position"), F.lit(e.mandatory).alias("must")) for e in entries if e.template == t])
    known = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.entries).alias("entries"), F.lit(t.mandatory).alias("must"), own(i).alias("words")) for i, t in enumerate(templates)])
    # A place is one number: the template, then where it would begin, which may be before the text.
    shift, before = 2**32, 2**20
    rows = docs.select(docs[key].alias("doc_id"), words_of(F.lower(F.replace(docs[text].cast("string"), F.lit(KELVIN), F.lit(ANGSTROM)))).alias("w"))
    anchors = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda p: p.word.isin(sorted({e.word for e in entries if e.anchor})))
    places = F.flatten(F.transform(anchors, lambda p: F.transform(F.filter(postings, lambda e: e.word == p.word), lambda e: e.template.cast("long") * shift + p.at - e.position + before)))
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), "w", F.array_distinct(places).alias("places"))

    def judged(place):
        start = place % shift - before
        met = lambda e: F.get(F.col("w"), (start + e.position).cast("int")) == e.word
        template = F.get(known, F.floor(place / shift).cast("int"))
        agreed = F.filter(template.words, met)
        return F.struct(
            start.alias("start"), template.label.alias("label"), template.base.alias("base"), template.entries.alias("entries"), F.size(agreed).alias("agree"),
            (F.size(F.filter(agreed, lambda e: e.must)) == template.must).alias("whole"),
        )

    # Named twice, w stays a column; else the optimizer would split the text anew for every place.
    full = F.filter(F.transform("places", judged), lambda f: f.whole & (f.agree >= f.entries * F.lit(share)))
    found = rows.select("doc_id", "n_words", F.when(F.size("w") > 0, full).otherwise(F.filter(full, lambda f: F.lit(False))).alias("full"))
    based = F.filter("full", lambda f: f.base)
    found = found.withColumn("based", based)
    starts = F.transform("based", lambda f: f.start)
    joined = lambda name: F.array_join(F.array_sort(F.array_distinct(F.transform(name, lambda f: f.label))), ",")
    return found.select(
        "doc_id", "n_words", F.size("based").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined("based").alias("base_labels"), joined("full").alias("labels"), F.coalesce(F.array_max(F.transform("full", lambda f: f.agree / f.entries)), F.lit(0.0)).alias("score"),
    )
