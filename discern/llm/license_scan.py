"""Licence scan over a positional index of rare tokens.

Each template's rarest words, by how many documents hold them, are posted with their
positions. All of a file's words are looked up there, and the postings vote
for a relative position of template and file; where enough of them agree, the template
is laid over the file, and its mandatory key phrases and the share of its words that
stand in place decide.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

#: Contract phrases and their labels (fixed values).
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: (label, text, key phrases) of licence texts and of the notices that refer to them (fixed values).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "sublicense")),
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2", "in compliance with the license")),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", ("apache license version 2",)),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse or promote products", "without specific prior written permission")),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ("redistribution and use in source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("for any purpose with or without fee is hereby granted",)),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu general public license as published by the free software foundation", "version 2 of the license")),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu general public license as published by the free software foundation", "version 3 of the license")),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("gnu lesser general public license", "version 2 1 of the license")),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu lesser general public license", "version 3 of the license")),
    ("agpl-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu affero general public license",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    ("cc-by-sa", "This work is licensed under CC BY-SA 4.0.", ("cc by sa",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0 international license",)),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ("dedicated the work to the public domain",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software released into the public domain",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("in no event will the authors be held liable for any damages",)),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software", ("any person or organization obtaining a copy of the software",)),
)

#: Identifiers of licences in SPDX lines, and names and heads of licence files, by label (fixed values).
IDENTIFIERS = {
    "mit": "MIT", "apache-2": "Apache-2.0", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause", "isc": "ISC", "gpl-2": "GPL-2.0", "gpl-3": "GPL-3.0", "lgpl-2.1": "LGPL-2.1", "lgpl-3": "LGPL-3.0",
    "agpl-3": "AGPL-3.0", "mpl-2": "MPL-2.0", "epl-2": "EPL-2.0", "cc-by-nc": "CC-BY-NC-4.0", "cc-by-sa": "CC-BY-SA-4.0", "cc-by": "CC-BY-4.0", "cc0": "CC0-1.0", "unlicense": "Unlicense", "zlib": "Zlib", "bsl-1": "BSL-1.0",
}
NAMES = {
    "apache-2": ("Apache License Version 2.0, January 2004", "Apache License 2.0", "Apache License, v2.0"),
    "bsd-2-clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "bsd-3-clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "gpl-2": ("GNU General Public License Version 2, June 1991", "GNU General Public License v2.0", "GNU General Public License v2", "GNU GPL version 2", "under the GPLv2"),
    "gpl-3": ("GNU General Public License Version 3, 29 June 2007", "GNU General Public License v3.0", "GNU General Public License v3", "GNU GPL version 3", "under the GPLv3"),
    "lgpl-2.1": ("GNU Lesser General Public License Version 2.1, February 1999", "GNU Lesser General Public License v2.1", "under the LGPLv2.1"),
    "lgpl-3": ("GNU Lesser General Public License Version 3, 29 June 2007", "GNU Lesser General Public License v3.0", "GNU Lesser General Public License v3", "under the LGPLv3"),
    "agpl-3": ("GNU Affero General Public License Version 3, 19 November 2007", "GNU Affero General Public License v3.0", "GNU Affero General Public License v3", "under the AGPLv3"),
    "mpl-2": ("Mozilla Public License Version 2.0", "Mozilla Public License 2.0"),
    "epl-2": ("Eclipse Public License - v 2.0", "Eclipse Public License 2.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International",),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International",),
    "cc0": ("CC0 1.0 Universal",),
    "bsl-1": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
    "unlicense": ("under the Unlicense",),
}

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
RARE_WORDS = 8  # of each template; of short ones half their words
LEAST_VOTES = 3
LEAST_COVER = 0.7
SLIP = 3  # words that postings may be out of step


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


_BASE = [(p.encode().split(), label) for p, label in BASE.items()]
_TEXTS = [(label, words(t.encode()), [p.encode() for p in phrases]) for label, t, phrases in TEMPLATES]
# a name stands word for word; an identifier on an SPDX line, or next to another that stands there
_TEXTS += [(label, words(n.encode()), [b" ".join(words(n.encode()))]) for label, names in NAMES.items() for n in names]
_TEXTS += [(label, words(f"SPDX-License-Identifier: {i}".encode()), [b"spdx license identifier", b" ".join(words(i.encode()))]) for label, i in IDENTIFIERS.items()]
VOCABULARY = sorted({w for _, ws, _ in _TEXTS for w in ws})


@dataclass
class Index:
    weight: dict[bytes, float]  # IDF of each licence word
    postings: dict[bytes, list[tuple[int, int]]]  # rare word: (template, position)
    needed: list[int]  # votes for each template


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = {w: i for i, w in enumerate(VOCABULARY)}
    total = np.zeros(len(place) + 1, np.int64)
    for b in batches:
        for t in b.column(0).to_pylist():
            total[[place[w] for w in place.keys() & set(words(t))]] += 1
            total[-1] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])


def index_from(frequencies: dict[int, int]) -> Index:
    """The index, from the number of documents with each word of VOCABULARY (documents in all: the last)."""
    n = frequencies.get(len(VOCABULARY), 0)
    weight = {w: float(np.log((n + 1) / (frequencies.get(i, 0) + 0.5))) for i, w in enumerate(VOCABULARY)}
    postings: dict[bytes, list] = defaultdict(list)
    needed = []
    for k, (_, ws, _) in enumerate(_TEXTS):
        rare = set(sorted(set(ws), key=lambda w: (-weight[w], w))[: min(RARE_WORDS, max(2, (len(ws) + 1) // 2))])
        for i, w in enumerate(ws):
            if w in rare:
                postings[w].append((k, i))
        needed.append(min(LEAST_VOTES, max(2, len(rare) - 1)))
    return Index(weight, dict(postings), needed)


def fit(docs: DataFrame) -> Index:
    """Document frequencies of the licence words over all of docs."""
    rows = docs.where("text is not null").select(utf8("text").alias("t")).mapInArrow(_frequency_batches, "word long, n long")
    return index_from({r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()})


def base_places(ws: list[bytes], norm: bytes) -> list[tuple[int, str]]:
    """(start, label) of each place where a contract phrase stands; norm: the words, space-joined."""
    found = []
    for phrase, label in _BASE:
        p = b" ".join(phrase)
        at = norm.find(p)
        word = upto = 0  # words in front of `upto`
        while at >= 0:
            end = at + len(p)
            if (at == 0 or norm[at - 1] == 32) and (end == len(norm) or norm[end] == 32):
                word, upto = word + norm.count(b" ", upto, at), at
                found.append((word, label))
            at = norm.find(p, at + 1)
    return found


def matches(ws: list[bytes], index: Index) -> list[tuple[str, float, int]]:
    """(label, share of the template's words in place, first word) of each template that the file holds."""
    own = index.postings.keys() & set(ws)
    if len(own) < 2:
        return []
    votes: dict[int, Counter] = defaultdict(Counter)
    for at, w in enumerate(ws):
        if w in own:
            for k, i in index.postings[w]:
                votes[k][at - i] += 1
    out = []
    for k, by in votes.items():
        label, text, phrases = _TEXTS[k]
        best = None
        for offset in by:
            if sum(by.get(offset + d, 0) for d in range(-SLIP, SLIP + 1)) < index.needed[k]:
                continue
            lo, hi = max(0, offset - SLIP), offset + len(text) + SLIP
            part = ws[lo:hi]
            cover = sum((Counter(text) & Counter(part)).values()) / len(text)
            line = b" " + b" ".join(part) + b" "
            if cover >= LEAST_COVER and all(b" " + p + b" " in line for p in phrases) and (best is None or cover > best[1]):
                best = label, cover, lo
        if best:
            out.append(best)
    return out


def scan_batches(index: Index):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(t)
                base = base_places(ws, b" ".join(ws))
                found = matches(ws, index)
                own = {label for _, label in base}
                score = max([1.0 if base else 0.0, *(c for _, c, _ in found)])
                starts = [i for i, _ in base]
                rows.append((doc, len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x for x, *_ in found})), score))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return run


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    Null text counts as empty: no word, no label, score 0. score is 1 with a contract
    phrase, else the best share of a template's words in place. Repeated rows are
    scanned each; only doc_id and text are read. An empty table gives an empty one.
    """
    index = index or fit(docs)
    return docs.select("doc_id", utf8("text").alias("t")).mapInArrow(scan_batches(index), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
