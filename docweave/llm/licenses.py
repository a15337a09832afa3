"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A multinomial logistic regression over sparse word n-grams tells license families apart. It is trained on the templates below, varied by rule
and set in other words, and on windows of the scanned corpus itself as the unknown class. Whole templates are held out to temper
the probabilities and to set the threshold below which a window counts as unknown; then all are learnt. A family counts only if the window
also shares enough of a template's word pairs.

A paragraph is divided into units: sentences and lines, and at most UNIT words. Every run of units up to the length of the longest template is a
window, in texts of any size, and every window is judged by the classifier: sums over a text's words give the scores of all its
windows at once, and only where a bound shows that no family can win are they not worked out class by class.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import mapped, raw

#: Names and characteristic sentences of public licenses.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT", "The MIT License (MIT)", "Expat license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL-2.0", "GPLv2", "GNU GPL version 2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL-3.0", "GPLv3", "GNU GPL version 3"],
    "LGPL": ["GNU Lesser General Public License", "LGPL-2.1", "LGPLv3", "GNU LGPL"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"],
    "BSD": ["BSD license", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0"],
    "EPL": ["Eclipse Public License v2.0", "EPL-2.0", "Eclipse Public License 1.0"],
    "ISC": ["ISC License", "ISC"],
    "Zlib": ["zlib License", "zlib/libpng license"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "BSL-1.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0", "Creative Commons Zero"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-3.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "Proprietary": [],
}
GRANTS = [
    "Licensed under {the} {name}.", "Released under the {name}.", "This work is licensed under the {name}.", "This software is licensed under the {name}.", "This project is licensed under the terms of the {name}.",
    "Distributed under the {name}.", "SPDX-License-Identifier: {name}", "This file is available under the {name}, see LICENSE for details.", "License: {name}", "Code in this repository is provided under the {name}.",
    "You may use this content under the {name}.", "Made available under {the} {name}.",
]
PARAGRAPHS: dict[str, list[str]] = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License. You are free to share and adapt the material for any purpose as long as you give appropriate credit."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. If you remix the material you must distribute your contributions under the same license."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. You may not use the material for commercial purposes."],
    "CC-BY-ND": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License. You may not distribute modified material."],
    "Proprietary": ["All rights reserved.", "Copyright (c) 2024 Example Inc. All rights reserved. No part of this publication may be reproduced or distributed without prior written permission.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
}
#: Sentences that mention licenses but grant none: training rows of the unknown class.
MENTIONS = [
    "He lost his driving license last year.", "The license plate was missing from the car.", "A licensed electrician must check the work.", "The restaurant has no license to sell wine.", "The software is available in many versions.",
    "Version 2.0 was released in March.", "The public was free to enter.", "All rights and duties of the members are described below.", "Students of the university in Massachusetts wrote the report.", "The commons were open to all cattle.",
    "General conditions apply to all orders.", "Permission was granted to visit the archive.", "The foundation supports free schools.", "Terms of the contract were published.", "The distribution of rain was uneven.",
]
_WORD = re.compile(rb"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
UNKNOWN = "unknown"
#: The most words of a unit.
UNIT = 16
#: Words beyond this length are in no vocabulary.
_LONGEST_WORD = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def templates() -> dict[str, list[str]]:
    """Family: its template paragraphs."""
    out = {}
    for family, names in NAMES.items():
        grants = [g.replace("{the} ", "" if n[0:3] in ("CC ", "CC-", "CC0") else "the ").format(name=n) for g in GRANTS for n in names]
        out[family] = grants + PARAGRAPHS[family]
    return out


def grams(words: list[bytes]) -> list[bytes]:
    return words + [b" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]


def varied(text: str, rng: random.Random, around: list[list[bytes]]) -> list[bytes]:
    """The words of a template as it may turn up: cut short, a word lost, set in other words."""
    words = words_of(text.encode())
    if len(words) > 8 and rng.random() < 0.4:
        first = rng.randrange(len(words) // 3)
        words = words[first : first + max(8, rng.randrange(len(words)))]
    elif len(words) > 5 and rng.random() < 0.3:
        del words[rng.randrange(len(words))]
    if rng.random() < 0.6:
        other = rng.choice(around)
        at = rng.randrange(len(other) + 1)
        words = other[max(0, at - rng.randrange(UNIT)) : at] + words + other[at : at + rng.randrange(UNIT)]
    return words


@dataclass
class Scanned:
    """The words of a text, and its units."""

    starts: np.ndarray  # of words, in bytes
    ends: np.ndarray
    edges: np.ndarray  # first word of each unit, and the number of words
    paragraph: np.ndarray  # of each unit


@lru_cache(maxsize=4)
def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of data: its bytes as digits, by sums over the whole."""
    with np.errstate(over="ignore"):
        powers, back = (_powers(b, 1 << len(data).bit_length())[: len(data) + 1] for b in (_ODD, _ODD_INVERSE))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        out = (sums[ends] - sums[starts]) * back[starts]
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def scanned(data: np.ndarray) -> Scanned:
    """The words of a lower-cased text as _WORD finds them, and its units."""
    alnum = _ALNUM[data]
    within = alnum.copy()
    within[1:-1] |= _JOINS[data[1:-1]] & alnum[:-2] & alnum[2:]
    turns = np.flatnonzero(np.diff(np.concatenate([[False], within, [False]]).view(np.int8)))
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return Scanned(starts, ends, np.zeros(1, np.int64), starts)
    space = _SPACES[data]
    lines = np.flatnonzero(data == 10)
    solid = np.concatenate([[0], np.cumsum(~space)])
    blank = lines[1:][solid[lines[1:]] == solid[lines[:-1]]] if len(lines) else lines  # line ends of blank lines
    new_paragraph = np.searchsorted(blank, starts[1:]) > np.searchsorted(blank, ends[:-1])
    new_line = np.searchsorted(lines, starts[1:]) > np.searchsorted(lines, ends[:-1])
    padded = np.concatenate([data, [32, 32]])
    stopped = _STOPS[padded[ends[:-1]]] & _SPACES[padded[ends[:-1] + 1]]
    first = np.concatenate([[True], new_paragraph | new_line | stopped])
    at = np.arange(len(first))
    first |= (at - np.maximum.accumulate(np.where(first, at, 0))) % UNIT == 0
    edges = np.flatnonzero(first)
    paragraph = np.cumsum(np.concatenate([[0], new_paragraph]))[edges]
    return Scanned(starts, ends, np.append(edges, len(starts)), paragraph)


def _table(signs: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(signs)] = True
    return out


_ALNUM = _table(b"abcdefghijklmnopqrstuvwxyz0123456789")
_JOINS, _STOPS, _SPACES = _table(b".+-"), _table(b".!?"), _table(b" \t\n\r\f\v")


@dataclass
class LicenseModel:
    """Weights of n-grams, one row each, in order of single words, pairs and triples; the last row is of all other n-grams, and zero."""

    families: list[str]
    words: list[bytes]  # in order of their hashes
    hashes: np.ndarray
    pair: np.ndarray  # feature of two words
    triple: np.ndarray  # feature of the number of a pair and a word
    weights: np.ndarray  # features by families and unknown
    constant: np.ndarray
    temperature: float
    least: float
    compared: list[Compared]  # each family's templates
    longest: int  # words of the longest template

    @classmethod
    def fit(cls, background: list[bytes], seed: int = 5, rounds: int = 90, false_rate: float = 0.005) -> LicenseModel:
        """background: windows of the corpus, as text. Those that a template confirms are notices, and left out."""
        rng, known = random.Random(seed), templates()
        families = sorted(known)
        none = len(families)
        compared = [Compared(known[f]) for f in families]
        other = [w for w in map(words_of, background) if w and max(c.alike(w)[0] for c in compared) < 0.6]
        mentions = [words_of(t.encode()) for t in MENTIONS]
        around = other or mentions
        rows: list[tuple[list[bytes], int, bool]] = []  # words, class, held out
        for k, f in enumerate(families):
            for i, t in enumerate(known[f]):
                held = rng.random() < 0.2
                rows += [(words_of(t.encode()), k, held)] + [(varied(t, rng, around), k, held) for _ in range(3)]
        rows += [(w, none, i % 4 == 0) for i, w in enumerate(mentions + other)]
        model = cls._empty(families, rows, compared, max(len(words_of(t.encode())) for f in families for t in known[f]))
        x = [model.features(w) for w, _, _ in rows]
        y = np.array([k for _, k, _ in rows])
        held = np.array([h for _, _, h in rows])
        pick = lambda mask: [f for f, m in zip(x, mask) if m]
        model.weights, model.constant = softmax_regression(pick(~held), y[~held], len(model.weights), none + 1, rounds)
        logits = np.stack([model.logits(f) for f in pick(held)])
        scales = np.exp(np.linspace(-2, 2, 41))
        model.temperature = float(min(scales, key=lambda s: -_log_softmax(logits / s)[np.arange(len(logits)), y[held]].sum()))
        wrong = np.exp(_log_softmax(logits / model.temperature))[y[held] == none, :none].max(axis=1, initial=0)
        model.least = max(0.5, float(np.quantile(wrong, 1 - false_rate, method="higher")) + 1e-6 if len(wrong) else 0.5)
        model.weights, model.constant = softmax_regression(x, y, len(model.weights), none + 1, rounds)
        return model

    @classmethod
    def _empty(cls, families, rows, compared, longest) -> LicenseModel:
        seen: dict[bytes, int] = {}
        for words, k, _ in rows:
            if k != len(families):
                for g in set(grams(words)):
                    seen[g] = seen.get(g, 0) + 1
        often = {g for g, n in seen.items() if n >= 4}
        single = sorted({w for g in often for w in g.split(b" ")})
        data = np.frombuffer(b"".join(single), np.uint8)
        ends = np.cumsum([len(w) for w in single])
        hashed = hashes_of(data, np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(hashed)
        words = [single[i] for i in order]
        number = {w: i for i, w in enumerate(words)}
        two = sorted(g for g in often if g.count(b" ") == 1)
        three = sorted(g for g in often if g.count(b" ") == 2)
        size = len(words) + len(two) + len(three)
        pair = np.full((len(words) + 1, len(words) + 1), size, dtype=np.int32)  # the last word number is of unknown words
        for i, g in enumerate(two):
            a, b = (number[w] for w in g.split(b" "))
            pair[a, b] = len(words) + i
        triple = np.full((len(two) + 1, len(words) + 1), size, dtype=np.int32)
        for i, g in enumerate(three):
            a, b, c = g.split(b" ")
            triple[pair[number[a], number[b]] - len(words), number[c]] = len(words) + len(two) + i  # a frequent triple's pairs are frequent
        return cls(families, words, hashed[order], pair, triple, np.zeros((size + 1, len(families) + 1)), np.zeros(len(families) + 1), 1.0, 0.5, compared, longest)

    def numbers(self, hashed: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes; the number of words stands for all others."""
        at = np.searchsorted(self.hashes, hashed)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashed, at, len(self.hashes))

    def gram_features(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of the single words, pairs and triples that begin at each word; one less of pairs than words, two less of triples."""
        n, none = len(self.words), len(self.weights) - 1
        one = np.where(number == n, none, number)
        two = self.pair[number[:-1], number[1:]]
        three = self.triple[np.where(two == none, len(self.triple) - 1, two - n)[:-1], number[2:]] if len(number) > 2 else two[:0]
        return one, two, three

    def features(self, words: list[bytes]) -> np.ndarray:
        """Features of the known n-grams of some words, repeats included."""
        if not words:
            return np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        found = np.concatenate(self.gram_features(self.numbers(hashes_of(data, ends - [len(w) for w in words], ends))))
        return found[found < len(self.weights) - 1]

    def logits(self, features: np.ndarray) -> np.ndarray:
        """Sums of the weights of the features, over the root of their number, and the constant."""
        return self.weights[features].sum(axis=0) / max(1.0, np.sqrt(len(features))) + self.constant

    def classify(self, paragraph: bytes, confirm: float = 0.6) -> tuple[str, float, float] | None:
        """(family, probability, similarity with its closest template) of a paragraph as one window, or None for the unknown class."""
        words = words_of(paragraph)
        found = self.verdict(self.logits(self.features(words)), words, confirm)
        return found and found[:3]

    def verdict(self, logits: np.ndarray, words: list[bytes], confirm: float) -> tuple[str, float, float, float] | None:
        """Family, probability, similarity, and how many of the word pairs a template has, less a tenth of those that it lacks."""
        p = np.exp(_log_softmax(logits[None] / self.temperature))[0]
        best = int(p.argmax())
        if best == len(self.families) or p[best] < self.least:
            return None
        similar, shared, size = self.compared[best].alike(words)
        return (self.families[best], float(p[best]), similar, shared - 0.1 * (size - shared)) if similar >= confirm else None

    def scan(self, text: bytes | None, confirm: float = 0.6) -> list[tuple[int, int, str, float, float]]:
        """(start, end, family, probability, similarity) of the license notices of a text, in bytes.

        Of windows that overlap the one counts of which a template has most word pairs (each that it lacks takes a tenth off), of equal
        ones the shortest; neighbours of one family within a paragraph are put together.
        """
        return self.scan_many([text], confirm)[0]

    def scan_many(self, texts: list[bytes | None], confirm: float = 0.6, most: int = 1 << 18) -> list[list[tuple[int, int, str, float, float]]]:
        """scan of each text. Texts are joined by blank lines, which no window crosses, until `most` bytes are together."""
        out: list[list] = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            held.append(i)
            size += len(text or b"")
            if size >= most or i == len(texts) - 1:
                low = b"\n\n".join((texts[h] or b"").lower() for h in held)
                begin = np.cumsum([0, *(len(texts[h] or b"") + 2 for h in held)])
                for start, end, *found in self._scan(low, confirm):
                    at = int(np.searchsorted(begin, start, side="right")) - 1
                    out[held[at]].append((start - int(begin[at]), end - int(begin[at]), *found))
                held, size = [], 0
        return out

    def _scan(self, low: bytes, confirm: float) -> list[tuple[int, int, str, float, float]]:
        data = np.frombuffer(low, np.uint8)
        s = scanned(data)
        if not len(s.starts):
            return []
        number = np.full(len(s.starts), len(self.words))
        short = np.flatnonzero(s.ends - s.starts <= _LONGEST_WORD)
        number[short] = self.numbers(hashes_of(data, s.starts[short], s.ends[short]))
        hits = []
        for a, z, logits in self.candidates(number, s):
            if found := self.verdict(logits, words_of(low[s.starts[a] : s.ends[z - 1]]), confirm):
                hits.append((a, z, *found))
        free = np.ones(len(s.starts), dtype=bool)
        taken: list[tuple] = []
        for hit in sorted(hits, key=lambda x: (-x[5], x[1] - x[0], -x[3], x[0])):
            if free[hit[0] : hit[1]].all():
                free[hit[0] : hit[1]] = False
                taken.append(hit)
        out: list[tuple] = []
        paragraph = lambda word: s.paragraph[np.searchsorted(s.edges, word, side="right") - 1]
        for a, z, family, p, similar, _ in sorted(taken):
            if out and out[-1][1] == a and out[-1][2] == family and paragraph(a) == paragraph(a - 1):
                out[-1] = (out[-1][0], z, family, max(p, out[-1][3]), max(similar, out[-1][4]))
            else:
                out.append((a, z, family, p, similar))
        return [(int(s.starts[a]), int(s.ends[z - 1]), *x) for a, z, *x in out]

    def candidates(self, number: np.ndarray, s: Scanned):
        """(first word, last word + 1, logits) of each window for which a family may be likelier than unknown."""
        features = self.gram_features(number)
        ahead = self.weights[:, :-1] - self.weights[:, -1:]
        gain = np.append(ahead[:-1].max(axis=1), 0.0)  # the most that a feature helps a family against unknown
        handicap = (self.constant[:-1] - self.constant[-1]).max()
        n = len(number)
        sums, counts = [], []
        for order, f in enumerate(features):
            by_word = np.zeros(n + 1 + 2)
            np.cumsum(gain[f], out=by_word[1 : len(f) + 1])
            known = np.zeros(n + 1 + 2, np.int64)
            np.cumsum(f < len(gain) - 1, out=known[1 : len(f) + 1])
            sums.append((by_word, order))
            counts.append((known, order))

        def over(parts, a, z):
            return sum(x[np.maximum(z - order, a)] - x[a] for x, order in parts)

        first, last = s.edges[:-1], s.edges[1:]
        unit = np.arange(len(first))
        run = 0
        while len(unit):
            a, z = first[unit], last[unit + run]
            bound = over(sums, a, z) / np.sqrt(np.maximum(1, over(counts, a, z))) + handicap
            likely = np.flatnonzero(bound > 0)
            for at in range(0, len(likely), 4096):
                yield from self._judged(features, a[likely[at : at + 4096]], z[likely[at : at + 4096]])
            run += 1
            unit = unit[(unit + run < len(first))]
            unit = unit[(s.paragraph[unit + run] == s.paragraph[unit]) & (first[unit + run] - last[unit] < self.longest)]


    def _judged(self, features, a: np.ndarray, z: np.ndarray):
        """Those windows, with their logits, for which a family is likelier than unknown."""
        none = len(self.weights) - 1
        sums, known = np.zeros((len(a), self.weights.shape[1])), np.zeros(len(a), np.int64)
        for order, f in enumerate(features):
            size = np.maximum(0, z - order - a)
            window = np.repeat(np.arange(len(a)), size)
            own = f[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(len(window))]
            window, own = window[own < none], own[own < none]
            count = np.bincount(window, minlength=len(a))
            full = np.flatnonzero(count)
            if len(full):
                sums[full] += np.add.reduceat(self.weights[own], (np.cumsum(count) - count)[full], axis=0)
            known += count
        logits = sums / np.sqrt(np.maximum(1, known))[:, None] + self.constant
        for k in np.flatnonzero(logits[:, :-1].max(axis=1) > logits[:, -1]):
            yield int(a[k]), int(z[k]), logits[k]


class Compared:
    """The word pairs of some templates, by pair."""

    def __init__(self, texts: list[str]):
        own = [Counter(_pairs(words_of(t.encode()))) for t in texts]
        self.sizes = [c.total() for c in own]
        self.by_pair: dict[bytes, list[tuple[int, int]]] = {}
        for i, c in enumerate(own):
            for pair, n in c.items():
                self.by_pair.setdefault(pair, []).append((i, n))

    def alike(self, words: list[bytes]) -> tuple[float, int, int]:
        """The largest share of the shorter one's word pairs that words and a template both have, the largest number of such, and how many the words have."""
        shared: dict[int, int] = {}
        own = _pairs(words)
        for pair, n in Counter(own).items():
            for i, m in self.by_pair.get(pair, ()):
                shared[i] = shared.get(i, 0) + min(n, m)
        return max((n / min(len(own), self.sizes[i]) for i, n in shared.items()), default=0.0), max(shared.values(), default=0), len(own)


def _pairs(words: list[bytes]) -> list[bytes]:
    return [a + b" " + b for a, b in zip(words, words[1:])] or words


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def softmax_regression(rows: list[np.ndarray], y: np.ndarray, size: int, classes: int, rounds: int, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by classes, the last feature's zero) and constants; rows are lists of features, each worth one over the root of their number."""
    counts = np.array([len(r) for r in rows])
    feature = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), counts)
    value = (1 / np.sqrt(np.maximum(1, counts)))[row].astype(np.float32)[:, None]
    full = np.flatnonzero(counts)
    begin = (np.cumsum(counts) - counts)[full]
    order = np.argsort(feature, kind="stable")
    met, met_at = np.unique(feature[order], return_index=True)
    row_by_feature, value_by_feature = row[order], value[order]
    w, b = np.zeros((size, classes), np.float32), np.zeros(classes, np.float32)
    m, v = np.zeros((size + 1, classes), np.float32), np.zeros((size + 1, classes), np.float32)
    target = np.eye(classes, dtype=np.float32)[y]
    for t in range(1, rounds + 1):
        z = np.tile(b, (len(rows), 1))
        if len(full):
            z[full] += np.add.reduceat(w[feature] * value, begin, axis=0)
        error = ((np.exp(_log_softmax(z)) - target) / len(y)).astype(np.float32)
        g = np.zeros_like(m)
        if len(met):
            g[met] = np.add.reduceat(error[row_by_feature] * value_by_feature, met_at, axis=0)
        g[:-1] += ridge * w
        g[-1] = error.sum(axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
        w[-1] = 0
    return w.astype(np.float64), b.astype(np.float64)


def window_at(text: bytes | None, where: int, longest: int) -> bytes:
    """A window of a text, as the scan would take it: from some unit on, one or more units. where chooses which."""
    low = (text or b"").lower()
    s = scanned(np.frombuffer(low, np.uint8))
    if not len(s.starts):
        return b""
    rng = random.Random(where)
    k = rng.randrange(len(s.edges) - 1)
    run = [n for n in range(k + 1, len(s.edges)) if s.paragraph[n - 1] == s.paragraph[k] and (n == k + 1 or s.edges[n - 1] - s.edges[k + 1] < longest)]
    a, z = s.edges[k], s.edges[rng.choice(run)]
    return b" ".join(low[i:j] if j - i <= _LONGEST_WORD else b"x" for i, j in zip(s.starts[a:z], s.ends[a:z]))


def background_windows(documents: DataFrame, id_col: str, text_col: str, limit: int) -> list[bytes]:
    """One window, from any place, of each of at most `limit` ids' texts; ids are chosen by a hash."""
    longest = max(len(words_of(t.encode())) for own in templates().values() for t in own)
    space = 1 << 30
    share = min(space, space * (2 * limit + 100) // max(documents.count(), 1))  # a count of rows: footers of Parquet files alone are read
    ids = documents.select(F.col(id_col).alias("i")).where(F.pmod(F.xxhash64("i"), F.lit(space)) < share)
    ids = ids.distinct().orderBy(F.xxhash64("i"), "i").limit(limit)  # at most `limit` ids are broadcast
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("i"))).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("where"))

    def cut(batches):
        for b in batches:
            windows = [window_at(t, w, longest) for t, w in zip(raw(b.column(1)), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(windows, pa.binary())], names=["doc_id", "window"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = mapped(docs, cut, f"doc_id {kind}, window binary").groupBy("doc_id").agg(F.max("window").alias("window")).orderBy("window").collect()
    return [bytes(r["window"]) for r in rows if r["window"]]


def license_findings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", background: int = 2000) -> DataFrame:
    """doc_id, findings: for each text its license notices as structs of start, end (bytes), family, probability and similarity.

    The unknown class is learnt from one window, at any place, of each of at most `background` ids' texts, besides fixed sentences. Of these
    and of the templates a part is held out to set the temperature and the threshold. The scan itself covers whole texts.

    Defined cases: null, empty and blank texts have no findings (an empty list). Null ids are scanned like any row, repeated rows are
    returned each. An empty table gives no rows. Other columns are ignored.
    """
    model = LicenseModel.fit(background_windows(documents, id_col, text_col, background))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # as large as the templates
    kind = documents.schema[id_col].dataType.simpleString()
    names = ["start", "end", "family", "probability", "similarity"]
    own = pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()))))

    def run(batches):
        for b in batches:
            found = [[dict(zip(names, x)) for x in own_] for own_ in shared.value.scan_many(raw(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(own))], names=["doc_id", "findings"])

    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(docs, run, f"doc_id {kind}, findings array<struct<start: long, end: long, family: string, probability: double, similarity: double>>")


def op4_license_scan(spark, sf_dir):
    found = license_findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    families = F.array_join(F.array_sort(F.array_distinct("findings.family")), ";")
    return found.select("doc_id", F.size("findings").alias("n_paragraphs"), F.when(F.size("findings") > 0, families).alias("licenses"), F.array_max("findings.probability").alias("probability"))
