"""License scans: a trained paragraph classifier, confirmed by template comparison.

Paragraphs are runs of lines that no blank line parts. Their words are cut into chunks of ``CHUNK`` words, a new one at each line,
and scored in windows of two neighbouring chunks, across line ends; a line of one chunk is scored by itself, too. A window's hashed
words and word pairs go through multinomial logistic regression with a class for each licence family and one for unknown. The model
is trained here, on the templates below with wordings, omissions and insertions made by rule from a fixed seed, against sentences
that only sound like licences and a bounded, documented sample of windows of the corpus's own lines. Sentences of another hand, which
neither the templates nor the rules have made, and a part of the corpus's windows that is held out set one temperature, so that a
probability says how often such a prediction is right; what stays under ``threshold`` is unknown. Every family that some window of a
paragraph predicts is a finding, with its best window's probability.

A finding is confirmed by the templates of its family: if the paragraph holds ``SHARE`` of the word pairs of a licence's text or
notice, or if a licence's whole name stands near one of its windows and is granted there (a word that grants comes shortly before)
or is nearly all of its line.

Scoring is one pass without a shuffle; the model is a fixed number of floats.

Defined results: a null or empty text has no paragraphs and no findings; a finding's paragraph is the number of the line it starts
on; repeated rows are scanned one by one.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm import _common as c

BITS = 16
CHUNK = 10
UNKNOWN = "unknown"

#: The share of a text's word pairs that confirms it, and of a line's words that a name alone must make up.
SHARE, ALONE = 0.6, 0.75

#: At most so many lines of the corpus, of at most so many characters, are taken as a background, and at most so many of their windows
#: are shown to training as unknown; a fifth of those are kept from it for the temperature.
BACKGROUND_LINES, BACKGROUND_CHARS, BACKGROUND_WINDOWS = 3000, 2000, 4000

#: They are taken from about so many documents.
BACKGROUND_DOCS = 600

# Names under which licences are granted, by family.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl": ("GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL version 3", "AGPL-3.0", "AGPL-3.0-or-later", "AGPLv3"),
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License", "Apache-2.0", "Apache 2.0 license"),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "BSD license", "New BSD License"),
    "cc-by": ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution license"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0"),
    "cc0": ("CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero", "CC0 public domain dedication"),
    "epl": ("Eclipse Public License 2.0", "Eclipse Public License v1.0", "Eclipse Public License, version 2.0", "EPL-2.0"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License, version 2", "GNU General Public License v3.0", "GNU General Public License", "GNU GPL version 3", "GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-only", "GPLv3", "GPLv2"),
    "isc": ("ISC License", "ISC license terms"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU LGPL version 3", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPLv3"),
    "mit": ("MIT License", "MIT license terms", "The MIT License (MIT)", "Expat license"),
    "mpl": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0", "MPL 2.0"),
    "unlicense": ("The Unlicense", "Unlicense terms"),
}

_WARRANTY = "without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"

# The texts of short licences by their paragraphs, and the notices of long ones, as they are published.
TEXTS: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        f"This program is distributed in the hope that it will be useful, but {_WARRANTY}. See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "cc-by": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    ),
    "cc-by-nc": (
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    ),
    "cc-by-sa": (
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    ),
    "cc0": (
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        f"This program is distributed in the hope that it will be useful, but {_WARRANTY}. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        f"This library is distributed in the hope that it will be useful, but {_WARRANTY}. See the GNU Lesser General Public License for more details.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
}

# Fixed words that grant.
GRANTING = frozenset("under license licence licensed licenced terms spdx-license-identifier identifier covered governed permits apply applies".split())

# Fixed sentences of another hand, for the temperature alone.
CALIBRATION: tuple[tuple[str, str], ...] = (
    ("mit", "You are free to use the plugin, as it comes with the MIT License and nothing else."),
    ("mit", "license = MIT license terms, see the repository"),
    ("mit", "granted, free of charge, to anyone who obtains a copy of this software and its documentation files"),
    ("apache", "All code here is open source, Apache License 2.0, unless a file says otherwise."),
    ("apache", "the file may not be used except in compliance with the Apache-2.0 terms"),
    ("bsd", "Our fork stays under the old BSD license of the project."),
    ("bsd", "binary redistributions must reproduce the copyright notice, the list of conditions and the disclaimer"),
    ("gpl", "Because we link readline the whole tool is GPLv3 now."),
    ("gpl", "redistribute it or modify it under the GNU General Public License, version 2 or later"),
    ("gpl", "kernel modules must carry GPL-2.0-only headers"),
    ("lgpl", "dynamic linking is fine with the GNU Lesser General Public License"),
    ("agpl", "Running it as a service triggers the AGPLv3, mind you."),
    ("mpl", "Firefox parts stay under MPL 2.0 in our tree."),
    ("cc-by", "Photos by the author, CC BY 4.0."),
    ("cc-by", "text available with a Creative Commons Attribution license"),
    ("cc-by-sa", "Wikipedia's articles are CC BY-SA 3.0 content."),
    ("cc-by-nc", "Slides may be shared for non profit work, CC BY-NC 4.0."),
    ("cc0", "Data are public domain by CC0 1.0 Universal."),
    ("isc", "OpenBSD prefers the ISC License for new code."),
    ("unlicense", "I put my dotfiles out with The Unlicense."),
    ("epl", "JUnit is published with the Eclipse Public License v1.0."),
    (UNKNOWN, "The committee was licensed to hold public sessions in the general hall."),
    (UNKNOWN, "Version 3 of the manual is out, see the library for more details."),
    (UNKNOWN, "Apache pilots trained near the border for two weeks."),
    (UNKNOWN, "He got his pilot licence in March and his fishing license in May."),
    (UNKNOWN, "Terms of the sale apply to any person over eighteen."),
    (UNKNOWN, "This software may only be used by employees of the bank."),
    (UNKNOWN, "Permission is needed from the owner before you copy the key."),
    (UNKNOWN, "The public library lends works without fee for any purpose."),
    (UNKNOWN, "Creative writing classes share a common room."),
    (UNKNOWN, "The foundation published a free guide to gardening."),
    (UNKNOWN, "Redistribution of wealth was the subject of the following debate."),
    (UNKNOWN, "She graduated from MIT in 1999 and moved to Berkeley."),
    (UNKNOWN, "Copyright law and related rights in this country are strict."),
    (UNKNOWN, "All copies of the notice were removed from the wall."),
    (UNKNOWN, "The warranty covers parts and labour for a particular period."),
    (UNKNOWN, "A universal remote for 1.0 and 2.0 sets."),
    (UNKNOWN, "The attribution of the painting is in doubt."),
    (UNKNOWN, "No commercial breaks were shown in the first hour."),
    (UNKNOWN, "Use of the pool is at your own risk, in no event shall we be liable."),
)

# Fixed wordings that grant a licence by name.
GRANTS = (
    "Licensed under the {}.",
    "Licensed under {}.",
    "Released under the {}.",
    "This work is licensed under the {}.",
    "This work is licensed under a {}.",
    "Distributed under the terms of the {}.",
    "This software is available under the {}.",
    "Published under {}.",
    "SPDX-License-Identifier: {}",
    "See LICENSE for details of the {}.",
    "{}",
)

# Fixed sentences without a known licence.
OTHERS = (
    "You need a driving licence to rent a car here.",
    "The bar was licensed under the new rules of the city.",
    "He was released under the terms of a deal with the court.",
    "The album was released under the name of the band.",
    "This work is under review and may be published next year.",
    "The general public was not told of version 3 of the report.",
    "All rights reserved.",
    "Copyright 2020 by the authors.",
    "She studied at MIT and later taught there.",
    "Apache helicopters were seen over the valley.",
    "The Mozilla browser opened the page.",
    "Licensed under the Example Company End User License Agreement.",
    "Licensed to the Acme Corporation for internal use only.",
    "This software is proprietary and confidential.",
    "Released under embargo until version 2.0 is out.",
    "The license of the restaurant was revoked.",
    "Creative people share common attributes.",
    "A commons is land that the public may use.",
    "Permission to enter the building is granted by the guard.",
    "Free of charge for any person under six.",
    "The above notice shall be read in all schools.",
    "Version 4.0 International edition of the textbook.",
    "Distributed evenly over the surface of the work.",
    "Binary forms and source material of the poem.",
    "Available under the table, see details.",
)

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9]+)*")


def words_of(line: bytes) -> list[bytes]:
    return _WORD.findall(line)


class Windows:
    """Texts to windows of hashed features."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> list[int]:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w)
        return list(map(known.__getitem__, words))

    def cut(self, lines: list[list[bytes]], blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words and word pairs as numbers, the first word of each chunk, and each chunk's line. 2^BITS: no pair. Pairs don't leave a
        block of lines; without blocks every line is one."""
        counts = np.fromiter(map(len, lines), np.int64, len(lines))
        flat = np.array(self.hashes([w for line in lines for w in line]), np.uint64)
        ends = np.cumsum(counts)
        single = (flat * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
        pair = np.full(len(flat), 1 << BITS, np.int64)
        if len(flat) > 1:
            of = np.repeat(np.arange(len(lines)) if blocks is None else blocks, counts)
            mixed = (flat[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ flat[1:] + np.uint64(0x165667B1)) * np.uint64(0x9E3779B97F4A7C15)
            pair[:-1] = np.where(of[1:] == of[:-1], (mixed >> np.uint64(64 - BITS)).astype(np.int64), 1 << BITS)
        chunks = -(-counts // CHUNK)
        line = np.repeat(np.arange(len(lines)), chunks)
        within = np.arange(len(line)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        return single, pair, (ends - counts)[line] + within * CHUNK, line

    def spans(self, line: np.ndarray, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first chunk, last chunk) of each window: lines of one chunk, then all neighbours in a block."""
        of = line if blocks is None else blocks[line]
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]) & np.append(line[1:] != line[:-1], True)) if len(line) else np.zeros(0, np.int64)
        two = np.flatnonzero(of[1:] == of[:-1])
        return np.concatenate([first, two]), np.concatenate([first, two + 1])

    def logits(self, lines: list[list[bytes]], weights: np.ndarray, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A row of class logits for each window, its first line, and its first and its last word's number. weights: 2^BITS rows, a zero
        row, a bias row."""
        single, pair, starts, line = self.cut(lines, blocks)
        if not len(starts):
            return np.zeros((0, weights.shape[1])), line, starts, starts
        sums = np.add.reduceat(weights[single] + weights[pair], starts, axis=0).astype(np.float64)
        stops = np.append(starts[1:], len(single))
        first, last = self.spans(line, blocks)
        total = np.where((first == last)[:, None], sums[first], sums[first] + sums[last])
        size = stops[last] - starts[first]
        return total / np.sqrt(2 * size - 1)[:, None] + weights[-1], line[first], starts[first], stops[last]

    def rows(self, lines: list[list[bytes]]) -> list[tuple[int, np.ndarray]]:
        """(line, features) of each window, every line a block of its own."""
        single, pair, starts, line = self.cut(lines)
        stops = np.append(starts[1:], len(single))
        out = []
        for i, j in zip(*self.spans(line)) if len(starts) else ():
            a, b = starts[i], stops[j]
            out.append((int(line[i]), np.concatenate([single[a:b], pair[a:b][pair[a:b] < 1 << BITS]])))
        return out


def _examples(rng: random.Random) -> list[tuple[str, str]]:
    """(family, text) made from the templates and from the sentences without a known licence."""
    fillers = "the of and to in is it on as with for by at from that this are be or an not can will other all".split()
    out = []
    for family, names in NAMES.items():
        for name in names:
            for grant in GRANTS:
                out.append((family, grant.format(name)))
                for _ in range(2):  # among other words, half of which occur nowhere else
                    around = [rng.choice([rng.choice(fillers), f"w{rng.randrange(10**6)}"]) for _ in range(rng.randint(1, 14))]
                    at = rng.randint(0, len(around))
                    out.append((family, " ".join([*around[:at], grant.format(name), *around[at:]])))
        for notice in TEXTS[family]:
            for _ in range(12):
                kept = [w for w in notice.split() if rng.random() > 0.1]
                at = rng.randrange(CHUNK)  # windows start anywhere
                out.append((family, " ".join(rng.choices(fillers, k=rng.randint(0, 3)) + kept[at if len(kept) > 3 * CHUNK else 0 :])))
    for text in OTHERS:
        for _ in range(8):
            kept = [w for w in text.split() if rng.random() > 0.15]
            out.append((UNKNOWN, " ".join(rng.choices(fillers, k=rng.randint(0, 3)) + kept)))
    for grant in GRANTS[:-1]:
        for _ in range(12):
            name = " ".join(rng.choice("Example Foo House Open Data Software Public License Agreement Terms version 1.0 2.0 3 4.0 rules".split()) for _ in range(rng.randint(1, 4)))
            out.append((UNKNOWN, grant.format(name)))
    for _ in range(300):
        out.append((UNKNOWN, " ".join(rng.choices(fillers, k=rng.randint(1, 40)))))
    return out


@dataclass(frozen=True)
class Model:
    """Weights (2^BITS rows, a zero row for no pair, the bias row), classes by column, and the temperature."""

    weights: np.ndarray
    classes: tuple[str, ...]
    temperature: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _words(text: str) -> list[bytes]:
    return words_of(text.lower().encode("utf-8", "surrogatepass"))


def train(background: Sequence[str] = (), seed: int = 7, epochs: int = 14, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """Softmax regression by AdaGrad over the windows of the made examples and of background lines; then the temperature, on sentences
    of another hand and the held-out part of the background."""
    rng = random.Random(seed)
    examples = _examples(rng)
    classes = (UNKNOWN, *sorted(NAMES))
    windows = Windows()
    weights = np.zeros(((1 << BITS) + 2, len(classes)), np.float32)
    squares = np.full_like(weights, 1e-6)
    fit = [(features, classes.index(examples[k][0])) for k, features in windows.rows([_words(t) for _, t in examples])]
    around = [features for _, features in windows.rows([_words(t) for t in background])]
    rng.shuffle(around)
    around = around[:BACKGROUND_WINDOWS]
    fit += [(f, 0) for i, f in enumerate(around) if i % 5]
    held = [(features, classes.index(CALIBRATION[k][0])) for k, features in windows.rows([_words(t) for _, t in CALIBRATION])]
    held += [(f, 0) for f in around[:: 5 * max(1, len(around) // (5 * len(held)))]]  # about as many as sentences

    def logits(features: np.ndarray) -> np.ndarray:
        return weights[features].sum(axis=0) / np.sqrt(len(features)) + weights[-1]

    for _ in range(epochs):
        rng.shuffle(fit)
        for features, want in fit:
            z = logits(features)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[want] -= 1
            at, counts = np.unique(features, return_counts=True)
            at, x = np.append(at, len(weights) - 1), np.append(counts / np.sqrt(len(features)), 1.0)
            g = np.outer(x, p) + decay * weights[at]
            squares[at] += g * g
            weights[at] -= rate * g / np.sqrt(squares[at])
    z, want = np.array([logits(f) for f, _ in held]), np.array([k for _, k in held])

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(want)), want]))

    return Model(weights, classes, min((0.25 * 1.15**k for k in range(40)), key=loss))


def _pairs(words: Sequence[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


_TEXT_PAIRS = {family: [_pairs(_words(t)) for t in texts] for family, texts in TEXTS.items()}
_NAME_WORDS = {family: [_words(n) for n in names] for family, names in NAMES.items()}
_GRANTING = frozenset(w.encode() for w in GRANTING)


def holds_text(family: str, words: list[bytes], share: float = SHARE) -> bool:
    """Whether a paragraph has at least `share` of the word pairs of some text of the family."""
    have = _pairs(words)
    return any(len(t & have) >= share * len(t) for t in _TEXT_PAIRS[family])


def grants_name(family: str, words: list[bytes], line_of: Sequence[int], line_size: Sequence[int]) -> bool:
    """Whether a whole name of the family stands among the words after one that grants, or is nearly all of its line. line_of: each
    word's line; line_size: words by line."""
    for name in _NAME_WORDS[family]:
        for i in range(len(words) - len(name) + 1):
            if words[i] == name[0] and words[i : i + len(name)] == name:
                if not _GRANTING.isdisjoint(words[max(0, i - 4) : i]) or len(name) >= ALONE * line_size[line_of[i]]:
                    return True
    return False


def findings(many: list[str], model: Model, windows: Windows, threshold: float) -> list[tuple[int, list[tuple[int, str, float, bool]]]]:
    """For each text its number of paragraphs, and (paragraph's first line, family, probability, confirmed) of those that are known."""
    lines, blocks, owner, number = [], [], [], []  # owner and first line by block
    counts = []
    for i, t in enumerate(many):
        blank, before = True, len(owner)
        for k, line in enumerate(t.lower().encode("utf-8", "surrogatepass").split(b"\n")):
            if not line.strip():
                blank = True
                continue
            if blank:
                owner.append(i)
                number.append(k)
                blank = False
            lines.append(words_of(line))
            blocks.append(len(owner) - 1)
        counts.append(len(owner) - before)
    out: list[tuple[int, list]] = [(n, []) for n in counts]
    of = np.array(blocks, np.int64)
    logits, line, start, stop = windows.logits(lines, model.weights, of)
    some = np.flatnonzero(logits.argmax(axis=1)) if len(logits) else []
    if not len(some):
        return out
    best: dict[tuple[int, str], tuple[float, list]] = {}
    for w, p in zip(some.tolist(), model.probabilities(logits[some])):
        k = int(p.argmax())
        if p[k] >= threshold:
            key = int(of[line[w]]), model.classes[k]
            was = best.get(key, (0.0, []))
            was[1].append((int(start[w]), int(stop[w])))
            best[key] = max(float(p[k]), was[0]), was[1]
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    flat_line, ends = np.repeat(np.arange(len(lines)), size), np.cumsum(size)
    edges = np.searchsorted(of, np.arange(len(owner) + 1))  # the first line of each block
    for (block, family), (p, spans) in sorted(best.items()):
        own = [w for x in lines[edges[block] : edges[block + 1]] for w in x]
        base = int(ends[edges[block]] - size[edges[block]])
        sure = holds_text(family, own)
        for a, b in spans if not sure else ():
            lo, hi = max(base, a - CHUNK), min(base + len(own), b + CHUNK)
            if grants_name(family, own[lo - base : hi - base], flat_line[lo:hi], size):
                sure = True
                break
        out[owner[block]][1].append((number[block], family, p, sure))
    return out


_FINDING = T.StructType([T.StructField("paragraph", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("confirmed", T.BooleanType())])
_ARROW = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch], get, threshold: float) -> Iterator[pa.RecordBatch]:
    model, windows = get(), Windows()
    for whole in batches:
        for b in c.slices(whole):
            found = findings(c.texts(b), model, windows, threshold)
            rows = [[dict(zip(("paragraph", "family", "probability", "confirmed"), f)) for f in fs] for _, fs in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(rows, _ARROW)], names=[b.schema.names[0], "n_paragraphs", "findings"])


def background(docs: DataFrame, lines: int = BACKGROUND_LINES, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Lines of the corpus without any that speaks of licences; bounded by `lines`, whatever the corpus's size.

    They come from documents whose ids hash to 0 modulo a number that the row count sets, so that about BACKGROUND_DOCS
    documents are looked at, and of those the lines whose own hashes are lowest."""
    step = max(1, docs.count() // BACKGROUND_DOCS)
    few = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(step)) == 0)
    line = F.explode(F.split(c.clean_text(text_col), "\n")).alias("line")
    some = few.select(line).where((F.length("line") <= BACKGROUND_CHARS) & F.col("line").rlike(r"\S") & ~F.col("line").rlike("(?i)licen[sc]|copyright|spdx|permission|redistribut|cc[ -]by"))
    return [r["line"] for r in some.distinct().orderBy(F.xxhash64("line"), "line").limit(lines).collect()]


def scan(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_paragraphs, findings) for each row; findings: array of paragraph, family, probability, confirmed."""
    spark = docs.sparkSession
    c.ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.classes, model.temperature))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_paragraphs", T.LongType()), T.StructField("findings", T.ArrayType(_FINDING))])
    return rows.mapInArrow(lambda it: _scan(it, lambda: Model(*shared.value), threshold), schema)
