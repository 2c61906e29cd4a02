"""Licence scans: a trained paragraph classifier with template comparison.

Every paragraph of every text is cut into words; its one- to
three-word n-grams that the training notices hold are the sparse features of a
multinomial logistic regression over licence families, ``unknown`` (a licence of no
family here) and ``none`` (no licence notice). The
regression is fitted on notices generated from public licence wording
and on unrelated sentences; a temperature fitted on held-out notices
calibrates it, and what is not probable enough is ``unknown``. A prediction
counts as confirmed when the paragraph also resembles a template of the family.

N-grams are compared by 64-bit hashes, looked up in two small tables (cuckoo hashing), so
words that no notice has cost one look-up and weigh nothing.
Scoring uses DataFrame functions only: one scan, no shuffle, no Python.
"""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A new line goes on with the paragraph if it starts with a small letter and the line before does not end a sentence.
_WRAP = r"\r?\n(?=\p{Ll})(?<![.:;!?\n]\r?\n)"
_WORD = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"

#: Wording of short notices: family -> names that licences of the family go by.
FAMILIES: dict[str, tuple[str, ...]] = {
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache Software License"),
    "mit": ("MIT License", "MIT license", "Expat License", "The MIT License (MIT)", "MIT"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD-2-Clause", "New BSD license", "Simplified BSD License", "3-clause BSD license"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License v2.0 or later", "GNU GPL version 3", "GPLv3", "GPL-3.0-or-later", "GNU General Public License, version 2", "GPL-2.0"),
    "lgpl": ("GNU Lesser General Public License, version 3", "LGPL-2.1", "GNU LGPL", "GNU Lesser General Public License v2.1 or later", "LGPLv3"),
    "agpl": ("GNU Affero General Public License, version 3", "AGPL-3.0", "GNU AGPL", "AGPLv3", "GNU Affero General Public License v3.0 or later"),
    "mpl": ("Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution License"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike License"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial License", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"),
    "public-domain": ("CC0 1.0 Universal Public Domain Dedication", "CC0-1.0", "public domain", "Unlicense", "Creative Commons Zero license"),
    "isc": ("ISC License", "ISC license", "ISC"),
}
_FRAMES = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the {}.",
    "This program is licensed under the terms of the {}; see LICENSE.", "SPDX-License-Identifier: {}", "This file is made available under the {}.", "You may use this file under the licence {}.",
    "Copyright 2020 The Authors. Licensed under the {}.", "The contents are licensed under {}, see the license file for details.", "License: {}", "Code in this repository is released under license {}.",
)
_BODIES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY AND NONINFRINGEMENT.',
        "Permission is hereby granted, free of charge, to any person with this software, to deal in the Software without restriction.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.',
    ),
    "apache": (
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.',
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but without any warranty; see the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "agpl": (
        "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, licensed under ISC.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary.",
        "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain.",
    ),
    "cc-by": ("You are free to share and adapt the material if you give appropriate credit, under the Creative Commons Attribution licence.",),
    "cc-by-sa": ("If you remix or build upon the material, you must distribute your contributions under the same Creative Commons ShareAlike license.",),
    "cc-by-nc": ("You may not use the material for commercial purposes under the Creative Commons NonCommercial license.",),
}
#: No licence notices.
_OTHER = (
    "The licensed driver showed a valid driving license to the officer.", "All rights reserved.", "Copyright 2019 the company. All rights reserved.", "A licence fee is due every year for each television.",
    "The bar lost its liquor license last week.", "She is a licensed therapist in the state.", "The warranty covers parts and labour for two years.", "No warranty is given for used goods.",
    "Copyright law differs between countries.", "He renewed his fishing license at the counter.", "The court issued a search warrant for the house.", "Poetic license lets writers bend the rules.",
    "Please read the license agreement before you install the product.", "The committee will redistribute the seats after the census.", "Licensing terms are available on request.", "Unauthorized redistribution is prohibited.",
    "This is a proprietary product; its license is granted to one user only.", "The song is in copyright until 2050.", "Lizenz und Gebühren werden jährlich neu festgelegt.", "La licence sportive est obligatoire pour jouer.", "Extended warranty plans are sold separately.",
)
_PLAIN = (
    "This is the house of the author and you may see it from the file of trees.", "The program starts at eight and the contents of the box are listed below.", "You can use the tools in the shed, see the list on the wall.",
    "The work was released in the spring and distributed to the schools.", "For more details see the file on the table.", "In the hope that it will be useful, the group published a copy of the letter.", "The general public was free to enter with or without a ticket.",
    "Any person may modify the conditions of the sale in writing.", "The source of the river lies in the hills, and the law of the land applies.", "Version two of the story is under review.", "The library is open to the public, and you should have received a card.",
    "This document describes the design of the bridge.", "All copies of the map were sold for a fee.", "Der Vertrag gilt unter den Bedingungen, die im Text stehen.", "Le texte est publié sous la direction de la maison.", "La obra se publica en la ciudad de los autores.",
    "Permission to enter the park was granted without restriction.", "The software engineer lives in a house without any furniture.", "He is an expert on foundations and the terms of trade.", "The following conditions apply to the race.", "I can see it, and it is not limited to the use of one person.",
    "The MIT campus lies on the river.", "The commons were open to all creative people in town.", "The Apache pilots flew over Mozilla street.", "BSD and ISC are abbreviations.", "The name of the holder is on the card, neither more nor less.",
)
#: Words that are frequent in any text; some are also names of licences.
_COMMON = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said may",
    "der die das und ist nicht mit von auf zu den des sich ein eine im für als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde mit",
    "le la les de des du et à un une est en que qui dans pour pas sur au par plus avec ce il elle se sont ne ou mais comme on son sa ses aux été leur deux était être cette même si",
    "el la los las de del y a en un una que es no por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde",
)

#: Licences of no family here: they teach the class ``unknown`` (even places) and calibrate it (odd places).
_FOREIGN = (
    "Eclipse Public License 1.0", "Boost Software License", "zlib License", "Artistic License 2.0", "European Union Public Licence", "Do What You Want License", "Microsoft Public License", "Common Development and Distribution License",
    "SIL Open Font License", "Academic Free License", "Open Software License 3.0", "Eiffel Forum License", "Python Software Foundation License", "PHP License 3.01", "Oracle Binary Code License", "Business Source License 1.1",
    "Elastic License 2.0", "Server Side Public License", "Open Database License", "Community Data License Agreement", "LaTeX Project Public License", "Ruby License", "Vim License", "OpenSSL License",
    "Commercial License", "Evaluation License", "Site License", "Enterprise Subscription Agreement", "Acme Corporation license", "Nokia Open Source License", "Sleepycat License", "W3C Software Notice",
)


def words_of(text: str) -> list[str]:
    """The words of a paragraph, as the scoring columns cut them."""
    import regex

    return regex.findall(_WORD, text.lower())


def _mix(a: int, b: int) -> int:
    return ((a << 1) ^ b) & (1 << 64) - 1


def features_of(text: str) -> set[int]:
    """64-bit hashes of the n-grams of one to three words, as the scoring columns make them."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words_of(text)]
    two = [_mix(a, b) for a, b in zip(h, h[1:])]
    return {*h, *two, *(_mix(a, b) for a, b in zip(two, h[2:]))}


@dataclass
class LicenceModel:
    """Hashes of the n-grams that count, their weights (n-gram x class), biases and the temperature that calibrates them."""

    families: list[str]
    keys: list[int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[list[str]]]

    def __post_init__(self):
        self._row = {k: i for i, k in enumerate(self.keys)}

    def probabilities(self, text: str) -> np.ndarray:
        own = sorted(self._row[f] for f in features_of(text) if f in self._row)
        z = (self.weights[own].sum(0) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def similarity(self, text: str, family: str) -> float:
        own = set(words_of(text))
        return max((len(own & set(t)) / len(own | set(t)) for t in self.templates.get(family, [])), default=0.0)

    def tables(self, bits: int = 14) -> tuple[list[int], list[int]]:
        """Two tables of numbers of n-grams (0: none, else number + 1) that hold every n-gram at one of its two slots."""
        one, two, mask = [0] * (1 << bits), [0] * (1 << bits), (1 << bits) - 1
        for i in range(len(self.keys)):
            at, n = i, 0
            while True:
                k = self.keys[at] & mask
                one[k], at = at + 1, one[k] - 1
                if at < 0:
                    break
                k = self.keys[at] >> 20 & mask
                two[k], at = at + 1, two[k] - 1
                if at < 0:
                    break
                n += 1
                if n > 1000:
                    return self.tables(bits + 1)
        return one, two


def notices() -> list[tuple[str, str]]:
    """Generated (text, class) pairs, the same every time."""
    rows = [(frame.format(name), family) for family, names in FAMILIES.items() for name in names for frame in _FRAMES]
    rows += [(body, family) for family, bodies in _BODIES.items() for body in bodies for _ in range(4)]
    rows += [(text, "none") for text in (*_OTHER, *_PLAIN) for _ in range(4)]
    rows += [(f"{a} {b}", "none") for a, b in itertools.permutations(_OTHER, 2)]
    rows += [(f"{a} {b}", "none") for a in _PLAIN for b in _PLAIN[:8]]
    rows += [(re.sub(r"\s*the \{\}|\s*a \{\}|\{\}", " {}", f).format(x), "unknown") for f in _FRAMES for x in ("terms set out in the contract", "conditions of sale", "house rules", "agreement between both parties", "state law", "Foo Bar terms")]
    rows += [(f.format(x), "unknown") for f in _FRAMES for x in _FOREIGN[::2]]
    # words of notices out of their order, alone or few together, are no notice
    draw = random.Random(11)
    loose = sorted({w for text in (*_FRAMES, *itertools.chain(*_BODIES.values())) for w in words_of(text)} - {w for names in FAMILIES.values() for n in names for w in words_of(n)})
    rows += [(w, "none") for w in loose]
    rows += [(" ".join(draw.sample(loose, draw.randint(2, 6))), "none") for _ in range(400)]
    rows += [(w, "none") for line in _COMMON for w in sorted(set(line.split()))]
    rows += [(" ".join(draw.choices(line.split(), k=draw.randint(2, 12))), "none") for line in _COMMON for _ in range(250)]
    return rows


def train(rounds: int = 400, ridge: float = 1e-5, lasso: float = 2e-5) -> LicenceModel:
    """Fit on four fifths of the notices (and all that are repeated), calibrate the temperature on the others."""
    rows = notices()
    families = [*FAMILIES, "unknown", "none"]
    y = np.array([families.index(f) for _, f in rows])
    times = Counter(t for t, _ in rows)  # wording that only one notice has is always learned
    held = np.array([zlib.crc32(t.encode()) % 5 == 0 and times[t] == 1 for t, _ in rows])
    strange = [f.format(x) for f in _FRAMES for x in _FOREIGN[1::2]]  # only calibrate
    rows += [(t, "unknown") for t in strange]
    y = np.concatenate([y, np.full(len(strange), families.index("unknown"))])
    held = np.concatenate([held, np.full(len(strange), True)])
    balance = 1.0 / np.sqrt(np.bincount(y, minlength=len(families)))[y]
    grams = [features_of(t) for t, _ in rows]
    keys = sorted(set().union(*(g for g, h in zip(grams, held) if not h)))
    number = {k: i for i, k in enumerate(keys)}
    size = len(keys) + 1  # the last one stands for texts without any
    sets = [sorted(number[f] for f in g if f in number) or [len(keys)] for g in grams]

    def sparse(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([sets[i] for i in chosen]), np.cumsum([0, *(len(sets[i]) for i in chosen[:-1])])

    own = np.flatnonzero(~held)
    at, starts = sparse(own)
    row = np.repeat(np.arange(len(own)), np.diff([*starts, len(at)]))
    share = balance[own] / balance[own].mean()
    one_hot = np.eye(len(families))[y[own]]
    w, b = np.zeros((size, len(families))), np.zeros(len(families))
    b[-1] = 3.0  # most paragraphs of a corpus are no notices
    wy, t = w, 1.0
    x = np.ones(size) / 64  # largest eigenvalue of the weighted Gram matrix, by powers
    for _ in range(30):
        x = np.bincount(at, (share * np.add.reduceat(x[at], starts))[row], size) / len(own)
        top = np.linalg.norm(x)
        x /= top
    rate = 1.0 / (0.5 * top + 1)
    for _ in range(rounds):  # accelerated proximal gradient with an elastic net; biases stay
        logits = np.add.reduceat(wy[at], starts, axis=0) + b
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - one_hot) * (share / len(own))[:, None]
        slope = np.stack([np.bincount(at, g[row, c], size) for c in range(len(families))], 1)
        w2 = wy - rate * (slope + ridge * wy)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * lasso, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wy = w2 + (t - 1) / t2 * (w2 - w)
        w, t = w2, t2
    w[-1] = 0
    at, starts = sparse(np.flatnonzero(held))
    logits = np.add.reduceat(w[at], starts, axis=0) + b

    def loss(heat: float) -> float:
        q = logits / heat
        q = q - q.max(1, keepdims=True)
        return float(-(q[np.arange(len(q)), y[held]] - np.log(np.exp(q).sum(1))).mean())

    heat = min(np.geomspace(0.5, 16, 61), key=loss)
    weights = np.round(w[:-1], 6)
    kept = np.flatnonzero(np.abs(weights).max(1) > 0)
    templates = {f: [sorted(set(words_of(t))) for t in dict.fromkeys(t for t, g in notices() if g == f)] for f in FAMILIES}
    return LicenceModel(families, [keys[i] for i in kept], weights[kept], np.round(b, 6), float(heat), templates)


def _constant(values, kind: str) -> Column:
    """An array as one literal, folded once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def scan(docs: DataFrame, model: LicenceModel, least: float = 0.6, similar: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, notice, family, probability, template_similarity, confirmed) of every paragraph that is not classified as ``none``.

    All paragraphs are classified. A paragraph is a line with the lines that go on with it (those that start with a small letter, after a
    line that ends no sentence), counted from 0. ``family`` is
    ``unknown`` where that class wins or the best has a calibrated probability below ``least``.
    ``template_similarity`` is the largest share of common words with a
    template of the family (Jaccard), 0 for unknown; ``confirmed`` asks for
    ``similar`` at least. Null and empty texts have no paragraph; repeated rows are
    scanned one by one; null ids stay; ties go to the family listed first.
    """
    text = F.regexp_replace(F.col(text_col), _WRAP, " ")
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("paragraph", "notice"))
    lines = lines.withColumn("words", F.regexp_extract_all(F.lower("notice"), F.lit(_WORD), 0))
    one, two = model.tables()
    signed = [0, *(k - (1 << 64) if k >> 63 else k for k in model.keys)]
    t1, t2, keys = _constant(one, "int"), _constant(two, "int"), _constant(signed, "bigint")
    mask1, mask2 = len(one) - 1, len(two) - 1

    def number(h: Column) -> Column:
        """The number of a known n-gram, null for others; the slot without one points at key 0, a hash no n-gram needs to have."""
        a, b = F.get(t1, h.bitwiseAND(F.lit(mask1)).cast("int")), F.get(t2, F.shiftright(h, 20).bitwiseAND(F.lit(mask2)).cast("int"))
        return F.when(F.get(keys, a) == h, a).when(F.get(keys, b) == h, b)

    hashes = F.transform("words", lambda w: F.xxhash64(w))
    lines = lines.withColumn("h", hashes)
    pair = F.transform("h", lambda x, i: F.shiftleft(x, 1).bitwiseXOR(F.get("h", i + 1)))
    triple = F.transform("h", lambda x, i: F.shiftleft(F.shiftleft(x, 1).bitwiseXOR(F.get("h", i + 1)), 1).bitwiseXOR(F.get("h", i + 2)))
    known = F.filter(F.transform(F.concat("h", pair, triple), number), lambda k: k > 0)
    # a paragraph can only be a notice if its n-grams together may outweigh what speaks for none; rows are
    # chosen inside an explode, as a filter would be pushed down and compute all of this again
    n = len(model.families)
    gain = (model.weights[:, :-1] - model.weights[:, -1:]).max(1)
    may = _constant([0, *(f"{v:.6f}" for v in np.maximum(gain, 0))], "double")
    gap = float(model.bias[-1] - model.bias[:-1].max()) - 1e-3
    hopeful = F.filter(F.array(known), lambda ks: F.aggregate(ks, F.lit(0.0), lambda s, k: s + F.get(may, k)) >= gap)
    lines = lines.select("id", "paragraph", "notice", "words", F.explode(hopeful).alias("known"))
    lines = lines.withColumn("known", F.array_distinct("known"))
    table, bias = _constant([f"{v:.6f}" for v in np.vstack([np.zeros(n), model.weights]).ravel()], "double"), _constant([f"{v:.6f}" for v in model.bias], "double")
    add = lambda c: F.aggregate("known", F.lit(0.0), lambda s, k: s + F.get(table, k * n + c))
    logits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: (F.get(bias, c) + add(c)) / model.temperature)
    notice = F.filter(F.array(logits), lambda z: F.array_position(z, F.array_max(z)) < n)
    lines = lines.select("id", "paragraph", "notice", "words", F.explode(notice).alias("z"))
    lines = lines.withColumn("best", F.array_position("z", F.array_max("z")).cast("int"))
    top = F.array_max("z")
    lines = lines.withColumn("probability", 1.0 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - top)))
    named = F.element_at(F.split(F.lit(",".join(model.families)), ","), F.col("best"))
    lines = lines.withColumn("family", F.when(F.col("probability") >= least, named).otherwise(F.lit("unknown")))
    shapes = F.split(F.lit(";".join("\n".join(dict.fromkeys(" ".join(ws) for ws in model.templates.get(f, []))) for f in model.families)), ";")
    own = F.array_distinct("words")

    def share(template):
        other = F.split(template, " ")
        return F.size(F.array_intersect(own, other)) / F.size(F.array_union(own, other))

    jaccard = F.transform(F.split(F.element_at(shapes, F.col("best")), "\n"), share)
    similarity = F.when(F.col("family") != "unknown", F.array_max(jaccard)).otherwise(F.lit(0.0))
    lines = lines.withColumn("template_similarity", similarity)
    return lines.select("id", "paragraph", "notice", "family", "probability", "template_similarity", (F.col("template_similarity") >= similar).alias("confirmed"))
