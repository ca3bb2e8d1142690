"""Licence scans by a trained paragraph classifier.

A paragraph is a run of lines, their newlines read as blanks: it ends at a line without a letter or a
digit, and where a line ends its sentence and the next one begins with a capital (or in a script without
case). So a hard-wrapped notice stays whole, and a text of a paragraph a line is scanned line by line. A
paragraph's different word n-grams (one to three words) weigh in a multinomial logistic regression whose
weights, for n-grams of the templates only, are few enough to go to every task. The classes are the
licence families and *unknown*; the probabilities are calibrated by a temperature, and a family below
``ACCEPT`` counts as unknown. The share of the best template that the paragraph has then confirms the family,
or not. Half of a template lies on the n-grams that no other family's templates have: what a licence shares
with others (a "Public License 2.0" of another name) never confirms it.

The lines of a paragraph are judged one by one as well, and stand instead of it where they confirm a
family and it does not (an identifier among lines of code), or where they confirm different families
(notices below each other). A line that speaks of licensing and names several licences is cut before each
further one. A sentence that denies a licence is *unknown*.

Training is a small fit on the driver from the templates below (whole notices and short forms), with words
dropped or exchanged and foreign words around; from their denials; from sentences that speak of rights
without granting any, word salads and single words. Its temperature is fitted to paragraphs that are not
learnt from. Scanning is DataFrame operations only, in one pass over the texts: paragraphs are filtered by
an expression, their n-grams exploded and joined with the weights, which are broadcast (their number is
fixed by the templates), and summed by paragraph, then by document. The filter drops no family: it asks for
an anchor word, for one of the strong words, or for three of the weak ones; with fewer the weights together
cannot outweigh *unknown* (``needed``).

Defined results: paragraphs that have an anchor word or a family count. A null or empty text, or one
without such a paragraph, has family ``none``, probability 1, confirmed false, no paragraphs; a text whose
paragraphs are all unknown has ``unknown``; of several families the confirmed one of highest probability
counts, ties by name; rows that repeat are scanned each for itself; an empty table stays empty. Other
columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: How licences are named, granted and noted, by family.
TEMPLATES = {
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", "This program is licensed under the terms of the GNU AGPL v3.", "GNU Affero General Public License", "Published under the AGPL.", "Licence: AGPLv3", "AGPLv3", "Affero GPL", "GNU AGPL", "GNU AGPL version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "all-rights-reserved": ["All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "No part of this publication may be reproduced without permission. All rights reserved."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license.", "Licensed under Apache-2.0.", "Licence: Apache-2.0", "Apache License 2.0", "The Apache License", "Apache-2.0 licensed", "Available under the terms of the Apache License.", "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD License.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "BSD 3-Clause License", "BSD 2-Clause License", "Licensed under BSD.", "BSD License", "Licence: BSD", "Distributed under the BSD license.", "BSD-licensed", "Available under the terms of the BSD license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "artistic-2.0": ["Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0", "The Artistic License 2.0"],
    "boost-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Boost Software License"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nc-nd-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "cc-by-nc-sa-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0-1.0": ["Released under CC0 1.0.", "CC0", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. Public domain dedication.", "CC0 1.0 Universal"],
    "cddl-1.0": ["Licensed under the Common Development and Distribution License, version 1.0.", "SPDX-License-Identifier: CDDL-1.0", "Licensed under the CDDL."],
    "epl-2.0": ["Licensed under the Eclipse Public License 2.0.", "This program is made available under the terms of the Eclipse Public License 2.0.", "Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0", "Licensed under the EPL."],
    "eupl-1.2": ["Licensed under the European Union Public Licence, version 1.2.", "Licensed under the EUPL.", "SPDX-License-Identifier: EUPL-1.2"],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GPL, version 2.", "SPDX-License-Identifier: GPL-2.0", "Licensed under the GPL v2.", "Licence: GPLv2", "GPLv2", "Licensed under GPL-2.0-or-later.", "GNU General Public License Version 2, June 1991", "GNU General Public License version 2", "GNU GPL version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0", "Licensed under the GPL v3.", "Licence: GPLv3", "Licence: GPLv3+", "GPLv3", "Under GPLv3 or later.", "Licensed under GPL-3.0-or-later.", "GNU General Public License Version 3, 29 June 2007", "GNU General Public License version 3", "GNU GPL version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": [
        "ISC License", "Released under the ISC License.", "SPDX-License-Identifier: ISC", "Licensed under ISC.", "ISC-licensed", "Available under the terms of the ISC license.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 3.", "Licensed under the LGPL.", "Licence: LGPLv3", "Licence: LGPLv2.1", "LGPLv3", "SPDX-License-Identifier: LGPL-2.1", "GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction. MIT License.", "SPDX-License-Identifier: MIT", "MIT License", "The MIT License (MIT)", "Licensed under MIT.", "Licence: MIT", "MIT-licensed", "Available under the terms of the MIT license.", "Licensed to you under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0", "Licensed under MPL 2.0.", "Mozilla Public License 2.0", "Available under MPL-2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "ofl-1.1": ["Licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1", "SIL Open Font License"],
    "osl-3.0": ["Licensed under the Open Software License version 3.0.", "SPDX-License-Identifier: OSL-3.0", "Open Software License 3.0"],
    "public-domain": ["This work is in the public domain.", "In the public domain.", "Released into the public domain.", "The author places this in the public domain."],
    "unlicense": ["This is released under the Unlicense.", "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain."],
    "wtfpl": ["Licensed under the WTFPL.", "SPDX-License-Identifier: WTFPL", "WTFPL"],
    "zlib": ["Licensed under the zlib license.", "SPDX-License-Identifier: Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
_OTHERS = [
    "She showed the officer a driving licence.", "The shop lost its liquor license last year.", "Copyright law differs between countries.", "The warranty covers parts and labour for two years.",
    "A license is needed to fish in this lake.", "They argued about copyright and free speech.", "The pilot license test is hard.", "No license information is given.", "Ask the owner before you redistribute the flyers.",
    "The Apache helicopter landed near the village.", "Apache warriors rode north.", "MIT students built the robot.", "He studied at MIT and reserved a table.", "The general public was not licensed to enter version 3 of the park.",
    "Creative people commonly like commons.", "GPL prices rose.", "The public house has a licence until midnight.", "License plates are reserved for residents.", "See the license for details.", "Terms and conditions apply under this license.",
    "The report was released under embargo.", "Permission is granted by the council.", "The software is free of charge.", "Er ging mit dem Hund und mit der Frau in die Stadt.", "A copy of the notice was published in the journal.", "The library lends this work to members.", "The lesser known foundation published version 2.0 of its guide.",
    "Licensed under the Example Public License 2.0.", "Released under a proprietary license.", "Available under the terms of the vendor license, version 1.0.", "Licensed under the Sample Software License, version 3.0.",
]
#: What turns a grant into its denial, put before it; such sentences are learnt as unknown.
_DENIALS = ("not", "no longer", "never", "this is not", "it is not", "was never", "is no longer", "not to be")
#: Words that stand for each other in a grant.
_VERBS = ("licensed", "released", "distributed", "published", "available", "provided", "covered", "offered")
#: Paragraphs that calibrate the probabilities, and are not learnt from.
_CALIBRATION = {
    "agpl-3.0": ["This code is available under the GNU Affero General Public License version 3."],
    "apache-2.0": ["This project is licensed under the Apache License 2.0.", "Apache License, Version 2.0"],
    "bsd": ["This package is distributed under the BSD license."],
    "gpl-2.0": ["This module is covered by the GNU General Public License version 2."],
    "gpl-3.0": ["The source is available under the GNU General Public License version 3."],
    "isc": ["This tool is licensed under the ISC license."],
    "lgpl": ["This library is licensed under the LGPL version 2.1."],
    "mit": ["This project is licensed under the MIT License.", "The code is available under the MIT license."],
    "mpl-2.0": ["The code is licensed under the Mozilla Public License 2.0."],
    "public-domain": ["The text is in the public domain."],
    "unknown": ["The restaurant has a licence to serve wine.", "Copyright was the topic of the lecture.", "Apache is a county in Arizona.", "He works at MIT.", "The public domain of the lake is closed.", "Do not redistribute the keys.", "All seats are reserved.", "The version 2.0 report is free.", "They were granted permission to leave.", "The commons were crowded."],
}
#: Before a licence named after another one; each is judged for itself, as if it were the first named, in lines that speak of licensing before.
ALSO = r"(?<!\s)(?:\s+(?i:and|or|as well as)\s+|\s*[/&]\s*)(?:(?i:under|by)\s+)?(?:(?i:the)\s+)?(?=(?:MIT|Apache|BSD|[AL]?GPL|GNU|Mozilla|MPL|ISC|CC|Creative Commons)\b)"
#: What stands behind the first word of a line that speaks of licensing; found in one pass, and searched in another, so that no line takes longer than it is long.
GRANT = r"(?s)(?i:licen[sc]ed?|released|distributed|available|published|identifier)\b(.*)"
ANCHORS = r"(?i)licen[sc]|copyright|rights\s+reserved|public\s+domain|redistribut|creative\s+commons|\bgpl|\blgpl|\bagpl|\bapache\b|\bbsd\b|spdx|\bcc0\b|\bcc\s+by"
#: Where a text is split into paragraphs.
BREAK = r"\n(?:[^\p{L}\p{N}]*\n|(?<=[.!?\u3002\uFF01\uFF1F][\"'\u201D\u2019)\]*_]{0,3}[ \t\r]{0,4}\n)(?=[^\p{L}\p{N}\n]*[\p{Lu}\p{Lo}]))"
#: Words that tell nothing by themselves, since ordinary prose has them; an n-gram counts only if it has another word.
_COMMON = set(
    "a above all an and any are as at be but by copy do either following for from if in included including into is it its june january later list may met mit must name names neither no nor of on or other part "
    "persons places provided shall that the their there this to under use used was whom with without work writing you your 0 1 2 3 4 5 6 7 8 9 29 1991 2004 2007 2020".split()
)
#: So many different words of lesser weight the filter asks for, where there is none of greater.
LEAST_WORDS = 3
ACCEPT = 0.5
#: The share of a template's n-grams that confirms a paragraph, and a line by itself (whose end may be the beginning of another name).
CONFIRM, CONFIRM_LINE = 0.6, 0.9
WIDTH = 3
#: What a template's shares add up to, but for rounding; the sums of ``PACKED`` templates go in one number, ``BITS`` each.
UNITS, BITS, PACKED = 1000, 12, 5
#: Weights are summed as whole numbers of this part, so that the order of a sum does not matter.
MICRO = 1_000_000
_WORD, _WORD_JAVA = r"[^\W_]+", r"[\p{L}\p{N}]+"
UNKNOWN = "unknown"


def grams_of(text: str) -> list[str]:
    """The different n-grams of a text's words, those of ``licence`` spelt ``license``."""
    words = re.findall(_WORD, text.lower().replace("licence", "license"))
    return sorted({" ".join(words[i : i + n]) for n in range(1, WIDTH + 1) for i in range(len(words) - n + 1)})


def _shares(templates: list[tuple[str, str]]) -> list[dict[str, int]]:
    """Each template's n-grams and their shares of it, in ``UNITS``: half lies on those that no other family's templates have, if there are any."""
    owners: dict[str, set[str]] = {}
    for family, text in templates:
        for g in grams_of(text):
            owners.setdefault(g, set()).add(family)
    out = []
    for _, text in templates:
        grams = grams_of(text)
        own = {g for g in grams if len(owners[g]) == 1}
        others = len(grams) - len(own)
        halves = 2 if own and others else 1
        out.append({g: max(1, round(UNITS / halves / (len(own) if g in own else others))) for g in grams})
    return out


class Model:
    """``weights``: n-gram to a number for each class; ``parts``: n-gram to (template, share) of those that have it; ``sizes``: the shares' sums."""

    def __init__(self, classes, bias, weights, templates, parts, sizes):
        self.classes, self.bias, self.weights, self.templates, self.parts, self.sizes = classes, bias, weights, templates, parts, sizes

    def judge(self, text: str) -> tuple[str, float, bool]:
        """Family, probability and confirmation of one paragraph, without Spark; for tests."""
        grams = grams_of(text)
        z = self.bias + sum((self.weights[g] for g in grams if g in self.weights), np.zeros(len(self.classes)))
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        name = self.classes[best] if p[best] >= ACCEPT else UNKNOWN
        hits = np.zeros(len(self.templates))
        for g in grams:
            for t, share in self.parts.get(g, ()):
                hits[t] += share
        fits = max((h / s for h, s, f in zip(hits, self.sizes, self.templates, strict=True) if f == name), default=0.0)
        return name, float(p[best]), name != UNKNOWN and fits >= CONFIRM


def train(seed: int = 4) -> Model:
    """The model, from the templates, their denials and the other sentences; a few seconds' work, always the same."""
    rng = np.random.default_rng(seed)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    templates = [(f, t) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]
    denied = [f"{d} {t[0].lower()}{t[1:]}" for _, t in templates if re.match(r"(?i)(?:licensed|released|published|distributed|available)\b", t) for d in _DENIALS]
    denied += [re.sub(r"(?i)\bis (licensed|subject|in|free)\b", r"is not \1", t) for _, t in templates if re.search(r"(?i)\bis (?:licensed|subject|in the public|free)\b", t)]
    vocabulary = sorted({g for _, t in templates for g in grams_of(t)} | {g for t in _OTHERS for g in grams_of(t) if " " not in g} | {g for t in denied for g in grams_of(t) if re.search(r"\b(?:not|never|longer)\b", g)} | {f"{v} {rest}" for v in _VERBS for rest in ("under", "under the", "by")})
    vocabulary = [g for g in vocabulary if not _COMMON.issuperset(g.split())]
    number = {g: k for k, g in enumerate(vocabulary)}
    names = {g[0] for g in (grams_of(t) for _, t in templates) if len(g) == 1}
    pool = [w for t in [*_OTHERS, *(t for _, t in templates)] for w in re.findall(_WORD, t.lower())]

    def varied(text: str, drop: float) -> str:
        words = [str(rng.choice(_VERBS)) if w in _VERBS[:4] and rng.random() < 0.5 else w for w in re.findall(_WORD, text.lower().replace("licence", "license")) if rng.random() >= drop]
        around = [f"word{rng.integers(1000)}" for _ in range(rng.integers(0, 12))]
        k = int(rng.integers(0, len(around) + 1))
        return " ".join(around[:k] + words + around[k:])

    def rows_of(rows: list[str]) -> np.ndarray:
        x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
        for r, text in enumerate(rows):
            x[r, [number[g] for g in grams_of(text) if g in number]] = 1
        return x

    def draw(copies: int):
        rows, of = [], []
        for family, text in templates:
            for c in range(copies * 3):
                rows.append(text if c == 0 else varied(text, float(rng.choice([0, 0, 0.1, 0.2]))))
                of.append(classes.index(family))
        for text in [*_OTHERS, *denied]:
            for c in range(copies if text in _OTHERS else max(copies // 4, 1)):
                rows.append(text if c == 0 else varied(text, 0.1 if text in _OTHERS else 0))
                of.append(len(classes) - 1)
        for _ in range(copies * 25):
            rows.append(" ".join(rng.choice(pool, rng.integers(1, 9))))
            of.append(len(classes) - 1)
        # No word by itself makes a licence (one of another language may look the same), but for those that are templates.
        for word in (g for g in vocabulary if " " not in g and g not in names):
            rows += [word, varied(word, 0)]
            of += [len(classes) - 1] * 2
        for _ in range(copies * 40):
            apart = [str(rng.choice(pool)) for _ in range(rng.integers(2, 4))]
            rows.append(" ".join(f"{w} {varied('', 0)} x" for w in apart))
            of.append(len(classes) - 1)
        for _ in range(copies * 10):
            rows.append(varied("", 0))
            of.append(len(classes) - 1)
        return rows_of(rows), np.array(of)

    x, of = draw(8)
    goal = np.eye(len(classes), dtype=np.float32)[of]
    w, b = np.zeros((x.shape[1], len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 201):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - goal) / len(x) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= 0.5 * (p - goal).mean(axis=0)
    w[np.abs(w) < 0.02] = 0
    # What stands in no template speaks for no family.
    ours = {g for _, t in templates for g in grams_of(t)}
    foreign = [k for g, k in number.items() if g not in ours]
    w[foreign, :-1] = np.minimum(w[foreign, :-1], w[foreign, -1:])
    # The temperature is that of paragraphs which were not learnt from.
    kept = [(f, t) for f in sorted(_CALIBRATION) for t in _CALIBRATION[f]]
    of = np.array([classes.index(f) for f, _ in kept])
    z = (rows_of([t for _, t in kept]) @ w + b).astype(float)
    nll = lambda t: -(z[np.arange(len(z)), of] * t - np.logaddexp.reduce(z * t, axis=1)).mean()
    t = min((0.25, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0), key=nll)
    weights = {g: np.round(w[k].astype(float) * t, 6) for g, k in number.items() if w[k].any()}
    parts: dict[str, list[tuple[int, int]]] = {}
    shares = _shares(templates)
    for k, share in enumerate(shares):
        for g, units in share.items():
            parts.setdefault(g, []).append((k, units))
    return Model(classes, np.round(b.astype(float) * t, 6), weights, [f for f, _ in templates], parts, [sum(share.values()) for share in shares])


def _weights_table(spark: SparkSession, model: Model) -> DataFrame:
    """The model as rows (gram, w, fits); a few thousand, from a literal. The empty n-gram, which every unit has, weighs nothing."""
    zero, lanes = [0] * len(model.classes), -(-len(model.templates) // PACKED)
    assert max(model.sizes) < 1 << BITS
    rows = [{"gram": "", "w": zero, "fits": [0] * lanes}]
    for g in sorted({*model.weights, *model.parts}):
        fits = [0] * lanes
        for t, share in model.parts.get(g, ()):
            fits[t // PACKED] += share << BITS * (t % PACKED)
        rows.append({"gram": g, "w": [round(float(x) * MICRO) for x in model.weights.get(g, zero)], "fits": fits})
    text = json.dumps(rows)
    schema = "array<struct<gram:string,w:array<bigint>,fits:array<bigint>>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), schema)).alias("x")).select("x.*")


def needed(model: Model) -> tuple[list[str], list[str]]:
    """Strong and weak words: without a strong word, and with fewer than ``LEAST_WORDS`` of the weak ones, no paragraph's n-grams can make any family as likely as unknown."""
    last = len(model.classes) - 1
    need = model.bias[last] - model.bias[:last]
    alone: dict[str, np.ndarray] = {}
    both: dict[tuple[str, ...], np.ndarray] = {}
    for g, w in model.weights.items():
        gain, words = np.maximum(w[:last] - w[last], 0), tuple(sorted(set(g.split()) - _COMMON))
        if not gain.any():
            continue
        for word in words:
            alone.setdefault(word, np.zeros(last))
        if len(words) == 1:
            alone[words[0]] = alone[words[0]] + gain
        elif len(words) == 2:
            both[words] = both.get(words, np.zeros(last)) + gain
    words = sorted(alone)
    number = {word: k for k, word in enumerate(words)}
    single = np.array([alone[word] for word in words]).reshape(-1, last)
    # The most that two words can bring any family.
    most = np.full((len(words), len(words)), -np.inf)
    for k in range(len(words)):
        most[k, k + 1 :] = (single[k] + single[k + 1 :] - need).max(axis=1)
    for (u, v), gain in both.items():
        most[number[u], number[v]] = (single[number[u]] + single[number[v]] + gain - need).max()
    met = np.bincount([number[word] for pair in both for word in pair], minlength=len(words))
    part = lambda k: (float((single[k] - need).max()), int(met[k]), words[k])
    strong = []
    while len(words) and most.max() >= 0:
        strong.append(max(np.unravel_index(most.argmax(), most.shape), key=part))
        most[strong[-1], :] = most[:, strong[-1]] = -np.inf
    return sorted(words[k] for k in strong), [w for k, w in enumerate(words) if k not in set(strong)]


def _any_of(words: list[str]) -> str:
    """A pattern of any of the words, tried by first letter."""
    by_first: dict[str, list[str]] = {}
    for word in words:
        by_first.setdefault(word[0], []).append(word[1:])
    return f"(?<![a-z0-9])(?:{'|'.join(f'{first}(?:{"|".join(rest)})' for first, rest in sorted(by_first.items()))})(?![a-z0-9])"


def _filter(model: Model):
    """Whether a text has an anchor word, a strong word, or enough weak ones."""
    strong, weak = needed(model)
    one, some = f"{_any_of(strong)}|{ANCHORS.removeprefix('(?i)')}", _any_of(weak)
    return lambda x: F.lower(x).rlike(one) | (F.regexp_count(F.lower(x), F.lit(some)) >= LEAST_WORDS)


def paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, at, part, anchored, gram: the different n-grams of each paragraph that the filter lets through (part 0) and, if it has several, of its lines (from 1); one more n-gram, empty, for each, and one with ``at`` -1 for each document."""
    passes = _filter(model)
    kept = F.filter(F.transform(F.split("text", BREAK), lambda x, k: F.struct(k.alias("at"), x.alias("run"))), lambda x: passes(x["run"]))
    # A text that does not pass whole has no paragraph that does, and need not be split.
    kept = F.when(passes(F.col("text")), kept)
    mark = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("run")))
    runs = docs.select("row", "doc_id", F.explode(F.concat(mark, F.coalesce(kept, F.array().cast("array<struct<at:int,run:string>>")))).alias("x")).select("row", "doc_id", "x.*")
    several = lambda x: F.when(F.regexp_extract(x, GRANT, 1).rlike(ALSO), F.regexp_replace(x, ALSO, "\nLicensed under ")).otherwise(x)
    lined = F.array_join(F.transform(F.split("run", "\n"), several), "\n")
    lines = F.filter(F.transform(F.split(lined, "\n"), lambda x, k: F.struct((k + 1).alias("part"), x.alias("line"))), lambda x: passes(x["line"]))
    own = F.array(F.struct(F.lit(0).alias("part"), F.col("run").alias("line")))
    units = runs.select("row", "doc_id", "at", F.explode(F.when(F.contains(lined, F.lit("\n")), F.concat(own, lines)).otherwise(own)).alias("x"))
    words = units.select("row", "doc_id", "at", "x.part", F.coalesce(F.col("x.line").rlike(ANCHORS), F.lit(False)).alias("anchored"), F.coalesce(F.regexp_extract_all(F.replace(F.lower("x.line"), F.lit("licence"), F.lit("license")), F.lit(f"({_WORD_JAVA})"), 1), F.array().cast("array<string>")).alias("words"))
    n = F.size("words")
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, k), " "))
    grams = F.concat(*[F.when(n >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in range(1, WIDTH + 1)], F.array(F.lit("")))
    return words.select("row", "doc_id", "at", "part", "anchored", F.explode(F.array_distinct(grams)).alias("gram"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, family, probability, confirmed, n_paragraphs, families (each paragraph's, in order)."""
    model = model or train()
    docs = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    joined = paragraphs(docs, model).join(F.broadcast(_weights_table(docs.sparkSession, model)), "gram")
    classes, templates = range(len(model.classes)), range(len(model.templates))
    sums = [F.sum(F.col("w")[c]).alias(f"z{c}") for c in classes] + [F.sum(F.col("fits")[k]).alias(f"t{k}") for k in range(-(-len(templates) // PACKED))]
    part = lambda t: F.shiftright(f"t{t // PACKED}", BITS * (t % PACKED)).bitwiseAND(F.lit((1 << BITS) - 1))
    by_unit = joined.groupBy("row", "doc_id", "at", "part", "anchored").agg(*sums)
    z = F.array(*[F.col(f"z{c}") / F.lit(float(MICRO)) + F.lit(float(model.bias[c])) for c in classes])
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    names = F.array(*[F.lit(c) for c in model.classes])
    fits = F.coalesce(*[F.when(F.col("name") == f, F.greatest(*[part(t) / F.lit(float(model.sizes[t])) for t in templates if model.templates[t] == f], F.lit(0.0))) for f in sorted(TEMPLATES)], F.lit(0.0))
    judged = (
        by_unit.withColumn("z", z)
        .withColumn("p", 1 / total)
        .withColumn("name", F.when(F.col("p") >= ACCEPT, F.element_at(names, F.array_position("z", top).cast("int"))).otherwise(UNKNOWN))
        .withColumn("counts", (F.col("at") >= 0) & (F.col("anchored") | (F.col("name") != UNKNOWN)))
        .select("row", "doc_id", "at", "part", "counts", "name", "p", (fits >= F.when(F.col("part") > 0, CONFIRM_LINE).otherwise(CONFIRM)).alias("confirmed"))
    )
    line = (F.col("part") > 0) & F.col("confirmed")
    unit = F.struct("at", "part", "counts", "name", "p", "confirmed")
    by_run = judged.groupBy("row", "doc_id", "at").agg(F.collect_list(unit).alias("units"), F.coalesce(F.max(F.when(F.col("part") == 0, F.col("confirmed"))), F.lit(False)).alias("whole"), F.collect_set(F.when(line, F.col("name"))).alias("named"))
    split = F.size("named") > F.when(F.col("whole"), 1).otherwise(0)
    own = F.filter("units", lambda x: x["counts"] & (F.when(split, x["part"] > 0).otherwise(x["part"] == 0)))
    found = by_run.select("row", "doc_id", own.alias("units")).groupBy("row", "doc_id").agg(F.array_sort(F.flatten(F.collect_list("units"))).alias("units"))
    rank = F.array_max(F.transform("units", lambda x: F.struct(x["confirmed"].alias("confirmed"), (x["name"] != UNKNOWN).alias("known"), x["p"].alias("p"), x["name"].alias("name"))))
    return found.withColumn("best", rank).select(
        "doc_id",
        F.coalesce("best.name", F.lit("none")).alias("family"),
        F.coalesce("best.p", F.lit(1.0)).alias("probability"),
        F.coalesce("best.confirmed", F.lit(False)).alias("confirmed"),
        F.size("units").cast("bigint").alias("n_paragraphs"),
        F.transform("units", lambda x: x["name"]).alias("families"),
    )


def op4_licenses(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
