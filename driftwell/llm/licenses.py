"""License scans (operator 6): Dice coefficient over word bigrams between licence templates and windows of a text.

Texts and templates are normalised: lower case, words of letters and digits. A window has the template's own number
of bigrams (a shorter text is one window); from the size bounds, a window with a Dice coefficient of t or more has at
least t / (2 - t) of the template's bigrams, so texts too short for that, and places with fewer shared bigrams, are
never compared.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import K1, K2, PUNCTUATION, Words, groups, mix, texts_of

LEAST = 0.8

#: Notices and texts of common licences: (licence, template).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Distributed under the MIT License."),
    ("MIT", "This software is released under the MIT License."),
    ("Apache-2.0", "Licensed under Apache License 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "Distributed under the Apache 2.0 license."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC0-1.0", "This work is licensed under CC0 1.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: Paragraphs of licence texts.
BODIES = (
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("Apache-2.0", "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MPL-2.0", "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions"),
    ("EPL-2.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    ("CC-BY-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\")."),
    ("CC-BY-SA-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License (\"Public License\")."),
    ("CC0-1.0", "Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights and associated claims and causes of action"),
)

#: Licences by their identifiers, with the names that people write.
NAMES = (
    ("MIT", ("MIT",)), ("Apache-2.0", ("Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache-2")), ("GPL-2.0", ("GPLv2", "GPL 2.0", "GNU GPL v2", "GNU General Public License v2.0")),
    ("GPL-3.0", ("GPLv3", "GPL 3.0", "GNU GPL v3", "GNU General Public License v3.0")), ("LGPL-2.1", ("LGPLv2.1", "LGPL 2.1", "GNU LGPL v2.1")), ("LGPL-3.0", ("LGPLv3", "LGPL 3.0", "GNU LGPL v3")), ("AGPL-3.0", ("AGPLv3", "AGPL 3.0", "GNU AGPL v3")),
    ("BSD-2-Clause", ("BSD 2-Clause", "Simplified BSD")), ("BSD-3-Clause", ("BSD 3-Clause", "New BSD", "Modified BSD")), ("MPL-2.0", ("MPL 2.0", "Mozilla Public License 2.0")), ("ISC", ("ISC",)), ("Zlib", ("zlib",)), ("BSL-1.0", ("Boost Software License 1.0",)),
    ("EPL-1.0", ("EPL 1.0", "Eclipse Public License 1.0")), ("EPL-2.0", ("EPL 2.0", "Eclipse Public License 2.0")), ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal")), ("CC-BY-4.0", ("CC BY 4.0",)), ("CC-BY-SA-4.0", ("CC BY-SA 4.0",)), ("CC-BY-NC-4.0", ("CC BY-NC 4.0",)),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0",)), ("CC-BY-NC-SA-4.0", ("CC BY-NC-SA 4.0",)), ("CC-BY-NC-ND-4.0", ("CC BY-NC-ND 4.0",)), ("0BSD", ("0BSD", "Zero-Clause BSD")), ("Unlicense", ("Unlicense",)), ("WTFPL", ("WTFPL",)), ("Artistic-2.0", ("Artistic License 2.0",)),
)
#: How a licence is named in a sentence; a name may end with the word itself.
FORMS = ("licensed under {}", "licensed under the {}", "licensed under the {} license", "released under the {} license", "distributed under the {} license", "available under the {} license", "is under the {} license", "this project is {} licensed", "published under {}", "covered by the {} license")


def named(names: tuple[tuple[str, tuple[str, ...]], ...] = NAMES) -> tuple[tuple[str, str], ...]:
    """Templates of the tags and sentences that name a licence; tags of the identifiers with and without their suffixes too."""
    out = []
    for ident, written in names:
        out += [(ident, f"SPDX-License-Identifier: {ident}{suffix}") for suffix in ("", "-only", "-or-later")[: 3 if "GPL" in ident else 1]]
        out += [(ident, f"License: {x}") for x in (ident, *written)]
        for x in (ident, *written):
            out += [(ident, f.format(x)) for f in FORMS if not ("license" in x.lower() and f.endswith("license"))]
    return tuple({(ident, text.lower()): None for ident, text in out})


#: Notices, paragraphs, tags and sentences, some hundreds.
EVERY = TEMPLATES + BODIES + named()


def bigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the word bigrams, in order."""
    w = Words([t.decode("utf-8", "replace").lower().encode() for t in texts], parts=PUNCTUATION)
    h = mix(w.hash[:-1] * K1 + w.hash[1:] * K2)
    same = w.doc[1:] == w.doc[:-1]
    return w.doc[1:][same], h[same]


class Templates:
    """Templates as bags of bigrams; ``holds[i, t]`` says whether template t has the bigram ``keys[i]``.

    ``rare[i]`` are the templates of which that is one of the bigrams least shared by other templates, so many of
    them that a window like enough has one: what many templates say, such as "under the", makes none a candidate.
    """

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float = LEAST):
        bags = [(name, bigrams([text.encode()])[1]) for name, text in templates]
        self.bags = [(name, Counter(h.tolist())) for name, h in bags if len(h)]
        self.keys = np.unique(np.concatenate([h for _, h in bags])) if self.bags else np.zeros(0, np.uint64)
        self.holds = np.array([np.isin(self.keys, np.array(list(bag), np.uint64)) for _, bag in self.bags]).T if self.bags else np.zeros((0, 0), bool)
        size = np.array([bag.total() for _, bag in self.bags], np.int64)
        self.bounds = np.ceil(least * size / (2 - least) - 1e-9).astype(np.int64)
        of: list[list[int]] = [[] for _ in self.keys]
        often = self.holds.sum(axis=1)
        for t, (_, bag) in enumerate(self.bags):
            spare = int(size[t] - self.bounds[t])  # bigrams that a window like enough may lack
            own = np.flatnonzero(self.holds[:, t])
            for k in own[np.argsort(often[own], kind="stable")]:
                of[k].append(t)
                spare -= bag[int(self.keys[k])]
                if spare < 0:
                    break
        self.rare = [np.array(x, np.int64) for x in of]
        self.tells = np.array([len(x) > 0 for x in of], bool)

    def candidates(self, row: np.ndarray) -> np.ndarray:
        """Templates that a text with these bigrams can hold."""
        told = np.unique(row[self.tells[row]])
        return np.unique(np.concatenate([self.rare[k] for k in told])) if len(told) else np.zeros(0, np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` of bigrams of any template, and their rows in ``holds``."""
        if not len(h) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[row] == h)
        return at, row[at]


def alike(h: np.ndarray, templates: Templates, at: np.ndarray, row: np.ndarray, least: float) -> list[tuple[float, int, int, str]]:
    """(dice, first bigram, bigrams, licence) of all windows of ``least`` or more. at, row: what ``find`` gives of ``h``."""
    found = []
    some = templates.candidates(row)
    shares = templates.holds[np.ix_(row, some)].sum(axis=0)
    for t in some[(shares >= templates.bounds[some]) & (len(h) >= templates.bounds[some])]:
        name, bag = templates.bags[t]
        size, bound = bag.total(), int(templates.bounds[t])
        own = at[templates.holds[row, t]]
        width = min(size, len(h))
        starts = np.unique(np.minimum(own, len(h) - width))
        shared = np.searchsorted(own, starts + width) - np.searchsorted(own, starts)
        for start in starts[shared >= bound].tolist():
            dice = 2 * (Counter(h[start : start + width].tolist()) & bag).total() / (size + width)
            if dice >= least:
                found.append((dice, start, width, name))
    return found


def best_windows(windows: list[tuple[float, int, int, str]], n: int) -> dict[str, tuple[float, int, int]]:
    """For each licence (dice, first bigram, bigrams) of its best window that stands, the first of equals.

    Windows stand by falling likeness, then length, each where none that stands covers a part of it; so a licence
    that loses one place to a closer one keeps its others. ``n`` bigrams are in the text.
    """
    taken = np.zeros(n, bool)
    kept: dict[str, tuple[float, int, int]] = {}
    for dice, start, width, name in sorted(windows, key=lambda w: (-w[0], -w[2], w[1], w[3])):
        if not taken[start : start + width].any():
            taken[start : start + width] = True
            kept.setdefault(name, (dice, start, width))
    return kept


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Rows (doc_id, licence, dice, first_word, n_words): for each document and licence found the best window that no closer licence's overlaps.

    Words count from 0; texts are read whole, however long. Null and empty texts, and templates of one word, match nothing. Repeated rows are reported
    each, null ids included. Columns other than doc_id and text are not read; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Templates(templates, least))  # as large as the templates

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = sent.value
        for b in batches:
            texts = texts_of(b.column(1))
            out = []
            for i, j in groups(texts):
                d, h = bigrams(texts[i:j])
                at, row = bags.find(h)
                bounds = np.searchsorted(d, np.arange(j - i + 1))
                for k in np.unique(d[at]):
                    lo, hi = bounds[k], bounds[k + 1]
                    one = slice(*np.searchsorted(at, (lo, hi)))
                    found = best_windows(alike(h[lo:hi], bags, at[one] - lo, row[one], least), hi - lo)
                    for name, (dice, start, width) in found.items():
                        out.append((i + int(k), name, dice, start, width + 1))
            if out:
                at, *columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "licence", "dice", "first_word", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, licence string, dice double, first_word long, n_words long")
