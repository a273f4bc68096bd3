import re
from collections import Counter

from driftwell.llm import licenses

from .conftest import prose


def bigrams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return list(zip(w, w[1:], strict=False))


def brute(text):
    """Best Dice of any window of each template's length."""
    b, best = bigrams(text), {}
    for name, t in licenses.TEMPLATES:
        g = Counter(bigrams(t))
        n = min(g.total(), len(b))
        for s in range(len(b) - n + 1) if n else ():
            dice = 2 * (Counter(b[s : s + n]) & g).total() / (g.total() + n)
            if dice >= licenses.LEAST and dice > best.get(name, 0):
                best[name] = dice
    return best


def test_scan_equals_brute_force(spark, awkward, empty):
    mit = dict(reversed(licenses.TEMPLATES))["MIT"]
    long_mit = licenses.TEMPLATES[3][1]
    texts = [prose(k, 60) for k in range(6)] + [
        prose(10, 30) + "\n" + mit + "\n" + prose(11, 20), long_mit.upper().replace(" ", "\n"), " ".join(w for k, w in enumerate(long_mit.split()) if k % 12), "Licensed under CC BY-NC 4.0.",
        "licensed under the apache license, version 2.0", licenses.TEMPLATES[8][1], "Released under the MIT", None, "", "License", " ".join(long_mit.split()[:20]), mit + " " + prose(12, 9) + " Licensed under CC BY-NC 4.0.",
    ]
    got = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.licence] = r.dice
    for d, t in enumerate(texts):
        want = brute(t)
        assert bool(want) == (d in got)
        if want:
            assert max(want.values()) == max(got[d].values()) and all(want[k] == v for k, v in got[d].items())
    assert set(got[len(texts) - 1]) == {"MIT", "CC-BY-NC-4.0"} and set(got[11]) == {"GPL-2.0"}
    assert licenses.scan(awkward).collect() == [] and licenses.scan(empty).collect() == []


def test_nothing_is_missing_beside_closer_licences(spark):
    gpl2, gpl3 = licenses.TEMPLATES[8][1], licenses.TEMPLATES[7][1].split()
    altered = [w if k % 9 else f"changed{k}" for k, w in enumerate(gpl3)]
    while brute(" ".join(altered)).get("GPL-3.0", 0) < licenses.LEAST:
        altered[next(k for k, w in enumerate(altered) if w.startswith("changed"))] = "is"
        altered = [gpl3[k] if w == "is" else w for k, w in enumerate(altered)]
    lesser = dict(reversed(licenses.TEMPLATES))["LGPL-2.1"]
    bsd2 = dict(reversed(licenses.TEMPLATES))["BSD-2-Clause"]
    texts = [
        f"{gpl2} {prose(30, 20)} {' '.join(altered)}", f"{' '.join(altered)} {gpl2}", lesser, bsd2, "Distributed under the MIT License", "Licensed under Apache License 2.0", "Licensed under CC BY-NC-SA 4.0.",
        f"{prose(31, 30)} {lesser.replace('library', 'toolkit')} {prose(32, 30)} {dict(licenses.TEMPLATES)['AGPL-3.0']}", (dict(licenses.TEMPLATES)["Zlib"] + "\n") * 300,
    ]
    want = [{"GPL-2.0", "GPL-3.0"}, {"GPL-2.0", "GPL-3.0"}, {"LGPL-2.1"}, {"BSD-2-Clause"}, {"MIT"}, {"Apache-2.0"}, {"CC-BY-NC-SA-4.0"}, {"LGPL-2.1", "AGPL-3.0"}, {"Zlib"}]
    got = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.licence)
    assert [got.get(k, set()) for k in range(len(texts))] == want


def test_every_licence_with_a_free_window_is_found():
    """Against plain windows: a licence is missing only if each of its windows meets one of a closer licence."""
    templates = licenses.Templates(licenses.TEMPLATES)
    text = " ".join(t for _, t in licenses.TEMPLATES[::3]) + " " + prose(33, 50) + " " + licenses.TEMPLATES[7][1]
    h = licenses.bigrams([text.encode()])[1]
    windows = licenses.alike(h, templates, *templates.find(h), licenses.LEAST)
    plain = {}
    for name, t in licenses.TEMPLATES:
        bag = Counter(licenses.bigrams([t.encode()])[1].tolist())
        for s in range(len(h) - bag.total() + 1):
            dice = 2 * (Counter(h[s : s + bag.total()].tolist()) & bag).total() / (2 * bag.total())
            if dice >= licenses.LEAST:
                plain[name, s, bag.total()] = dice
    starts = {(name, s, w): d for d, s, w, name in windows}
    assert starts.items() <= plain.items() and {k[0] for k in plain} == {k[0] for k in starts}
    assert all(max(d for (n, _, _), d in starts.items() if n == name) == max(d for (n, _, _), d in plain.items() if n == name) for name in {k[0] for k in plain})
    kept = licenses.best_windows(windows, len(h))
    for name in {w[3] for w in windows} - set(kept):
        for d, s, w, _ in (x for x in windows if x[3] == name):
            assert any(o[3] != name and o[0] >= d and s < o[1] + o[2] and o[1] < s + w for o in windows)


def test_long_text_is_scanned_whole(spark, longest):
    rows = [(1, longest + " " + licenses.TEMPLATES[3][1])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.licence) for r in got] == [(1, "MIT")] and got[0].first_word == len(re.findall(r"[^\W_]+", longest))


def test_tags_bodies_and_sentences_are_found_and_prose_is_left(spark):
    """Wordings that no template has as they stand, with text around."""
    said = [
        ("MIT", "# SPDX-License-Identifier: MIT"), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"), ("GPL-3.0", "/* SPDX-License-Identifier: GPL-3.0-or-later */"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
        ("MIT", "License: MIT"), ("MIT", "This project is under the MIT License"), ("GPL-3.0", "Licensed under GPLv3"), ("Apache-2.0", "it is available under the Apache 2.0 license, see LICENSE"), ("BSD-3-Clause", "Code is released under the New BSD license."),
        ("MPL-2.0", "All files are licensed under the MPL 2.0 license"), ("AGPL-3.0", "The server is distributed under the AGPLv3 license"), ("CC-BY-SA-4.0", "Texts are published under CC BY-SA 4.0"), ("LGPL-2.1", "This is licensed under the LGPL 2.1"),
        ("MIT", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement. in no event shall the authors or copyright owners be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
        ("Apache-2.0", "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare derivative works of, publicly display, publicly perform, sublicense and distribute the Work"),
        ("GPL-3.0", "The GNU General Public License is a free copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program, to make sure it remains free software for all of its users."),
        ("Unlicense", "SPDX-License-Identifier: Unlicense"), ("ISC", "is distributed under the ISC license"), ("EPL-2.0", "covered by the Eclipse Public License 2.0"), ("CC0-1.0", "data: licensed under CC0 1.0 Universal"), ("BSD-2-Clause", "Licensed under the Simplified BSD license"), ("Artistic-2.0", "It is licensed under the Artistic License 2.0"),
    ]
    clean = ["he is under the table and the license is under the chair", "the terms of the work are under the conditions of the house", "License to drive", prose(40, 300), "a public license is a license for the public, version 2 or 3"]
    rows = [(k, f"{prose(k, 20)}\n{t}\n{prose(90 + k, 20)}") for k, (_, t) in enumerate(said)] + [(100 + k, t) for k, t in enumerate(clean)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.EVERY).collect():
        got.setdefault(r.doc_id, set()).add(r.licence)
    hits = sum(name in got.get(k, ()) for k, (name, _) in enumerate(said))
    assert hits >= 0.9 * len(said), [t[:40] for k, (name, t) in enumerate(said) if name not in got.get(k, ())]
    assert not {k for k in got if k >= 100}
    assert sum(len(got.get(k, ())) for k in range(len(said))) <= 1.1 * len(said)


def test_candidates_lose_no_window():
    from collections import Counter as Bag

    import numpy as np

    templates = licenses.Templates(licenses.EVERY)
    assert len(licenses.EVERY) > 500
    r = np.random.default_rng(5)
    for t in r.integers(0, len(templates.bags), 120):
        words = licenses.EVERY[t][1].encode().split()
        text = b" ".join(w for w in words if r.random() > 0.06)
        _, h = licenses.bigrams([text])
        at, row = templates.find(h)
        some = set(templates.candidates(row).tolist()) if len(row) else set()
        for k, (_, bag) in enumerate(templates.bags):
            if (Bag(h.tolist()) & bag).total() >= templates.bounds[k]:
                assert k in some
