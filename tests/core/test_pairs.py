"""Difference ratio and best pairs against the standard library's matcher and all pairs."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from driftwell.operators import pairs


def test_ratio_equals_plain_matcher():
    r = random.Random(1)
    for _ in range(400):
        alphabet = r.choice(["ab", "abcd ", "abcdefghijklmnopqrstuvwxyz ", "aé漢𝄞"])
        a = "".join(r.choice(alphabet) for _ in range(r.randint(0, 120)))
        b = "".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) if r.random() < 0.4 else "".join(c for c in a if r.random() > 0.2)
        assert pairs.ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)
        for limit in (0.3, 0.75, 1.0):
            assert pairs.at_least(a, b, limit) == (SequenceMatcher(None, a, b).ratio() >= limit)


def test_popular_characters_begin_no_block():
    r = random.Random(2)
    for _ in range(60):
        a = "".join(r.choice("abcdefghijklmnopqrstuvwxyzéàüß0123456789 ,.;:" + "漢字仮名交文") for _ in range(r.randint(150, 600)))
        b = "".join(c for c in a if r.random() > 0.1) if r.random() < 0.6 else "".join(r.sample(a, len(a)))
        assert pairs.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def squeezed(t):
    return re.sub(r"[ \t\n\f\r\v]+", " ", t).strip(" ").lower()


def plain(rows, limit):
    out, groups = [], {}
    for g, o, t in rows:
        if g is not None and t is not None:
            groups.setdefault(g, []).append((o, t))
    for g, own in groups.items():
        found = []
        own.sort()
        for i, (a, s) in enumerate(own):
            for b, t in own[i + 1 :]:
                x, y = squeezed(s), squeezed(t)
                v, w = (set(re.findall("[a-z0-9_]{2,}", z.lower())) for z in (s, t))
                n = len(v & w)
                if x != y and SequenceMatcher(None, x, y).ratio() < limit:
                    found.append((-round(n / len(v | w) + min(n, 8) * 0.01 if n else 0.0, 9), -b, a))
        if found:
            s, b, a = min(found)
            out.append((g, a, -b, round(-s, 6)))
    return sorted(out)


@pytest.mark.parametrize("vocabulary", [8, 60, 4000])
def test_best_pairs_equal_all_pairs(spark, vocabulary):
    r = random.Random(vocabulary)
    rows = []
    for g in range(12):
        for o in range(r.randint(1, 25)):
            t = " ".join(f"w{r.randrange(vocabulary)}" for _ in range(r.randint(1, 12)))
            rows.append((g, o, t if r.random() < 0.8 or o == 0 else rows[-1][2].upper() + " "))
    rows += [(50, 0, "a"), (50, 1, "é"), (51, 0, "same words here"), (51, 1, "Same  words here"), (52, 0, None), (None, 1, "w1 w2"), (53, 0, "ab"), (53, 1, "cd"), (53, 2, "cd")]
    frame = spark.createDataFrame(rows, "conv long, turn long, text string")
    got = sorted(tuple(x) for x in pairs.best_pairs(frame, "conv", "turn", "text").collect())
    assert got == plain(rows, 0.75)


def test_unlike_texts_are_given_up_early(monkeypatch):
    calls = []

    class Counted(SequenceMatcher):
        def find_longest_match(self, *place):
            calls.append(place)
            return super().find_longest_match(*place)

    monkeypatch.setattr(pairs, "SequenceMatcher", Counted)
    r = random.Random(5)
    a = "".join(r.choice("abcdefghij") for _ in range(190))
    b = "".join(r.sample(a, len(a)))
    assert not pairs.at_least(a, b, 0.75) and len(calls) < len(Counted(None, a, b).get_matching_blocks()) / 2
    b = a[:80] + "x" + a[85:]
    for limit in (0.5, 0.75, 0.95, 0.99):
        assert pairs.at_least(a, b, limit) == (SequenceMatcher(None, a, b).ratio() >= limit)


def test_best_pairs_of_texts_with_and_without_words(spark):
    """Copies in any order, pairs that share no word, pairs nearly alike one way round alone."""
    r = random.Random(11)
    rows = []
    for g in range(200):
        kinds = r.choice([["a", "é", "a é", "é a", "b", "ba", "ab"], ["ab cd", "ab ce", "ab  CD", "cd ab", "é", "x y"], ["".join(r.choice("abé ") for _ in range(r.randint(1, 9))) for _ in range(5)]])
        rows += [(g, o, r.choice(kinds)) for o in range(r.randint(2, 7))]
    frame = spark.createDataFrame(rows, "conv long, turn long, text string")
    assert sorted(tuple(x) for x in pairs.best_pairs(frame, "conv", "turn", "text").collect()) == plain(rows, 0.75)


def test_best_pairs_match_few_texts(spark, monkeypatch, tmp_path):
    """Texts are matched from the best score on, not for every pair that shares a word."""
    real = pairs.at_least

    def differs(x, y, limit):
        @F.udf("boolean")
        def run(a, b):
            with open(tmp_path / "matched", "a") as f:
                f.write(".")
            return not real(a, b, limit)

        return run(x, y)

    monkeypatch.setattr(pairs, "differs", differs)
    r = random.Random(7)
    rows = [(g, o, " ".join(f"w{r.randrange(60)}" for _ in range(10))) for g in range(5) for o in range(30)]
    frame = spark.createDataFrame(rows, "conv long, turn long, text string")
    assert sorted(tuple(x) for x in pairs.best_pairs(frame, "conv", "turn", "text").collect()) == plain(rows, 0.75)
    assert (tmp_path / "matched").stat().st_size <= 5 * 10
