import functools
import random

import pytest

from driftwell.llm import registry
from driftwell.llm import token_counts as tc

from .conftest import prose

SCORES = {bytes([c]): -5.0 - c / 300 for c in range(97, 105)} | {b"ab": -6.0, b"abc": -7.5, b"cab": -7.0, b"bca": -7.0, b"abcabc": -9.0, b" ": -3.0, b" a": -4.0}


def brute(word, scores):
    @functools.cache
    def best(n):
        if not n:
            return 0.0, 0
        found = [(best(n - k), scores[word[n - k : n]]) for k in range(1, n + 1) if word[n - k : n] in scores]
        found = [(s + p, -c - 1) for (s, c), p in found if c >= 0]
        s, c = max(found, default=(float("-inf"), 1))
        return s, -c

    return best(len(word))[1]


def test_trie_equals_brute_force():
    r = random.Random(8)
    trie = tc.Trie(tc.Pieces(SCORES))
    for _ in range(2000):
        w = bytes(r.choice(b"abch x") for _ in range(r.randint(1, 14)))
        assert trie.insert(w) == brute(w, SCORES)


def test_pre_tokens_hold_every_byte():
    for t in (b"a  b\n c ", b"  ", b" a", b"\n\n  a\tb", "é 漢 ".encode()):
        assert b"".join(tc.PRE_TOKEN.findall(t)) == t
    assert tc.PRE_TOKEN.findall(b"a  b\n c ") == [b"a", b" ", b" b", b"\n", b" c", b" "]


def test_counts(spark, awkward, empty, monkeypatch):
    try:
        scores = tc.read_pieces(registry.PIECES)
    except FileNotFoundError:
        pytest.skip("no vocabulary file")
    monkeypatch.setattr(tc, "REMEMBERED", 50)
    got = tc.count_tokens(awkward, scores).collect()
    want = {}
    for r in awkward.collect():
        pre = tc.PRE_TOKEN.findall((r.text or "").encode())
        want.setdefault(r.doc_id, []).append((len(pre), sum(brute(w, scores) for w in pre)))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_pre_tokens, r.n_tokens))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert tc.count_tokens(empty, scores).collect() == []
    one = tc.count_tokens(spark.createDataFrame([(1, "zz zz")], "doc_id long, text string"), SCORES).collect()[0]
    assert one.n_tokens == 5  # no pieces: a token for each byte
    assert prose(1, 3)


def test_long_pre_tokens_and_texts(spark, monkeypatch):
    r = random.Random(9)
    pieces = tc.Pieces(SCORES)
    for _ in range(500):
        w = bytes(r.choice(b"abch x") for _ in range(r.randint(1, 60)))
        assert tc.rolled(w, pieces) == tc.Trie(pieces).insert(w)
    monkeypatch.setattr(tc, "AT_ONCE", 1000)
    text = "abc cab " * 300_000 + "abcabcab" * 100_000
    one = tc.count_tokens(spark.createDataFrame([(1, text), (2, "ab" * 200 + " a")], "doc_id long, text string"), SCORES).collect()
    got = {x.doc_id: (x.n_pre_tokens, x.n_tokens) for x in one}
    pre = tc.PRE_TOKEN.findall(text.encode())
    counts = {w: tc.rolled(w, pieces) for w in set(pre)}
    assert got[1] == (len(pre), sum(n if (n := counts[w]) >= 0 else len(w) for w in pre))
    assert got[2] == (2, tc.rolled(b"ab" * 200, pieces) + 1)
