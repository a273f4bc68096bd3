import math
import zlib
from collections import Counter

import numpy as np

from driftwell.llm import lm
from driftwell.llm._words import Words

from .conftest import prose, words


def brute_base(rows):
    c = Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            c.update(words(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    return n, [(len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None])) for _, t in rows]


def likelihood(model, seq):
    a = model.start * model.emit[seq[0]]
    for s in seq[1:]:
        a = (a @ model.move) * model.emit[s]
    return math.log10(a.sum())


def some_model(seed=1):
    r = np.random.default_rng(seed)
    k = lm.STATES
    return lm.Model(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(lm.N_CLASSES), k).T)


def test_forward_and_counts_equal_brute_force():
    r = np.random.default_rng(2)
    model, k = some_model(), lm.STATES
    seqs = sorted((r.integers(0, 50, n).astype(np.int16) for n in (1, 2, 5, 9, 9, 12)), key=len, reverse=True)
    counts = lm.empty_counts()
    assert np.allclose(lm.forward(model, seqs, counts), [likelihood(model, s) for s in seqs])
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((lm.N_CLASSES, k))
    for s in seqs:
        n = len(s)
        a, b = np.zeros((n, k)), np.ones((n, k))
        a[0] = model.start * model.emit[s[0]]
        for t in range(1, n):
            a[t] = (a[t - 1] @ model.move) * model.emit[s[t]]
        for t in range(n - 2, -1, -1):
            b[t] = model.move @ (model.emit[s[t + 1]] * b[t + 1])
        total = a[-1].sum()
        g = a * b / total
        start += g[0]
        for t in range(n):
            emit[s[t]] += g[t]
        for t in range(n - 1):
            move += a[t][:, None] * model.move * (model.emit[s[t + 1]] * b[t + 1])[None, :] / total
    assert np.allclose(counts["start"], start) and np.allclose(counts["move"], move) and np.allclose(counts["emit"], emit)


def test_base_counts_scores_and_held_out_gain(spark):
    rows = [(i, prose(i % 40, 80 + i)) for i in range(90)] + [(200, None), (201, ""), (None, "one two"), (202, "unseenword é")]
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()}
    n, want = brute_base(rows)
    for (d, _), (tokens, known, base) in zip(rows, want, strict=True):
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 20)
    rows = [(i, prose(i, 60)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words_, voc = lm.vocabulary(docs.where(~lm.held_out()))
    model = some_model()
    got = {r.doc_id: r for r in lm.score_documents(docs, words_, voc, model).collect()}
    counts = {r.h: r.c for r in words_.collect()}
    for (d, t), (tokens, known, base) in zip(rows, brute_base(rows)[1], strict=True):
        seq, w, cls, _ = lm.sequences([t.encode()], voc)
        want = likelihood_scaled(model, seq[0]) + sum(math.log10(counts.get(h, 0) + 1) - voc.tail_log[c - lm.OWN - 1] for h, c in zip(w.hash.view(np.int64).tolist(), cls, strict=True) if c > lm.OWN)
        assert (got[d].n_tokens, got[d].n_known) == (tokens, known)
        assert math.isclose(got[d].base_score, base, rel_tol=1e-9) and math.isclose(got[d].score, want, rel_tol=1e-9)


def likelihood_scaled(model, seq):
    a, log = model.start * model.emit[seq[0]], 0.0
    for s in [*seq[1:], None]:
        log += math.log10(a.sum())
        a = a / a.sum()
        if s is not None:
            a = (a @ model.move) * model.emit[s]
    return log


def test_model_is_a_distribution_over_the_next_word(spark):
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(20)], "doc_id long, text string")
    words_, voc = lm.vocabulary(docs)
    by_class = np.zeros(lm.N_CLASSES)
    for r in words_.collect():
        if r.h == int(lm.END.view(np.int64)):
            by_class[0] += 1
            continue
        w = Words([b"x"], tail=True)
        w.hash, w.tail = np.array([r.h], np.int64).view(np.uint64), np.array([r.tail], np.uint32)
        c = int(voc.look_up(w)[0][0])
        by_class[c] += 1 if c <= lm.OWN else 10 ** (math.log10(r.c + 1) - voc.tail_log[c - lm.OWN - 1])
    unknown = 10 ** -voc.tail_log
    assert np.allclose(by_class[lm.OWN + 1 :] + unknown, 1) and set(by_class[: lm.OWN + 1]) <= {0.0, 1.0}


def test_awkward_rows(awkward, empty):
    got = lm.score_texts(awkward, rounds=1).collect()
    assert len(got) == awkward.count() and all(math.isfinite(r.score) for r in got)
    assert lm.score_texts(empty).collect() == []


def test_training_reads_all_texts_and_gains(spark):
    rows = [(i, prose(i % 7, 40 + i)) for i in range(40)] + [(50, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words_, voc = lm.vocabulary(docs)
    encoded = lm.encode(docs, spark.sparkContext.broadcast(voc))
    seqs = lm.sequences([t.encode() for _, t in rows], voc)[0]
    assert math.isclose(voc.share.sum(), 1)
    lines = np.random.default_rng(11).normal(size=(lm.N_CLASSES, lm.STATES))
    emit = np.zeros((lm.N_CLASSES, lm.STATES))
    for s in seqs:  # the longest text too
        state = int(np.argmax(sum(lines[c] for c in s) - len(s) * (voc.share @ lines)))
        n = np.bincount(s, minlength=lm.N_CLASSES)
        emit += (1 - lm.LEAN) / lm.STATES * n[:, None]
        emit[:, state] += lm.LEAN * n
    model = lm.start_model(encoded, voc.share)
    want = lm.Model.of_counts(np.ones(lm.STATES), 1000 * (1 + 100 * np.eye(lm.STATES)), emit)
    assert np.allclose(model.emit, want.emit)
    logs = []
    for _ in range(4):
        counts = lm.empty_counts()
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        log = lm.forward(model, [seqs[i] for i in order], counts).sum()
        own = lm.Model.of_counts(counts["start"], counts["move"], counts["emit"])
        model, got = lm.expected(encoded, model)
        assert math.isclose(got, log, rel_tol=1e-9) and np.allclose(model.move, own.move)
        logs.append(got)
    assert logs == sorted(logs)


def test_long_text_is_scored_whole(spark, longest):
    rows = [(1, longest), (2, prose(3, 40))]
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()}
    assert got[1].n_tokens == len(words(longest)) + 1 and math.isfinite(got[1].score)
