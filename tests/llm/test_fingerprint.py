import hashlib

from driftwell.llm import fingerprint as fp

from .conftest import prose


def test_pairs_equal_brute_force(spark, awkward, empty, longest):
    rows = [(r.doc_id, r.text) for r in awkward.collect()] + [(5000 - 7 * k, prose(k, 10 + k)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = []
    for i, (d, t) in enumerate(order):
        n = order[(i + 1) % len(order)][1]
        k = len(t) // 4
        e = t[: len(t) - k] + n[:k]
        a, b, c = (fp.fingerprint(x.encode()) for x in (t, e, n))
        want.append((d is not None, d or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(), fp.likeness(a, b), fp.likeness(a, c)))
    for parts in (1, 3, 16):
        got = [(r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.fingerprints(docs, parts).collect()]
        assert sorted(got) == sorted(want)
    assert fp.fingerprints(empty).collect() == []
    one = fp.fingerprints(spark.createDataFrame([(1, longest)], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_likeness():
    texts = [prose(k, 200).encode() for k in range(30)]
    prints = [fp.fingerprint(t) for t in texts]
    for i, t in enumerate(texts):
        near = fp.fingerprint(t[: len(t) * 3 // 4] + texts[i - 1][: len(t) // 4])
        assert fp.likeness(prints[i], prints[i]) == 1.0
        assert 0 <= fp.likeness(prints[i], prints[i - 1]) < fp.likeness(prints[i], near) <= 1
    assert 0 <= fp.likeness(fp.fingerprint(b""), prints[0]) < 1 and fp.likeness(fp.fingerprint(b""), fp.fingerprint(b"")) == 1.0


def test_pieces_count_like_the_whole(monkeypatch):
    t = prose(1, 500).encode()
    whole = fp.fingerprint(t)
    monkeypatch.setattr(fp, "PIECE", 64)
    assert fp.fingerprint(t) == whole
