import random

import numpy as np

from driftwell.llm import line_dedup as ld

from .conftest import WHITE, prose


def levenshtein(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1]


def edited(r, a, n):
    b = bytearray(a)
    for _ in range(n):
        i = r.randrange(len(b))
        k = r.random()
        if k < 0.33:
            del b[i]
        elif k < 0.66:
            b.insert(i, r.choice(b"abc"))
        else:
            b[i] = r.choice(b"abc")
    return bytes(b)


def test_banded_distance_and_shared_segments():
    r = random.Random(5)
    for e in (1, 2, 3):
        a, b = [], []
        while len(a) < 600:
            x = bytes(r.choice(b"abc") for _ in range(r.randint(9, 40)))
            y = edited(r, x, r.randint(0, e + 2))
            if abs(len(x) - len(y)) <= e and len(y) > e:
                a.append(x)
                b.append(y)
        want = np.array([min(e + 1, levenshtein(x, y)) for x, y in zip(a, b, strict=True)])
        assert (ld.distances(a, b, e) == want).all()
        for x, y, d in zip(a, b, want, strict=True):
            if 0 < d <= e:
                x, y = (x, y) if len(x) >= len(y) else (y, x)
                parity, index, probe = ld.keys(ld.Lines([x, y]), e)
                assert set(probe[0].tolist()) & set(index[1].tolist())
                assert int(parity[0] ^ parity[1]).bit_count() <= 4 * e


def brute(rows, edits, long=0):
    """edits: a number for lines of ``long`` bytes or more, or steps by the shorter line's bytes."""
    steps = ((long, edits),) if isinstance(edits, int) else edits
    lines = []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(WHITE):
                lines.append((d, k, line.strip(WHITE).encode()))
    comp = list(range(len(lines)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (_, _, x) in enumerate(lines):
        for j in range(i):
            y = lines[j][2]
            most = max((e for lo, e in steps if min(len(x), len(y)) >= lo), default=0)
            if x == y or (most and abs(len(x) - len(y)) <= most and levenshtein(x, y) <= most):
                comp[find(i)] = find(j)
    first = {}
    for i, (d, k, _) in enumerate(lines):
        first[find(i)] = min(first.get(find(i), (d, k)), (d, k))
    out = {d: [] for d, _ in rows}
    for i, (d, k, _) in enumerate(lines):
        if first[find(i)] != (d, k):
            out[d].append(k)
    return out


def test_dropped_lines_equal_brute_force(spark):
    r = random.Random(9)
    bases = [bytes(r.choice(b"abcdefgh ") for _ in range(r.randint(18, 60))).strip() for _ in range(12)]
    rows = []
    for d in range(60):
        part = [edited(r, r.choice(bases), r.choice((0, 0, 1, 1, 2, 4))).decode() for _ in range(r.randint(0, 5))] + ["", " short ", "  " + bases[d % 12].decode() + "\t"]
        r.shuffle(part)
        rows.append((d, "\n".join(part)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for edits in (1, 2):
        got = {x.doc_id: list(x.dropped) for x in ld.dropped_lines(docs, edits).collect()}
        assert got == brute(rows, edits, ld.LONG)
    kept = {x.doc_id: x.text for x in ld.dedup_lines(docs).collect()}
    want = brute(rows, 1, ld.LONG)
    for d, t in rows:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d])
        assert kept.get(d) == (left if left.strip(WHITE) else None)


def test_awkward_rows(awkward, empty):
    got = ld.dropped_lines(awkward).collect()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 11, 12)}
    assert by[3].n_lines == 0 and by[4].n_lines == 1 and by[1].n_dropped == by[1].n_lines
    assert [r.n_dropped for r in got if r.doc_id == 11] == [0, 0]
    kept = ld.dedup_lines(awkward)
    assert kept.columns == awkward.columns
    assert 1 not in [r.doc_id for r in kept.collect()] and {3, 4, 5, 6} <= {r.doc_id for r in kept.collect()}
    assert all(r.n_chars == len(r.text or "") for r in kept.collect())
    assert ld.dropped_lines(empty).collect() == [] and ld.dedup_lines(empty).collect() == []


def test_long_texts_keep_their_line_numbers():
    text = "\n".join(prose(i, 40) for i in range(14_000))
    want = [(k, x.strip(WHITE)) for k, x in enumerate(text.split("\n")) if x.strip(WHITE)]
    got = [(int(n), p.buf[s:e].tobytes().decode()) for _, p in ld.lines_of([text.encode()]) for n, s, e in zip(p.number, p.start, p.end, strict=True)]
    assert len(text) > 2 * ld.PIECE and got == want


def test_edits_by_length_equal_brute_force(spark):
    r = random.Random(19)
    bases = [bytes(r.choice(b"abcdefgh ") for _ in range(n)).strip() for n in (6, 9, 10, 11, 14, 38, 39, 40, 41, 43, 60, 78, 79, 80, 82, 83, 120) for _ in range(2)]
    rows = [(d, "\n".join(edited(r, r.choice(bases), r.choice((0, 1, 1, 2, 3, 4))).decode() for _ in range(6))) for d in range(70)]
    rows += [(100 + d, f"{d % 7}\n{'x' * (d % 4)}{d % 3}") for d in range(20)]  # short lines with one edit between them stay apart
    got = {x.doc_id: list(x.dropped) for x in ld.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string"), ld.BY_LENGTH).collect()}
    assert got == brute(rows, ld.BY_LENGTH)


def test_long_lines_equal_plain_distance():
    r = random.Random(12)
    a, b = [], []
    for _ in range(120):
        x = bytes(r.choice(b"abc ") for _ in range(r.choice([60, 520, 700])))
        y = bytearray(x)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(y))
            kind = r.randrange(3)
            if kind == 0:
                y[at] = r.choice(b"abcx")
            elif kind == 1:
                del y[at]
            else:
                y.insert(at, r.choice(b"abcx"))
        a.append(x)
        b.append(bytes(y))
    for edits in (1, 2, 3):
        near = [i for i in range(len(a)) if abs(len(a[i]) - len(b[i])) <= edits]
        got = ld.distances([a[i] for i in near], [b[i] for i in near], edits)
        assert got.tolist() == [min(edits + 1, levenshtein(a[i], b[i])) for i in near]
        assert [ld.within(a[i], b[i], edits) for i in near] == got.tolist()


def test_very_long_lines_take_little_time():
    import time

    x = bytes(random.Random(1).randbytes(10_000_000)).replace(b"\n", b" ")
    y, z = x[:5_000_000] + b"!" + x[5_000_000:], b"#" + x[1:-1] + b"#"
    began = time.perf_counter()
    assert ld.distances([x, x, x], [y, z, x[:-1] + b"?"], 1).tolist() == [1, 2, 1]
    assert ld.distances([x, x], [y, z], 2).tolist() == [1, 2]
    assert time.perf_counter() - began < 5


def test_parity_parts_agree_within_the_edits(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = []
    for e in (1, 2, 3):
        for _ in range(150):
            p = r.getrandbits(64)
            q = p
            for bit in r.sample(range(64), 4 * e):
                q ^= 1 << bit
            rows.append((e, p - (1 << 64) if p >> 63 else p, q - (1 << 64) if q >> 63 else q))
    frame = spark.createDataFrame(rows, "e int, p long, q long")
    for e in (1, 2, 3):
        agree = F.exists(F.zip_with(ld.parity_parts(F.col("p"), e), ld.parity_parts(F.col("q"), e), lambda x, y: x == y), lambda x: x)
        assert frame.where(F.col("e") == e).where(~agree).count() == 0


def test_texts_of_many_lines_are_joined_in_linear_time(spark):
    import time

    rows = [(1, "\n".join(f"line number {k // 2} of the long text" for k in range(40_000)))]
    began = time.perf_counter()
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 0, 10).first()
    assert got.text == "\n".join(f"line number {k} of the long text" for k in range(20_000))
    assert time.perf_counter() - began < 60
