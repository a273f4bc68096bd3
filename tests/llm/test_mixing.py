import hashlib

from driftwell.llm import mixing

from .conftest import words


def brute(rows, weights=(5, 2, 1), most=3):
    size = {}
    for _, s, n in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        free = sum(w[s] for s in order if s not in capped)
        level = (total - sum(most * size[s] for s in capped)) / free if free else 0
        new = {s for s in order if s not in capped and w[s] * level >= most * size[s]}
        if not new:
            break
        capped |= new
    target = {s: most * size[s] if s in capped else w[s] * level for s in order}
    out = []
    for s in order:
        budget, at = round(target[s]), 0
        mine = sorted((hashlib.md5(f"17:{'' if i is None else i}".encode()).hexdigest()[:16], i is None, i or 0, n) for i, t, n in rows if t == s)
        epochs = budget // size[s] if size[s] else 0
        for _, none, i, n in mine:
            part = max(0, min(n, budget - epochs * size[s] - at))
            out.append((None if none else i, n, size[s], round(target[s], 6), epochs * n + part))
            at += n
    return out


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def test_mix_equals_brute_force(spark, awkward):
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_sources(awkward).collect()]
    want = brute([(r.doc_id, r.source, len(words(r.text))) for r in awkward.collect()])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_many_sources_meet_their_budgets(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 9}") for i in range(500)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in taken)
    assert abs(sum(target.values()) - sum(len(t.split()) for _, t, _ in rows)) < 1e-6


def test_ranks_by_ranges(spark):
    names = [f"s{i * 7 % 50:02}" for i in range(50)]
    by = spark.createDataFrame([(s,) for s in names] + [(None,)], "source string")
    assert {r.source: r["rank"] for r in mixing._rank(by).collect()} == {s: i for i, s in enumerate([*sorted(names), None])}


def test_mixed_documents_are_those_taken(awkward, empty):
    got = mixing.mixed_documents(awkward)
    assert set(got.columns) == {*awkward.columns, "source_size", "target", "taken"}
    want = sorted(((r.doc_id, r["size"], r.taken) for r in mixing.mix_sources(awkward).where("taken > 0").collect()), key=key)
    rows = got.collect()
    assert sorted(((r.doc_id, r["size"], r.taken) for r in rows), key=key) == want and all(len(words(r.text)) == r["size"] for r in rows)
    assert mixing.mixed_documents(empty).collect() == []


def test_long_text_is_counted_whole(spark, longest):
    docs = spark.createDataFrame([(1, longest, "a"), (2, "w", "a")], "doc_id long, text string, source string")
    assert {r.doc_id: r["size"] for r in mixing.mix_sources(docs).collect()} == {1: len(words(longest)), 2: 1}


def test_empty(empty):
    assert mixing.mix_sources(empty).collect() == []
