import numpy as np
import pytest

from driftwell.llm import jaccard_join
from driftwell.llm._words import Words, shingles

from .conftest import prose, words


def sets_of(rows, width):
    out = []
    for _, t in rows:
        w = words(t)
        out.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    return out


def brute(rows, width, at_least, of):
    sets = sets_of(rows, width)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and of * len(sets[i] & sets[j]) >= at_least * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "similarity"), [(3, (90, 100)), (5, (80, 100))])
def test_components_equal_brute_force(spark, width, similarity):
    rows, k = [], 0
    for g in range(6):  # groups of near copies with one to many edits, some larger than FEW
        base = prose(100 + g, 90 + 10 * g).split(" ")
        for c in range(14):
            w = list(base)
            for e in range(c % 5):
                w[(e * 17 + c * 3) % len(w)] = f"x{g}{c}{e}"
            rows.append((k := k + 1, " ".join(w)))
            if c % 6 == 0:
                rows.append((k := k + 1, " ".join(w).upper()))
    rows += [(k + i, t) for i, t in enumerate(("", " ", "one", "ONE", "one two", None), 1)]
    got = jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), width, similarity).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, width, *similarity)


def test_awkward_rows(awkward, empty):
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id) for r in jaccard_join.link_documents(awkward, 3, (90, 100)).collect())
    assert len(got) == awkward.count()
    by = {d: c for d, _, c in got if d not in (-1, 11, 12)}
    assert by[1] == 0 and by[2] == 0 and by[8] == 7 and by[6] == 6 and by[3] == 3 and by[5] == 5
    assert [c for d, _, c in got if d == 11] == [11, 11]
    assert [c for d, _, c in got if d == -1] == [None, None]
    assert jaccard_join.link_documents(empty).collect() == []


def test_one_of_each_keeps_columns_and_clean_rows(awkward, empty):
    kept = jaccard_join.one_of_each(awkward, 3, (90, 100))
    assert kept.columns == awkward.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, -1, 0, 3, 4, 5, 6, 7, 9, 10, 11, 12, 12]
    assert jaccard_join.one_of_each(empty).collect() == []


def test_one_of_each_parts_rows_that_share_an_id(spark):
    near = prose(44, 60).replace("\n", " ").split(" ")
    other = [*near[:-1], "changed"]
    rows = [(1, prose(40, 60)), (None, prose(40, 60)), (None, prose(41, 60)), (None, None), (2, prose(42, 60)), (3, prose(42, 60)), (3, prose(43, 60)), (4, " ".join(near)), (4, " ".join(other))]
    kept = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 3, (90, 100)).collect()]
    assert len(kept) == 6 and set(kept[:]) >= {rows[k] for k in (0, 2, 3, 4, 6)}
    assert sum(d == 4 for d, _ in kept) == 1


def test_suffix_bound_never_exceeds_the_difference(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    pairs = [tuple(np.unique(r.integers(0, 60, r.integers(1, 40))).tolist() for _ in "ab") for _ in range(300)]
    rows = spark.createDataFrame(pairs, "x array<long>, y array<long>").select("x", "y", jaccard_join.suffix_bound(F.col("x"), F.col("y")).alias("b")).collect()
    assert all(0 <= q.b <= len(set(q.x) ^ set(q.y)) for q in rows) and any(q.b > abs(len(q.x) - len(q.y)) for q in rows)


def test_long_texts_are_read_whole(longest):
    w = Words([longest.encode()])
    assert len(w.hash) == len(longest.split())
    d, h = shingles(w, 1, 3)
    v = longest.split()
    assert len(h) == len(set(zip(v, v[1:], v[2:], strict=False))) and set(d) == {0}
