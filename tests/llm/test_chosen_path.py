import numpy as np
import pytest

from driftwell.llm import chosen_path
from driftwell.llm.chosen_path import minwise, near_duplicates, trees_for

from .conftest import prose
from .test_jaccard_join import brute


def rows_of(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect())


def grouped(groups, copies, words_of=110):
    rows, k = [], 0
    for g in range(groups):
        base = prose(300 + g, words_of + 10 * g).split(" ")
        for c in range(copies):
            w = list(base)
            for e in range(c % 5):
                w[(e * 17 + c * 3) % len(w)] = f"x{g}{c}{e}"
            rows.append((k := k + 1, " ".join(w)))
            if c % 6 == 0:
                rows.append((k := k + 1, " ".join(w).upper()))
    return rows + [(k + i, t) for i, t in enumerate(("", " ", "one", "ONE", "one two", None), 1)]


@pytest.mark.parametrize(("width", "similarity"), [(4, (80, 100)), (3, (90, 100))])
def test_components_equal_brute_force(spark, width, similarity):
    rows = grouped(5, 22)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, similarity)
    assert rows_of(found) == brute(rows, width, *similarity)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


@pytest.mark.parametrize("depth", [1])
def test_large_nodes_of_many_components(spark, monkeypatch, depth):
    """A passage that all documents share makes nodes that hubs don't settle; what is in them to the end is joined exactly."""
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    monkeypatch.setattr(chosen_path, "DEPTH", depth)
    shared, rows = prose(9, 60).replace("\n", " ").split(" "), []
    for g in range(40):
        own = prose(500 + g, 30).replace("\n", " ").split(" ")
        rows += [(3 * g, " ".join(shared + own)), (3 * g + 1, " ".join([*shared, *own[:-1], f"new{g}"])), (3 * g + 2, " ".join([*shared[:40], *own, "q", *own[::-1]]))]
    assert rows_of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)) == brute(rows, 4, 80, 100)


def test_awkward_rows(awkward, empty):
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(awkward, 4).collect())
    assert len(got) == awkward.count()
    by = {d: (c, kept) for d, _, c, kept in got if d not in (-1, 11, 12)}
    assert by[1] == (0, False) and by[2] == (0, False) and by[0] == (0, True) and by[8] == (7, False) and by[3] == (3, True) and by[5] == (5, True)
    assert [x[2:] for x in got if x[0] == 11] == [(11, True), (11, True)]
    assert [x[2:] for x in got if x[0] == -1] == [(None, False), (None, False)]
    assert near_duplicates(empty).collect() == []


def test_minwise_tokens_agree_as_often_as_sets_do():
    r = np.random.default_rng(8)
    common, a, b = (r.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
    sig = minwise(np.concatenate([common, a, common, b]), np.array([0, 900]), 400)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.08
    assert len(np.unique(sig[0])) > 200


def test_trees_meet_the_stated_recall():
    assert trees_for(0.8) == 12 and trees_for(0.5) == 27 and trees_for(1.0) == 1
    assert 0.2 ** trees_for(0.8) <= chosen_path.MISS


def test_long_texts_are_read_whole(spark, longest):
    changed = longest[:-9] + " changed"
    other = longest[: len(longest) // 2]
    rows = [(1, longest), (2, changed), (3, other)]
    assert rows_of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)) == brute(rows, 4, 80, 100)
