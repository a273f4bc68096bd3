import random

import numpy as np

from driftwell.llm import decontaminate as dc

from .conftest import prose


def brute_tile(item, doc, least):
    """Greedy string tiling by comparing all places."""
    fi, fd, marked, tiles = [True] * len(item), [x != 0 for x in doc], 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and fi[i + k] and fd[j + k] and item[i + k] == doc[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return marked, tiles
        for x in range(k):
            fi[i + x] = fd[j + x] = False
        marked, tiles = marked + k, tiles + 1


def test_tiles_equal_brute_force():
    r = random.Random(4)
    for _ in range(150):
        a = [r.randint(1, 6) for _ in range(r.randint(3, 25))]
        b = [r.randint(0, 6) for _ in range(r.randint(3, 40))]
        assert dc.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3) == brute_tile(a, b, 3)


def test_whole_cased_and_reordered_passages_are_found_and_clean_ones_left(spark, awkward, empty):
    items = [(k, prose(500 + k, 40).replace("\n", " ")) for k in range(8)] + [(20, "one two three"), (21, None), (22, ""), (23, prose(500, 40).replace("\n", " "))]
    docs = [(k, prose(600 + k, 100)) for k in range(20)]
    w = items[1][1].split()
    docs += [
        (100, prose(700, 50) + " " + items[0][1] + " " + prose(701, 50)), (101, items[2][1].upper().replace(" ", "!! ")), (102, " x ".join(" ".join(p) for p in (w[24:], w[12:24], w[:12]))),
        (103, prose(702, 50) + " " + " ".join(items[3][1].split()[:12])), (104, "we count ONE, two - three."), (105, " ".join(w[::-1])), (106, items[0][1]), (106, items[0][1]),
    ]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.tiles) for r in dc.contaminated(d, benchmark).collect())
    assert got == [(100, 0, 1), (101, 2, 1), (102, 1, 3), (104, 20, 1), (106, 0, 1), (106, 0, 1)]
    kept = dc.decontaminate(d, benchmark)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [*range(20), 103, 105]
    assert dc.decontaminate(awkward, benchmark).count() == awkward.count() and dc.decontaminate(awkward, benchmark).columns == awkward.columns
    assert dc.contaminated(empty, benchmark).collect() == [] and dc.contaminated(d, benchmark.limit(0)).collect() == []


def test_long_texts(spark, longest):
    item = " ".join(longest.split()[350_000:350_040])
    got = dc.contaminated(spark.createDataFrame([(1, longest)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.coverage) for r in got] == [(1, 1.0)]


def brute_report(docs, items, least, coverage):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
    texts = {}
    for i, t in items:
        if t is not None:
            texts[t] = min(i, texts.get(t, i))
    out = []
    for d, t in docs:
        doc = split(t)
        for text, i in texts.items():
            item = split(text)
            if not item:
                continue
            width = min(least, len(item))
            # Words outside runs of ``width`` shared words can't be in a tile.
            seeds = {tuple(item[k : k + width]) for k in range(len(item) - width + 1)}
            inside = [False] * len(doc)
            for k in range(len(doc) - width + 1):
                if tuple(doc[k : k + width]) in seeds:
                    inside[k : k + width] = [True] * width
            marked, tiles = brute_tile(item, [w if on else 0 for w, on in zip(doc, inside, strict=True)], width)
            if marked >= coverage * len(item):
                out.append((d, i, len(item), marked / len(item), tiles))
    return sorted(out)


def test_whole_query_equals_brute_force_with_a_phrase_in_all_items(spark):
    """Few words, so that seeds are shared by chance, and one phrase in every item and in most documents."""
    r = random.Random(9)
    words, phrase = [f"w{k}" for k in range(14)], "this phrase is in every one of all items"
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, f"{some(r.randint(2, 12))} {phrase} {some(r.randint(2, 12))}") for k in range(25)] + [(30, phrase), (31, "w1 w1 w1 w1 w1 w1 w1 w1 w1"), (32, "w1 w2"), (33, None)]
    docs = []
    for k in range(60):
        parts = [r.choice([some(r.randint(1, 20)), phrase, items[r.randrange(25)][1], items[r.randrange(25)][1].split(phrase)[0], "w1 " * r.randint(3, 12)]) for _ in range(r.randint(1, 4))]
        docs.append((k, " ".join(parts)))
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3, 0.5).collect()
    want = brute_report(docs, items, 3, 0.5)
    assert sorted((x.doc_id, x.item_id, x.n_words, x.coverage, x.tiles) for x in got) == want and len(want) > 40


def test_frequent_seeds_make_no_pairs(spark):
    """A phrase of all items and documents is left out of each item's rare seeds."""
    from pyspark.sql import functions as F

    seeds = spark.createDataFrame([(i, 10, 5, h) for i in range(50) for h in (-1, -2, *(100 * i + k for k in range(1, 5)))], "item long, n long, width long, h long")
    held = spark.createDataFrame([(t, h) for t in range(200) for h in (-1, -2)], "t long, h long")
    kept = dc._rare(seeds, held, 0.5)
    assert kept.where(F.col("h") < 0).count() <= 50 * 1 + 50
    assert kept.groupBy("item").count().where("count < 5").isEmpty()
    many = spark.createDataFrame([(i, 40, 5, h) for i in range(50) for h in (-1, -2, *(100 * i + k for k in range(1, 35)))], "item long, n long, width long, h long")
    assert dc._rare(many, held, 0.5).where(F.col("h") < 0).isEmpty()
