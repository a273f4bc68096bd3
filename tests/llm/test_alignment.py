import hashlib
import os
from collections import Counter

import numpy as np
import pytest

from driftwell.llm import alignment
from driftwell.llm.alignment import CUT, Aligner, Alignment, bytes_of_a, bytes_of_b, coalesced, overlaps

FOLDER = os.environ.get("TEST_TOKENIZERS", "/opt/tokenizers")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no vocabulary files")
SPECIAL = "<|endoftext|> <s> </s> <unk> <0x0A>x"
ODD = ["a  b", "tab\tand\nline ", " leading", "trailing  ", "don't we'll I'm", "x y z", "12 345,67 -- ...", "été Ünï 漢字 𝄞 ok", "▁ piece ▁sign", "ﬁ é", "\x00\x01 nul", SPECIAL, "a" * 300, "x y", " wide space", "end "]


@pytest.fixture(scope="module")
def files():
    return tuple(open(f"{FOLDER}/{n}", "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plainly(text, files, made={}):
    """Whole-text tokens and, walked byte by byte, groups [(A ids, B ids)] and links (a, b); None without tokens."""
    if "a" not in made:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        made["a"], made["b"] = Tokenizer.from_str(files[0].decode()), SentencePieceProcessor(model_proto=files[1])
        made["a"].encode_special_tokens = True
        made["of_a"], made["of_b"] = bytes_of_a(files[0]), bytes_of_b(files[1])
    if not text:
        return None
    a, b = made["a"].encode(f" {text}", add_special_tokens=False).ids, made["b"].encode(text)
    whole = f" {text}".encode()
    if b"".join(made["of_a"][k] for k in a) != whole or b"".join(made["of_b"][k] for k in b) != whole:
        return None
    ends = [{}, {}]
    for side, (ids, of) in enumerate(((a, made["of_a"]), (b, made["of_b"]))):
        at = 0
        for k in ids:
            at += len(of[k])
            ends[side][at] = k
    groups, links, now = [], [], ([], [])
    for at in range(1, len(whole) + 1):
        for side in (0, 1):
            if at in ends[side]:
                now[side].append(ends[side][at])
        if at in ends[0] and at in ends[1]:
            groups.append(now)
            links.append((ends[0][at], ends[1][at]))
            now = ([], [])
    return a, b, groups, links


def brute(rows, files):
    found = [(d, plainly(t, files)) for d, t in rows]
    count = Counter(p for _, f in found if f for p in f[3])
    most = {}
    for (_, b), c in count.items():
        most[b] = max(most.get(b, 0), c)
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), written))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()), key=repr)


def test_equals_whole_text_tokens(spark, files):
    r = np.random.default_rng(5)
    parts = [*ODD, *"the of and to in is was he for it with as his on be at by I this had not are but from or have an they which one you were".split()]
    rows = list(enumerate([*ODD, None, "", " ", "\n", *(" ".join(parts[k] for k in r.integers(0, len(parts), r.integers(1, 60))) for _ in range(80))]))
    rows += [(3, rows[3][1]), (3, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(Alignment(*files).align(docs)) == brute(rows, files)


def test_long_texts_in_parts(spark, files, monkeypatch, longest):
    rows = [(1, longest[:60_000]), (2, " ".join(ODD * 40)), (3, "ok but " * 500 + "▁"), (4, "no" * 3000)]
    monkeypatch.setattr(alignment, "PIECE", 1000)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    assert list(alignment._pieces(rows[0][1])) != [rows[0][1]] and " ".join(alignment._pieces(rows[0][1])) == rows[0][1]
    al = Alignment(*files)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(al.align(frame)) == brute(rows, files)


def test_links_of_the_corpus(spark, files):
    rows = [(k, t) for k, t in enumerate(ODD)]
    found = {(r.a_id, r.b_id): r["count"] for r in Alignment(*files).links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == Counter(p for _, t in rows if (f := plainly(t, files)) for p in f[3])


def test_awkward_rows(files, awkward, empty):
    al = Alignment(*files)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(al.align(awkward)) == brute(rows, files)
    assert al.align(empty).collect() == [] and al.links(empty).collect() == []


def test_coalescing_and_overlaps_of_intervals():
    starts, ends = np.array([0, 2, 5, 0, 3, 5]), np.array([2, 5, 6, 3, 5, 6])
    order, group = coalesced(starts, ends)
    of = dict(zip(order.tolist(), group.tolist(), strict=True))
    assert [of[k] for k in range(6)] == [0, 0, 1, 0, 0, 1]
    i, j = overlaps(starts[:3], ends[:3], starts[3:], ends[3:])
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 2)]


def test_possible_links_bound_what_is_seen(files):
    a = Aligner(*files)
    a.rows(ODD)
    assert (a.pairs[a.links] >> 32 >= 0).all() and len(a.pairs) < 1_000_000
    assert CUT.split("a b  c d ") == ["a", "b  c", "d "]


def test_query_hashes_the_written_groups(spark, files, tmp_path):
    from driftwell.llm import registry

    rows = [(1, "one two"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r.groups_sha256 for r in registry.op12_align_tokenizers(spark, str(tmp_path)).collect()}
    assert out == {1: hashlib.sha256(brute(rows[:1], files)[0][-1].encode()).hexdigest(), 2: "", 3: ""}
