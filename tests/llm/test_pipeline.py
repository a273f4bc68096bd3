import corpus_pipeline
from driftwell.llm import mixing, quality
from driftwell.llm._shared import materialize

from .conftest import prose


def junk(seed):
    return " ".join(w.upper() + "###" for w in prose(seed, 80).split())


def test_stages(spark, tmp_path):
    item = prose(900, 40).replace("\n", " ")
    base = prose(901, 120).replace("\n", " ").split(" ")
    near = list(base)
    near[50] = "changed"
    rows = [(k, junk(k) if k % 5 == 0 else prose(k, 90), f"s{k % 4}") for k in range(160)]
    rows += [(200, " ".join(base), "s1"), (201, " ".join(near), "s2"), (202, prose(1, 90), "s1"), (203, prose(903, 30) + "\n" + item, "s0"), (204, None, None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialize(stage(spark, at, str(tmp_path)))
        assert at.columns == docs.columns, name
        kept.append({r.doc_id for r in at.collect()})
    clean = {k for k in range(160) if k % 5}
    assert clean <= kept[0] and not kept[0] & {k for k in range(160) if k % 5 == 0}
    assert kept[0] - kept[1] == {202}
    assert kept[1] - kept[2] == {201}
    assert kept[2] - kept[3] == {203}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    mix = {r.doc_id: r.taken for r in mixing.mix_sources(at).collect()}
    assert set(mix) == kept[3]
    assert {r.doc_id: r.taken for r in got} == {d: n for d, n in mix.items() if n}
    texts = {r.doc_id: r.text for r in at.collect()}
    assert all(r.text == texts[r.doc_id] for r in got)
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[r.source] - r.target) <= 0.5 for r in got)
    assert quality.FEATURES


def written(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (2, 1, 0), (9, 0, 1), (11, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one passage of eight words that nobody has"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_bear_awkward_and_no_rows(spark, tmp_path, awkward, empty):
    """Nulls, repeated rows and clashing columns go through every stage but the mix with the columns they came with; an empty table stays one."""
    for name, docs in (("awkward", awkward), ("empty", empty)):
        (tmp_path / name).mkdir()
        sf = written(spark, tmp_path / name, docs)
        for stage, f in corpus_pipeline.STAGES:
            out = materialize(f(spark, docs, sf))
            if stage != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, stage
            assert out.count() <= docs.count()
            docs = out
        assert docs.count() == 0 if name == "empty" else docs.count() > 3
