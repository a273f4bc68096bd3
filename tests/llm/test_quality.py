import zlib

import numpy as np

from driftwell.llm import quality

from .conftest import prose


def junk(seed):
    return " | ".join(w.upper() + "!!" for w in prose(seed, 80).split())


def corpus(spark, n=240):
    rows = [(i, junk(i) if i % 4 == 0 else prose(i, 60 + i % 50)) for i in range(n)]
    labels = [(i, 0 if i % 4 == 0 else 1) for i in range(n) if i % 5]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy_and_columns(spark):
    docs, labels, _ = corpus(spark)
    got = quality.classify(docs, labels).collect()
    assert len(got) == 240
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in got if r.held_out]) > 0.97


def test_model_equals_moments_taken_at_once(spark):
    docs, labels, known = corpus(spark)
    model = quality.fit(quality.document_vectors(docs), labels.selectExpr("doc_id", "quality AS label"))
    rows = {r.doc_id: r.text.encode() for r in docs.collect()}
    for k in (0, 1):
        x = quality.features([rows[i] for i, v in known.items() if v == k])
        assert np.allclose(model[k][0] * model["scale"], x.mean(axis=0))
    # Mahalanobis by a plain inverse
    x = quality.features(list(rows.values()))[:5] / model["scale"]
    inv = np.linalg.inv(model[1][1].T @ model[1][1])
    d = ((x - model[1][0]) @ model[1][1].T) ** 2
    assert np.allclose(d.sum(axis=1), [(r - model[1][0]) @ np.linalg.inv(inv) @ (r - model[1][0]) for r in x])


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels, _ = corpus(spark)
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({r.doc_id: round(r.score, 9) for r in quality.classify(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 1), (None, 1), (2, 7), (3, None)], "doc_id long, quality int")
    got = quality.classify(awkward, labels).collect()
    assert len(got) == awkward.count() and {r.score for r in got} == {0.5}  # no two documents of each class
    assert quality.classify(empty, labels).collect() == []
    docs, labels, _ = corpus(spark)
    model = quality.fit(quality.document_vectors(docs), labels.selectExpr("doc_id", "quality AS label"))
    scored = quality.score(quality.document_vectors(awkward), model).collect()
    assert len(scored) == awkward.count() and all(0 <= r.score <= 1 for r in scored)


def test_keep_good(spark, empty):
    docs, labels, _ = corpus(spark)
    kept = [r.doc_id for r in quality.keep_good(docs, labels).collect()]
    want = [r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted]
    assert sorted(kept) == sorted(want)
    assert quality.keep_good(empty, labels).collect() == []


def test_score_equals_log_densities_worked_out_plainly(spark):
    """Prior, shrinkage, log-determinant and Mahalanobis distance from the definition, without Cholesky factors."""
    docs, labels, known = corpus(spark)
    own, share = 0.4, 0.1
    model = quality.fit(quality.document_vectors(docs), labels.selectExpr("doc_id", "quality AS label"), own, share)
    rows = {r.doc_id: r.text.encode() for r in docs.collect()}
    x = {k: quality.features([rows[i] for i, v in known.items() if v == k]) for k in (0, 1)}
    n = {k: len(v) for k, v in x.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    seen = quality.features(list(rows.values()) + [b"", b"one", b"\n \t"])
    logs = []
    for k in (0, 1):
        c = (own * cov[k] + (1 - own - share) * pooled) / np.outer(scale, scale) + (share + 1e-6) * np.eye(len(scale))
        away = (seen - x[k].mean(axis=0)) / scale
        logs.append(np.log(n[k]) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    assert np.allclose(quality.posterior(model, seen), want, atol=1e-6)


def test_keep_good_beside_clashing_columns(spark, awkward):
    docs, labels, _ = corpus(spark)
    rows = docs.selectExpr("doc_id", "text", "'x' AS label", "'y' AS f", "'z' AS score", "'w' AS good", "1 AS quality")
    kept = quality.keep_good(rows, labels)
    assert kept.columns == rows.columns and kept.count() == quality.keep_good(docs, labels).count()
    assert quality.keep_good(awkward, labels).columns == awkward.columns


def test_long_text_is_scored_whole(spark, longest):
    whole = quality.features([longest.encode()])[0]
    assert np.isclose(whole[0], np.log1p(len(longest.encode().split())))
    docs, labels, _ = corpus(spark)
    more = docs.union(spark.createDataFrame([(999, longest)], "doc_id long, text string"))
    got = {r.doc_id: r.score for r in quality.classify(more, labels).collect()}
    assert 0 <= got[999] <= 1
