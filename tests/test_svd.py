"""Sparse truncated SVD and LSI against NumPy."""

import numpy as np
import pytest

from tickloom.core import svd as S
from tickloom.text import terms as T
from tickloom.text import topics as P


def matrix(spark, x):
    cells = [(int(i), f"t{j:03d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return spark.createDataFrame(cells, "doc long, term string, weight double").repartition(5)


def test_both_sides_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(S, "CELLS", 50)
    r = np.random.default_rng(2)
    x = (r.normal(size=(150, 6)) * [9, 7, 5, 3, 2, 1] @ r.normal(size=(6, 60)) + r.normal(size=(150, 60)) * 0.3) * (r.random((150, 60)) < 0.3)
    values, columns, rows = S.truncated_svd(matrix(spark, x), "doc", 4)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values.orderBy("component").toPandas().value, s[:4])
    v = vt[:4].T * np.sign(vt[:4].T[np.abs(vt[:4].T).argmax(axis=0), range(4)])
    got = columns.toPandas().pivot(index="term", columns="component", values="weight").sort_index()
    assert np.allclose(got, v, atol=1e-4)
    place = rows.toPandas().pivot(index="doc", columns="component", values="weight").sort_index()
    assert np.allclose(place, (x @ v)[place.index], atol=1e-3)


def test_small_empty_and_null(spark):
    one = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (None, "b", 1.0)], "doc long, term string, weight double")
    values, columns, rows = S.truncated_svd(one, "doc", 3)
    assert [(r.component, round(r.value, 9)) for r in values.collect()] == [(0, 2.0)]
    assert [tuple(r) for r in rows.collect()] == [(1, 0, 2.0)]
    assert [d.count() for d in S.truncated_svd(one.limit(0), "doc", 3)] == [0, 0, 0]


def test_too_many_columns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_COLUMNS", 2)
    with pytest.raises(ValueError):
        S.truncated_svd(spark.createDataFrame([(1, t, 1.0) for t in "abc"], "doc long, term string, weight double"), "doc", 1)


def test_lsi_words_documents_and_ratio(spark):
    texts = ["rates bank loan bank", "bank rates money", "goal match team", "team goal player match", "loan money rates", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    topics, words, documents = P.lsi(df, "doc", 2, ngrams=(1, 1), min_df=1, max_df=1.0)
    cells = T.tfidf(df, "doc", ngrams=(1, 1), max_df=1.0).toPandas().pivot(index="doc", columns="term", values="weight").reindex(range(7)).fillna(0.0)
    _, s, vt = np.linalg.svd(cells.to_numpy(), full_matrices=False)
    t = topics.orderBy("component").toPandas()
    assert np.allclose(t.value, s[:2])
    x = cells.to_numpy() @ vt[:2].T
    assert np.allclose(t.ratio, x.var(axis=0) / cells.to_numpy().var(axis=0).sum(), atol=1e-6)
    top = P.lsi_words(words, 3).toPandas()
    assert set(top[top.component == 0].term) <= {"rates", "bank", "loan", "money"} and set(top[top.component == 1].term) <= {"goal", "match", "team", "player"}
    d = documents.toPandas()
    assert len(d) == 14 and (d[d.doc >= 5].weight == 0).all()
