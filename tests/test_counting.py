"""Counts made inside a document's row against plain Python, with keys that repeat or are null."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.core import svd
from tickloom.text import counting, terms as T
from tickloom.text import topics as P

TEXTS = [(1, "aa bb aa bb cc"), (2, "bb cc"), (1, "aa bb"), (None, "cc cc"), (None, "dd"), (3, None), (4, ""), (5, "ee"), (6, "aa dd ee " * 9)]


def counted(low, high):
    c = defaultdict(Counter)
    for k, t in TEXTS:
        w = (t or "").split()
        for n in range(low, high + 1):
            c[k].update(" ".join(w[i:i + n]) for i in range(len(w) - n + 1))
    return c


@pytest.mark.parametrize("high", [1, 2, 3])
def test_terms_and_totals(spark, monkeypatch, high):
    monkeypatch.setattr(counting, "WORDS", 4)
    df, want = spark.createDataFrame(TEXTS, "doc long, text string").coalesce(1), counted(1, high)
    assert {(r.doc, r.term): r.n for r in T.terms(df, "doc", ngrams=(1, high)).collect()} == {(k, g): n for k, c in want.items() for g, n in c.items()}
    total, docs = sum(want.values(), Counter()), Counter(g for c in want.values() for g in c)
    assert {r.term: (r.total, r.df) for r in T.totals(df, "doc", ngrams=(1, high)).collect()} == {g: (n, docs[g]) for g, n in total.items()}


def test_a_document_is_counted_without_a_shuffle(spark):
    """Before, every word and pair of words of the corpus was shuffled, twice."""
    df = spark.createDataFrame([(i, f"w{i % 3}x yy zz") for i in range(20)], "doc long, text string")
    plan = T.tfidf(df, "doc", max_df=1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert T.tfidf(df, "doc", max_df=1.0).groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("s")).where("abs(s - 1) > 1e-9").isEmpty()


@pytest.mark.parametrize("most", [2, 4, 1000])
def test_document_vectors_of_frequent_and_rare_words(spark, monkeypatch, most):
    monkeypatch.setattr(T, "MOST_VALUES", most)
    vectors = [("aa", [1.0, 2.0]), ("bb", [3.0, None]), ("bb", [1.0, 1.0]), ("dd", None), ("ee", [5.0, -1.0])]
    v = spark.createDataFrame(vectors, "word string, vector array<float>")
    df = spark.createDataFrame(TEXTS, "doc long, text string")
    got = {r.doc: r.vector for r in T.document_vectors(df, v, "doc", 2).collect()}
    for k in (1, 2, 3, 4, 5, 6):
        rows = [x for d, t in TEXTS if d == k for w in (t or "").split() for n, x in vectors if n == w]
        some = [[x[i] for x in rows if x is not None and x[i] is not None] for i in range(2)]
        want = [sum(s) / len(rows) if s else None for s in some] if rows else [0.0, 0.0]
        assert [None if x is None else round(x, 9) for x in got[k]] == [None if x is None else round(x, 9) for x in want], k
    assert got[None] == [0.0, 0.0]


def test_risk_sentiment_with_few_and_many_near_words(spark, monkeypatch):
    v = spark.createDataFrame([("aa", [1.0, 0.0]), ("bb", [1.0, 0.1]), ("cc", [0.0, 1.0])], "word string, vector array<double>")
    df = spark.createDataFrame([(1, "aa bb cc cc"), (2, "cc"), (3, None), (1, "aa")], "doc long, text string")
    few = sorted(map(tuple, T.risk_sentiment(df, v, v.where("word = 'aa'"), "doc").collect()))
    monkeypatch.setattr(T, "MOST_WORDS", 1)
    assert few == sorted(map(tuple, T.risk_sentiment(df, v, v.where("word = 'aa'"), "doc").collect()))
    assert np.allclose([r[1] for r in few], [(2 + 1 / np.sqrt(1.01)) / 5] * 2 + [0, 0])


def test_word_vectors_train_bounded_partitions(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(P, "Word2Vec", lambda **kw: seen.append(kw["numPartitions"]) or type("M", (), {"fit": lambda self, d: None})())
    df = spark.createDataFrame([("a b c d e f",)] * 10, "text string")
    P.word2vec(df)
    monkeypatch.setattr(P, "WORDS_PER_PARTITION", 7)
    P.word2vec(df)
    assert seen == [4, 9]


def test_a_flat_spectrum_needs_few_rounds(spark):
    """Subspace iteration without the earlier blocks needs more than 30 rounds here."""
    r = np.random.default_rng(7)
    x = np.linalg.qr(r.normal(size=(160, 120)))[0] * np.linspace(1.0, 0.5, 120) @ np.linalg.qr(r.normal(size=(120, 120)))[0]
    cells = spark.createDataFrame([(int(i), f"t{j:03d}", float(x[i, j])) for i in range(160) for j in range(120)], "doc long, term string, weight double")
    values, _, _ = svd.truncated_svd(cells, "doc", 3, rounds=20)
    assert np.allclose([v.value for v in values.orderBy("component").collect()], np.linalg.svd(x, compute_uv=False)[:3])
