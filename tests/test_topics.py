"""Vocabulary and perplexity of topic models against plain Python and Spark's own figure."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizer

from tickloom.text import topics as P
from tickloom.text.documents import tokens

TEXTS = [f"zz yy xx{i % 4} ww{i % 3}w Mm{i % 5} a " * (1 + i % 3) + (f"solo{i} solo{i} solo{i} solo{i} solo{i} solo{i} solo{i}" if i % 7 == 0 else "") for i in range(40)] + ["", "q", "only once here"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc long, text string").repartition(3, "doc")


@pytest.mark.parametrize("min_df", [1, 2, 3])
@pytest.mark.parametrize("size", [6, 5000])
def test_vocabulary(corpus, min_df, size):
    n, docs = Counter(), Counter()
    for t in TEXTS:
        w = [x for x in t.lower().split() if len(x) > 1]
        n.update(w)
        docs.update(set(w))
    want = sorted((w for w in n if docs[w] >= min_df), key=lambda w: (-n[w], w))[:size]
    m, d = P.count_vectors(corpus, vocabulary=size, min_df=min_df)
    if min_df < 3:  # words of equal count came as the tasks ended
        assert m.vocabulary == want
    assert [n[w] for w in m.vocabulary] == [n[w] for w in want]
    for r in d.select("doc", "counts").collect():
        c = Counter(TEXTS[r.doc].lower().split())
        assert {m.vocabulary[i]: v for i, v in zip(r.counts.indices, r.counts.values)} == {w: c[w] for w in m.vocabulary if c[w]}


def test_one_partition_keeps_the_order_of_the_vectorizer(corpus):
    one = corpus.coalesce(1)
    own = CountVectorizer(inputCol="t", outputCol="c", minDF=2).fit(one.select(tokens("text", 2).alias("t")))
    assert P.count_vectors(one)[0].vocabulary == own.vocabulary
    assert set(P.count_vectors(corpus)[0].vocabulary) == set(own.vocabulary)


def test_no_word_is_an_error(spark):
    with pytest.raises(ValueError, match="min_df"):
        P.count_vectors(spark.createDataFrame([("aa bb",), ("cc",)], "text string").repartition(2))


@pytest.mark.parametrize("cut", [5, 400_000])
def test_perplexity_is_that_of_the_models(spark, corpus, monkeypatch, cut):
    monkeypatch.setattr("tickloom.text.counting.WORDS", cut)
    d = P.count_vectors(corpus)[1].select("counts").localCheckpoint()
    models = [LDA(k=k, maxIter=4, seed=3, featuresCol="counts", **kw).fit(d) for k, kw in ((2, {}), (3, {"topicConcentration": 0.7}), (4, {"docConcentration": [0.1, 0.5, 1.0, 2.0]}))]
    assert np.allclose(P.log_perplexity(models, d), [m.logPerplexity(d) for m in models], rtol=1e-6)


def test_topic_counts_do_not_ask_the_model_for_every_document(spark, corpus, monkeypatch):
    """Before, each document took the exponential of all of vocabulary x topics."""
    for kind in (LDAModel, LocalLDAModel):
        monkeypatch.setattr(kind, "logPerplexity", lambda *a: pytest.fail("logPerplexity was called"))
    rows = P.choose_topics(corpus, [2, 4], 3).orderBy("k").collect()
    assert [r.k for r in rows] == [2, 4] and all(0 < r.log_perplexity < 20 for r in rows)


def test_gamma_functions():
    x = np.array([1e-3, 0.25, 0.5, 1.0, 3.7, 8.0, 500.0, 1e7])
    assert np.allclose(P.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
    assert np.allclose(P.digamma(np.array([0.5, 1.0, 10.0])), [-1.9635100260214235, -0.5772156649015329, 2.251752589066721], rtol=1e-12)
    assert np.allclose(P.digamma(x + 1) - P.digamma(x), 1 / x, rtol=1e-9)
