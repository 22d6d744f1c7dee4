"""Topic tables (doc, topic, weight) and the spark.ml models that produce them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.slices import over_rows, spread
from ..core.svd import decompose, packed
from ..session import durable
from .counting import slices
from .documents import tokens
from .terms import idf, weights

C = F.col


def count_vectors(df: DataFrame, text: str = "text", vocabulary: int = 5000, min_df: int = 2):
    """(model, documents with sparse ``counts`` of the most frequent words of at least ``min_df`` documents).

    Words of equal count come in order in a corpus of several partitions, where ``CountVectorizer`` leaves them, and which of them are last in, to the task
    that ends first; in one partition they come as it has them.
    """
    d = df.withColumn("tokens", tokens(text, 2))
    if min_df > 2 or df.rdd.getNumPartitions() < 2:
        m = CountVectorizer(inputCol="tokens", outputCol="counts", vocabSize=vocabulary, minDF=min_df).fit(d)
    else:
        m = CountVectorizerModel.from_vocabulary(frequent_words(d, "tokens", vocabulary, min_df), "tokens", "counts")
    return m, m.transform(d)


def frequent_words(d: DataFrame, words: str, most: int, min_df: int) -> list[str]:
    """The ``most`` words with the highest counts, ties by word. ``min_df`` is 2 at most: a word of two documents has a first and a last one."""
    w = d.select(F.monotonically_increasing_id().alias("_d"), words).select("_d", F.explode(words).alias("word"))
    g = w.groupBy("word").agg(F.count("*").alias("n"), F.min("_d").alias("first"), F.max("_d").alias("last"))
    top = [r.word for r in g.where(C("first") < C("last") if min_df > 1 else F.lit(True)).orderBy(F.desc("n"), "word").limit(most).collect()]
    if not top:
        raise ValueError("no word is in enough documents: lower min_df")
    return top


def lda(df: DataFrame, k: int = 10, iterations: int = 15, seed: int = 3, **kw):
    """(model, vocabulary, transformed documents with a ``topics`` array)."""
    cv, d = count_vectors(df, **kw)
    d = durable(d.drop("tokens"))
    m = LDA(k=k, maxIter=iterations, seed=seed, featuresCol="counts").fit(d)
    return m, cv.vocabulary, m.transform(d).withColumn("topics", vector_to_array("topicDistribution")), d


def topic_words(model, vocabulary: Sequence[str], n: int = 10) -> DataFrame:
    t = model.describeTopics(n)
    words = F.array(*[F.lit(w) for w in vocabulary])
    t = t.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "z"))
    v = t.sparkSession.createDataFrame([(i, w) for i, w in enumerate(vocabulary)], "i int, word string")  # at most the vocabulary size
    return t.join(F.broadcast(v), C("z.termIndices") == C("i")).select("topic", "place", "word", C("z.termWeights").alias("weight"))


def lsi(df: DataFrame, key: str, k: int = 10, text: str = "text", max_features: int = 10_000, ngrams: tuple[int, int] = (1, 2), min_df: int = 2, max_df: float = 0.8):
    """Truncated SVD of the tf-idf rows of a corpus: (topics, words, documents).

    ``topics`` is (component, value, ratio) with the share of the variance of the columns, over all documents; ``words`` (component, term,
    weight); ``documents`` (key, component, weight) for every document, 0 where it holds no term of the vocabulary.
    Documents without a key take no part. Stop words stay in unless ``max_df`` takes them.
    """
    keyed = df.where(C(key).isNotNull())
    known = idf(keyed, key, text, max_features, ngrams, min_df, max_df)
    cells = packed(weights(keyed, key, known, text, ngrams), key, sorted(known))  # every term of the vocabulary is in some document
    values, words, rows = decompose(cells, key, sorted(known), k)
    rows = durable(rows)
    every = df.where(C(key).isNotNull()).select(key).distinct()
    documents = every.join(values.select("component")).join(rows, [key, "component"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))  # k rows
    size = every.agg(F.count("*").alias("_n"))
    spread_of = lambda d, by, v: d.groupBy(by).agg(F.sum(v).alias("_s"), F.sum(C(v) * C(v)).alias("_q")).join(F.broadcast(size)).select(by, (C("_q") / C("_n") - C("_s") * C("_s") / C("_n") / C("_n")).alias("_var"))
    each = cells.select(F.explode(F.arrays_zip("at", "cell")).alias("_z")).select(C("_z.at").alias("at"), C("_z.cell").alias("weight"))
    total = spread_of(each, "at", "weight").agg(F.sum("_var").alias("_total"))
    own = spread_of(rows, "component", "weight")
    topics = values.join(own, "component").join(F.broadcast(total)).select("component", "value", (C("_var") / C("_total")).alias("ratio"))
    return topics, words, documents


def lsi_words(words: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` terms of largest absolute weight per component, with their sign."""
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("weight")), "term")
    return words.withColumn("place", F.row_number().over(w) - 1).where(C("place") < n).select("component", "place", "term", "weight")


def choose_topics(df: DataFrame, ks: Sequence[int], iterations: int = 5) -> DataFrame:
    """Perplexity per number of topics on one shared matrix."""
    _, d = count_vectors(df)
    d = durable(d.select("counts"))
    values = log_perplexity([LDA(k=k, maxIter=iterations, seed=3, featuresCol="counts").fit(d) for k in ks], d)
    return df.sparkSession.createDataFrame([(int(k), v) for k, v in zip(ks, values)], "k int, log_perplexity double")


def log_perplexity(models: Sequence, d: DataFrame, counts: str = "counts") -> list[float]:
    """What ``logPerplexity`` of each LDA model says of all documents, from one pass for all models.

    The models infer the topics of a document, and its part of the bound follows from them: gamma adds up to the prior and the words of the document.
    ``logPerplexity`` itself takes the exponential of a whole table of vocabulary x topics for every document.
    """
    priors, tables, out = [], [], []
    for m in models:
        lam = m.topicsMatrix().toArray()  # vocabulary x topics
        priors.append(np.array(m.estimatedDocConcentration().toArray()))
        tables.append(digamma(lam) - digamma(lam.sum(0)))
    x = d.select(counts)
    for i, m in enumerate(models):
        x = m.copy().setFeaturesCol(counts).setTopicDistributionCol(f"_t{i}").transform(x)
    sparse = F.unwrap_udt(counts)  # count_vectors makes sparse vectors only
    x = x.select(sparse["indices"].alias("at"), sparse["values"].alias("n"), *[vector_to_array(f"_t{i}").alias(f"_t{i}") for i in range(len(models))])

    names = ["_n"] + [f"_b{i}" for i in range(len(models))]

    def run(batches):
        total = np.zeros(len(names))
        for batch in batches:
            for first, last in slices(batch.column(0)):
                part = batch.slice(first, last - first)
                row, at, n = cells(part.column(0), part.column(1))
                total[0] += n.sum()
                words = np.bincount(row, n, part.num_rows)
                some = np.bincount(row, minlength=part.num_rows) > 0  # a document without words has no topics
                for i, (prior, table) in enumerate(zip(priors, tables)):
                    share = part.column(2 + i).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(prior))
                    total[1 + i] += documents_bound(row, at, n, share, words, some, prior, table)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names)

    n, *bounds = x.mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    for m, prior, table, bound in zip(models, priors, tables, bounds):
        lam, k = m.topicsMatrix().toArray(), len(prior)
        eta = m.getTopicConcentration() if m.isSet("topicConcentration") else 1.0 / k
        bound += ((eta - lam) * table).sum() + (lgamma(lam) - lgamma(eta)).sum() + (lgamma(eta * len(lam)) - lgamma(lam.sum(0))).sum()
        out.append(float(-bound / n))
    return out


def cells(at: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, value) of the lists of sparse vectors."""
    length = pc.list_value_length(at).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(at)), length), at.flatten().to_numpy(zero_copy_only=False), n.flatten().to_numpy(zero_copy_only=False)


def documents_bound(row, at, n, share, words, some, prior, table) -> float:
    """The documents' part of the variational bound: words given topics, and topics given the prior."""
    gamma = share[some] * (prior.sum() + words[some])[:, None]
    theta = np.zeros(share.shape)
    theta[some] = digamma(gamma) - digamma(gamma.sum(1))[:, None]
    likely = theta[row, 0] + table[at, 0]
    for k in range(1, len(prior)):
        likely = np.logaddexp(likely, theta[row, k] + table[at, k])
    own = ((prior - gamma) * theta[some]).sum() + (lgamma(gamma) - lgamma(prior)).sum()
    return float((n * likely).sum() + own + some.sum() * float(lgamma(prior.sum())) - lgamma(gamma.sum(1)).sum())


def _raised(x, step) -> tuple[np.ndarray, np.ndarray]:
    """x moved up to 8 and more, and the sum of ``step`` over the values passed by."""
    x = np.array(x, float)
    passed = np.zeros(x.shape)
    while (low := x < 8).any():
        passed[low] += step(x[low])
        x[low] += 1
    return x, passed


def digamma(x) -> np.ndarray:
    x, passed = _raised(x, lambda v: 1 / v)
    q = 1 / (x * x)
    return np.log(x) - 0.5 / x - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q * (1 / 132 - q * (691 / 32760 - q / 12)))))) - passed


def lgamma(x) -> np.ndarray:
    x, passed = _raised(x, np.log)
    q = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q * (1 / 1680 - q * (1 / 1188 - q * 691 / 360360))))) / x - passed


WORDS_PER_PARTITION = 10_000_000


def word2vec(df: DataFrame, text: str = "text", size: int = 100, window: int = 5, least: int = 5, iterations: int = 1, partitions: int = 4):
    """Skip-gram word vectors of all words. ``partitions`` are trained side by side; a corpus of more than WORDS_PER_PARTITION words in each gets more of them,
    so that one holds and trains a bounded number of words however large the corpus."""
    d = df.select(tokens(text).alias("tokens"))
    words = d.agg(F.sum(F.size("tokens"))).first()[0] or 0
    partitions = max(partitions, -(-words // WORDS_PER_PARTITION))
    return Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=iterations, seed=3, numPartitions=partitions, inputCol="tokens", outputCol="v").fit(d)


def coherence(top: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """UMass coherence per topic from co-document counts of its top words (topic, place, word); docs is (key, term)."""
    w = docs.withColumnRenamed("term", "word").join(F.broadcast(top.select("word").distinct()), "word").select(key, "word").distinct()
    w = durable(w)
    single = w.groupBy("word").agg(F.count("*").alias("_d"))
    # top words only: at most topics * n per document
    a = top.join(w, "word").select("topic", key, "place", "word")
    b = a.select("topic", key, C("place").alias("_pj"), C("word").alias("_wj"))
    co = a.join(b, ["topic", key]).where(C("_pj") < C("place")).groupBy("topic", "word", "_wj").agg(F.count("*").alias("_co"))
    t2 = top.select("topic", C("place").alias("_pj"), C("word").alias("_wj"))
    pairs = top.select("topic", "place", "word").join(t2, "topic").where(C("_pj") < C("place"))
    j = pairs.join(co, ["topic", "word", "_wj"], "left").join(single.withColumnRenamed("word", "_wj"), "_wj")
    return j.groupBy("topic").agg(F.avg(F.log((F.coalesce("_co", F.lit(0)) + 1) / C("_d"))).alias("coherence"))


def dominant(weights: DataFrame, key: str) -> DataFrame:
    """Largest topic per document (the lowest number among equals)."""
    g = weights.groupBy(key).agg(F.max(F.struct("weight", (-C("topic")).alias("_t"))).alias("m"))
    return g.select(key, (-C("m._t")).alias("topic"), C("m.weight").alias("weight"))


def trends(weights: DataFrame, order: str, at: float = 0.1, bin: Column | None = None) -> DataFrame:
    """Correlation of a topic's weight with its position; its direction and average, largest and smallest weight."""
    b = bin if bin is not None else F.floor(C(order) / 10_000)
    d = spread(weights, keys=["topic"], order=[order], bin=b).position("_pos").done()
    g = d.groupBy("topic").agg(F.corr("_pos", "weight").alias("corr"), F.avg("weight").alias("avg_weight"), F.max("weight").alias("max_weight"), F.min("weight").alias("min_weight"))
    return g.withColumn("trend", F.when(C("corr") > at, "increasing").when(C("corr") < -at, "decreasing").otherwise("stable"))


def shifts(weights: DataFrame, order: str, window: int = 4, threshold: float = 0.3) -> DataFrame:
    """Rows where the dominant topic of the mean weights changes and they move by more than the threshold.

    ``weights`` is (order, topic, weight) with every topic on every document.
    """
    b = F.floor(C(order) / 10_000)
    s = spread(weights, back=window + 1, keys=["topic"], order=[order], bin=b)
    w = s.w
    s = s.roll(lambda d, w: d.withColumns({"_prev": F.avg("weight").over(w.rowsBetween(-window, -1)), "_now": F.avg("weight").over(w.rowsBetween(-window + 1, 0)),
                                           "_n": F.count("*").over(w.rowsBetween(-window, -1))}))
    d = s.done().where(C("_n") == window)
    g = d.groupBy(order).agg(F.max(F.struct("_prev", -C("topic"))).alias("p"), F.max(F.struct("_now", -C("topic"))).alias("c"),
                             F.sqrt(F.sum((C("_now") - C("_prev")) * (C("_now") - C("_prev")))).alias("magnitude"))
    g = g.select(order, (-C("p.col2")).alias("old_topic"), (-C("c.col2")).alias("new_topic"), "magnitude", C("p._prev").alias("old_weight"), C("c._now").alias("new_weight"))
    return g.where((C("old_topic") != C("new_topic")) & (C("magnitude") > threshold))


def topic_sentiment(weights: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    d = dominant(weights, key).join(scores, key)
    return d.groupBy("topic").agg(F.avg("score").alias("avg_sentiment"), F.var_pop("score").alias("variance"), F.count("*").alias("documents"),
                                  (F.sum(C("score") * C("weight")) / F.sum("weight")).alias("weighted_sentiment"))


def compare_topics(a: DataFrame, b: DataFrame, method: str = "cosine") -> DataFrame:
    """Similarity of every topic pair of two models from (topic, word, weight)."""
    sq = lambda t, n: t.groupBy("topic").agg(F.sum(C("weight") * C("weight")).alias("_q")).select(C("topic").alias(n), C("_q").alias(f"_q_{n}"))
    j = a.select(C("topic").alias("a"), "word", C("weight").alias("_wa")).join(b.select(C("topic").alias("b"), "word", C("weight").alias("_wb")), "word")
    dot = j.groupBy("a", "b").agg(F.sum(C("_wa") * C("_wb")).alias("_dot"))
    d = sq(a, "a").join(sq(b, "b")).join(dot, ["a", "b"], "left").fillna(0.0, ["_dot"])  # topics x topics
    sim = C("_dot") / F.sqrt(C("_q_a") * C("_q_b")) if method == "cosine" else -F.sqrt(F.greatest(C("_q_a") + C("_q_b") - 2 * C("_dot"), F.lit(0.0)))
    return d.select("a", "b", sim.alias("similarity"))


def compare_topic_sets(weights: DataFrame, model: str) -> DataFrame:
    """Cosine similarity of every topic pair of every two models, from (``model``, topic, word, weight); words are joined once for all of them.

    One model or none gives an empty result.
    """
    norm = weights.groupBy(model, "topic").agg(F.sum(C("weight") * C("weight")).alias("_q"))
    side = lambda t, n, extra: t.select(C(model).alias(f"{model}_{n}"), C("topic").alias(n), *[C(c).alias(f"{c}_{n}") for c in extra])
    pairs = side(norm, "a", ["_q"]).join(side(norm, "b", ["_q"]), C(f"{model}_a") < C(f"{model}_b"))  # topics of all models, by themselves
    w = side(weights, "a", ["word", "weight"]).withColumnRenamed("word_a", "word").join(side(weights, "b", ["word", "weight"]).withColumnRenamed("word_b", "word"), "word")
    dot = w.where(C(f"{model}_a") < C(f"{model}_b")).groupBy(f"{model}_a", f"{model}_b", "a", "b").agg(F.sum(C("weight_a") * C("weight_b")).alias("_dot"))
    d = pairs.join(dot, [f"{model}_a", f"{model}_b", "a", "b"], "left").fillna(0.0, ["_dot"])
    return d.select(f"{model}_a", f"{model}_b", "a", "b", (C("_dot") / F.sqrt(C("_q_a") * C("_q_b"))).alias("similarity"))


def evolution(weights: DataFrame, by: str, topics: Sequence[int]) -> DataFrame:
    """Mean weight per period and topic, one column per topic."""
    p = weights.groupBy(by).pivot("topic", list(topics)).agg(F.avg("weight"))
    return p.select(by, *[C(str(t)).alias(f"topic_{t}") for t in topics])


def rolling_evolution(weights: DataFrame, by: str, topics: Sequence[int], window: int = 3) -> DataFrame:
    """:func:`evolution` with each topic's mean over the last ``window`` periods (fewer at the start); a period without the topic adds nothing."""
    d = evolution(weights, by, topics).withColumn("_k", F.lit(0))  # one row a period
    mean = lambda x, w: x.withColumns({f"topic_{t}": F.avg(f"topic_{t}").over(w.rowsBetween(1 - window, 0)) for t in topics})
    return over_rows(d, mean, back=window - 1, keys=["_k"], order=[by], bin=F.lit(0).cast("long")).drop("_k")


def topic_frame(weights: DataFrame, key: str, topics: Sequence[int]) -> DataFrame:
    """One row per document with a column for each topic, 0 where the document has none of it."""
    return weights.groupBy(key).agg(*[F.coalesce(F.sum(F.when(C("topic") == t, C("weight"))), F.lit(0.0)).alias(f"topic_{t}") for t in topics])
