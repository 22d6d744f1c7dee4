"""Document-term tables, word vectors and vector search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.slices import match, spread
from ..core.vectors import cosine
from ..session import durable
from .counting import row_counts, term_totals, vector_sums, weight_rows
from .documents import tokens

C = F.col
TERM = r"[\p{L}\p{N}_]{2,}"
MOST_VALUES = 8_000_000  #: numbers of word vectors that go to every task
MOST_WORDS = 100_000  #: words near a keyword that go to every task


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.regexp_extract_all(F.lower(C(text)), F.lit(TERM), F.lit(0)).alias("_t"))


def _by_key(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other row has, and the other rows (none: None). Only the latter have to meet; null is a key."""
    again = durable(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    if again.isEmpty():
        return df, None
    return match(df, again, [key], "left_anti"), match(df, again, [key], "left_semi")


def _together(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(key, "term").agg(F.sum("n").alias("n"))


def terms(df: DataFrame, key: str, text: str = "text", ngrams: tuple[int, int] = (1, 1), only: list[str] | None = None) -> DataFrame:
    """(key, term, n): counts per document of the n-grams of words of two or more characters, of ``only`` those where given.

    A document is one row and is counted in place; rows that share their key are counted one by one and then added up.
    """
    once, again = _by_key(_words(df, key, text), key)
    c = row_counts(once, key, "_t", *ngrams, only)
    return c if again is None else c.unionByName(_together(row_counts(again, key, "_t", *ngrams, only), key))


def totals(df: DataFrame, key: str, text: str = "text", ngrams: tuple[int, int] = (1, 1)) -> DataFrame:
    """(term, total, df): occurrences and documents of every n-gram; rows of one key are one document."""
    once, again = _by_key(_words(df, key, text), key)
    t = term_totals(once, key, "_t", *ngrams)
    if again is None:
        return t
    t = t.unionByName(_together(row_counts(again, key, "_t", *ngrams), key).groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("df")))
    return t.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def vocabulary(totals: DataFrame, documents: int, max_features: int = 5000, min_df: int = 1, max_df: float = 0.95) -> DataFrame:
    """The ``max_features`` most frequent terms within the document-frequency limits, from (term, total, df)."""
    v = totals.where((C("df") >= min_df) & (C("df") <= max_df * F.lit(documents)))
    return v.orderBy(F.desc("total"), "term").limit(max_features)


def bag_of_words(df: DataFrame, key: str, text: str = "text", max_features: int = 5000, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    v = vocabulary(totals(df, key, text), df.count(), max_features, min_df, max_df).select("term")
    return terms(df, key, text, only=[r.term for r in v.collect()])  # at most max_features rows


def tfidf(df: DataFrame, key: str, text: str = "text", max_features: int = 5000, ngrams: tuple[int, int] = (1, 2), min_df: int = 1, max_df: float = 0.95) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), scaled to unit length per document."""
    return weights(df, key, idf(df, key, text, max_features, ngrams, min_df, max_df), text, ngrams)


def idf(df: DataFrame, key: str, text: str = "text", max_features: int = 5000, ngrams: tuple[int, int] = (1, 2), min_df: int = 1, max_df: float = 0.95) -> dict[str, float]:
    """ln((1 + n) / (1 + df)) + 1 of every term of the vocabulary, at most ``max_features``."""
    n = df.count()
    v = vocabulary(totals(df, key, text, ngrams), n, max_features, min_df, max_df)
    return {r.term: r.idf for r in v.select("term", (F.log((1 + n) / (1 + C("df"))) + 1).alias("idf")).collect()}


def weights(df: DataFrame, key: str, idf: dict[str, float], text: str = "text", ngrams: tuple[int, int] = (1, 2)) -> DataFrame:
    """(key, term, weight): count * idf, scaled to unit length per document."""
    once, again = _by_key(_words(df, key, text), key)
    w = weight_rows(once, key, "_t", idf, *ngrams)
    if again is None:
        return w
    c = _together(row_counts(again, key, "_t", *ngrams, list(idf)), key)
    known = df.sparkSession.createDataFrame(list(idf.items()), "term string, _idf double")
    d = c.join(F.broadcast(known), "term").withColumn("_w", C("n") * C("_idf"))
    # a document holds at most max_features terms
    length = F.sqrt(F.sum(C("_w") * C("_w")).over(Window.partitionBy(key)))
    return w.unionByName(d.select(key, "term", (C("_w") / length).alias("weight")))


def top_terms(weights: DataFrame, k: int = 20, by: str | None = None, value: str = "weight") -> DataFrame:
    """Largest terms of the corpus (summed) or of each document."""
    if by is None:
        return weights.groupBy("term").agg(F.sum(value).alias(value)).orderBy(F.desc(value), "term").limit(k)
    rn = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), "term"))
    return weights.withColumn("place", rn).where(C("place") <= k)


def document_lengths(weights: DataFrame, key: str) -> DataFrame:
    return weights.groupBy(key).agg(F.count("*").alias("terms"))


def document_frequency(weights: DataFrame) -> DataFrame:
    return weights.groupBy("term").agg(F.count("*").alias("df"))


def read_vectors(spark, path: str) -> DataFrame:
    """Text vectors, a word and its numbers per line; a line with a bad number is skipped."""
    d = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    v = F.transform(F.slice(C("p"), 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x.try_cast("float"))
    d = d.select(C("p")[0].alias("word"), v.alias("vector")).where((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull()))
    return d


def document_vectors(df: DataFrame, vectors: DataFrame, key: str, dim: int, text: str = "text") -> DataFrame:
    """Mean vector of the known words of a document; zeros when it has none.

    Words are counted in the document's row. The vectors of the most frequent words, ``MOST_VALUES`` numbers, go to every task, which
    hands on one sum per document; rarer words are joined with their vectors, one row per word of a document.
    """
    t = df.where(C(key).isNotNull()).select(key, tokens(text).alias("_t"))
    most = max(1, MOST_VALUES // dim)
    ranked = term_totals(t, key, "_t").orderBy(F.desc("total"), "term").limit(most)
    frequent = [r.term for r in ranked.select("term").collect()]
    known = df.sparkSession.createDataFrame([(w,) for w in frequent], "word string")
    v = vectors.join(F.broadcast(known), "word").groupBy("word").agg(F.count("*").alias("times"), F.array(*[F.coalesce(F.sum(C("vector")[i].cast("double")), F.lit(0.0)) for i in range(dim)]).alias("sums"),
                                                                       F.array(*[F.count(C("vector")[i]) for i in range(dim)]).alias("values")).toArrow()  # a word may have several vectors, a vector gaps
    number = lambda c: v[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    s = vector_sums(t, key, "_t", v["word"].to_pylist(), number("sums"), number("values"), v["times"].to_numpy())
    s = s.groupBy(key).agg(F.sum("_t").alias("_t"), *[F.when(F.sum(C("_q")[i]) > 0, F.sum(C("_s")[i])).alias(f"_s{i}") for i in range(dim)])
    if len(frequent) == most:
        rare = row_counts(t, key, "_t", but=frequent).withColumnRenamed("term", "word").join(vectors, "word").select(key, "n", "vector").repartition(key)
        rare = rare.groupBy(key).agg(F.sum("n").alias("_t"), *[F.sum(C("n") * C("vector")[i]).alias(f"_s{i}") for i in range(dim)])
        s = s.unionByName(rare).groupBy(key).agg(F.sum("_t").alias("_t"), *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(dim)])
    g = s.select(key, F.array(*[C(f"_s{i}") / C("_t") for i in range(dim)]).alias("vector"))
    zero = F.array(*[F.lit(0.0)] * dim)
    return df.select(key).join(g, key, "left").withColumn("vector", F.coalesce("vector", zero))


def similarity_to_prior(df: DataFrame, company: str, order: str, vector: str = "vector", bin=None) -> DataFrame:
    b = bin if bin is not None else F.floor(C(order) / 1_000)
    s = spread(df, back=1, keys=[company], order=[order], bin=b).roll(lambda x, w: x.withColumn("_p", F.lag(vector).over(w)))
    d = s.done().withColumn("similarity", cosine(C(vector), C("_p"))).drop("_p")
    return d.withColumn("change", 1 - C("similarity"))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, qid: str = "qid", cid: str = "cid", exclude_self: bool = False, batch: int = 256) -> DataFrame:
    """The k most similar corpus vectors per query (qid, qvec) x (cid, cvec).

    Queries go out in counted batches as one array, the corpus is read in place, and the top k are
    cut inside each partition before the small final ranking.
    """
    total = queries.count()
    q = queries.select(F.col(qid), "qvec")
    out = None
    for part in range(max(1, -(-total // batch))):
        cut = q if total <= batch else q.where(F.pmod(F.xxhash64(qid), F.lit(-(-total // batch))) == part)
        scored = corpus.join(F.broadcast(cut)).withColumn("similarity", cosine(C("qvec"), C("cvec"))).where("similarity is not null")
        if exclude_self:
            scored = scored.where(C(qid) != C(cid))
        rn = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("similarity"), cid))
        top = scored.select(qid, cid, "similarity").withColumn("place", rn).where(C("place") <= k)
        out = top if out is None else out.unionByName(top)
    return out


def analogy(vectors: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """b - a + c as one query vector."""
    g = vectors.where(C("word").isin(a, b, c)).groupBy().agg(*[F.max(F.when(C("word") == w, C("vector"))).alias(f"_{i}") for i, w in enumerate((a, b, c))])
    v = F.zip_with(F.zip_with("_1", "_0", lambda x, y: x - y), C("_2"), lambda x, y: x + y)
    return g.select(F.lit(f"{b}-{a}+{c}").alias("qid"), v.alias("qvec"))


def risk_sentiment(df: DataFrame, vectors: DataFrame, keywords: DataFrame, key: str, text: str = "text", at: float = 0.5, top: int = 20) -> DataFrame:
    """Sum of the ``top`` largest similarity * frequency terms near the keywords (word, vector), at most 1.

    Similar words are found once per vocabulary, not per document.
    """
    near = durable(nearest_words(vectors, keywords, at))
    t = df.select(key, tokens(text).alias("_t"))
    few = [r.word for r in near.select("word").distinct().limit(MOST_WORDS + 1).collect()]
    bounded = len(few) <= MOST_WORDS
    n = row_counts(t, key, "_t", only=few if bounded else None).groupBy(key, C("term").alias("word")).agg(F.sum("n").alias("_n"))
    size = t.groupBy(key).agg(F.sum(F.size("_t")).alias("_t"))
    near = F.broadcast(near) if bounded and near.count() <= MOST_WORDS else near
    d = n.join(near, "word").join(size, key).withColumn("_s", C("similarity") * C("_n") / C("_t"))
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_s")))
    g = d.withColumn("_rn", rn).where(C("_rn") <= top).groupBy(key).agg(F.least(F.sum("_s"), F.lit(1.0)).alias("risk_score"))
    return df.select(key).join(g, key, "left").fillna(0.0, ["risk_score"])


def nearest_words(vectors: DataFrame, keywords: DataFrame, at: float) -> DataFrame:
    """(word, keyword, similarity) above the limit. A list of up to a thousand keywords is broadcast."""
    k = keywords.select(C("word").alias("keyword"), C("vector").alias("_kv"))
    d = vectors.join(F.broadcast(k) if keywords.count() <= 1000 else k).withColumn("similarity", cosine(C("vector"), C("_kv")))
    return d.where(C("similarity") > at).select("word", "keyword", "similarity")
