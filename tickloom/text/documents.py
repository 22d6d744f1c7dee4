"""Tokens, entities, sentiment, sections and transcripts: row-wise expressions on whole texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..core.slices import spread
from . import lexicons as X

C = F.col
WORD = r"[\p{L}\p{N}_]+"


def _c(t) -> Column:
    return C(t) if isinstance(t, str) else t


def tokens(text, least: int = 1) -> Column:
    """Lower-case words of at least ``least`` characters, letters of any script."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD if least == 1 else WORD[:-1] + f"{{{least},}}"), F.lit(0))


def sentences(text) -> Column:
    return F.filter(F.transform(F.split(_c(text), r"[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def entities(text) -> Column:
    """PERCENT, MONEY and DATE matches, in that order."""
    t = _c(text)
    out = []
    for label, pattern in (("PERCENT", r"\b\d+(?:\.\d+)?%"), ("MONEY", r"\$\d+(?:,\d{3})*(?:\.\d{2})?(?:[BM])?"),
                           ("DATE", r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b")):
        out.append(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), _labelled(label)))
    return F.concat(*out)


def _labelled(label: str):
    return lambda m: F.struct(m.alias("text"), F.lit(label).alias("label"))


def _words(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def financial_terms(text, terms: Sequence[str] = tuple(X.FINANCIAL_TERMS)) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: t.isin(list(terms))))


def count_in(toks, words: Sequence[str]) -> Column:
    return F.size(F.filter(_c(toks), lambda t: t.isin(list(words))))


def rule_sentiment(df: DataFrame, text: str = "text", positive: Sequence[str] = tuple(X.POSITIVE), negative: Sequence[str] = tuple(X.NEGATIVE)) -> DataFrame:
    """(pos - neg) / words within +-1, the label at +-0.05, the counts and the matched words."""
    d = df.withColumn("_t", tokens(text))
    d = d.withColumns({"positive_words": F.filter("_t", lambda t: t.isin(list(positive))), "negative_words": F.filter("_t", lambda t: t.isin(list(negative))),
                       "total_words": F.size("_t")}).drop("_t")
    d = d.withColumns({"positive_count": F.size("positive_words"), "negative_count": F.size("negative_words")})
    s = F.when(C("total_words") > 0, (C("positive_count") - C("negative_count")) / C("total_words")).otherwise(0.0)
    d = d.withColumn("score", s)
    return d.withColumn("label", sentiment_label(C("score")))


def sentiment_label(score: Column, at: float = 0.05) -> Column:
    return F.when(score > at, "bullish").when(score < -at, "bearish").otherwise("neutral")


def weighted_sentiment(df: DataFrame, weights: Mapping[str, float], text: str = "text") -> DataFrame:
    """tanh of the weight sum per word; positive_score and negative_score count each distinct word once."""
    m = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    d = df.withColumn("_t", tokens(text))
    val = lambda t: F.coalesce(F.try_element_at(m, t), F.lit(0.0))
    total = F.aggregate("_t", F.lit(0.0), lambda s, t: s + val(t))
    once = lambda sign: F.aggregate(F.array_distinct("_t"), F.lit(0.0), lambda s, t: s + F.greatest(val(t) * sign, F.lit(0.0)))
    return d.withColumns({"score": F.when(F.size("_t") > 0, F.tanh(total / F.size("_t"))).otherwise(0.0), "positive_score": once(1.0), "negative_score": once(-1.0)}).drop("_t")


def lexicon_sentiment(df: DataFrame, lexicon: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same score with a lexicon table of any size: words are counted per document, then joined."""
    n = df.select(key, F.explode(tokens(text)).alias("word")).groupBy(key, "word").agg(F.count("*").alias("_n"))
    g = n.join(lexicon, "word", "left").groupBy(key).agg((F.sum(C("_n") * F.coalesce("weight", F.lit(0.0))) / F.sum("_n")).alias("_s"))
    return df.select(key).join(g, key, "left").select(key, F.coalesce(F.tanh("_s"), F.lit(0.0)).alias("score"))


def entity_sentiment(df: DataFrame, names: DataFrame, key: str, score: str = "score", text: str = "text") -> DataFrame:
    """Mean document score per mentioned organisation of a names table (name), each document once per name."""
    w = df.select(key, score, F.explode(F.array_distinct(tokens(text))).alias("name"))
    return w.join(names.select(F.lower("name").alias("name")).distinct(), "name").groupBy("name").agg(F.avg(score).alias("sentiment"), F.count("*").alias("mentions"))


def time_weighted(df: DataFrame, by: Sequence[str], score: str, ts: str, now, rate: float = 0.1) -> DataFrame:
    age = F.datediff(now, C(ts))
    return df.groupBy(*by).agg(F.avg(C(score) * F.exp(-rate * age)).alias("sentiment"))


def combined_score(lexicon: Column, model: Column, w: float = 0.6) -> Column:
    return lexicon * w + model * (1 - w)


def daily_sentiment(scores: DataFrame, bars: DataFrame, default: float = 0.5) -> DataFrame:
    g = scores.groupBy("ts").agg(F.avg("score").alias("sentiment"))
    return bars.join(g, "ts", "left").fillna(default, ["sentiment"])


def aggregate_articles(articles: DataFrame, decay: float = 0.95, at: float = 0.3) -> DataFrame:
    """Per ticker weighted mean of (seq, tickers, score, confidence); the weight falls by ``decay`` per later article."""
    n = articles.agg(F.count("*").alias("_n"))
    d = spread(articles, keys=[], order=["seq"], bin=F.floor(C("seq") / 100_000)).position("_pos").done().join(n)  # one-row count
    d = d.withColumn("_w", F.pow(F.lit(decay), C("_n") - 1 - C("_pos"))).select(F.explode("tickers").alias("ticker"), "score", "confidence", "_w")
    g = d.groupBy("ticker").agg(F.sum("_w").alias("_t"), F.sum(C("score") * C("_w")).alias("_s"), F.sum(C("confidence") * C("_w")).alias("_c"), F.count("*").alias("articles"))
    mean = lambda c: F.when(C("_t") > 0, C(c) / C("_t")).otherwise(0.0)
    g = g.select("ticker", "articles", mean("_s").alias("score"), mean("_c").alias("confidence"))
    return g.withColumn("signal", sentiment_label(C("score"), at))


def news_signal(agg: DataFrame, least: int = 2, confidence: float = 0.5, bullish: float = 0.3, bearish: float = -0.3) -> DataFrame:
    s = (F.when((C("articles") < least) | (C("confidence") < confidence), 0.0).when(C("score") >= bullish, F.least("score", F.lit(1.0)))
         .when(C("score") <= bearish, F.greatest("score", F.lit(-1.0))).otherwise(0.0))
    return agg.withColumn("signal", s)


def salvage_json(text, schema: str) -> Column:
    """Parse a reply as JSON, else its part from the first { to the last }; null when neither parses."""
    t = _c(text)
    whole = F.when(F.trim(t).startswith("{") & F.trim(t).endswith("}"), t)
    return F.from_json(F.coalesce(whole, F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))), schema)


def sections(df: DataFrame, text: str = "text") -> DataFrame:
    """prepared_remarks and qa_session, cut at the first marker of the list that occurs."""
    t = F.trim(C(text), F.lit(" \t\n\r"))
    low = F.lower(t)
    start = F.coalesce(*[F.when(F.instr(low, m) > 0, F.instr(low, m)) for m in X.QA_MARKERS])
    strip = lambda c: F.trim(c, F.lit(" \t\n\r"))
    d = df.withColumn("_s", start)
    return d.withColumns({"prepared_remarks": F.when(C("_s").isNull(), t).otherwise(strip(F.substring(t, F.lit(1), C("_s") - 1))),
                          "qa_session": F.when(C("_s").isNull(), F.lit("")).otherwise(strip(F.substring(t, C("_s"), F.length(t))))}).drop("_s")


def participants(text) -> Column:
    names = F.transform(F.split(_c(text), "\n"), lambda l: F.regexp_extract(F.trim(l), r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*[-:,]", 1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: (F.length(n) > 0) & ~n.isin("Operator", "Conference Call"))))


_METRIC = Y.ArrayType(Y.StructType([Y.StructField("metric", Y.StringType()), Y.StructField("value", Y.DoubleType()), Y.StructField("unit", Y.StringType()), Y.StructField("context", Y.StringType())]))


@F.pandas_udf(_METRIC)
def transcript_metrics(text: pd.Series) -> pd.Series:
    """Metric mentions with 100 characters of context on either side."""
    compiled = [(k, re.compile(p, re.IGNORECASE)) for k, p in X.METRIC_PATTERNS.items()]

    def one(t):
        out = []
        for name, rx in compiled:
            for m in rx.finditer(t or ""):
                try:
                    v = float(m.group(1).replace(",", ""))
                except ValueError:
                    continue
                out.append({"metric": name, "value": v, "unit": m.group(2) if rx.groups > 1 else None, "context": t[max(0, m.start() - 100):m.end() + 100].strip()})
        return out

    return text.map(one)


def section_sentiment(text, positive: Sequence[str] = tuple(X.SECTION_POSITIVE), negative: Sequence[str] = tuple(X.SECTION_NEGATIVE)) -> Column:
    t = tokens(text)
    p, n = count_in(t, positive), count_in(t, negative)
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)


def filing_sections(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns({"risk_factors": F.regexp_extract(C(text), X.RISK_SECTION, 0), "management": F.regexp_extract(C(text), X.MANAGEMENT_SECTION, 0)})


def vocabulary_change(docs: DataFrame, company: str, order: str, text: str = "text", threshold: float = 0.15, top: int = 50, bin=None) -> DataFrame:
    """1 - Jaccard of consecutive vocabularies where it reaches the threshold; new and removed terms sorted."""
    d = docs.withColumn("_v", F.array_distinct(F.filter(tokens(text), lambda t: t.rlike("^[a-z]+$"))))
    b = bin if bin is not None else F.floor(C(order) / 1_000)
    s = spread(d, back=1, keys=[company], order=[order], bin=b)
    s = s.roll(lambda x, w: x.withColumn("_p", F.lag("_v").over(w)))
    d = s.done().where("_p is not null")
    union = F.size(F.array_union("_v", "_p"))
    change = 1 - F.when(union > 0, F.size(F.array_intersect("_v", "_p")) / union).otherwise(0.0)
    d = d.withColumn("change_score", change).where(C("change_score") >= threshold)
    part = lambda a, b: F.slice(F.array_sort(F.array_except(a, b)), 1, top)
    return d.withColumns({"new_terms": part("_v", "_p"), "removed_terms": part("_p", "_v")}).drop("_v", "_p")
