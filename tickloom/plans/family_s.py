"""Financial text."""


from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizer, IDF, NGram
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..core.vectors import cosine
from ..operators import indicators as I
from ..session import durable
from ..text import documents as D
from ..text import lexicons as LX
from ..text import terms as T
from ..text import topics as P
from .family_e import MACD, RSI
from .inputs import BARS, bars, table
from .registry import query

C = F.col
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
POS = ["the", "that", "and", "le", "est", "der"]
NEG = ["of", "in", "to", "la", "les", "und"]
PL, NL = (", ".join(f"'{w}'" for w in ws) for ws in (POS, NEG))
TOKENS = rf"tk AS (SELECT doc_id, source, lang, {TOK} AS t FROM documents)"
SENT = TOKENS + f""",
sc AS (SELECT doc_id, source, lang, len(t) AS total_words, len(list_filter(t, lambda w: w IN ({PL}))) AS p, len(list_filter(t, lambda w: w IN ({NL}))) AS n FROM tk),
se AS (SELECT *, CASE WHEN total_words > 0 THEN (p - n) / total_words ELSE 0 END AS score FROM sc)"""


def docs(spark, d):
    return table(spark, d, "documents")


def scored(spark, d):
    return D.rule_sentiment(docs(spark, d), positive=POS, negative=NEG)


@query("s01_tokens_sentences", "doc_id# tokens# distinct_tokens# first sentences#", TOKENS + r""", result AS (SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, t[1] AS first,
  len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: len(trim(s, ' ')) > 0)) AS sentences FROM tk JOIN documents USING (doc_id))""")
def s01(spark, d):
    x = docs(spark, d).withColumns({"t": D.tokens("text"), "s": D.sentences("text")})
    return x.withColumns({"tokens": F.size("t"), "distinct_tokens": F.size(F.array_distinct("t")), "first": F.try_element_at("t", F.lit(1)), "sentences": F.size("s")})


ENT = r"""e AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d+(?:\.\d+)?%')) AS entity, 'PERCENT' AS label FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\$\d+(?:,\d{3})*(?:\.\d{2})?(?:[BM])?')), 'MONEY' FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b')), 'DATE' FROM documents)"""


@query("s02_entities", "doc_id# entity label", ENT.replace("FROM documents", "FROM md") .replace("e AS", """md AS (SELECT doc_id, text || ' up ' || (doc_id % 90) || '.5% to $' || doc_id || ',250.00 on 2024-0' || (1 + doc_id % 9) || '-15' AS text FROM documents),
e AS""", 1) + ", result AS (SELECT * FROM e)")
def s02(spark, d):
    t = F.concat("text", F.lit(" up "), (C("doc_id") % 90).cast("string"), F.lit(".5% to $"), C("doc_id").cast("string"), F.lit(",250.00 on 2024-0"), (1 + C("doc_id") % 9).cast("string"), F.lit("-15"))
    return docs(spark, d).withColumn("text", t).select("doc_id", F.inline(D.entities("text"))).withColumnRenamed("text", "entity")


@query("s03_financial_terms", "doc_id# terms#", r"""x AS (SELECT doc_id, regexp_extract_all(lower(text || ' Stocks rally; bond yield and stocks in ' || source), '[\p{L}\p{N}_]+') AS t FROM documents),
result AS (SELECT doc_id, len(list_distinct(list_filter(t, lambda w: w IN (""" + ", ".join(f"'{w}'" for w in LX.FINANCIAL_TERMS) + ")))) AS terms FROM x)")
def s03(spark, d):
    t = F.concat("text", F.lit(" Stocks rally; bond yield and stocks in "), "source")
    return docs(spark, d).withColumn("terms", F.size(D.financial_terms(t)))


@query("s04_entity_sentiment", "name sentiment:8 mentions#", SENT + """, w AS (SELECT DISTINCT doc_id, unnest(t) AS name FROM tk),
result AS (SELECT name, avg(score) AS sentiment, count(*) AS mentions FROM w JOIN se USING (doc_id) WHERE name IN ('africa', 'america', 'the', 'le', 'der', 'el') GROUP BY name)""")
def s04(spark, d):
    names = table(spark, d, "region").select(C("r_name").alias("name"))
    names = names.unionByName(names.select(F.explode(F.array(*[F.lit(w) for w in ("The", "LE", "der", "el")])).alias("name")))
    return D.entity_sentiment(scored(spark, d), names.where("lower(name) in ('africa', 'america', 'the', 'le', 'der', 'el')"), "doc_id")


WORDS2 = r"w2 AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS n FROM w2 GROUP BY 1, 2)"


@query("s05_bag_of_words", "doc_id# term n#", WORDS2 + """, v AS (SELECT term, sum(n) AS total FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM documents) ORDER BY total DESC, term LIMIT 5000),
result AS (SELECT tf.* FROM tf JOIN v USING (term))""")
def s05(spark, d):
    return T.bag_of_words(docs(spark, d), "doc_id", max_features=5000)


TFIDF = r"""l AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents),
g AS (SELECT doc_id, unnest(t) AS term FROM l UNION ALL SELECT doc_id, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) FROM l),
tf AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY 1, 2),
v AS (SELECT term, sum(n) AS total, count(*) AS df FROM tf GROUP BY term HAVING count(*) <= 0.95 * (SELECT count(*) FROM documents) ORDER BY total DESC, term LIMIT 5000),
wt AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM wt)"""


def weights(spark, d):
    return T.tfidf(docs(spark, d), "doc_id", max_features=5000)


@query("s06_tfidf", "doc_id# term weight:8", TFIDF + ", result AS (SELECT * FROM tfidf)")
def s06(spark, d):
    return weights(spark, d)


@query("s07_document_frequency", "term df#", TFIDF + ", result AS (SELECT term, count(*) AS df FROM tfidf GROUP BY term)")
def s07(spark, d):
    return T.document_frequency(weights(spark, d))


@query("s07_top_terms", "term weight:5", TFIDF + ", result AS (SELECT term, sum(weight) AS weight FROM tfidf GROUP BY term ORDER BY weight DESC, term LIMIT 20)")
def s07b(spark, d):
    return T.top_terms(weights(spark, d), 20)


@query("s07_document_lengths", "doc_id# terms#", TFIDF + ", result AS (SELECT doc_id, count(*) AS terms FROM tfidf GROUP BY doc_id)")
def s07c(spark, d):
    return T.document_lengths(weights(spark, d), "doc_id")


@query("s08_rule_sentiment", "doc_id# score:8", SENT + ", result AS (SELECT * FROM se)")
def s08(spark, d):
    return scored(spark, d)


@query("s09_rule_analysis", "doc_id# label positive_count# negative_count# total_words#", SENT + """, result AS (SELECT doc_id, p AS positive_count, n AS negative_count, total_words,
  CASE WHEN score > 0.05 THEN 'bullish' WHEN score < -0.05 THEN 'bearish' ELSE 'neutral' END AS label FROM se)""")
def s09(spark, d):
    return scored(spark, d)


WTS = {"the": 2.0, "that": 0.5, "le": 1.5, "of": -1.0, "in": -0.25, "und": -2.0}
CASEW = "CASE w " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WTS.items()) + " ELSE 0 END"


@query("s10_weighted_sentiment", "doc_id# score:8 positive_score:2 negative_score:2", TOKENS + f""", w AS (SELECT doc_id, unnest(t) AS w FROM tk),
c AS (SELECT doc_id, w, count(*) AS n, {CASEW} AS v FROM w GROUP BY doc_id, w),
g AS (SELECT doc_id, tanh(sum(n * v) / sum(n)) AS score, sum(greatest(v, 0)) AS positive_score, sum(greatest(-v, 0)) AS negative_score FROM c GROUP BY doc_id),
result AS (SELECT doc_id, coalesce(score, 0) AS score, coalesce(positive_score, 0) AS positive_score, coalesce(negative_score, 0) AS negative_score FROM documents LEFT JOIN g USING (doc_id))""")
def s10(spark, d):
    return D.weighted_sentiment(docs(spark, d), WTS)


DAY = "CAST(DATE '1995-01-02' + CAST(doc_id % 365 AS INT) AS DATE)"


def day():
    return F.date_add(F.lit("1995-01-02").cast("date"), (C("doc_id") % 365).cast("int"))


@query("s11_time_weighted_sentiment", "source sentiment:8", SENT + f", result AS (SELECT source, avg(score * exp(-0.1 * (DATE '1996-01-01' - {DAY}))) AS sentiment FROM se GROUP BY source)")
def s11(spark, d):
    return D.time_weighted(scored(spark, d).withColumn("day", day()), ["source"], "score", "day", F.lit("1996-01-01").cast("date"))


@query("s12_combined_score", "doc_id# score:8", SENT + ", result AS (SELECT doc_id, score * 0.6 + quality * 0.4 AS score FROM se JOIN labels USING (doc_id))")
def s12(spark, d):
    j = scored(spark, d).join(table(spark, d, "labels"), "doc_id")
    return j.withColumn("score", D.combined_score(C("score"), C("quality")))


@query("s13_daily_sentiment", "symbol ts! sentiment:8", SENT + f", g AS (SELECT {DAY} AS ts, avg(score) AS sentiment FROM se GROUP BY 1), " + BARS.strip() + """,
result AS (SELECT symbol, ts, coalesce(sentiment, 0.5) AS sentiment FROM bars LEFT JOIN g USING (ts))""")
def s13(spark, d):
    return D.daily_sentiment(scored(spark, d).select(day().alias("ts"), "score"), bars(spark, d))


def labelled(spark, d):
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", C("quality").cast("double").alias("label"))


def classifier(spark, d):
    x = durable(labelled(spark, d).withColumn("tokens", F.filter(D.tokens("text"), lambda t: F.length(t) > 1)))
    pipe = Pipeline(stages=[NGram(n=2, inputCol="tokens", outputCol="grams"), CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=5000, minDF=2),
                            IDF(inputCol="tf", outputCol="features"), NaiveBayes(smoothing=1.0)])
    return x, pipe.fit(x)


@query("s14_news_classifier", "doc_id# label:1 prediction:1")
def s14(spark, d):
    x, m = classifier(spark, d)
    return m.transform(x)


@query("s15_classifier_evaluation", "accuracy:6 weighted_precision:6 weighted_recall:6 weighted_f1:6")
def s15(spark, d):
    from ..models.evaluation import classification_metrics
    x, m = classifier(spark, d)
    return classification_metrics(durable(m.transform(x).select("label", "prediction")))


@query("s16_class_features", "class# place# term log_probability:6")
def s16(spark, d):
    _, m = classifier(spark, d)
    theta, vocab = m.stages[-1].theta.toArray(), m.stages[1].vocabulary
    rows = [(int(c), w, float(theta[c][i])) for c in range(theta.shape[0]) for i, w in enumerate(vocab)]  # classes x vocabulary, at most 5000 terms
    t = spark.createDataFrame(rows, "class int, term string, log_probability double")
    return T.top_terms(t, 20, "class", "log_probability")


ART = f"""ar AS (SELECT doc_id AS seq, [source, lang] AS tickers, (doc_id * 37 % 200) / 100.0::DOUBLE - 1 AS score, (doc_id * 13 % 100) / 100.0::DOUBLE AS confidence FROM documents),
ap AS (SELECT *, pow(0.95::DOUBLE, count(*) OVER () - row_number() OVER (ORDER BY seq)) AS w FROM ar),
au AS (SELECT unnest(tickers) AS ticker, score, confidence, w FROM ap),
ag AS (SELECT ticker, count(*) AS articles, sum(score * w) / sum(w) AS score, sum(confidence * w) / sum(w) AS confidence FROM au GROUP BY ticker)"""


def articles(spark, d):
    a = docs(spark, d).select(C("doc_id").alias("seq"), F.array("source", "lang").alias("tickers"), (C("doc_id") * 37 % 200 / 100.0 - 1).alias("score"), (C("doc_id") * 13 % 100 / 100.0).alias("confidence"))
    return D.aggregate_articles(a)


@query("s17_article_aggregation", "ticker articles# score:6 confidence:6 signal", ART + ", result AS (SELECT *, CASE WHEN score > 0.3 THEN 'bullish' WHEN score < -0.3 THEN 'bearish' ELSE 'neutral' END AS signal FROM ag)")
def s17(spark, d):
    return articles(spark, d)


@query("s18_news_signal", "ticker signal:6", ART + """, result AS (SELECT ticker, CASE WHEN articles < 2 OR confidence < 0.5 THEN 0 WHEN score >= 0.3 THEN least(score, 1.0)
  WHEN score <= -0.3 THEN greatest(score, -1.0) ELSE 0 END AS signal FROM ag)""")
def s18(spark, d):
    return D.news_signal(articles(spark, d))


@query("s19_watch_list", "symbol price:8 change:8 high_52w:8 low_52w:8 rsi:5 macd_side", MACD + f""", {RSI},
l AS (SELECT symbol, max(ts) AS ts FROM bars GROUP BY symbol), p AS (SELECT symbol, ts, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS change,
  max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS 251 PRECEDING) AS h, min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS 251 PRECEDING) AS lo FROM bars),
result AS (SELECT symbol, close AS price, change, h AS high_52w, lo AS low_52w, rsi, CASE WHEN macd > macd_signal THEN 'above' ELSE 'below' END AS macd_side
  FROM l JOIN p USING (symbol, ts) JOIN rsi USING (symbol, ts) JOIN macd USING (symbol, ts))""")
def s19(spark, d):
    return I.watch_list(bars(spark, d))


@query("s20_json_salvage", "event_id# k# ok", """x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN 'Sure: ' || props || ' done' ELSE 'no json' END AS t, event_id % 3 AS m, props FROM events),
result AS (SELECT event_id, CASE WHEN m < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE -1 END AS k, m < 2 AS ok FROM x)""")
def s20(spark, d):
    m = C("event_id") % 3
    e = table(spark, d, "events").withColumn("t", F.when(m == 0, C("props")).when(m == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).otherwise("no json"))
    j = D.salvage_json("t", "k bigint")
    return e.select("event_id", F.coalesce(j["k"], F.lit(-1)).alias("k"), j["k"].isNotNull().alias("ok"))


CONV = """cl AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN turn >= 2 THEN 'Operator: our first question. ' ELSE '' END ELSE 'Ann Lee - CEO: ' END || text AS line FROM conversations),
cv AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, line) AS text FROM cl GROUP BY conv_id)"""


def transcripts(spark, d):
    """One text per conversation with speaker labels. The turns of a conversation are few."""
    c = table(spark, d, "conversations")
    lead = F.when(C("role") == "user", F.when(C("turn") >= 2, "Operator: our first question. ").otherwise("")).otherwise("Ann Lee - CEO: ")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(lead, "text").alias("line")))).alias("l"))
    return g.select("conv_id", F.array_join(F.transform("l", lambda e: e["line"]), "\n").alias("text"))


SPLIT = CONV + r""", sp0 AS (SELECT conv_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM cv), sp1 AS (SELECT *, strpos(lower(t), 'operator: our first question') AS s FROM sp0),
sp AS (SELECT conv_id, CASE WHEN s = 0 THEN t ELSE trim(substr(t, 1, s - 1), ' ' || chr(9) || chr(10) || chr(13)) END AS pr, CASE WHEN s = 0 THEN '' ELSE trim(substr(t, s), ' ' || chr(9) || chr(10) || chr(13)) END AS qa FROM sp1)"""


@query("s21_transcript_sections", "conv_id# remarks# qa# qa_head", SPLIT + ", result AS (SELECT conv_id, len(pr) AS remarks, len(qa) AS qa, substr(qa, 1, 20) AS qa_head FROM sp)")
def s21(spark, d):
    s = D.sections(transcripts(spark, d))
    return s.select("conv_id", F.length("prepared_remarks").alias("remarks"), F.length("qa_session").alias("qa"), F.substring("qa_session", 1, 20).alias("qa_head"))


@query("s22_participants", "conv_id# names", CONV + """, result AS (SELECT conv_id, CASE WHEN bool_or(line LIKE 'Ann Lee - CEO%') THEN 'Ann Lee' ELSE '' END AS names FROM cl GROUP BY conv_id)""")
def s22(spark, d):
    t = transcripts(spark, d)
    return t.select("conv_id", F.array_join(D.participants("text"), "|").alias("names"))


@query("s23_transcript_metrics", "conv_id# metric value:2 unit context_length#")
def s23(spark, d):
    t = transcripts(spark, d)
    t = t.withColumn("text", F.concat("text", F.lit(" Revenue was $"), C("conv_id").cast("string"), F.lit(".5 million and gross margin was 40%. EPS of 1.25; guidance for $2 billion")))
    m = t.select("conv_id", F.inline(D.transcript_metrics("text")))
    return m.withColumn("context_length", F.length("context"))


@query("s24_section_sentiment", "conv_id# remarks:8 qa:8", SPLIT + "".join(f""", {s}x AS (SELECT conv_id, len(list_filter(regexp_extract_all(lower({s}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({PL}))) AS p,
  len(list_filter(regexp_extract_all(lower({s}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({NL}))) AS n FROM sp)""" for s in ("pr", "qa")) + """,
result AS (SELECT pr.conv_id, CASE WHEN prx.p + prx.n > 0 THEN (prx.p - prx.n) / (prx.p + prx.n) ELSE 0 END AS remarks, CASE WHEN qax.p + qax.n > 0 THEN (qax.p - qax.n) / (qax.p + qax.n) ELSE 0 END AS qa
  FROM sp pr JOIN prx USING (conv_id) JOIN qax USING (conv_id))""")
def s24(spark, d):
    s = D.sections(transcripts(spark, d))
    return s.select("conv_id", D.section_sentiment("prepared_remarks", POS, NEG).alias("remarks"), D.section_sentiment("qa_session", POS, NEG).alias("qa"))


@query("s25_filing_sections", "doc_id# risk# management#", r"""x AS (SELECT doc_id, 'Item 1A. Risk Factors ' || text || ' ITEM 1B none. Item 7. Management discussion and analysis ' || source || ' Item 8 end' AS t FROM documents),
result AS (SELECT doc_id, len(regexp_extract(t, '(?is)(item\s+1a\.?\s+risk\s+factors.*?)(item\s+1b|item\s+2|\z)', 1)) AS risk, len(regexp_extract(t, '(?is)(item\s+7\.?\s+management.*?discussion.*?analysis.*?)(item\s+7a|item\s+8|\z)', 1)) AS management FROM x)""")
def s25(spark, d):
    t = F.concat(F.lit("Item 1A. Risk Factors "), "text", F.lit(" ITEM 1B none. Item 7. Management discussion and analysis "), "source", F.lit(" Item 8 end"))
    f = D.filing_sections(docs(spark, d).select("doc_id", t.alias("text")))
    return f.select("doc_id", F.length("risk_factors").alias("risk"), F.length("management").alias("management"))


VEC = TOKENS + """, wd AS (SELECT DISTINCT unnest(t) AS word FROM tk),
vec AS (SELECT word, embedding AS vector FROM wd JOIN embeddings ON vec_id = (length(word) * 31 + unicode(word)) % 500),
wn AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(t) AS word FROM tk) GROUP BY 1, 2),
dv AS (SELECT doc_id, i, sum(n * vector[i]::DOUBLE) / sum(n) AS v FROM wn JOIN vec USING (word), range(1, 65) r(i) GROUP BY doc_id, i)"""
DIM = 64


def vectors(spark, d):
    """A vector for every word of the corpus, taken from the stored embeddings by a rule on the word."""
    w = docs(spark, d).select(F.explode(D.tokens("text")).alias("word")).distinct()
    return w.join(table(spark, d, "embeddings"), C("vec_id") == (F.length("word") * 31 + F.ascii("word")) % 500).select("word", C("embedding").alias("vector"))


def doc_vectors(spark, d):
    return T.document_vectors(docs(spark, d), vectors(spark, d), "doc_id", DIM)


@query("s26_document_vectors", "doc_id# v1:7 v2:7 v64:7", VEC + """, result AS (SELECT doc_id, coalesce(max(CASE WHEN i = 1 THEN v END), 0) AS v1, coalesce(max(CASE WHEN i = 2 THEN v END), 0) AS v2,
  coalesce(max(CASE WHEN i = 64 THEN v END), 0) AS v64 FROM documents LEFT JOIN dv USING (doc_id) GROUP BY doc_id)""")
def s26(spark, d):
    v = doc_vectors(spark, d)
    return v.select("doc_id", C("vector")[0].alias("v1"), C("vector")[1].alias("v2"), C("vector")[63].alias("v64"))


@query("s27_filing_similarity", "doc_id# source similarity:6 change:6", VEC + """, pr AS (SELECT doc_id, source, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents),
nm AS (SELECT doc_id, sqrt(sum(v * v)) AS l FROM dv GROUP BY doc_id),
dt AS (SELECT a.doc_id, sum(a.v * b.v) AS dot, any_value(p.prev) AS prev FROM dv a JOIN pr p USING (doc_id) JOIN dv b ON b.doc_id = p.prev AND a.i = b.i GROUP BY a.doc_id),
sm AS (SELECT dt.doc_id, dot / (x.l * y.l) AS similarity FROM dt JOIN nm x ON x.doc_id = dt.doc_id JOIN nm y ON y.doc_id = dt.prev WHERE x.l * y.l > 0),
result AS (SELECT pr.doc_id, source, similarity, 1 - similarity AS change FROM pr LEFT JOIN sm USING (doc_id))""")
def s27(spark, d):
    v = durable(docs(spark, d).select("doc_id", "source").join(doc_vectors(spark, d), "doc_id"))
    return T.similarity_to_prior(v, "source", "doc_id")


@query("s28_vocabulary_change", "doc_id# source change_score:8 new_terms removed_terms", r"""v AS (SELECT doc_id, source, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))) AS v FROM documents),
p AS (SELECT *, lag(v) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM v),
c AS (SELECT *, 1 - CASE WHEN len(list_distinct(list_concat(v, p))) > 0 THEN len(list_intersect(v, p)) / len(list_distinct(list_concat(v, p))) ELSE 0 END AS change_score FROM p WHERE p IS NOT NULL),
result AS (SELECT doc_id, source, change_score, array_to_string(list_sort(list_filter(v, lambda x: NOT list_contains(p, x)))[1:50], ' ') AS new_terms,
  array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(v, x)))[1:50], ' ') AS removed_terms FROM c WHERE change_score >= 0.15)""")
def s28(spark, d):
    x = D.vocabulary_change(docs(spark, d), "source", "doc_id")
    return x.withColumns({"new_terms": F.array_join("new_terms", " "), "removed_terms": F.array_join("removed_terms", " ")})


KEYW = ["the", "le", "und"]


@query("s29_risk_sentiment", "doc_id# risk_score:7", VEC + """, kw AS (SELECT word AS k, vector AS kv FROM vec WHERE word IN ('the', 'le', 'und')),
nr AS (SELECT word, k, list_cosine_similarity(vector::DOUBLE[], kv::DOUBLE[]) AS sim FROM vec, kw WHERE list_cosine_similarity(vector::DOUBLE[], kv::DOUBLE[]) > 0.5 AND NOT isnan(list_cosine_similarity(vector::DOUBLE[], kv::DOUBLE[]))),
ss AS (SELECT doc_id, sim * n / sum(n) OVER (PARTITION BY doc_id) AS s FROM wn LEFT JOIN nr USING (word)),
sz AS (SELECT doc_id, sum(n) AS t FROM wn GROUP BY doc_id), s2 AS (SELECT doc_id, sim * n / t AS s FROM wn JOIN nr USING (word) JOIN sz USING (doc_id)),
tp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS rn FROM s2),
result AS (SELECT doc_id, least(coalesce(sum(CASE WHEN rn <= 20 THEN s END), 0), 1.0) AS risk_score FROM documents LEFT JOIN tp USING (doc_id) GROUP BY doc_id)""")
def s29(spark, d):
    v = durable(vectors(spark, d))
    return T.risk_sentiment(docs(spark, d), v, v.where(C("word").isin(KEYW)), "doc_id")


@query("s30_word2vec", "word size#")
def s30(spark, d):
    m = P.word2vec(docs(spark, d), size=16, least=50)
    return m.getVectors().select("word", F.size(vector_to_array("vector")).alias("size"))


CENT = """ce AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
cm AS (SELECT label AS qid, list(v ORDER BY i) AS qvec FROM ce GROUP BY label)"""


def centroids(spark, d):
    e = table(spark, d, "embeddings")
    g = e.groupBy(C("label").alias("qid")).agg(*[F.avg(C("embedding")[i].cast("double")).alias(f"v{i}") for i in range(DIM)])
    return g.select("qid", F.array(*[F.col(f"v{i}") for i in range(DIM)]).alias("qvec"))


@query("s32_similar_words", "qid cid similarity:6 place#", VEC + """, q AS (SELECT word AS qid, vector AS qvec FROM vec WHERE word IN ('the', 'le')),
x AS (SELECT qid, word AS cid, list_cosine_similarity(qvec::DOUBLE[], vector::DOUBLE[]) AS similarity FROM q, vec WHERE word <> qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(similarity, 9) DESC, cid) AS place FROM x),
result AS (SELECT * FROM r WHERE place <= 10)""")
def s32(spark, d):
    v = durable(vectors(spark, d))
    q = v.where(C("word").isin("the", "le")).select(C("word").alias("qid"), C("vector").alias("qvec"))
    return T.nearest(q, v.select(C("word").alias("cid"), C("vector").alias("cvec")), 10, exclude_self=True)


@query("s32_analogy", "qid cid similarity:6 place#")
def s32b(spark, d):
    v = durable(vectors(spark, d))
    return T.nearest(T.analogy(v, "the", "le", "und"), v.select(C("word").alias("cid"), C("vector").alias("cvec")), 5)


@query("s33_semantic_search", "qid# cid# similarity:6 place#", CENT + """,
x AS (SELECT qid, vec_id AS cid, list_cosine_similarity(qvec, embedding::DOUBLE[]) AS similarity FROM cm, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(similarity, 9) DESC, cid) AS place FROM x), result AS (SELECT * FROM r WHERE place <= 10)""")
def s33(spark, d):
    corpus = table(spark, d, "embeddings").select(C("vec_id").alias("cid"), C("embedding").alias("cvec"))
    return T.nearest(centroids(spark, d), corpus, 10)


@query("s34_cluster_embeddings", "vec_id# cluster#")
def s34(spark, d):
    e = durable(table(spark, d, "embeddings").select("vec_id", array_to_vector(C("embedding").cast("array<double>")).alias("features")))
    return KMeans(k=5, seed=3, featuresCol="features", predictionCol="cluster").fit(e).transform(e)


@query("s35_lda_topics", "topic# place# word weight:6")
def s35(spark, d):
    m, vocab, _, _ = P.lda(docs(spark, d), k=5, iterations=5)
    return P.topic_words(m, vocab, 10)


@query("s35_lda_weights", "doc_id# topic# weight:6")
def s35b(spark, d):
    _, _, x, _ = P.lda(docs(spark, d), k=5, iterations=5)
    return x.select("doc_id", F.posexplode("topics").alias("topic", "weight"))


@query("s36_lsi", "component# value:4 ratio:4")
def s36(spark, d):
    return P.lsi(docs(spark, d), "doc_id")[0]


@query("s36_lsi_words", "component# place# term weight:4")
def s36b(spark, d):
    return P.lsi_words(P.lsi(docs(spark, d), "doc_id")[1])


@query("s36_lsi_documents", "doc_id# component# weight:4")
def s36c(spark, d):
    return P.lsi(docs(spark, d), "doc_id")[2]


WORDS = 40  # so few terms that every singular value can be asked for

LSI = rf"""l AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM documents), tf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM l) GROUP BY 1, 2),
v AS (SELECT term, sum(n) AS total, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.8 * (SELECT count(*) FROM documents) ORDER BY total DESC, term LIMIT {WORDS}),
wt AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term)),
wl AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM wt),
gm AS (SELECT a.term AS i, b.term AS j, sum(a.w * b.w) AS g FROM wl a JOIN wl b USING (doc_id) GROUP BY 1, 2)"""


@query("s36_lsi_identities", "components# total:5 squares:3 documents:5 ratio:6", LSI + """,
result AS (SELECT (SELECT count(*) FROM v) AS components, sum(g) FILTER (i = j) AS total, sum(g * g) AS squares, sum(g) FILTER (i = j) AS documents, 1.0 AS ratio FROM gm)""")
def s36d(spark, d):
    """With all components: squared singular values add up to the squared weights, their squares to the Gram matrix, and both sides agree."""
    t, _, x = P.lsi(docs(spark, d), "doc_id", WORDS, max_features=WORDS, ngrams=(1, 1))
    v = t.agg(F.count("*").alias("components"), F.sum(C("value") ** 2).alias("total"), F.sum(C("value") ** 4).alias("squares"), F.sum("ratio").alias("ratio"))
    return v.join(x.agg(F.sum(C("weight") ** 2).alias("documents")))


# Topic weights with a plain definition, so that the topic tables can be compared: the share of a document's words by length class.
TOPIC = TOKENS + """, tw0 AS (SELECT doc_id, length(w) % 4 AS topic, count(*) AS n FROM (SELECT doc_id, unnest(t) AS w FROM tk) GROUP BY 1, 2),
dn AS (SELECT doc_id, len(t) AS total FROM tk WHERE len(t) > 0), tg AS (SELECT doc_id, topic, total FROM dn, (VALUES (0), (1), (2), (3)) x(topic)),
tw AS (SELECT doc_id, topic, coalesce(n, 0) / total AS weight FROM tg LEFT JOIN tw0 USING (doc_id, topic))"""


def topic_weights(spark, d):
    t = docs(spark, d).withColumn("t", D.tokens("text")).where(F.size("t") > 0)
    of = lambda k: lambda w: F.length(w) % 4 == k
    share = [F.struct(F.lit(k).alias("topic"), (F.size(F.filter("t", of(k))) / F.size("t")).alias("weight")) for k in range(4)]
    return t.select("doc_id", F.inline(F.array(*share)))


TOPW = TOKENS + """, wc AS (SELECT length(w) % 4 AS topic, w AS word, count(*) AS n FROM (SELECT unnest(t) AS w FROM tk) GROUP BY 1, 2),
tp AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) - 1 AS place FROM wc QUALIFY place < 8)"""


def top_words(spark, d):
    from pyspark.sql import Window
    w = docs(spark, d).select(F.explode(D.tokens("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).withColumn("topic", F.length("word") % 4)
    rn = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "word")) - 1
    return w.withColumn("place", rn).where("place < 8")


@query("s37_topic_coherence", "topic# coherence:6", TOPW + """, dw AS (SELECT DISTINCT doc_id, unnest(t) AS word FROM tk), df AS (SELECT word, count(*) AS d FROM dw GROUP BY word),
pr AS (SELECT a.topic, a.word AS wi, b.word AS wj FROM tp a JOIN tp b ON a.topic = b.topic AND b.place < a.place),
co AS (SELECT p.topic, p.wi, p.wj, count(y.doc_id) AS co FROM pr p JOIN dw x ON x.word = p.wi LEFT JOIN dw y ON y.word = p.wj AND y.doc_id = x.doc_id GROUP BY 1, 2, 3),
result AS (SELECT topic, avg(ln((co + 1) / d)) AS coherence FROM co JOIN df ON df.word = wj GROUP BY topic)""")
def s37(spark, d):
    pairs = docs(spark, d).select("doc_id", F.explode(F.array_distinct(D.tokens("text"))).alias("term"))
    return P.coherence(durable(top_words(spark, d).select("topic", "place", "word")), pairs, "doc_id")


@query("s38_topic_count", "k# log_perplexity:4")
def s38(spark, d):
    return P.choose_topics(docs(spark, d), [2, 4], 3)


@query("s39_dominant_topic", "doc_id# topic# weight:8", TOPIC + ", result AS (SELECT doc_id, arg_max(topic, weight * 1000000 - topic) AS topic, max(weight) AS weight FROM tw GROUP BY doc_id)")
def s39(spark, d):
    return P.dominant(topic_weights(spark, d), "doc_id")


@query("s39_topic_trends", "topic# corr:6 trend avg_weight:8 max_weight:8 min_weight:8", TOPIC + """, p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS pos FROM tw),
g AS (SELECT topic, corr(pos, weight) AS corr, avg(weight) AS avg_weight, max(weight) AS max_weight, min(weight) AS min_weight FROM p GROUP BY topic),
result AS (SELECT *, CASE WHEN corr > 0.1 THEN 'increasing' WHEN corr < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM g)""")
def s39b(spark, d):
    return P.trends(topic_weights(spark, d), "doc_id")


@query("s40_topic_shifts", "doc_id# old_topic# new_topic# magnitude:6", TOPIC + """, w AS (SELECT doc_id, topic, avg(weight) OVER (PARTITION BY topic ORDER BY doc_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS p,
  avg(weight) OVER (PARTITION BY topic ORDER BY doc_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS rn FROM tw),
g AS (SELECT doc_id, arg_max(topic, round(p, 12) * 1e9 - topic) AS old_topic, arg_max(topic, round(c, 12) * 1e9 - topic) AS new_topic, sqrt(sum((c - p) * (c - p))) AS magnitude FROM w WHERE rn > 4 GROUP BY doc_id),
result AS (SELECT * FROM g WHERE old_topic <> new_topic AND magnitude > 0.05)""")
def s40(spark, d):
    return P.shifts(topic_weights(spark, d), "doc_id", threshold=0.05)


@query("s41_topic_sentiment", "topic# avg_sentiment:8 variance:8 documents# weighted_sentiment:8", TOPIC + f""", sc AS (SELECT doc_id, len(t) AS m, len(list_filter(t, lambda w: w IN ({PL}))) AS p, len(list_filter(t, lambda w: w IN ({NL}))) AS n FROM tk),
se AS (SELECT doc_id, CASE WHEN m > 0 THEN (p - n) / m ELSE 0 END AS score FROM sc), dm AS (SELECT doc_id, arg_max(topic, weight * 1000000 - topic) AS topic, max(weight) AS weight FROM tw GROUP BY doc_id),
result AS (SELECT topic, avg(score) AS avg_sentiment, var_pop(score) AS variance, count(*) AS documents, sum(score * weight) / sum(weight) AS weighted_sentiment FROM dm JOIN se USING (doc_id) GROUP BY topic)""")
def s41(spark, d):
    return P.topic_sentiment(topic_weights(spark, d), scored(spark, d).select("doc_id", "score"), "doc_id")


CMP = TOKENS + """, lw AS (SELECT lang, length(w) % 4 AS topic, w AS word, count(*)::DOUBLE AS weight FROM (SELECT lang, unnest(t) AS w FROM tk) GROUP BY 1, 2, 3)"""


@query("s42_topic_similarity", "lang_a lang_b a# b# similarity:8", CMP + """,
q AS (SELECT lang, topic, sum(weight * weight) AS q FROM lw GROUP BY ALL),
dt AS (SELECT a.lang AS lang_a, b.lang AS lang_b, a.topic AS a, b.topic AS b, sum(a.weight * b.weight) AS dot FROM lw a JOIN lw b ON a.word = b.word AND a.lang < b.lang GROUP BY ALL),
result AS (SELECT x.lang AS lang_a, y.lang AS lang_b, x.topic AS a, y.topic AS b, coalesce(dot, 0) / sqrt(x.q * y.q) AS similarity FROM q x JOIN q y ON x.lang < y.lang
  LEFT JOIN dt ON dt.lang_a = x.lang AND dt.lang_b = y.lang AND dt.a = x.topic AND dt.b = y.topic)""")
def s42(spark, d):
    w = docs(spark, d).select("lang", F.explode(D.tokens("text")).alias("word")).groupBy("lang", "word").agg(F.count("*").cast("double").alias("weight"))
    w = durable(w.withColumn("topic", F.length("word") % 4))
    return P.compare_topic_sets(w.where("lang is not null"), "lang")


@query("s43_topic_evolution", "source topic_0:8 topic_1:8 topic_2:8 topic_3:8", TOPIC + ", result AS (SELECT source, " + ", ".join(
    f"avg(CASE WHEN topic = {i} THEN weight END) AS topic_{i}" for i in range(4)) + " FROM tw JOIN documents USING (doc_id) GROUP BY source)")
def s43(spark, d):
    w = topic_weights(spark, d).join(docs(spark, d).select("doc_id", "source"), "doc_id")
    return P.evolution(w, "source", [0, 1, 2, 3])


@query("s43_rolling_evolution", "period# topic_0:8 topic_1:8 topic_2:8 topic_3:8", TOPIC + ", e AS (SELECT doc_id // 50 AS period, " + ", ".join(
    f"avg(CASE WHEN topic = {i} THEN weight END) AS topic_{i}" for i in range(4)) + " FROM tw GROUP BY 1), result AS (SELECT period, " + ", ".join(
    f"avg(topic_{i}) OVER (ORDER BY period ROWS 2 PRECEDING) AS topic_{i}" for i in range(4)) + " FROM e)")
def s43b(spark, d):
    w = topic_weights(spark, d).withColumn("period", F.floor(F.col("doc_id") / 50))
    return P.rolling_evolution(w, "period", [0, 1, 2, 3])


@query("s43_document_topics", "doc_id# topic_0:8 topic_1:8 topic_2:8 topic_3:8", TOPIC + ", result AS (SELECT doc_id, " + ", ".join(
    f"sum(CASE WHEN topic = {i} THEN weight END) AS topic_{i}" for i in range(4)) + " FROM tw GROUP BY doc_id)")
def s43c(spark, d):
    return P.topic_frame(topic_weights(spark, d), "doc_id", [0, 1, 2, 3])


@query("s31_vector_file", "word first:6 size#", VEC + """, result AS (SELECT word, vector[1] AS first, len(vector) AS size FROM vec)""")
def s31(spark, d):
    from ..session import scratch_folder
    out = scratch_folder(spark, "vectors")
    v = vectors(spark, d)
    v.select(F.concat_ws(" ", "word", F.array_join(C("vector").cast("array<string>"), " "))).write.text(out)
    return T.read_vectors(spark, out).select("word", C("vector")[0].alias("first"), F.size("vector").alias("size"))
