"""Machine learning."""

from pyspark.sql import functions as F

from ..core.slices import over_rows
from ..models import evaluation as V
from ..models import learning as M
from ..operators import indicators as I
from ..operators import portfolio as P
from ..session import durable
from .family_l import LR, log_returns
from .inputs import BARS, bars, table
from .registry import query

C = F.col
XS = ["r1", "r5", "vol_ratio"]


def frame(spark, d):
    """Lagged returns and volume ratio with the next direction and return."""
    c = F.col("close")
    f = lambda x, w: x.withColumns({"r1": F.log(c / F.lag(c, 1).over(w)), "r5": F.log(c / F.lag(c, 5).over(w)), "vol_ratio": c * 0 + C("volume") / I.mean("volume", 20, w),
                                    "next": F.log(F.lead(c, 1).over(w) / c)})
    d = over_rows(bars(spark, d), f, back=20, ahead=1).select("symbol", "ts", *XS, "next")
    return durable(d.withColumn("up", F.when(C("next") > 0, 1.0).when(C("next").isNotNull(), 0.0)))


@query("r01_random_forest", "symbol ts! up:1 prediction:1")
def r01(spark, d):
    f = frame(spark, d)
    m = M.fit(f, "up", XS, "forest", numTrees=10, maxDepth=5)
    return M.predict(m, f, XS, ["symbol", "ts"])


@query("r02_gradient_boosting", "symbol ts! next:6 prediction:4")
def r02(spark, d):
    f = frame(spark, d)
    m = M.fit(f, "next", XS, "boosting", "regression", maxIter=5, maxDepth=3)
    return M.predict(m, f, XS, ["symbol", "ts"])


@query("r03_parameter_grid", "params score:6 std:6")
def r03(spark, d):
    return M.tune(frame(spark, d), "next", XS, ["ts", "symbol"], {"maxDepth": [2, 3], "maxIter": [3]}, folds=3)


FOLDS = BARS + """, p AS (SELECT symbol, ts, row_number() OVER (ORDER BY ts, symbol) - 1 AS pos, count(*) OVER () AS n FROM bars),
b AS (SELECT *, n // 6 AS b, n - 5 * (n // 6) AS f0 FROM p), k AS (SELECT *, CASE WHEN pos < f0 THEN 0 ELSE (pos - f0) // b + 1 END AS k FROM b),
fo AS (SELECT symbol, ts, fold, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS role FROM k, range(1, 6) r(fold) WHERE fold >= greatest(k, 1))"""


@query("r04_time_folds", "fold# role n# first_ts! last_ts!", FOLDS + ", result AS (SELECT fold, role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM fo GROUP BY fold, role)")
def r04(spark, d):
    f = V.time_folds(bars(spark, d).select("symbol", "ts"), ["ts", "symbol"])
    return f.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("r04_cross_validation", "fold# accuracy:6 weighted_f1:6")
def r04b(spark, d):
    return M.cross_validate(frame(spark, d), "up", XS, ["ts", "symbol"], folds=3, numTrees=5, maxDepth=4)


@query("r05_classification_metrics", "accuracy:8 weighted_precision:8 weighted_recall:8 weighted_f1:8", """
c AS (SELECT l.c, count(CASE WHEN quality = l.c THEN 1 END) AS act, count(CASE WHEN toxic = l.c THEN 1 END) AS pred, count(CASE WHEN quality = l.c AND toxic = l.c THEN 1 END) AS hit FROM labels, (VALUES (0), (1)) l(c) GROUP BY l.c),
result AS (SELECT sum(hit) / sum(act) AS accuracy, sum(CASE WHEN pred > 0 THEN hit / pred ELSE 0 END * act) / sum(act) AS weighted_precision, sum(CASE WHEN act > 0 THEN hit / act ELSE 0 END * act) / sum(act) AS weighted_recall,
  sum(2 * hit / (pred + act) * act) / sum(act) AS weighted_f1 FROM c)""")
def r05(spark, d):
    return V.classification_metrics(table(spark, d, "labels"), "quality", "toxic")


@query("r05_regression_metrics", "symbol rmse:6 mae:6 r2:6", BARS + """, e AS (SELECT symbol, ln(close) AS y, ln(open) AS p FROM bars),
result AS (SELECT symbol, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY symbol)""")
def r05b(spark, d):
    return V.regression_metrics(bars(spark, d).select("symbol", F.log("close").alias("label"), F.log("open").alias("prediction")), by=["symbol"])


@query("r06_prediction_mask", "missing# predicted#")
def r06(spark, d):
    f = frame(spark, d)
    p = M.predict(M.fit(f, "up", XS, "forest", numTrees=5, maxDepth=3), f, XS, ["symbol", "ts"])
    return p.agg(F.count_if(C("prediction").isNull()).alias("missing"), F.count("prediction").alias("predicted"))


@query("r08_feature_importance", "feature forest:6 boosting:6 mean:6")
def r08(spark, d):
    f = frame(spark, d)
    models = {"forest": M.fit(f, "up", XS, "forest", numTrees=10, maxDepth=5), "boosting": M.fit(f, "up", XS, "boosting", maxIter=3, maxDepth=3)}
    return M.importances(spark, models, XS)


@query("r09_ensemble", "symbol ts! ensemble:9", BARS + """, p AS (SELECT symbol, ts, volume / 50 AS a, CASE WHEN volume % 5 <> 0 THEN 1 - volume / 50 END AS b, 1.0 / volume AS c FROM bars),
result AS (SELECT symbol, ts, (a + b + c) / 3 AS ensemble FROM p)""")
def r09(spark, d):
    v = C("volume")
    b = bars(spark, d).withColumns({"a": v / 50, "b": F.when(v % 5 != 0, 1 - v / 50), "c": 1.0 / v})
    return V.blend_predictions(b, {"a": 1.0, "b": 1.0, "c": 1.0})


def daily(spark, d):
    """Log returns of every brand on every day it trades."""
    return durable(log_returns(spark, d))


@query("r10_market_pca", "component# ratio:6 cumulative:6 needed_95")
def r10(spark, d):
    return M.variance_table(M.market_pca(daily(spark, d), 5)[2])


SIZE = 25  # brands of the tables: with as many components the whole matrix is decomposed


@query("r10_pca_identities", "components# total:8 squares:8 negative", LR + """,
t AS (SELECT count(*) AS components, sum(cov) AS total FROM cv WHERE a = b),
result AS (SELECT components, total, (SELECT sum(cov * cov) FROM cv) AS squares, false AS negative FROM t)""")
def r10b(spark, d):
    """Eigenvalues of all components add up to the trace, their squares to the sum of squared covariances."""
    r = M.market_pca(daily(spark, d), SIZE)[2]
    return r.agg(F.count("*").alias("components"), F.sum("value").alias("total"), F.sum(C("value") * C("value")).alias("squares"), (F.min("value") < -1e-3).alias("negative"))


@query("r10_orthonormal_loadings", "i# j# dot:6", "result AS (SELECT a.range AS i, b.range AS j, CASE WHEN a.range = b.range THEN 1.0 ELSE 0.0 END AS dot FROM range(5) a, range(5) b)")
def r10c(spark, d):
    v = M.market_pca(daily(spark, d), 5)[1]
    a, b = v.select("symbol", C("component").alias("i"), C("loading").alias("_a")), v.select("symbol", C("component").alias("j"), C("loading").alias("_b"))
    return a.join(b, "symbol").groupBy("i", "j").agg(F.sum(C("_a") * C("_b")).alias("dot"))


@query("r11_eigenportfolios", "component# symbol w:6")
def r11(spark, d):
    return M.eigenportfolios(M.market_pca(daily(spark, d), 3)[1])


@query("r12_reconstruction", "ts! symbol value:6")
def r12(spark, d):
    r = daily(spark, d)
    s, l, _, m = M.market_pca(r, 5)
    return M.reconstruct(s, l, m, 3, panel=r)


@query("r13_factor_attribution", "symbol ts! factor_return:6 specific_return:6")
def r13(spark, d):
    r = daily(spark, d)
    return M.attribution(r, M.factor_returns(M.market_pca(r, 3)[0]))


@query("r14_variance_decomposition", "symbol total:6 factor_pct:4 specific_pct:4 specific_risk:6")
def r14(spark, d):
    r = daily(spark, d)
    return M.variance_decomposition(M.attribution(r, M.factor_returns(M.market_pca(r, 3)[0])))


@query("r15_factor_timing", "ts! f1:6 signal:1")
def r15(spark, d):
    return M.factor_timing(M.factor_returns(M.market_pca(daily(spark, d), 3)[0]))


@query("r16_rolling_exposure", "window_end! component# symbol loading:5 ratio:5")
def r16(spark, d):
    return M.rolling_exposure(daily(spark, d))


for _m in ("kmeans", "gmm", "hierarchical"):
    query(f"r17_cluster_{_m}", "symbol cluster#")(lambda spark, d, m=_m: M.cluster(durable(M.asset_vectors(log_returns(spark, d), dims=5 if m == "gmm" else None)), 4, m))


@query("r18_dbscan", "vec_id# cluster#")
def r18(spark, d):
    e = table(spark, d, "embeddings")
    return M.dbscan(e.select("vec_id", C("embedding").alias("x")), 0.8, 5, cells=3)


@query("r19_choose_k", "k# silhouette:4 cost:4")
def r19(spark, d):
    return M.choose_k(M.asset_vectors(log_returns(spark, d)), [2, 3, 4])


LAB = LR + ", lb AS (SELECT DISTINCT symbol, CAST(substr(symbol, 7) AS INT) % 4 AS cluster FROM lr)"


def labels(r):
    return r.select("symbol").distinct().withColumn("cluster", F.substring("symbol", 7, 9).cast("int") % 4)


@query("r20_cluster_summary", "cluster# n# mean_return:5 mean_volatility:5 sharpe:6 names", LAB + """, a AS (SELECT symbol, avg(ret) * 252 AS r, stddev_samp(ret) * sqrt(252) AS v FROM lr GROUP BY symbol),
j AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY symbol) AS rn FROM a JOIN lb USING (symbol)),
result AS (SELECT cluster, count(*) AS n, avg(r) AS mean_return, avg(v) AS mean_volatility, avg(r) / avg(v) AS sharpe, string_agg(CASE WHEN rn <= 5 THEN symbol END, ' ' ORDER BY symbol) AS names FROM j GROUP BY cluster)""")
def r20(spark, d):
    r = durable(log_returns(spark, d))
    return M.cluster_summary(r, labels(r))


@query("r20_cluster_correlation", "ca# cb# corr:6", LAB + ", result AS (SELECT x.cluster AS ca, y.cluster AS cb, avg(corr) AS corr FROM cv JOIN lb x ON x.symbol = a JOIN lb y ON y.symbol = b GROUP BY 1, 2)")
def r20b(spark, d):
    r = durable(log_returns(spark, d))
    return M.cluster_correlation(durable(P.covariance(r)), durable(labels(r)))


@query("r21_distribution_check", "symbol ks:8 mean_gap:6 std_gap:6", BARS + """, re AS (SELECT symbol, ln(close) AS v FROM bars), sy AS (SELECT symbol, ln(open) + 0.1 AS v FROM bars WHERE volume % 2 = 0),
u AS (SELECT symbol, v, sum(r) AS nr, sum(1 - r) AS ns FROM (SELECT symbol, v, 1 AS r FROM re UNION ALL SELECT symbol, v, 0 FROM sy) GROUP BY symbol, v),
c AS (SELECT symbol, sum(nr) OVER (PARTITION BY symbol ORDER BY v) / sum(nr) OVER (PARTITION BY symbol) AS a, sum(ns) OVER (PARTITION BY symbol ORDER BY v) / sum(ns) OVER (PARTITION BY symbol) AS b FROM u),
k AS (SELECT symbol, max(abs(a - b)) AS ks FROM c GROUP BY symbol), m AS (SELECT symbol, avg(v) AS m, stddev_samp(v) AS s FROM re GROUP BY symbol), n AS (SELECT symbol, avg(v) AS m, stddev_samp(v) AS s FROM sy GROUP BY symbol),
result AS (SELECT symbol, ks, abs(m.m - n.m) AS mean_gap, abs(m.s - n.s) AS std_gap FROM k JOIN m USING (symbol) JOIN n USING (symbol))""")
def r21(spark, d):
    b = bars(spark, d)
    return M.ks_statistic(durable(b.select("symbol", F.log("close").alias("v"))), durable(b.where("volume % 2 = 0").select("symbol", (F.log("open") + 0.1).alias("v"))), ["symbol"], "v")


SYN = BARS + """, re AS (SELECT symbol, ln(close) AS v FROM bars), sy AS (SELECT symbol, ln(open) + 0.1 AS v FROM bars WHERE volume % 2 = 0),
u AS (SELECT symbol, v, sum(r) AS nr, sum(1 - r) AS ns FROM (SELECT symbol, v, 1 AS r FROM re UNION ALL SELECT symbol, v, 0 FROM sy) GROUP BY symbol, v),
c AS (SELECT symbol, sum(nr) OVER (PARTITION BY symbol ORDER BY v) / sum(nr) OVER (PARTITION BY symbol) AS a, sum(ns) OVER (PARTITION BY symbol ORDER BY v) / sum(ns) OVER (PARTITION BY symbol) AS b FROM u),
k AS (SELECT symbol, max(abs(a - b)) AS ks FROM c GROUP BY symbol), m AS (SELECT symbol, avg(v) AS m, stddev_samp(v) AS s FROM re GROUP BY symbol), n AS (SELECT symbol, avg(v) AS m, stddev_samp(v) AS s FROM sy GROUP BY symbol),
sz AS (SELECT symbol, ks, (SELECT count(*) FROM re WHERE re.symbol = k.symbol) AS a, (SELECT count(*) FROM sy WHERE sy.symbol = k.symbol) AS b FROM k)"""


def real_and_synthetic(spark, d):
    b = bars(spark, d)
    return durable(b.select("symbol", "ts", F.log("close").alias("v"))), durable(b.where("volume % 2 = 0").select("symbol", "ts", (F.log("open") + 0.1).alias("v")))


@query("r21_ks_test", "symbol ks:8 p:6", SYN + """, x AS (SELECT symbol, ks, sqrt(a * b / (a + b)) * ks AS x FROM sz),
result AS (SELECT symbol, ks, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(generate_series(1, 100), lambda i: (CASE WHEN i % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0::DOUBLE * i * i * x * x))), 0), 1) END AS p FROM x)""")
def r21b(spark, d):
    return M.ks_statistic(*real_and_synthetic(spark, d), ["symbol"], "v")


ACF = lambda t: f"(SELECT symbol, i, avg((v - m) * (l - m)) / any_value(q) AS c FROM (SELECT symbol, i, v, lag(v, i) OVER (PARTITION BY symbol, i ORDER BY ts) AS l, avg(v) OVER (PARTITION BY symbol) AS m, var_pop(v) OVER (PARTITION BY symbol) AS q FROM {t}, range(1, 21) r(i)) WHERE l IS NOT NULL GROUP BY symbol, i)"


@query("r21_autocorrelation_gap", "symbol acf_gap:7", BARS + f""", re AS (SELECT symbol, ts, ln(close) AS v FROM bars), sy AS (SELECT symbol, ts, ln(open) + 0.1 AS v FROM bars WHERE volume % 2 = 0),
result AS (SELECT symbol, sum(abs(a.c - b.c)) / 21 AS acf_gap FROM {ACF('re')} a JOIN {ACF('sy')} b USING (symbol, i) GROUP BY symbol)""")
def r21c(spark, d):
    return M.autocorrelation_gap(*real_and_synthetic(spark, d), ["symbol"], "v")


@query("r21_component_gap", "component# variance_gap:6 ks:6 p:6")
def r21d(spark, d):
    r, s = real_and_synthetic(spark, d)
    return M.component_gap(r, s, 5, "v")


@query("r07_model_catalog", "models# model score")
def r07(spark, d):
    from ..session import scratch_folder
    f = frame(spark, d)
    root = scratch_folder(spark, "models")
    for n in (3, 5):
        M.save_model(M.fit(f, "up", XS, "forest", numTrees=n, maxDepth=3), f"{root}/forest{n}", {"model": f"forest{n}", "score": str(n)})
    c = M.model_catalog(spark, root)
    return c.join(c.agg(F.count("*").alias("models"))).select("models", c.metadata["model"].alias("model"), c.metadata["score"].alias("score"))
