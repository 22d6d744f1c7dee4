"""Statistical models on panels."""

from pyspark.sql import functions as F

from ..models import regression as R
from ..session import durable
from .family_c import bench
from .family_j import PAIR, pairs
from .family_l import LR, log_returns
from .inputs import BARS, bars
from .registry import query

C = F.col
XS = ["x1", "x2"]
REG = BARS + """,
rg AS (SELECT symbol, ts, ln(close) AS y, ln(open) AS x1, ln(volume) AS x2, CASE WHEN close > open THEN 1.0 ELSE -1.0 END AS dir FROM bars)"""


def reg(spark, d):
    return bars(spark, d).select("symbol", "ts", F.log("close").alias("y"), F.log("open").alias("x1"), F.log("volume").alias("x2"),
                                 F.when(C("close") > C("open"), 1.0).otherwise(-1.0).alias("dir"))


@query("q01_ols", "symbol n# b0:6 b1:6 b2:6 r2:6 adj_r2:6 mse:6", REG + """,
m AS (SELECT symbol, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(y, x1) AS c1, covar_pop(y, x2) AS c2, var_pop(y) AS syy FROM rg GROUP BY symbol),
b AS (SELECT *, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m),
result AS (SELECT symbol, n, my - b1 * m1 - b2 * m2 AS b0, b1, b2, (b1 * c1 + b2 * c2) / syy AS r2, 1 - (1 - (b1 * c1 + b2 * c2) / syy) * (n - 1) / (n - 3) AS adj_r2,
  (syy - b1 * c1 - b2 * c2) * n / (n - 3) AS mse FROM b)""")
def q01(spark, d):
    o = R.ols(reg(spark, d), ["symbol"], "y", XS)
    return o.withColumns({f"b{i}": C("coef")[i] for i in range(3)})


@query("q02_ridge", "feature coefficient:4")
def q02(spark, d):
    _, coef = R.penalised(reg(spark, d), "y", XS, "ridge", [1e-3, 1e-1, 10.0], folds=3)
    return R.importance(spark, XS, coef)


@query("q03_lasso", "feature coefficient:4")
def q03(spark, d):
    _, coef = R.penalised(reg(spark, d), "y", XS, "lasso", [1e-4, 1e-2, 1.0], folds=3)
    return R.importance(spark, XS, coef).where("importance > 0")


@query("q04_direction_classifier", "symbol ts! label:1 prediction:1")
def q04(spark, d):
    return R.direction_classifier(reg(spark, d), "dir", XS)[1]


@query("q05_importance", "feature importance:4")
def q05(spark, d):
    m, _ = R.direction_classifier(reg(spark, d), "dir", XS)
    return R.importance(spark, XS, m.coefficients)


CAPM = LR + ", bm AS (SELECT ts, avg(ret) AS bench_ret FROM lr GROUP BY ts), cj AS (SELECT symbol, ts, ret, bench_ret FROM lr JOIN bm USING (ts))"


def capm_panel(spark, d):
    r = log_returns(spark, d)
    return r.join(r.groupBy("ts").agg(F.avg("ret").alias("bench_ret")), "ts")


@query("q06_capm", "symbol n# beta:6 alpha:6 r2:6 beta_t:5 alpha_t:5", CAPM + """,
g AS (SELECT symbol, count(*) AS n, regr_slope(ret, bench_ret) AS beta, regr_intercept(ret, bench_ret) AS alpha, regr_r2(ret, bench_ret) AS r2, regr_sxx(ret, bench_ret) AS sxx, regr_syy(ret, bench_ret) AS syy, avg(bench_ret) AS mx FROM cj GROUP BY symbol),
result AS (SELECT *, beta / sqrt((1 - r2) * syy / (n - 2) / sxx) AS beta_t, alpha / sqrt((1 - r2) * syy / (n - 2) * (1.0::DOUBLE / n + mx * mx / sxx)) AS alpha_t FROM g)""")
def q06(spark, d):
    return R.capm(capm_panel(spark, d))


@query("q07_factor_model", "symbol n# alpha:6 b1:6 b2:6 b3:6 r2:6")
def q07(spark, d):
    b = durable(bars(spark, d))
    f = b.groupBy("ts").agg(F.avg(F.log("close")).alias("f1"), F.avg(F.log("volume")).alias("f2"), F.stddev_samp(F.log("close")).alias("f3"))
    o = R.factor_model(log_returns(spark, d), f.na.drop(), ["f1", "f2", "f3"])
    return o.withColumns({"alpha": C("coef")[0], **{f"b{i}": C("coef")[i] for i in (1, 2, 3)}})


@query("q08_fama_macbeth", "factor premium:6 t:5 dates#", CAPM + """,
b AS (SELECT symbol, regr_slope(ret, bench_ret) AS beta FROM cj GROUP BY symbol),
s AS (SELECT ts, regr_slope(ret, beta) AS l1, regr_intercept(ret, beta) AS l0 FROM cj JOIN b USING (symbol) GROUP BY ts HAVING count(*) >= 3),
result AS (SELECT 'const' AS factor, avg(l0) AS premium, avg(l0) / (stddev_samp(l0) / sqrt(count(*))) AS t, count(*) AS dates FROM s
  UNION ALL SELECT 'bench_ret', avg(l1), avg(l1) / (stddev_samp(l1) / sqrt(count(*))), count(*) FROM s)""")
def q08(spark, d):
    return R.fama_macbeth(durable(capm_panel(spark, d)), ["bench_ret"])


EG = BARS + """, lp AS (SELECT symbol, ts, ln(close) AS v FROM bars),
pp AS (SELECT a.symbol AS a, b.symbol AS b, a.ts, a.v AS y, b.v AS x FROM lp a JOIN lp b ON a.ts = b.ts AND a.symbol < b.symbol),
h AS (SELECT a, b, regr_slope(y, x) AS hedge, regr_intercept(y, x) AS i0 FROM pp GROUP BY a, b HAVING count(*) >= 50),
e AS (SELECT a, b, ts, y - i0 - hedge * x AS e, hedge FROM pp JOIN h USING (a, b)),
l AS (SELECT a, b, hedge, e - lag(e) OVER w AS d, lag(e) OVER w AS l, lag(e) OVER w - lag(e, 2) OVER w AS d1 FROM e WINDOW w AS (PARTITION BY a, b ORDER BY ts)),
g0 AS (SELECT a, b, any_value(hedge) AS hedge, count(d1) AS n, sum(l * l) FILTER (d1 IS NOT NULL) AS s11, sum(d1 * d1) AS s22, sum(l * d1) AS s12, sum(d * l) FILTER (d1 IS NOT NULL) AS c1, sum(d * d1) AS c2,
  sum(d * d) FILTER (d1 IS NOT NULL) AS syy, 1 + regr_slope(d, l) AS phi FROM l GROUP BY a, b),
g1 AS (SELECT *, s11 * s22 - s12 * s12 AS det, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS slope, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM g0),
eg AS (SELECT *, slope / sqrt((syy - slope * c1 - b2 * c2) / (n - 2) * s22 / det) AS statistic, CASE WHEN phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END AS hl FROM g1)"""


def panel(spark, d):
    return bars(spark, d).select("symbol", "ts", F.log("close").alias("v"))


@query("q09_engle_granger", "a b n# hedge:6 statistic:5 cointegrated", EG + ", result AS (SELECT *, statistic < -3.3377 AS cointegrated FROM eg)")
def q09(spark, d):
    return R.engle_granger(durable(panel(spark, d)), "v")


@query("q10_unit_root", "symbol n# slope:6 statistic:5 stationary", BARS + """,
l AS (SELECT symbol, ln(close) - lag(ln(close)) OVER w AS d, lag(ln(close)) OVER w AS l, lag(ln(close)) OVER w - lag(ln(close), 2) OVER w AS d1 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
g AS (SELECT symbol, count(*) AS n, var_pop(l) AS s11, var_pop(d1) AS s22, covar_pop(l, d1) AS s12, covar_pop(d, l) AS c1, covar_pop(d, d1) AS c2, var_pop(d) AS syy FROM l WHERE d1 IS NOT NULL GROUP BY symbol),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS slope, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM g),
result AS (SELECT symbol, n, slope, slope / sqrt((syy - slope * c1 - b2 * c2) / (n - 3) * s22 / det) AS statistic, slope / sqrt((syy - slope * c1 - b2 * c2) / (n - 3) * s22 / det) < -2.8621 AS stationary FROM b)""")
def q10(spark, d):
    return R.unit_root(panel(spark, d), "v")


KP = BARS + """, m AS (SELECT symbol, ts, ln(close) - avg(ln(close)) OVER (PARTITION BY symbol) AS e FROM bars),
s AS (SELECT symbol, ts, e, sum(e) OVER (PARTITION BY symbol ORDER BY ts) AS s, """ + ", ".join(f"lag(e, {i}) OVER (PARTITION BY symbol ORDER BY ts) AS l{i}" for i in range(1, 13)) + """ FROM m),
kp AS (SELECT symbol, count(*) AS n, sum(s * s) / (count(*) * count(*)) / ((sum(e * e)""" + "".join(f" + 2 * (1 - {i} / 13.0::DOUBLE) * sum(e * l{i})" for i in range(1, 13)) + ") / count(*)) AS statistic FROM s GROUP BY symbol)"


@query("q11_kpss", "symbol n# statistic:6 stationary", KP + ", result AS (SELECT *, statistic < 0.463 AS stationary FROM kp)")
def q11(spark, d):
    return R.kpss(panel(spark, d), "v")


@query("q11_stationarity", "symbol adf kpss verdict")
def q11b(spark, d):
    p = durable(panel(spark, d))
    return R.stationarity(R.unit_root(p, "v"), R.kpss(p, "v"))


@query("q12_spread", "pair ts! hedge:6 spread:6", PAIR + """, h AS (SELECT pair, regr_slope(y, x) AS hedge FROM pairs GROUP BY pair),
result AS (SELECT pair, ts, hedge, y - hedge * x AS spread FROM pairs JOIN h USING (pair))""")
def q12(spark, d):
    return R.spread_frame(pairs(spark, d).drop("spread"))


@query("q13_half_life", "pair phi:6 half_life:5", PAIR + """, l AS (SELECT pair, spread AS e, lag(spread) OVER (PARTITION BY pair ORDER BY ts) AS l FROM pairs),
g AS (SELECT pair, 1 + regr_slope(e - l, l) AS phi FROM l WHERE l IS NOT NULL GROUP BY pair),
result AS (SELECT pair, phi, CASE WHEN phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END AS half_life FROM g)""")
def q13(spark, d):
    h = R.half_life(pairs(spark, d))
    return h.withColumn("half_life", F.when(C("half_life") < float("inf"), C("half_life")))


@query("q14_pair_selection", "a b statistic:5 half_life:5", EG + ", result AS (SELECT a, b, statistic, hl AS half_life FROM eg WHERE statistic < -3.3377 AND hl BETWEEN 0.1 AND 252)")
def q14(spark, d):
    return R.select_pairs(R.engle_granger(durable(panel(spark, d)), "v"), 0.1)


@query("q15_autocorrelation", "symbol lag# autocorr:6", BARS + ", l AS (" + " UNION ALL ".join(
    f"SELECT symbol, {i} AS lag, ln(close) AS v, lag(ln(close), {i}) OVER (PARTITION BY symbol ORDER BY ts) AS l FROM bars" for i in range(1, 41)) + """),
result AS (SELECT symbol, lag, corr(v, l) AS autocorr FROM l WHERE l IS NOT NULL GROUP BY symbol, lag)""")
def q15(spark, d):
    return R.autocorrelation(panel(spark, d), "v")


@query("q16_partial_autocorrelation", "symbol lag# pacf:6")
def q16(spark, d):
    return R.partial_autocorrelation(R.autocorrelation(panel(spark, d), "v"))


@query("q17_decomposition", "symbol ts! trend:6 seasonal:6 resid:6", BARS + """, r AS (SELECT symbol, ts, ln(close) AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS p FROM bars),
t AS (SELECT *, CASE WHEN count(*) OVER f = 21 THEN (sum(v) OVER f - (lag(v, 10) OVER (PARTITION BY symbol ORDER BY ts) + lead(v, 10) OVER (PARTITION BY symbol ORDER BY ts)) / 2) / 20 END AS trend FROM r
  WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
ph AS (SELECT symbol, p % 20 AS ph, avg(v - trend) AS s FROM t GROUP BY 1, 2), se AS (SELECT symbol, ph, s - avg(s) OVER (PARTITION BY symbol) AS seasonal FROM ph),
result AS (SELECT t.symbol, ts, trend, seasonal, v - trend - seasonal AS resid FROM t JOIN se ON se.symbol = t.symbol AND se.ph = t.p % 20)""")
def q17(spark, d):
    return R.decompose(panel(spark, d), "v", 20)


@query("q18_granger", "pair lag# f:5 p:6")
def q18(spark, d):
    return R.granger(pairs(spark, d).select("pair", "ts", "y", "x"))


VAR = BARS + """, w AS (SELECT ts, avg(ln(close)) AS p, avg(ln(volume)) AS v FROM bars GROUP BY ts),
x AS (SELECT ts, p, v, lag(p) OVER (ORDER BY ts) AS x1, lag(v) OVER (ORDER BY ts) AS x2 FROM w),
u AS (SELECT ts, 'p' AS equation, p AS y, x1, x2 FROM x WHERE x1 IS NOT NULL UNION ALL SELECT ts, 'v', v, x1, x2 FROM x WHERE x1 IS NOT NULL),
m AS (SELECT equation, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(y, x1) AS k1, covar_pop(y, x2) AS k2, var_pop(y) AS syy FROM u GROUP BY equation),
b AS (SELECT *, (k1 * s22 - k2 * s12) / (s11 * s22 - s12 * s12) AS c1, (k2 * s11 - k1 * s12) / (s11 * s22 - s12 * s12) AS c2 FROM m),
eq AS (SELECT *, my - c1 * m1 - c2 * m2 AS c0, n * (ln(2 * pi() * (syy - c1 * k1 - c2 * k2)) + 1) + 6 AS aic FROM b)"""


def system(spark, d):
    return bars(spark, d).groupBy("ts").agg(F.avg(F.log("close")).alias("p"), F.avg(F.log("volume")).alias("v"))


@query("q19_var_model", "equation n# c0:6 c1:6 c2:6 aic:4", VAR + ", result AS (SELECT * FROM eq)")
def q19(spark, d):
    return R.var_model(system(spark, d), ["p", "v"], 1).withColumns({f"c{i}": C("coef")[i] for i in range(3)})


@query("q19_var_order", "lags# n# aic:6 bic:6 best")
def q19b(spark, d):
    return R.var_order(system(spark, d), ["p", "v"])


@query("q19_var_residuals", "ts! p_resid:6 v_resid:6", VAR + """,
r AS (SELECT ts, equation, y - c0 - c1 * x1 - c2 * x2 AS e FROM u JOIN eq USING (equation)),
result AS (SELECT ts, max(CASE WHEN equation = 'p' THEN e END) AS p_resid, max(CASE WHEN equation = 'v' THEN e END) AS v_resid FROM r GROUP BY ts)""")
def q19c(spark, d):
    w = durable(system(spark, d))
    return R.var_residuals(w, ["p", "v"], R.var_model(w, ["p", "v"], 1), 1)
