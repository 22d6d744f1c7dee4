"""Portfolio statistics."""

from pyspark.sql import functions as F

from ..operators import portfolio as P
from ..session import durable
from .family_k import weights
from .inputs import RETURNS, returns
from .registry import query

# log-size returns keep the products of the test prices in a sane range
LR = RETURNS + """,
lr AS (SELECT symbol, ts, ln(1 + ret) AS ret FROM rets),
cv AS (SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, covar_samp(a.ret, b.ret) AS cov, corr(a.ret, b.ret) AS corr
  FROM lr a JOIN lr b ON a.ts = b.ts GROUP BY 1, 2),
pw AS (SELECT 'P' || (o_custkey % 5) AS portfolio, p_brand AS symbol, sum(l_quantity) AS q FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#3' GROUP BY 1, 2),
wt AS (SELECT portfolio, symbol, q / sum(q) OVER (PARTITION BY portfolio) AS w FROM pw),
mg AS (SELECT portfolio, symbol, any_value(w.w) AS w, sum(v.w * cov) AS marginal FROM wt w JOIN cv ON w.symbol = cv.a
  JOIN (SELECT portfolio, symbol AS b, w FROM wt) v USING (portfolio, b) GROUP BY portfolio, symbol)"""


def log_returns(spark, d):
    return returns(spark, d).withColumn("ret", F.log1p("ret"))


@query("l01_covariance", "a b n# cov:6 corr:6", LR + ", result AS (SELECT * FROM cv WHERE a <= b)")
def l01(spark, d):
    return P.covariance(log_returns(spark, d))


def parts(spark, d):
    r = durable(log_returns(spark, d))
    return r, durable(weights(spark, d)[0]), durable(P.covariance(r))


@query("l02_portfolio_stats", "portfolio ret:6 risk:6 sharpe:6", LR + """, mu AS (SELECT symbol, avg(ret) AS mu FROM lr GROUP BY symbol),
result AS (SELECT portfolio, sum(w * mu) AS ret, sqrt(sum(w * marginal)) AS risk, sum(w * mu) / sqrt(sum(w * marginal)) AS sharpe FROM mg JOIN mu USING (symbol) GROUP BY portfolio)""")
def l02(spark, d):
    r, w, cov = parts(spark, d)
    return P.portfolio_stats(w, r.groupBy("symbol").agg(F.avg("ret").alias("mu")), cov)


@query("l03_frontier_search", "bucket# portfolio# ret:6 risk:6 sharpe:6 max_sharpe min_variance")
def l03(spark, d):
    r, _, cov = parts(spark, d)
    means = r.groupBy("symbol").agg(F.avg("ret").alias("mu"))
    return P.frontier(durable(P.portfolio_stats(P.candidates(spark, means, 500), means, cov)), 20)


@query("l04_risk_contribution", "portfolio symbol contribution:8 share:6", LR + """, result AS (
  SELECT portfolio, symbol, w * marginal AS contribution, w * marginal / sum(w * marginal) OVER (PARTITION BY portfolio) AS share FROM mg)""")
def l04(spark, d):
    _, w, cov = parts(spark, d)
    return P.risk_contribution(w, cov)


@query("l05_inverse_volatility", "symbol w:8", LR + """, v AS (SELECT symbol, 1 / stddev_samp(ret) AS i FROM lr GROUP BY symbol),
result AS (SELECT symbol, i / sum(i) OVER () AS w FROM v)""")
def l05(spark, d):
    return P.inverse_volatility(log_returns(spark, d))


@query("l06_diversification_ratio", "portfolio ratio:6", LR + """, sd AS (SELECT a AS symbol, sqrt(cov) AS sd FROM cv WHERE a = b),
result AS (SELECT portfolio, sum(w * sd) / sqrt(sum(w * marginal)) AS ratio FROM mg JOIN sd USING (symbol) GROUP BY portfolio)""")
def l06(spark, d):
    _, w, cov = parts(spark, d)
    return P.diversification_ratio(w, cov)
