"""Returns, metrics and tearsheets."""

from pyspark.sql import functions as F

from ..operators import metrics as M
from .inputs import BARS, RETURNS, bars, returns
from .registry import query

W = "PARTITION BY symbol ORDER BY ts"
BENCH = RETURNS + ",\nbench AS (SELECT ts, avg(ret) AS bench_ret FROM rets GROUP BY ts)"
JOINED = BENCH + ",\nj AS (SELECT symbol, ts, ret, bench_ret, ret - bench_ret AS x FROM rets JOIN bench USING (ts))"


def bench(spark, d):
    return returns(spark, d).groupBy("ts").agg(F.avg("ret").alias("bench_ret"))


def joined(spark, d):
    r = returns(spark, d)
    return r.join(bench(spark, d), "ts")


@query("c01_simple_return", "symbol ts! ret:8", BARS + f", result AS (SELECT symbol, ts, close / lag(close) OVER ({W}) - 1 AS ret FROM bars)")
def c01(spark, d):
    return M.simple_return(bars(spark, d))


@query("c02_log_return", "symbol ts! log_ret:8", BARS + f", result AS (SELECT symbol, ts, ln(close / lag(close) OVER ({W})) AS log_ret FROM bars)")
def c02(spark, d):
    return M.log_return(bars(spark, d))


@query("c03_cumulative_return", "symbol ts! cum_ret:5", BARS + f""", result AS (
  SELECT symbol, ts, close / first_value(close) OVER ({W}) - 1 AS cum_ret FROM bars
  QUALIFY row_number() OVER ({W}) > 1)""")
def c03(spark, d):
    return M.cumulative_return(returns(spark, d))


@query("c04_annual_volatility", "symbol volatility:8", RETURNS + """, result AS (
  SELECT symbol, stddev_samp(ret) * sqrt(252) AS volatility FROM rets GROUP BY symbol)""")
def c04(spark, d):
    return returns(spark, d).groupBy("symbol").agg(M.annual_volatility().alias("volatility"))


@query("c05_sharpe", "symbol sharpe:8", RETURNS + """, result AS (
  SELECT symbol, avg(ret - 0.05 / 252) / stddev_samp(ret - 0.05 / 252) * sqrt(252) AS sharpe FROM rets GROUP BY symbol)""")
def c05(spark, d):
    return returns(spark, d).groupBy("symbol").agg(M.sharpe().alias("sharpe"))


@query("c06_drawdown", "symbol ts! peak:4 drawdown:8", BARS + f""", result AS (
  SELECT symbol, ts, max(close) OVER ({W}) AS peak, (close - max(close) OVER ({W})) / max(close) OVER ({W}) AS drawdown FROM bars)""")
def c06(spark, d):
    return M.drawdown(bars(spark, d), "close")


@query("c07_drawdown_duration", "symbol longest#", BARS + f""",
u AS (SELECT symbol, ts, CASE WHEN close < max(close) OVER ({W}) THEN 1 ELSE 0 END AS under FROM bars),
i AS (SELECT symbol, under, sum(1 - under) OVER ({W}) AS island FROM u),
r AS (SELECT symbol, island, sum(under) AS n FROM i GROUP BY symbol, island),
result AS (SELECT symbol, max(n) AS longest FROM r GROUP BY symbol)""")
def c07(spark, d):
    return M.longest_underwater(bars(spark, d), "close")


PNL = RETURNS + ", tr AS (SELECT symbol, ret * 1000 AS pnl FROM rets)"


@query("c08_trade_metrics", "symbol trades# win_rate:8 profit_factor:8 avg_win:6 avg_loss:6 expectancy:6", PNL + """,
a AS (SELECT symbol, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
  sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gw, sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) AS gl,
  avg(CASE WHEN pnl > 0 THEN pnl END) AS avg_win, avg(CASE WHEN pnl < 0 THEN -pnl END) AS avg_loss FROM tr GROUP BY symbol),
result AS (SELECT *, gw / gl AS profit_factor, win_rate * avg_win - (1 - win_rate) * avg_loss AS expectancy FROM a)""")
def c08(spark, d):
    return M.trade_metrics(returns(spark, d).withColumn("pnl", F.col("ret") * 1000), ["symbol"])


@query("c09_strategy_report", "symbol total_return:6 annual_return:6 volatility:6 sharpe:6 beta:6 alpha:6 max_drawdown:8", BARS + f""",
be AS (SELECT ts, avg(close) AS bench_equity FROM bars GROUP BY ts),
j AS (SELECT symbol, ts, close AS equity, bench_equity FROM bars JOIN be USING (ts)),
r AS (SELECT *, equity / lag(equity) OVER ({W}) - 1 AS r, bench_equity / lag(bench_equity) OVER ({W}) - 1 AS b,
  (equity - max(equity) OVER ({W})) / max(equity) OVER ({W}) AS dd FROM j),
a AS (SELECT symbol, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return, count(*) AS n,
  stddev_samp(r) * sqrt(252) AS volatility, avg(r - 0.05 / 252) / stddev_samp(r - 0.05 / 252) * sqrt(252) AS sharpe,
  covar_samp(CASE WHEN b IS NOT NULL THEN r END, b) / var_samp(b) AS beta, avg(r) AS mr, avg(b) AS mb, min(dd) AS max_drawdown FROM r GROUP BY symbol),
result AS (SELECT *, pow(1 + total_return, 252.0 / n) - 1 AS annual_return,
  (mr - 0.05 / 252 - beta * (mb - 0.05 / 252)) * 252 AS alpha FROM a)""")
def c09(spark, d):
    b = bars(spark, d).select("symbol", "ts", F.col("close").alias("equity"))
    return M.strategy_report(b, b.groupBy("ts").agg(F.avg("equity").alias("bench_equity")))


@query("c10_portfolio_stats", "symbol annual_vol:6 sharpe:6 sortino:6 skew:6 kurtosis:6 win_rate:8 avg_win:6 avg_loss:6 var_95:8 cvar_95:8 max_drawdown:6", RETURNS + f""",
e AS (SELECT symbol, ts, exp(sum(ln(1 + ret)) OVER ({W})) AS w FROM rets),
dd AS (SELECT symbol, min(d) AS max_drawdown FROM (SELECT symbol, (w - max(w) OVER ({W})) / max(w) OVER ({W}) AS d FROM e) GROUP BY symbol),
v AS (SELECT symbol, quantile_cont(ret, 0.05) AS var_95 FROM rets GROUP BY symbol),
m AS (SELECT symbol, avg(ret) AS mu, count(*) AS n FROM rets GROUP BY symbol),
p AS (SELECT symbol, any_value(n) AS n, avg((ret - mu) ** 2) AS m2, avg((ret - mu) ** 3) AS m3, avg((ret - mu) ** 4) AS m4
  FROM rets JOIN m USING (symbol) GROUP BY symbol),
k AS (SELECT symbol, m3 / m2 ** 1.5 * sqrt(n * (n - 1)) / (n - 2) AS skew,
  (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6) AS kurtosis FROM p),
c AS (SELECT symbol, avg(ret) AS cvar_95 FROM rets JOIN v USING (symbol) WHERE ret <= var_95 GROUP BY symbol),
a AS (SELECT symbol, stddev_samp(ret) * sqrt(252) AS annual_vol, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe,
  avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS sortino,
  avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(CASE WHEN ret > 0 THEN ret END) AS avg_win,
  avg(CASE WHEN ret < 0 THEN ret END) AS avg_loss FROM rets GROUP BY symbol),
result AS (SELECT * FROM a JOIN v USING (symbol) JOIN c USING (symbol) JOIN dd USING (symbol) JOIN k USING (symbol))""")
def c10(spark, d):
    return M.portfolio_stats(returns(spark, d))


@query("c11_benchmark_tearsheet", "symbol n# tracking_error:6 information_ratio:6 beta:6", JOINED + """, result AS (
  SELECT symbol, count(*) AS n, stddev_samp(x) * sqrt(252) AS tracking_error, avg(x) / stddev_samp(x) * sqrt(252) AS information_ratio,
  covar_samp(ret, bench_ret) / var_samp(bench_ret) AS beta FROM j GROUP BY symbol)""")
def c11(spark, d):
    return M.benchmark_stats(returns(spark, d), bench(spark, d))


MONTHS = " ".join(f"m{i:02d}:4" for i in range(1, 13))


@query("c12_monthly_returns", "symbol year# " + MONTHS, RETURNS + """,
m AS (SELECT symbol, year(ts) AS year, month(ts) AS mo, product(1 + ret) - 1 AS v FROM rets GROUP BY ALL),
result AS (SELECT symbol, year, """ + ", ".join(f"max(CASE WHEN mo = {i} THEN v END) AS m{i:02d}" for i in range(1, 13)) + " FROM m GROUP BY symbol, year)")
def c12(spark, d):
    return M.monthly_returns(returns(spark, d))


@query("c13_rolling_metrics", "symbol ts! roll_return:5 roll_vol:5 roll_sharpe:6", RETURNS + f""",
a AS (SELECT symbol, ts, count(*) OVER f AS n, avg(ret) OVER f * 252 AS rr, stddev_samp(ret) OVER f * sqrt(252) AS rv FROM rets
  WINDOW f AS ({W} ROWS 251 PRECEDING)),
result AS (SELECT symbol, ts, CASE WHEN n >= 252 THEN rr END AS roll_return, CASE WHEN n >= 252 THEN rv END AS roll_vol,
  CASE WHEN n >= 252 THEN rr / rv END AS roll_sharpe FROM a)""")
def c13(spark, d):
    return M.rolling_metrics(returns(spark, d))


@query("c14_cumulative_vs_benchmark", "symbol ts! roll_corr:6", JOINED + f""",
a AS (SELECT symbol, ts, count(*) OVER f AS n, corr(ret, bench_ret) OVER f AS c FROM j WINDOW f AS ({W} ROWS 19 PRECEDING)),
result AS (SELECT symbol, ts, CASE WHEN n >= 20 THEN c END AS roll_corr FROM a)""")
def c14(spark, d):
    return M.cumulative_comparison(joined(spark, d))


CMP = """covar_samp(ret, bench_ret) {o} / var_pop(bench_ret) {o} AS beta,
  avg(ret) {o} - covar_samp(ret, bench_ret) {o} / var_pop(bench_ret) {o} * avg(bench_ret) {o} AS alpha,
  stddev_samp(x) {o} AS tracking_error, avg(x) {o} / stddev_samp(x) {o} AS information_ratio, corr(ret, bench_ret) {o} AS correlation"""


@query("c15_benchmark_comparison", "symbol beta:6 alpha:6 tracking_error:6 information_ratio:6 correlation:6 outperformance:4",
       JOINED + f", result AS (SELECT symbol, {CMP.format(o='')}, (sum(ret) - sum(bench_ret)) * 100 AS outperformance FROM j GROUP BY symbol)")
def c15(spark, d):
    return M.compare(joined(spark, d))


@query("c16_rolling_comparison", "symbol ts! beta:4 alpha:4 tracking_error:5 information_ratio:6 correlation:6", JOINED + f""",
a AS (SELECT symbol, ts, count(*) OVER f AS n, {CMP.format(o='OVER f')} FROM j WINDOW f AS ({W} ROWS 59 PRECEDING)),
result AS (SELECT symbol, ts, """ + ", ".join(f"CASE WHEN n >= 60 THEN {c} END AS {c}" for c in
       ["beta", "alpha", "tracking_error", "information_ratio", "correlation"]) + " FROM a)")
def c16(spark, d):
    return M.rolling_compare(joined(spark, d))


@query("c17_bootstrap_sharpe", "symbol mean:6 std:6 low:6 high:6 p_positive:6 place:1")
def c17(spark, d):
    return M.bootstrap_sharpe(returns(spark, d))
