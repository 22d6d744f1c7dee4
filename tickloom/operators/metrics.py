"""Returns, performance metrics and tearsheets. Return frames are (key columns, ts, ret)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.ranking import quantiles, rank_average
from ..core.slices import over_rows, spread
from ..session import durable

YEAR = 252


def simple_return(bars: DataFrame, value: str = "close", out: str = "ret", **kw) -> DataFrame:
    return over_rows(bars, lambda d, w: d.withColumn(out, F.col(value) / F.lag(value).over(w) - 1), back=1, **kw)


def log_return(bars: DataFrame, value: str = "close", out: str = "log_ret") -> DataFrame:
    return over_rows(bars, lambda d, w: d.withColumn(out, F.log(F.col(value) / F.lag(value).over(w))), back=1)


def cumulative_return(rets: DataFrame, value: str = "ret", out: str = "cum_ret", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    s = spread(rets, keys=keys).run(_cp=("product", 1 + F.col(value)))
    return s.col(**{out: F.col("_cp") - 1}).done("_cp")


def annual_volatility(r: str = "ret") -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(float(YEAR)))


def sharpe(r: str = "ret", risk_free: float = 0.05) -> Column:
    x = F.col(r) - risk_free / YEAR
    return F.avg(x) / F.stddev_samp(x) * F.sqrt(F.lit(float(YEAR)))


def drawdown(df: DataFrame, value: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    s = spread(df, keys=keys).run(peak=("max", F.col(value)))
    return s.col(drawdown=(F.col(value) - F.col("peak")) / F.col("peak")).done()


def longest_underwater(df: DataFrame, value: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Longest run of rows below the running peak (gaps and islands)."""
    keys = list(keys)
    d = drawdown(df, value, keys)
    under = F.col("drawdown") < 0
    d = spread(d, keys=keys).run(_island=("sum", F.when(under, 0).otherwise(1))).done()
    runs = d.groupBy(*keys, "_island").agg(F.sum(F.when(under, 1).otherwise(0)).alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias("longest"))


def trade_metrics(trades: DataFrame, by: Sequence[str], pnl: str = "pnl") -> DataFrame:
    p = F.col(pnl)
    d = trades.groupBy(*by).agg(
        F.count(pnl).alias("trades"), F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("gross_win"), F.sum(F.when(p < 0, -p).otherwise(0.0)).alias("gross_loss"),
        F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, -p)).alias("avg_loss"))
    d = d.withColumn("profit_factor", F.when(F.col("gross_loss") > 0, F.col("gross_win") / F.col("gross_loss")).otherwise(float("inf")))
    return d.withColumn("expectancy", F.col("win_rate") * F.coalesce("avg_win", F.lit(0.0))
                        - (1 - F.col("win_rate")) * F.coalesce("avg_loss", F.lit(0.0)))


def skew_sample(r: str) -> Column:
    n = F.count(r)
    return F.when(n > 2, F.skewness(r) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_sample(r: str) -> Column:
    n = F.count(r).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(r) + 6))


def max_drawdown(rets: DataFrame, keys: Sequence[str], r: str = "ret") -> DataFrame:
    keys = list(keys)
    d = durable(spread(rets, keys=keys).run(_w=("product", 1 + F.col(r))).done())
    d = drawdown(d, "_w", keys)
    return d.groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def portfolio_stats(rets: DataFrame, keys: Sequence[str] = ("symbol",), r: str = "ret", risk_free: float = 0.0) -> DataFrame:
    """The thirteen tearsheet figures per key."""
    keys = list(keys)
    rets = durable(rets.select(*keys, "ts", r))  # read by four branches
    ex = F.col(r) - risk_free / YEAR
    x = F.col(r)
    base = rets.groupBy(*keys).agg(
        (F.pow(1 + F.avg(x), F.lit(float(YEAR))) - 1).alias("annual_return"), annual_volatility(r).alias("annual_vol"),
        (F.avg(ex) / F.stddev_samp(x) * F.sqrt(F.lit(float(YEAR)))).alias("sharpe"),
        (F.avg(ex) / F.stddev_samp(F.when(x < 0, x)) * F.sqrt(F.lit(float(YEAR)))).alias("sortino"),
        skew_sample(r).alias("skew"), kurtosis_sample(r).alias("kurtosis"),
        F.avg(F.when(x > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(F.when(x > 0, x)).alias("avg_win"),
        F.avg(F.when(x < 0, x)).alias("avg_loss"))
    var = quantiles(rets, keys, r, [0.05], "_q").select(*keys, F.col("_q")[0].alias("var_95"))
    tail = rets.join(var, keys).where(x <= F.col("var_95")).groupBy(*keys).agg(F.avg(x).alias("cvar_95"))
    d = base.join(max_drawdown(rets, keys, r), keys).join(var, keys, "left").join(tail, keys, "left")
    return d.withColumn("calmar", F.when(F.col("max_drawdown") != 0, F.col("annual_return") / F.abs("max_drawdown")))


def benchmark_stats(rets: DataFrame, bench: DataFrame, keys: Sequence[str] = ("symbol",), r: str = "ret",
                    b: str = "bench_ret", risk_free: float = 0.0) -> DataFrame:
    """Tearsheet figures against a benchmark joined on date."""
    j = rets.join(bench, "ts").withColumn("_x", F.col(r) - F.col(b))
    return _versus(j, keys, r, b, risk_free)


def _versus(j: DataFrame, keys: Sequence[str], r: str, b: str, risk_free: float) -> DataFrame:
    root = F.sqrt(F.lit(float(YEAR)))
    d = j.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(r).alias("_mr"), F.avg(b).alias("_mb"), F.covar_samp(r, b).alias("_cov"),
        F.var_samp(b).alias("_vb"), (F.stddev_samp("_x") * root).alias("tracking_error"),
        (F.avg("_x") / F.stddev_samp("_x") * root).alias("information_ratio"))
    d = d.withColumn("beta", F.col("_cov") / F.col("_vb"))
    ann = lambda m: F.pow(1 + F.col(m), F.lit(float(YEAR))) - 1
    d = d.withColumn("alpha", ann("_mr") - (risk_free + F.col("beta") * (ann("_mb") - risk_free)))
    return d.drop("_mr", "_mb", "_cov", "_vb")


def strategy_report(equity: DataFrame, bench: DataFrame, keys: Sequence[str] = ("symbol",), risk_free: float = 0.05) -> DataFrame:
    """Total and annual return, vol, sharpe, drawdown, alpha and beta from two equity curves."""
    keys = list(keys)
    j = equity.join(bench, "ts")
    f = lambda d, w: d.withColumns({"_r": F.col("equity") / F.lag("equity").over(w) - 1,
                                    "_b": F.col("bench_equity") / F.lag("bench_equity").over(w) - 1})
    rets = over_rows(j, f, back=1, keys=keys)
    o = F.col("ts")
    d = rets.groupBy(*keys).agg(
        (F.max_by("equity", o) / F.min_by("equity", o) - 1).alias("total_return"), F.count("*").alias("n"),
        (F.stddev_samp("_r") * F.sqrt(F.lit(float(YEAR)))).alias("volatility"), sharpe("_r", risk_free).alias("sharpe"),
        (F.covar_samp("_r", "_b") / F.var_samp("_b")).alias("beta"), F.avg("_r").alias("_mr"), F.avg("_b").alias("_mb"))
    d = d.withColumn("annual_return", F.pow(1 + F.col("total_return"), F.lit(float(YEAR)) / F.col("n")) - 1)
    rf = risk_free / YEAR
    d = d.withColumn("alpha", (F.col("_mr") - rf - F.col("beta") * (F.col("_mb") - rf)) * YEAR)
    dd = drawdown(equity, "equity", keys).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))
    return d.join(dd, keys).drop("_mr", "_mb")


def monthly_returns(rets: DataFrame, keys: Sequence[str] = ("symbol",), r: str = "ret") -> DataFrame:
    m = rets.groupBy(*keys, F.year("ts").alias("year"), F.month("ts").alias("month")).agg((F.product(1 + F.col(r)) - 1).alias("v"))
    p = m.groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.first("v"))
    return p.select(*keys, "year", *[F.col(str(i)).alias(f"m{i:02d}") for i in range(1, 13)])


def full(c: Column, n: int, w, of: str) -> Column:
    """Null until ``n`` non-null rows are in the frame."""
    return F.when(F.count(of).over(w) >= n, c)


def rolling_metrics(rets: DataFrame, n: int = YEAR, r: str = "ret", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    def f(d, w):
        fr = w.rowsBetween(-(n - 1), 0)
        d = d.withColumn("roll_return", full(F.avg(r).over(fr) * YEAR, n, fr, r))
        d = d.withColumn("roll_vol", full(F.stddev_samp(r).over(fr) * F.sqrt(F.lit(float(YEAR))), n, fr, r))
        return d.withColumn("roll_sharpe", F.col("roll_return") / F.col("roll_vol"))
    return over_rows(rets, f, back=n, keys=keys)


def cumulative_comparison(j: DataFrame, r: str = "ret", b: str = "bench_ret", n: int = 20, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    s = spread(j, back=n, keys=keys).run(cum_strategy=("product", 1 + F.col(r)), cum_bench=("product", 1 + F.col(b)))
    fr = s.rows(-(n - 1))
    return s.col(excess=F.col("cum_strategy") - F.col("cum_bench"), roll_corr=full(F.corr(r, b).over(fr), n, fr, r)).done()


def _compare(agg, r: str, b: str) -> dict[str, Column]:
    """Comparison figures; beta keeps the mixed ddof of the original (sample cov, population var)."""
    x = F.col(r) - F.col(b)
    beta = agg(F.covar_samp(r, b)) / agg(F.var_pop(b))
    te = agg(F.stddev_samp(x))
    return {"beta": beta, "alpha": agg(F.avg(r)) - beta * agg(F.avg(b)), "tracking_error": te,
            "information_ratio": F.when(te > 0, agg(F.avg(x)) / te).otherwise(0.0), "correlation": agg(F.corr(r, b))}


def compare(j: DataFrame, keys: Sequence[str] = ("symbol",), r: str = "ret", b: str = "bench_ret") -> DataFrame:
    c = _compare(lambda e: e, r, b)
    sr, sb = F.sum(r), F.sum(b)
    c["outperformance"] = (sr - sb) * 100
    return j.groupBy(*keys).agg(*[v.alias(k) for k, v in c.items()])


def rolling_compare(j: DataFrame, n: int = 60, keys: Sequence[str] = ("symbol",), r: str = "ret", b: str = "bench_ret") -> DataFrame:
    def f(d, w):
        fr = w.rowsBetween(-(n - 1), 0)
        c = _compare(lambda e: e.over(fr), r, b)
        return d.withColumns({k: full(v, n, fr, r) for k, v in c.items()})
    return over_rows(j, f, back=n, keys=keys)


def bootstrap_sharpe(rets: DataFrame, replicates: int = 200, seed: int = 7, keys: Sequence[str] = ("symbol",),
                     r: str = "ret", risk_free: float = 0.0) -> DataFrame:
    """Distribution of the annual Sharpe ratio by a Poisson bootstrap.

    Weights come from a hash of (seed, key, row, replicate), so they do not depend on the
    partitioning. Each row carries one array of weights; the sums per replicate are taken on the
    map side, so nothing but (key, replicate) sums is shuffled.
    """
    keys = list(keys)
    d = rets.withColumn("_x", F.col(r) - risk_free / YEAR).withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys, F.col("ts"), F.col("_rep")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # inverse Poisson(1) distribution function
    cdf = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    k = sum([F.when(u > c, 1.0).otherwise(0.0) for c in cdf], F.lit(0.0))
    d = d.withColumn("_k", k)
    g = d.groupBy(*keys, "_rep").agg(F.sum("_k").alias("n"), F.sum(F.col("_k") * F.col("_x")).alias("s"),
                                     F.sum(F.col("_k") * F.col("_x") * F.col("_x")).alias("q"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    g = g.withColumn("_sr", F.col("s") / F.col("n") / F.sqrt(var) * F.sqrt(F.lit(float(YEAR))))
    # at most ``replicates`` rows per key from here on
    out = g.groupBy(*keys).agg(F.avg("_sr").alias("mean"), F.stddev_samp("_sr").alias("std"),
                               F.percentile("_sr", F.lit(0.025)).alias("low"), F.percentile("_sr", F.lit(0.975)).alias("high"),
                               F.avg(F.when(F.col("_sr") > 0, 1.0).otherwise(0.0)).alias("p_positive"))
    return rank_average(out.withColumn("_neg", -F.col("mean")), [], "_neg", "place").drop("_neg")
