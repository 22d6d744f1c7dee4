"""Factor evaluation over (ts, symbol) panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.distributions import t_sf
from ..core.ranking import qcut, quantiles, rank_average
from ..core.slices import over_rows
from ..session import durable

C = F.col
EPS = 1e-8


def forward_returns(bars: DataFrame, periods: Sequence[int] = (1, 5, 10), value: str = "close") -> DataFrame:
    return over_rows(bars, lambda d, w: d.withColumns({f"fwd_{p}": F.lead(value, p).over(w) / C(value) - 1 for p in periods}),
                     ahead=max(periods))


def information_coefficient(panel: DataFrame, factor: str, ret: str, method: str = "pearson", least: int = 3) -> DataFrame:
    """Per-date correlation of factor and forward return over dates with enough assets."""
    d = panel.where(C(factor).isNotNull() & C(ret).isNotNull()).select("ts", "symbol", factor, ret)
    x, y = factor, ret
    if method == "spearman":
        d = durable(d)
        d = rank_average(rank_average(d, ["ts"], factor, "_rf"), ["ts"], ret, "_rr")
        x, y = "_rf", "_rr"
    g = d.groupBy("ts").agg(F.count("*").alias("n"), F.corr(x, y).alias("ic"))
    return g.where(C("n") >= least).withColumn("ic", F.nanvl("ic", F.lit(None)))


def quantile_factor_returns(panel: DataFrame, factor: str, rets: Sequence[str], q: int = 5) -> DataFrame:
    """Per date: mean return of the top quantile minus that of the bottom one, for each horizon."""
    d = durable(panel.where(C(factor).isNotNull()).select("ts", "symbol", factor, *rets))
    d = qcut(d, ["ts"], factor, q, "bin")
    agg = []
    for r in rets:
        agg += [F.avg(F.when(C("bin") == q, C(r))).alias(f"_t_{r}"), F.avg(F.when(C("bin") == 1, C(r))).alias(f"_b_{r}")]
    g = d.groupBy("ts").agg(*agg, F.count(F.when(C("bin") == q, 1)).alias("_nt"), F.count(F.when(C("bin") == 1, 1)).alias("_nb"))
    g = g.where("_nt > 0 and _nb > 0")
    return g.select("ts", *[(C(f"_t_{r}") - C(f"_b_{r}")).alias(r) for r in rets])


def _date_pairs(panel: DataFrame, factor: str, lag: int) -> DataFrame:
    """Each asset's factor on a date and ``lag`` panel dates earlier."""
    d = durable(panel.where(C(factor).isNotNull()).select("ts", "symbol", C(factor).alias("now")))
    # one row per date: the calendar of the panel, far below the panel itself
    dates = d.select("ts").distinct()
    prev = over_rows(dates.withColumn("_k", F.lit(0)), lambda x, w: x.withColumn("_prev", F.lag("ts", lag).over(w)), back=lag, keys=["_k"]).drop("_k")
    before = d.select(C("ts").alias("_prev"), "symbol", C("now").alias("before"))
    return durable(d.join(prev, "ts").join(before, ["_prev", "symbol"]).drop("_prev"))


def turnover(panel: DataFrame, factor: str, q: int = 5, least: int = 3) -> DataFrame:
    """Share (in per cent) of common assets that changed quantile since the previous date."""
    p = _date_pairs(panel, factor, 1)
    n = p.groupBy("ts").agg(F.count("*").alias("_n")).where(C("_n") >= least)
    p = p.join(n, "ts")
    b = qcut(durable(qcut(durable(p), ["ts"], "now", q, "_qn")), ["ts"], "before", q, "_qb")
    return b.groupBy("ts").agg((F.avg(F.when(C("_qn") != C("_qb"), 1.0).otherwise(0.0)) * 100).alias("turnover"))


def tearsheet(panel: DataFrame, factor: str, ret: str, q: int = 5) -> DataFrame:
    """One row: IC mean/std/IR, Spearman mean, factor return mean/std/Sharpe, mean turnover."""
    panel = durable(panel.select("ts", "symbol", factor, ret))
    ic = information_coefficient(panel, factor, ret).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"))
    sp = information_coefficient(panel, factor, ret, "spearman").agg(F.avg("ic").alias("ic_spearman_mean"))
    fr = quantile_factor_returns(panel, factor, [ret], q).agg(F.avg(ret).alias("mean_return"), F.stddev_samp(ret).alias("std_return"))
    to = turnover(panel, factor, q).agg(F.avg("turnover").alias("mean_turnover"))
    d = ic.join(sp).join(fr).join(to)  # four one-row aggregates
    return d.withColumns({"ic_ir": C("ic_mean") / (C("ic_std") + EPS), "sharpe": C("mean_return") / (C("std_return") + EPS)})


def autocorrelation(panel: DataFrame, factor: str, lags: int = 5) -> DataFrame:
    """Autocorrelation at each lag, averaged over assets."""
    d = over_rows(panel.where(C(factor).isNotNull()),
                  lambda x, w: x.withColumns({f"_l{i}": F.lag(factor, i).over(w) for i in range(1, lags + 1)}), back=lags)
    g = d.groupBy("symbol").agg(*[F.nanvl(F.corr(factor, f"_l{i}"), F.lit(None)).alias(f"c{i}") for i in range(1, lags + 1)])
    return g.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(1, lags + 1)]).select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("lag"), C(f"c{i}").alias("autocorr")) for i in range(1, lags + 1)])))


def rank_autocorrelation(panel: DataFrame, factor: str, lag: int = 1, least: int = 3) -> DataFrame:
    p = _date_pairs(panel, factor, lag)
    d = rank_average(rank_average(p, ["ts"], "now", "_rn"), ["ts"], "before", "_rb")
    g = d.groupBy("ts").agg(F.count("*").alias("n"), F.corr("_rn", "_rb").alias("c")).where(C("n") >= least)
    return g.agg(F.avg(F.nanvl("c", F.lit(None))).alias("rank_autocorr"))


def quantile_returns(panel: DataFrame, factor: str, ret: str, q: int = 5) -> DataFrame:
    """Mean, std and count over dates of the per-date bin means."""
    d = durable(panel.where(C(factor).isNotNull() & C(ret).isNotNull()).select("ts", "symbol", factor, ret))
    n = d.groupBy("ts").agg(F.count("*").alias("_n")).where(C("_n") > q)
    b = qcut(d.join(n, "ts"), ["ts"], factor, q, "bin")
    per = b.groupBy("ts", "bin").agg(F.avg(ret).alias("_m"), F.count("*").alias("_c"))
    return per.groupBy("bin").agg(F.avg("_m").alias("mean_return"), F.stddev_samp("_m").alias("std_return"), F.sum("_c").alias("n"))


def _spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    by = list(by)
    d = durable(df.where(C(x).isNotNull() & C(y).isNotNull()).select(*by, C(x).alias("_x"), C(y).alias("_y")))
    d = rank_average(rank_average(d, by, "_x", "_rx"), by, "_y", "_ry")
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("ic"))


def signal_quality(df: DataFrame, signal: str, ret: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman IC, ir, t statistic and its p value; null under ten rows."""
    g = _spearman(df, by, signal, ret)
    ok = C("n") >= 10
    g = g.withColumns({"ir": F.when(ok, C("ic") * F.sqrt("n")), "t_stat": F.when(ok, C("ic") * F.sqrt(C("n") - 2) / F.sqrt(1 - C("ic") * C("ic")))})
    g = g.withColumn("ic", F.when(ok, C("ic")))

    @F.pandas_udf("double")
    def p_value(t, n):
        return t.combine(n, lambda a, b: None if a != a else 2 * t_sf(abs(a), b - 2))

    return g.withColumn("p_value", p_value("t_stat", "n"))


def decay_half_life(df: DataFrame, signal: str, ret: str, max_lag: int = 20) -> DataFrame:
    """First lag whose absolute Spearman IC is at most half that of lag one, per symbol.

    Lags stop at a quarter of the series and at the first one with under ten pairs.
    """
    d = over_rows(df, lambda x, w: x.withColumn("_f", F.array(*[F.lead(ret, i).over(w) for i in range(1, max_lag + 1)])), ahead=max_lag)
    n = df.groupBy("symbol").agg(F.floor(F.count("*") / 4).alias("_max"))
    e = d.select("symbol", "ts", signal, F.posexplode("_f").alias("lag", "_y")).withColumn("lag", C("lag") + 1)
    g = _spearman(e, ["symbol", "lag"], signal, "_y").join(n, "symbol").where((C("lag") <= C("_max")) & (C("n") >= 10))
    first = g.where("lag = 1").select("symbol", F.abs("ic").alias("_i1"))
    return g.join(first, "symbol").groupBy("symbol").agg(
        F.min(F.when((C("_i1") > 0) & (F.abs("ic") <= C("_i1") / 2), C("lag"))).alias("half_life"))


def signal_backtest(df: DataFrame, signal: str, ret: str, q: int = 5) -> DataFrame:
    """Whole-sample quantile bins of a signal with mean, std, annual Sharpe and count.

    ``long_short`` sits beside every row: the mean of the top bin minus that of the bottom bin;
    ``top_only`` is what subtracting unmatched dates as zero gives.
    """
    d = durable(df.where(C(signal).isNotNull() & C(ret).isNotNull()).select(signal, ret))
    b = qcut(d, [], signal, q, "bin")
    g = b.groupBy("bin").agg(F.avg(ret).alias("mean_return"), F.stddev_samp(ret).alias("std_return"), F.count("*").alias("n"))
    g = g.withColumn("sharpe", F.when(C("std_return") > 0, C("mean_return") / C("std_return") * F.sqrt(F.lit(252.0))).otherwise(0.0))
    ends = g.agg(F.max(F.when(C("bin") == q, C("mean_return"))).alias("top_only"), F.max(F.when(C("bin") == 1, C("mean_return"))).alias("_low"))
    return g.join(ends).withColumn("long_short", C("top_only") - C("_low")).drop("_low")
