"""Technical indicators. Each takes bars (symbol, ts, open, high, low, close, volume).

The underscore-free functions are complete operators; the ``_x`` functions add columns inside an
already sliced frame, so that many indicators share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.slices import Series, ema_back, emas, over_rows, span, spread

EPS = 1e-10
C = F.col


def full(expr: Column, n: int, w, of: str | None = None) -> Column:
    """Null until the frame holds ``n`` rows (non-null ones of a column if given)."""
    return F.when(F.count(of if of else F.lit(1)).over(w) >= n, expr)


def mean(c: str, n: int, w) -> Column:
    f = w.rowsBetween(-(n - 1), 0)
    return full(F.avg(c).over(f), n, f, c)


def std(c: str, n: int, w) -> Column:
    f = w.rowsBetween(-(n - 1), 0)
    return full(F.stddev_samp(c).over(f), n, f, c)


def total(c: str, n: int, w) -> Column:
    f = w.rowsBetween(-(n - 1), 0)
    return full(F.sum(c).over(f), n, f, c)


def change(c: str, n: int, w) -> Column:
    return C(c) / F.lag(c, n).over(w) - 1


def _sma(d, w, windows=(20, 50, 200)):
    return d.withColumns({f"sma_{n}": mean("close", n, w) for n in windows})


def _bollinger(d, w, n=20, k=2.0):
    d = d.withColumns({"bb_middle": mean("close", n, w), "_bs": std("close", n, w)})
    d = d.withColumns({"bb_upper": C("bb_middle") + k * C("_bs"), "bb_lower": C("bb_middle") - k * C("_bs")}).drop("_bs")
    return d.withColumns({"bb_width": (C("bb_upper") - C("bb_lower")) / C("bb_middle"),
                          "bb_position": (C("close") - C("bb_lower")) / (C("bb_upper") - C("bb_lower"))})


def _rsi(d, w, n=14, eps=EPS):
    # the first difference counts as zero gain and zero loss
    d = d.withColumn("_d", F.coalesce(C("close") - F.lag("close").over(w), F.lit(0.0)))
    d = d.withColumns({"_g": F.greatest("_d", F.lit(0.0)), "_l": F.greatest(-C("_d"), F.lit(0.0))})
    d = d.withColumns({"_ag": mean("_g", n, w), "_al": mean("_l", n, w)})
    loss = C("_al") + eps
    rsi = 100 - 100 / (1 + C("_ag") / F.when(loss != 0, loss))
    if not eps:
        rsi = F.when(C("_al") == 0, F.when(C("_ag") > 0, 100.0)).otherwise(rsi)
    return d.withColumn("rsi", rsi).drop("_d", "_g", "_l", "_ag", "_al")


def _macd(d, w, fast=12, slow=26, signal=9):
    d = emas(d, w, [("close", span(fast), f"ema_{fast}"), ("close", span(slow), f"ema_{slow}")])
    d = d.withColumn("macd", C(f"ema_{fast}") - C(f"ema_{slow}"))
    d = emas(d, w, [("macd", span(signal), "macd_signal")])
    return d.withColumn("macd_hist", C("macd") - C("macd_signal"))


def _stoch(d, w, k=14, n=3):
    f = w.rowsBetween(-(k - 1), 0)
    lo, hi = F.min("low").over(f), F.max("high").over(f)
    d = d.withColumn("stoch_k", full(100 * (C("close") - lo) / (hi - lo + EPS), k, f))
    return d.withColumn("stoch_d", mean("stoch_k", n, w))


def _tr(d, w):
    p = F.lag("close").over(w)
    return d.withColumn("tr", F.greatest(C("high") - C("low"), F.abs(C("high") - p), F.abs(C("low") - p)))


def _atr(d, w, n=14):
    d = _tr(d, w).withColumn("atr", mean("tr", n, w))
    return d.withColumn("natr", C("atr") / C("close") * 100)


def _adx(d, w, n=14):
    d = _tr(d, w)
    d = d.withColumns({"_up": C("high") - F.lag("high").over(w), "_dn": F.lag("low").over(w) - C("low")})
    d = d.withColumns({"_pd": F.when((C("_up") > C("_dn")) & (C("_up") > 0), C("_up")).otherwise(0.0),
                       "_md": F.when((C("_dn") > C("_up")) & (C("_dn") > 0), C("_dn")).otherwise(0.0)})
    d = d.withColumns({"_a": mean("tr", n, w), "_p": mean("_pd", n, w), "_m": mean("_md", n, w)})
    d = d.withColumns({"plus_di": 100 * C("_p") / (C("_a") + EPS), "minus_di": 100 * C("_m") / (C("_a") + EPS)})
    d = d.withColumn("_dx", 100 * F.abs(C("plus_di") - C("minus_di")) / (C("plus_di") + C("minus_di") + EPS))
    return d.withColumn("adx", mean("_dx", n, w)).drop("_up", "_dn", "_pd", "_md", "_a", "_p", "_m", "_dx")


def _typical() -> Column:
    return (C("high") + C("low") + C("close")) / 3


def _cci(d, w, n=14):
    f = w.rowsBetween(-(n - 1), 0)
    d = d.withColumn("_tp", _typical())
    d = d.withColumns({"_m": mean("_tp", n, w), "_win": F.collect_list("_tp").over(f)})
    mad = F.aggregate("_win", F.lit(0.0), lambda s, x: s + F.abs(x - C("_m"))) / n
    return d.withColumn("cci", (C("_tp") - C("_m")) / (0.015 * mad + EPS)).drop("_tp", "_m", "_win")


def _mfi(d, w, n=14):
    d = d.withColumn("_tp", _typical())
    d = d.withColumns({"_dt": C("_tp") - F.lag("_tp").over(w), "_mf": C("_tp") * C("volume")})
    d = d.withColumns({"_p": F.when(C("_dt") > 0, C("_mf")).otherwise(0.0), "_n": F.when(C("_dt") < 0, C("_mf")).otherwise(0.0)})
    return d.withColumn("mfi", 100 - 100 / (1 + total("_p", n, w) / (total("_n", n, w) + EPS))).drop("_tp", "_dt", "_mf", "_p", "_n")


def _clv() -> Column:
    return ((C("close") - C("low")) - (C("high") - C("close"))) / (C("high") - C("low") + EPS)


def _obv_step(d, w):
    return d.withColumn("_obv", F.coalesce(F.signum(C("close") - F.lag("close").over(w)), F.lit(0.0)) * C("volume"))


def _adosc(d, w):
    d = emas(d, w, [("ad", span(3), "_e3"), ("ad", span(10), "_e10")])
    return d.withColumn("adosc", C("_e3") - C("_e10")).drop("_e3", "_e10")


def sma(bars: DataFrame, windows: Sequence[int] = (20, 50, 200)) -> DataFrame:
    return over_rows(bars, lambda d, w: _sma(d, w, windows), back=max(windows))


def ema(bars: DataFrame, spans: Sequence[int] = (12, 26)) -> DataFrame:
    return over_rows(bars, lambda d, w: emas(d, w, [("close", span(n), f"ema_{n}") for n in spans]), back=ema_back(max(spans)))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    return over_rows(bars, lambda d, w: _bollinger(d, w, n, k), back=n)


def sar(bars: DataFrame) -> DataFrame:
    """Simplified stop-and-reverse: the running minimum of all earlier lows (the first low on row one)."""
    s = spread(bars, back=1).run(_lo=("min", C("low")))
    return s.roll(lambda d, w: d.withColumn("sar", F.coalesce(F.lag("_lo").over(w), C("low")))).done("_lo")


def rsi(bars: DataFrame, n: int = 14, eps: float = EPS) -> DataFrame:
    return over_rows(bars, lambda d, w: _rsi(d, w, n, eps), back=n + 1)


def macd(bars: DataFrame) -> DataFrame:
    return over_rows(bars, _macd, back=ema_back(26, 9))


def stochastic(bars: DataFrame) -> DataFrame:
    return over_rows(bars, _stoch, back=17)


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    return over_rows(bars, lambda d, w: _adx(d, w, n), back=2 * n + 1)


def cci(bars: DataFrame) -> DataFrame:
    return over_rows(bars, _cci, back=14)


def mfi(bars: DataFrame) -> DataFrame:
    return over_rows(bars, _mfi, back=15)


def obv(bars: DataFrame) -> DataFrame:
    return spread(bars, back=1).roll(_obv_step).run(obv=("sum", C("_obv"))).done("_obv")


def accumulation(bars: DataFrame) -> DataFrame:
    return spread(bars).run(ad=("sum", _clv() * C("volume"))).done()


def ad_oscillator(bars: DataFrame) -> DataFrame:
    return spread(bars, back=ema_back(10)).run(ad=("sum", _clv() * C("volume"))).roll(_adosc).done()


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return over_rows(bars, lambda d, w: _atr(d, w, n), back=n + 1)


CATEGORIES = ("overlap", "momentum", "volume", "volatility")


def compute_all(bars: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Every indicator of the named categories over one exchange and one sort."""
    s: Series = spread(bars, back=ema_back(26, 9))
    # all running aggregates in one pass, before the rolling columns
    totals = {}
    if "overlap" in categories:
        totals["_lo"] = ("min", C("low"))
    if "volume" in categories:
        s = s.roll(_obv_step)
        totals.update(obv=("sum", C("_obv")), ad=("sum", _clv() * C("volume")))
    if totals:
        s = s.run(**totals)
    if "overlap" in categories:
        s = s.roll(_sma).roll(_bollinger)
        s = s.roll(lambda d, w: d.withColumn("sar", F.coalesce(F.lag("_lo").over(w), C("low"))).drop("_lo"))
    if "momentum" in categories:
        for f in (_rsi, _macd, _stoch, _adx, _cci, _mfi):
            s = s.roll(f)
    elif "overlap" in categories:
        s = s.roll(lambda d, w: emas(d, w, [("close", span(12), "ema_12"), ("close", span(26), "ema_26")]))
    if "volume" in categories:
        s = s.roll(_adosc)
        s = s._with(s.df.drop("_obv"))
    if "volatility" in categories:
        s = s.roll(_atr)
    return s.done()


def ml_features(bars: DataFrame, lags: Sequence[int] = (1, 5, 10, 21),
                custom: Mapping[str, tuple[int, Callable]] | None = None) -> DataFrame:
    """Feature frame for models. ``custom``: name -> (rows back, fn(frame, window) -> Column)."""
    custom = custom or {}

    def f(d, w):
        d = _rsi(d, w, 14, 0.0)
        d = _macd(d, w)
        d = _bollinger(d, w).withColumnRenamed("bb_position", "bb_pct").drop("bb_width")
        d = _atr(d, w).drop("natr", "tr")
        d = d.withColumns({"volume_sma_20": mean("volume", 20, w), **{f"return_{n}d": change("close", n, w) for n in lags}})
        d = d.withColumn("volume_ratio", C("volume") / C("volume_sma_20"))
        for name, (_, fn) in custom.items():
            d = d.withColumn(name, fn(d, w))
        return d

    back = max([ema_back(26, 9), *lags, *[b for b, _ in custom.values()]])
    return over_rows(bars, f, back=back)


def watch_list(bars: DataFrame, n: int = 252) -> DataFrame:
    """Latest row per symbol: price, change, 52-week range, RSI and the side of MACD."""
    def f(d, w):
        fr = w.rowsBetween(-(n - 1), 0)
        d = _macd(_rsi(d, w), w)
        return d.withColumns({"change": change("close", 1, w), "high_52w": F.max("high").over(fr), "low_52w": F.min("low").over(fr),
                              "macd_side": F.when(C("macd") > C("macd_signal"), "above").otherwise("below")})
    d = over_rows(bars, f, back=ema_back(26, 9))
    cols = ["close", "change", "high_52w", "low_52w", "rsi", "macd_side"]
    return d.groupBy("symbol").agg(*[F.max_by(c, "ts").alias("price" if c == "close" else c) for c in cols])
