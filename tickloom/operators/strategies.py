"""Strategy signals. Each adds signal and confidence to bars, always per symbol."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.slices import decay_rows, emas, over_rows, span, spread
from ..core.states import state_run
from .indicators import change, mean, std

C = F.col


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def momentum(bars: DataFrame, short: int = 20, long: int = 50, ma: str = "sma", threshold: float = 0.0) -> DataFrame:
    def f(d, w):
        if ma == "ema":
            d = emas(d, w, [("close", span(short), "_s"), ("close", span(long), "_l")])
        else:
            d = d.withColumns({"_s": mean("close", short, w), "_l": mean("close", long, w)})
        sp = (C("_s") - C("_l")) / C("_l")
        d = d.withColumn("spread", sp)
        return d.withColumns({"signal": F.when(C("spread") > threshold, 1.0).when(C("spread") < -threshold, -1.0).otherwise(0.0),
                              "confidence": F.when(C("spread").isNotNull(), F.least(F.abs("spread"), F.lit(1.0)))}).drop("_s", "_l")
    back = decay_rows(span(long)) + 2 if ma == "ema" else long
    return over_rows(bars, f, back=back)


def _zscore(d: DataFrame, w, value: str, n: int, eps: float = 0.0) -> DataFrame:
    d = d.withColumns({"_m": mean(value, n, w), "_sd": std(value, n, w)})
    den = C("_sd") + eps
    return d.withColumn("z", F.when(den != 0, (C(value) - C("_m")) / den)).drop("_m", "_sd")


def mean_reversion(bars: DataFrame, n: int = 20, num_std: float = 2.0, entry: float = -2.0, exit: float = 0.0) -> DataFrame:
    def f(d, w):
        d = _zscore(d, w, "close", n)
        z = C("z")  # the assignment made last wins
        sig = F.when((z > exit - 0.5) & (z < exit + 0.5), 0.0).when(z >= -entry, -1.0).when(z <= entry, 1.0).otherwise(0.0)
        return d.withColumns({"signal": sig, "confidence": clip(F.abs(z) / (num_std * 2), 0.0, 1.0)})
    return over_rows(bars, f, back=n)


def ratio_stat_arb(pair: DataFrame, n: int = 60, entry: float = 2.0, exit: float = 0.5, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """``pair`` holds close_a and close_b on common dates."""
    def f(d, w):
        d = _zscore(d.withColumn("_r", C("close_a") / C("close_b")), w, "_r", n).drop("_r")
        z = C("z")
        sig = F.when(F.abs(z) <= exit, 0.0).when(z >= entry, -1.0).when(z <= -entry, 1.0).otherwise(0.0)
        return d.withColumns({"signal": sig, "confidence": clip(F.abs(z) / entry, 0.0, 1.0)})
    return over_rows(pair, f, back=n, keys=keys)


def market_making(bars: DataFrame, spread_bps: float = 10.0, vol_window: int = 20) -> DataFrame:
    def f(d, w):
        d = d.withColumn("_r", change("close", 1, w))
        d = d.withColumn("_v", std("_r", vol_window, w))
        d = d.withColumns({"_vr": C("_v") / mean("_v", 100, w), "_ma": mean("close", 5, w)})
        d = d.withColumn("deviation", (C("close") - C("_ma")) / C("_ma"))
        lim = spread_bps / 10000
        return d.withColumns({"signal": F.when(C("deviation") > lim, -0.5).when(C("deviation") < -lim, 0.5).otherwise(0.0),
                              "confidence": F.when(C("_vr").isNotNull(), clip(1.0 / F.greatest("_vr", F.lit(0.5)), 0.0, 1.0))}).drop("_r", "_v", "_vr", "_ma")
    return over_rows(bars, f, back=vol_window + 102)


def quote_prices(df: DataFrame, mid: str = "mid", vol: str = "volatility", spread_bps: float = 10.0) -> DataFrame:
    half = C(mid) * (spread_bps / 10000) / 2 * F.when(C(vol) > 0, F.greatest(F.lit(1.0), C(vol) * 100)).otherwise(1.0)
    return df.withColumns({"bid": C(mid) - half, "ask": C(mid) + half, "spread_bps": half * 2 / C(mid) * 10000})


def pair_signal(spread_frame: DataFrame, entry: float = 2.0, exit: float = 0.5, n: int = 20, value: str = "spread",
                keys: Sequence[str] = ("pair",)) -> DataFrame:
    """Enter beyond +-entry, leave once past the opposite of exit, hold through null scores."""
    d = over_rows(spread_frame, lambda x, w: _zscore(x, w, value, n), back=n, keys=keys)
    z = C("z")
    flat, long, short = 1, 2, 3
    after_flat = F.when(z > entry, short).when(z < -entry, long).otherwise(flat)
    after_long = F.when(z > -exit, flat).otherwise(long)
    after_short = F.when(z < exit, flat).otherwise(short)
    hold = F.array(F.lit(flat), F.lit(long), F.lit(short))
    step = F.when(z.isNull(), hold).otherwise(F.array(after_flat, after_long, after_short))
    d = state_run(d, step, "_state", flat, keys)
    return d.withColumn("signal", F.when(C("_state") == long, 1.0).when(C("_state") == short, -1.0).otherwise(0.0)).drop("_state")


def hold_until_flat(spread_frame: DataFrame, value: str = "spread", entry: float = 2.0, exit: float = 0.5,
                    keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Zeros are filled with the last entry, so the exit band has no effect once a position is taken."""
    s = spread(spread_frame, back=20, keys=keys).roll(lambda d, w: _zscore(d, w, value, 20, 1e-8))
    z = C("z")
    raw = F.when(F.abs(z) < exit, None).when(z < -entry, 1.0).when(z > entry, -1.0)
    s = s.run(signal=("last", raw))
    return s.col(signal=F.coalesce("signal", F.lit(0.0))).done()


def rolling_hedge(pair: DataFrame, n: int = 60, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """Hedge ratio of y on x over the n rows before each row (sample covariance over population variance)."""
    def f(d, w):
        fr = w.rowsBetween(-n, -1)
        h = F.covar_samp("y", "x").over(fr) / F.var_pop("x").over(fr)
        d = d.withColumn("hedge", F.when(F.count("*").over(fr) >= n, h))
        return d.withColumn("spread", C("y") - C("hedge") * C("x"))
    return over_rows(pair, f, back=n, keys=keys)


def blend(df: DataFrame, technical: str, sentiment: str, w_technical: float = 0.6, w_sentiment: float = 0.4) -> DataFrame:
    return df.withColumn("signal", clip(C(technical) * w_technical + C(sentiment) * w_sentiment, -1.0, 1.0))


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"momentum": momentum, "mean_reversion": mean_reversion, "market_making": market_making}


def sweep(bars: DataFrame, specs: Sequence[tuple[str, Mapping]]) -> DataFrame:
    """One strategy run per (name, parameters) row, in long form."""
    out = None
    for name, params in specs:
        label = name + "".join(f" {k}={v}" for k, v in sorted(params.items()))
        d = STRATEGIES[name](bars, **params).select("symbol", "ts", F.lit(label).alias("run"), "signal", "confidence")
        out = d if out is None else out.unionByName(d)
    return out
