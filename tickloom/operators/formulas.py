"""Cross-section operators, the alpha library, blends and neutralisation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.ranking import rank_average
from ..core.slices import match, over_rows
from ..functions import formulaic as fx

C = F.col


def rank(df: DataFrame, value: str, out: str, by: str = "ts") -> DataFrame:
    """Cross-section percentile rank with ties averaged."""
    return rank_average(df, [by], value, out, pct=True)


def scale(df: DataFrame, value: str, out: str, by: str = "ts") -> DataFrame:
    t = df.groupBy(by).agg(F.sum(F.abs(value)).alias("_t"))
    return match(df, t, [by]).withColumn(out, F.when(C("_t") != 0, C(value) / C("_t"))).drop("_t")


def _ts(df: DataFrame, back: int, fn: Callable) -> DataFrame:
    return over_rows(df, lambda d, w: d.withColumn("_x", fn(d, w)), back=back)


def _ranked(df: DataFrame, back: int, fn: Callable, out: str) -> DataFrame:
    return rank(_ts(df, back, fn), "_x", out).drop("_x")


def alpha001(b): return _ranked(b, 10, lambda d, w: fx.ts_rank(fx.log("volume"), 10, w), "alpha001")


def alpha002(b):
    return _ts(b, 2, lambda d, w: fx.divide(fx.delta(fx.log("volume"), 2, w), fx.delta(fx.log("close"), 2, w))).withColumnRenamed("_x", "alpha002")


def alpha003(b): return _ranked(b, 10, lambda d, w: fx.correlation("close", "volume", 10, w), "alpha003")


def alpha004(b):
    return over_rows(rank(b, "low", "_r"), lambda d, w: d.withColumn("alpha004", fx.ts_rank("_r", 9, w)), back=9).drop("_r")


def alpha005(b): return _ranked(b, 10, lambda d, w: fx.divide("close", fx.ts_mean("volume", 10, w)), "alpha005")


def alpha006(b): return _ts(b, 10, lambda d, w: fx.correlation("open", "volume", 10, w)).withColumnRenamed("_x", "alpha006")


def _signed_move(b, n: int, out: str):
    d = _ts(b, n, lambda d, w: fx.delta("close", n, w)).withColumn("_a", F.abs("_x"))
    return rank(d, "_a", "_r").withColumn(out, C("_r") * F.signum("_x")).drop("_x", "_a", "_r")


def alpha007(b): return _signed_move(b, 7, "alpha007")


def alpha008(b):
    def f(d, w):
        d = d.withColumn("_s", fx.ts_sum("open", 5, w))
        return d.withColumn("_x", fx.delta("_s", 1, w)).drop("_s")
    return rank(over_rows(b, f, back=6), "_x", "alpha008").drop("_x")


def alpha009(b):
    def f(d, w):
        d = d.withColumn("_s", fx.ts_mean("close", 10, w))
        return d.withColumn("alpha009", fx.delta("_s", 1, w)).drop("_s")
    return over_rows(b, f, back=11)


def alpha010(b): return _signed_move(b, 1, "alpha010")


ALPHAS: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f for f in (alpha001, alpha002, alpha003, alpha004, alpha005, alpha006, alpha007, alpha008, alpha009, alpha010)}


def alpha_library(bars: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The named alphas in long form (ts, symbol, alpha, value).

    002, 007 and 010 are evaluated whole, as written; a reader that stops after the leading
    function call would lose their right-hand side.
    """
    out = None
    for n in names or list(ALPHAS):
        d = ALPHAS[n](bars).select("ts", "symbol", F.lit(n).alias("alpha"), C(n).alias("value"))
        out = d if out is None else out.unionByName(d)
    return out


def wide_to_long(df: DataFrame, id_col: str = "ts", out: str = "value") -> DataFrame:
    return df.unpivot([id_col], [c for c in df.columns if c != id_col], "symbol", out)


def combine(df: DataFrame, weights: Mapping[str, float], out: str = "combined") -> DataFrame:
    """Weighted blend of factor columns; weights are normalised to one."""
    total = sum(weights.values())
    expr = None
    for c, v in weights.items():
        term = C(c) * (v / total)
        expr = term if expr is None else expr + term
    return df.withColumn(out, expr)


def neutralize(df: DataFrame, factor: str, on: str, out: str, by: str = "ts") -> DataFrame:
    """Residual of the per-date regression of ``factor`` on ``on``; needs two valid rows."""
    ok = C(factor).isNotNull() & C(on).isNotNull()
    x, y = F.when(ok, C(on)), F.when(ok, C(factor))
    g = df.groupBy(by).agg(F.count(F.when(ok, 1)).alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
                           F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_v"))
    # a cross-section without spread in the regressor leaves only its mean to remove
    beta = F.when(C("_v") > 0, C("_c") / C("_v")).otherwise(0.0)
    d = match(df, g, [by]).withColumn(out, F.when(ok & (C("_n") > 1), C(factor) - C("_my") - beta * (C(on) - C("_mx"))))
    return d.drop("_n", "_mx", "_my", "_c", "_v")
