"""Kalman filters, wavelets and exponential volatility on series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.folds import fold_sorted
from ..core.gaussian import random_walk_regression
from ..core.ranking import quantiles
from ..core.slices import affine, decay_rows, decayed_sums, over_rows, spread
from ..session import durable

C = F.col


def kalman_gains(q: float, r: float, p0: float = 1.0) -> list[tuple[int, float, float]]:
    """(row, gain, smoothing factor) until both are constant; they depend on the row number only."""
    out, p = [], p0
    for t in range(1 << 20):
        pred = p + q
        k = pred / (pred + r)
        p = (1 - k) * pred
        out.append((t, k, p / (p + q)))
        if t and abs(out[-1][1] - out[-2][1]) <= 1e-15 * out[-1][1]:
            return out
    raise ValueError("the gain is not constant after a million rows; q is too small beside r")


def kalman_level(df: DataFrame, value: str, q: float = 1e-5, r: float = 1e-2, out: str = "level", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Scalar random-walk filter started at 0 with variance 1."""
    g = kalman_gains(q, r)
    # fixed size: the rows until the gain is constant, known before any data is read
    table = F.broadcast(df.sparkSession.createDataFrame(g, "_row long, _k double, _c double"))
    reach = decay_rows(g[-1][1]) + len(g)
    s = spread(df, back=reach, keys=keys).position("_pos")
    s = s._with(s.df.withColumn("_row", F.least("_pos", F.lit(g[-1][0]))).join(table, "_row"))
    s = s.roll(lambda d, w: affine(d, 1 - C("_k"), C("_k") * C(value), w, reach, out))
    return s.done("_row", "_k", "_pos").withColumnRenamed("_c", "_smooth")


def kalman_smooth(df: DataFrame, value: str, q: float = 1e-5, r: float = 1e-2, out: str = "trend", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Backward pass over the filtered level: xs = (1 - c) * x + c * xs_next."""
    d = durable(kalman_level(df, value, q, r, "_x", keys).withColumn("_neg", -F.unix_micros(C("ts").cast("timestamp"))))
    g = kalman_gains(q, r)
    reach = decay_rows(1 - g[-1][2]) + 1
    b = F.floor(C("_neg") / (2_592_000 * 1_000_000))
    s = spread(d, back=reach, keys=keys, order=["_neg"], bin=b).position("_pos")
    last = C("_pos") == 0
    s = s.roll(lambda x, w: affine(x, C("_smooth"), F.when(last, C("_x")).otherwise((1 - C("_smooth")) * C("_x")), w, reach, out))
    return s.done("_neg", "_pos", "_smooth", "_x")


def kalman_crossover(df: DataFrame, value: str, fast: float = 1e-4, slow: float = 1e-6) -> DataFrame:
    d = kalman_level(df, value, fast, 1e-2, "fast").drop("_smooth")
    d = kalman_level(durable(d), value, slow, 1e-2, "slow").drop("_smooth")
    return d.withColumn("signal", F.signum(C("fast") - C("slow")))


def dynamic_hedge(pairs: DataFrame, delta: float = 1e-5, r: float = 1e-3) -> DataFrame:
    """Two-state (slope, intercept) filter of y on x per pair: (pair, ts, hedge, intercept, error).

    The covariance depends on the data; both it and the states are one associative scan, so a long pair is spread over
    many tasks. A row with a null price keeps the states and has a null error.
    """
    return random_walk_regression(pairs, ["pair"], ["ts"], "y", ["x"], delta / (1 - delta), r, ["hedge", "intercept"], "error")


def adaptive_kalman(df: DataFrame, value: str, q: float = 1e-5, r: float = 1e-2, window: int = 20) -> DataFrame:
    """Level filter whose observation variance follows the variance of the last innovations."""
    def make():
        state = {"x": 0.0, "p": 1.0, "r": r, "e": []}

        def step(row):
            pred = state["p"] + q
            e = row.z - state["x"]
            state["e"] = (state["e"] + [e])[-window:]
            if len(state["e"]) >= window:
                state["r"] = float(np.var(state["e"]))
            k = pred / (pred + state["r"])
            state["x"] += k * e
            state["p"] = (1 - k) * pred
            return (row.symbol, row.ts, float(state["x"]), float(state["r"]))

        return step

    d = df.select("symbol", "ts", C(value).cast("double").alias("z"))
    return fold_sorted(d, ["symbol"], ["ts"], make, f"symbol string, ts {d.schema['ts'].dataType.simpleString()}, level double, noise double")


# The eight reconstruction low-pass taps of the Daubechies-4 wavelet.
DB4 = [0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385,
       -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278]
_N = len(DB4)
_DEC_LO, _REC_LO = DB4[::-1], DB4
_DEC_HI = [(-1) ** (j + 1) * v for j, v in enumerate(DB4)]
_REC_HI = _DEC_HI[::-1]


def _taps(values: Sequence[float]):
    return F.array(*[F.lit(v) for v in values])


def wavelet_step(x: DataFrame) -> DataFrame:
    """One analysis level of (symbol, n, i, x): approximation a and detail d per (symbol, k).

    Each value knows the outputs it reaches (symmetric extension at the ends), so a level is one
    exploded projection and one map-side combined sum.
    """
    n, i = C("n"), C("i")
    places = F.array(i, F.when(i < _N, -1 - i), F.when(i >= n - _N, 2 * n - 1 - i))
    d = x.withColumn("e", F.explode(F.array_compact(places)))
    d = d.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(_N - 1)))).where((C("e") + C("j") - 1) % 2 == 0)
    d = d.withColumn("k", F.floor((C("e") + C("j") - 1) / 2)).withColumn("m", F.floor((n + _N - 1) / 2)).where((C("k") >= 0) & (C("k") < C("m")))
    tap = C("j") + 1
    return d.groupBy("symbol", "m", "k").agg(F.sum(C("x") * F.element_at(_taps(_DEC_LO), tap)).alias("a"), F.sum(C("x") * F.element_at(_taps(_DEC_HI), tap)).alias("d"))


def wavelet_inverse(c: DataFrame) -> DataFrame:
    """One synthesis level of (symbol, m, k, a, d) with ``n`` wanted outputs."""
    d = c.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(_N - 1)))).withColumn("i", C("t") - (_N - 2) + 2 * C("k"))
    d = d.where((C("i") >= 0) & (C("i") < C("n")))
    v = C("a") * F.element_at(_taps(_REC_LO), C("t") + 1) + C("d") * F.element_at(_taps(_REC_HI), C("t") + 1)
    return d.groupBy("symbol", "n", "i").agg(F.sum(v).alias("x"))


def _indexed(df: DataFrame, value: str) -> DataFrame:
    n = df.groupBy("symbol").agg(F.count("*").alias("n"))
    return spread(df).position("i").done().join(n, "symbol").select("symbol", "ts", "n", "i", C(value).cast("double").alias("x"))


def wavelet_coefficients(df: DataFrame, value: str, level: int) -> list[DataFrame]:
    """Detail tables of levels 1..level (symbol, n, m, k, a, d); ``a`` of the last is the approximation."""
    x, out = _indexed(df, value).drop("ts"), []
    for _ in range(level):
        lengths = x.select("symbol", "n").distinct()
        c = durable(wavelet_step(x).join(lengths, "symbol"))
        out.append(c)
        x = c.select("symbol", C("m").alias("n"), C("k").alias("i"), C("a").alias("x"))
    return out


def _rebuild(coefs: list[DataFrame], keep_detail: Sequence[int], keep_trend: bool) -> DataFrame:
    zero = F.lit(0.0)
    cur = None
    for lv in range(len(coefs), 0, -1):
        c = coefs[lv - 1].withColumn("d", C("d") if lv in keep_detail else zero)
        if cur is None:
            c = c.withColumn("a", C("a") if keep_trend else zero)
        else:
            up = cur.select("symbol", C("i").alias("k"), C("x").alias("_a"))
            c = c.join(up, ["symbol", "k"]).withColumn("a", C("_a")).drop("_a")
        cur = wavelet_inverse(c)
    return cur


def wavelet_components(df: DataFrame, value: str, level: int = 3) -> DataFrame:
    """trend and detail_1..level per row; they add up to the signal."""
    coefs = wavelet_coefficients(df, value, level)
    out = _indexed(df, value)
    parts = [("trend", [], True)] + [(f"detail_{i}", [i], False) for i in range(1, level + 1)]
    for name, keep, trend in parts:
        p = _rebuild(coefs, keep, trend).select("symbol", "i", C("x").alias(name))
        out = out.join(p, ["symbol", "i"])
    return out


def wavelet_denoise(df: DataFrame, value: str, level: int = 3, method: str = "soft", mode: str = "universal", adaptive: bool = False) -> DataFrame:
    """Threshold the details and rebuild. Noise from the finest details (every level when adaptive)."""
    coefs = wavelet_coefficients(df, value, level)
    size = coefs[0].select("symbol", C("n").alias("_n")).distinct()

    def sigma(c):
        q = quantiles(c.withColumn("_a", F.abs("d")), ["symbol"], "_a", [0.5], "_q")
        return q.select("symbol", (C("_q")[0] / 0.6745).alias("_s"))

    base = durable(sigma(coefs[0]).join(size, "symbol"))
    shrunk = []
    for c in coefs:
        s = sigma(c).join(size, "symbol") if adaptive else base
        log_n = F.log("_n") / math.log(2)
        thr = C("_s") * (F.sqrt(2 * F.log("_n")) if mode == "universal" else F.when(C("_n") > 32, 0.3936 + 0.1829 * log_n).otherwise(0.0))
        d = c.join(s.withColumn("_t", thr).select("symbol", "_t"), "symbol")
        kept = F.signum("d") * F.greatest(F.abs("d") - C("_t"), F.lit(0.0)) if method == "soft" else F.when(F.abs("d") > C("_t"), C("d")).otherwise(0.0)
        shrunk.append(durable(d.withColumn("d", kept).drop("_t")))
    p = _rebuild(shrunk, range(1, level + 1), True).select("symbol", "i", C("x").alias("denoised"))
    return _indexed(df, value).join(p, ["symbol", "i"])


def wavelet_variance(df: DataFrame, value: str, level: int = 3) -> DataFrame:
    """Share of variance (population) per component in per cent."""
    w = wavelet_components(df, value, level)
    names = ["trend"] + [f"detail_{i}" for i in range(1, level + 1)]
    g = w.groupBy("symbol").agg(*[F.var_pop(n).alias(n) for n in names])
    total = sum([C(n) for n in names[1:]], C(names[0]))
    return g.select("symbol", F.inline(F.array(*[F.struct(F.lit(n).alias("component"), C(n).alias("variance"), (C(n) / total * 100).alias("share")) for n in names])))


def ewm_volatility(df: DataFrame, value: str = "ret", half_life: float = 20.0) -> DataFrame:
    """Exponential standard deviation (adjusted, bias corrected); the first row takes the second's value."""
    lam = math.exp(math.log(0.5) / half_life)

    def f(d, w):
        d = d.withColumns({"_one": F.when(C(value).isNotNull(), 1.0), "_x2": C(value) * C(value)})
        d = decayed_sums(d, w, [("_one", lam, "_w"), ("_one", lam * lam, "_w2"), (value, lam, "_s"), ("_x2", lam, "_q")])
        den = C("_w") * C("_w") - C("_w2")
        m = C("_s") / C("_w")
        var = F.greatest(C("_q") / C("_w") - m * m, F.lit(0.0)) * C("_w") * C("_w") / F.when(den > 1e-12, den)
        d = d.withColumn("_sd", F.sqrt(var))
        d = d.withColumn("volatility", F.coalesce("_sd", F.lead("_sd").over(w)))
        return d.withColumns({"low": C("volatility") * 0.8, "high": C("volatility") * 1.2}).drop("_one", "_x2", "_w", "_w2", "_s", "_q", "_sd")

    return over_rows(df, f, back=decay_rows(1 - lam) + 1, ahead=1)
