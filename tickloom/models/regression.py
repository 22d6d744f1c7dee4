"""Regressions, factor models and time-series tests over whole panels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.distributions import f_sf, t_sf
from ..core.lagged import lagged_pair_moments, residual_tests, series_tests
from ..core.regress import gram, ols
from ..core.slices import over_rows, spread
from ..session import durable

C = F.col


def scaled(df: DataFrame, xs: Sequence[str]):
    """Complete rows with a standardised ``features`` vector."""
    a = VectorAssembler(inputCols=list(xs), outputCol="_raw", handleInvalid="skip").transform(df)
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(a).transform(a)


def penalised(df: DataFrame, y: str, xs: Sequence[str], kind: str = "ridge", alphas: Sequence[float] = (), folds: int = 5, seed: int = 3) -> tuple[float, list[float]]:
    """Cross-validated ridge or lasso on standardised features: (alpha, coefficients).

    Spark's objective divides the squared error by the row count, so a ridge alpha of the usual
    unscaled form is handed over as alpha / n.
    """
    d = durable(scaled(df, xs).select("features", C(y).alias("label")).where("label is not null"))
    n = d.count()
    grid = list(alphas) or list(np.logspace(-3, 3, 50) if kind == "ridge" else np.logspace(-4, 0, 50))
    lr = LinearRegression(elasticNetParam=0.0 if kind == "ridge" else 1.0, standardization=False, solver="l-bfgs")
    to = lambda a: float(a) / n if kind == "ridge" else float(a)
    pg = ParamGridBuilder().addGrid(lr.regParam, [to(a) for a in grid]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=pg, evaluator=RegressionEvaluator(metricName="rmse"), numFolds=folds, seed=seed, parallelism=4).fit(d)
    best = cv.bestModel
    return float(grid[int(np.argmin(cv.avgMetrics))]), [float(v) for v in best.coefficients]


def importance(spark, xs: Sequence[str], coef: Sequence[float]) -> DataFrame:
    """Absolute coefficients, largest first (one row per feature)."""
    rows = [(x, float(c), abs(float(c))) for x, c in zip(xs, coef)]
    return spark.createDataFrame(rows, "feature string, coefficient double, importance double").orderBy(F.desc("importance"), "feature")


def direction_classifier(df: DataFrame, y: str, xs: Sequence[str]):
    """Balanced logistic regression on scaled features: (model, scored rows)."""
    d = durable(scaled(df, xs).withColumn("label", F.when(C(y) > 0, 1.0).otherwise(0.0)).where(C(y).isNotNull()))
    n = d.groupBy("label").agg(F.count("*").alias("_n"))
    t = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    w = n.join(t).select("label", (C("_t") / (C("_k") * C("_n"))).alias("weight"))  # two rows
    d = durable(d.join(F.broadcast(w), "label"))
    m = LogisticRegression(weightCol="weight", regParam=0.0, maxIter=50).fit(d)
    return m, m.transform(d)


def capm(panel: DataFrame, ret: str = "ret", market: str = "bench_ret", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Alpha, beta, r2 and their t statistics from one aggregate."""
    by = list(by)
    g = panel.where(C(ret).isNotNull() & C(market).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(ret, market).alias("beta"), F.regr_intercept(ret, market).alias("alpha"), F.regr_r2(ret, market).alias("r2"),
        F.regr_sxx(ret, market).alias("_sxx"), F.regr_syy(ret, market).alias("_syy"), F.avg(market).alias("_mx"))
    s2 = (1 - C("r2")) * C("_syy") / (C("n") - 2)
    g = g.withColumns({"beta_t": C("beta") / F.sqrt(s2 / C("_sxx")), "alpha_t": C("alpha") / F.sqrt(s2 * (1 / C("n") + C("_mx") * C("_mx") / C("_sxx")))})
    return g.drop("_sxx", "_syy", "_mx")


def factor_model(returns: DataFrame, factors: DataFrame, names: Sequence[str], ret: str = "ret", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Returns on several factors after an inner join on date, one regression per key."""
    return ols(returns.join(factors, "ts"), by, ret, names)


def fama_macbeth(panel: DataFrame, factors: Sequence[str], ret: str = "ret", asset: str = "symbol", time: str = "ts") -> DataFrame:
    """Betas per asset, cross-sections per date, then the mean premium and its t statistic."""
    b = durable(ols(panel, [asset], ret, factors))
    betas = b.select(asset, *[C("coef")[i + 1].alias(f"_b{i}") for i in range(len(factors))])
    second = ols(panel.select(asset, time, ret).join(betas, asset), [time], ret, [f"_b{i}" for i in range(len(factors))], min_extra=1)
    lam = second.select(time, F.posexplode("coef").alias("i", "premium"))
    g = lam.groupBy("i").agg(F.avg("premium").alias("premium"), (F.avg("premium") / (F.stddev_samp("premium") / F.sqrt(F.count("*")))).alias("t"), F.count("*").alias("dates"))
    label = F.element_at(F.array(*[F.lit(x) for x in ("const", *factors)]), C("i") + 1)
    return g.select(label.alias("factor"), "premium", "t", "dates")


# Asymptotic critical values at five per cent.
ADF_5 = -2.8621
EG_5 = -3.3377
KPSS_5 = 0.463


def unit_root(df: DataFrame, value: str, keys: Sequence[str] = ("symbol",), critical: float = ADF_5, constant: bool = True, lags: int = 1, criterion: str | None = None) -> DataFrame:
    """Augmented Dickey-Fuller regression of the difference on the lagged level and ``lags`` lagged differences.

    Slope, t statistic, verdict and the lag used: ``lags``, or with a criterion (aic, bic) the best of 0 to ``lags``
    on the same rows. Series without a solution have nulls.
    """
    keys = list(keys)

    def f(x, w):
        at = lambda i: F.lag(value, i).over(w) if i else C(value)
        return x.withColumns({"_l": at(1), "_d": at(0) - at(1), **{f"_d{i}": at(i) - at(i + 1) for i in range(1, lags + 1)}})

    d = over_rows(df.where(C(value).isNotNull()), f, back=lags + 1, keys=keys)
    sums = gram(d, keys, "_d", ["_l", *[f"_d{i}" for i in range(1, lags + 1)]], constant)
    return series_tests(sums, keys, lags, constant, criterion).withColumn("stationary", C("statistic") < critical)


def engle_granger(panel: DataFrame, value: str, least: int = 50, critical: float = EG_5, lags: int = 1, criterion: str | None = None, blocks: int | None = None) -> DataFrame:
    """Residual Dickey-Fuller statistic for every pair with enough common dates, with the half-life of the spread.

    Everything comes from lagged moments, summed in blocks of series; no pair meets its dates as rows. A residual's lag is
    the date before on which both series have a value.
    """
    m = lagged_pair_moments(panel, value, lags + 1, blocks)
    out = residual_tests(m, lags, least, criterion)
    return out.withColumns({"cointegrated": C("statistic") < critical, "half_life": _half_life(C("phi"))}).drop("phi")


def _half_life(phi: Column) -> Column:
    return F.when((phi > 0) & (phi < 1), -F.log(F.lit(2.0)) / F.log(phi)).otherwise(F.lit(float("inf")))


def half_life(df: DataFrame, value: str = "spread", keys: Sequence[str] = ("pair",)) -> DataFrame:
    """ln 2 / -ln phi of the AR(1) fit of the spread; infinite unless 0 < phi < 1."""
    keys = list(keys)
    d = over_rows(df, lambda x, w: x.withColumn("_l", F.lag(value).over(w)), back=1, keys=keys).where("_l is not null").withColumn("_d", C(value) - C("_l"))
    g = d.groupBy(*keys).agg((1 + F.regr_slope("_d", "_l")).alias("phi"))
    return g.withColumn("half_life", _half_life(C("phi")))


def select_pairs(scan: DataFrame, low: float = 1.0, high: float = 252.0) -> DataFrame:
    return scan.where(C("cointegrated") & C("half_life").between(low, high)).orderBy("statistic", "a", "b")


def spread_frame(pairs: DataFrame, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """y - hedge * x with the ordinary least squares hedge of each pair."""
    keys = list(keys)
    h = pairs.groupBy(*keys).agg(F.regr_slope("y", "x").alias("hedge"))
    return pairs.join(h, keys).withColumn("spread", C("y") - C("hedge") * C("x"))


def autocorrelation(df: DataFrame, value: str, lags: int = 40, keys: Sequence[str] = ("symbol",), adjusted: bool = False) -> DataFrame:
    """Pearson correlation with each lag; ``adjusted`` multiplies by n / (n - lag)."""
    keys = list(keys)
    d = over_rows(df, lambda x, w: x.withColumns({f"_l{i}": F.lag(value, i).over(w) for i in range(1, lags + 1)}), back=lags, keys=keys)
    g = d.groupBy(*keys).agg(F.count(value).alias("_n"), *[F.corr(value, f"_l{i}").alias(f"_c{i}") for i in range(1, lags + 1)])
    scale = (lambda i: C("_n") / (C("_n") - i)) if adjusted else (lambda i: F.lit(1.0))
    return g.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("lag"), (C(f"_c{i}") * scale(i)).alias("autocorr")) for i in range(1, lags + 1)])))


def partial_autocorrelation(acf: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Durbin-Levinson on the few autocorrelations of each series."""
    keys = list(keys)
    g = acf.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "autocorr"))), lambda e: e["autocorr"]).alias("r"))

    @F.pandas_udf("array<double>")
    def levinson(r: pd.Series) -> pd.Series:
        def one(rho):
            phi, out = np.zeros(0), []
            for k in range(1, len(rho) + 1):
                den = 1 - phi @ rho[:k - 1] if k > 1 else 1.0
                last = (rho[k - 1] - (phi @ rho[:k - 1][::-1] if k > 1 else 0.0)) / den
                phi = np.append(phi - last * phi[::-1], last)
                out.append(float(last))
            return out
        return r.map(lambda a: one(np.asarray(a, float)))

    return g.select(*keys, F.posexplode(levinson("r")).alias("lag", "pacf")).withColumn("lag", C("lag") + 1)


def kpss(df: DataFrame, value: str, lags: int = 12, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Level-stationarity statistic with a Newey-West variance of ``lags`` lags."""
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count(value).alias("n"))
    s = spread(df.join(m, keys).withColumn("_e", C(value) - C("_m")), back=lags, keys=keys).run(_s=("sum", C("_e")))
    s = s.roll(lambda x, w: x.withColumns({f"_l{i}": F.lag("_e", i).over(w) for i in range(1, lags + 1)}))
    g = s.done().groupBy(*keys).agg(F.first("n").alias("n"), F.sum(C("_s") * C("_s")).alias("_ss"), F.sum(C("_e") * C("_e")).alias("_g0"),
                                    *[F.sum(C("_e") * C(f"_l{i}")).alias(f"_g{i}") for i in range(1, lags + 1)])
    long_run = C("_g0")
    for i in range(1, lags + 1):
        long_run = long_run + 2 * (1 - i / (lags + 1)) * F.coalesce(C(f"_g{i}"), F.lit(0.0))
    g = g.withColumn("statistic", C("_ss") / (C("n") * C("n")) / (long_run / C("n")))
    return g.select(*keys, "n", "statistic", (C("statistic") < KPSS_5).alias("stationary"))


def stationarity(adf: DataFrame, kp: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Both verdicts: stationary, unit root, or the two ways they can disagree."""
    j = adf.select(*keys, C("stationary").alias("adf")).join(kp.select(*keys, C("stationary").alias("kpss")), list(keys))
    v = F.when(C("adf") & C("kpss"), "stationary").when(~C("adf") & ~C("kpss"), "non-stationary").when(C("adf"), "difference-stationary").otherwise("trend-stationary")
    return j.withColumn("verdict", v)


def decompose(df: DataFrame, value: str, period: int, model: str = "additive", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Centred moving-average trend, phase means and residual; the ends have no trend."""
    keys = list(keys)
    half = period // 2

    def f(d, w):
        if period % 2:
            fr = w.rowsBetween(-half, half)
            t = F.when(F.count(value).over(fr) == period, F.avg(value).over(fr))
        else:
            fr = w.rowsBetween(-half, half)
            ends = (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
            t = F.when(F.count(value).over(fr) == period + 1, (F.sum(value).over(fr) - ends) / period)
        return d.withColumn("trend", t)

    s = spread(df, back=half, ahead=half, keys=keys).position("_pos").roll(f)
    d = s.done().withColumn("_ph", C("_pos") % period)
    mult = model == "multiplicative"
    d = durable(d.withColumn("_dt", C(value) / C("trend") if mult else C(value) - C("trend")))
    ph = d.groupBy(*keys, "_ph").agg(F.avg("_dt").alias("_s"))
    base = ph.groupBy(*keys).agg(F.avg("_s").alias("_b"))
    ph = ph.join(base, keys).select(*keys, "_ph", (C("_s") / C("_b") if mult else C("_s") - C("_b")).alias("seasonal"))
    d = d.join(ph, keys + ["_ph"])
    return d.withColumn("resid", C("_dt") / C("seasonal") if mult else C("_dt") - C("seasonal")).drop("_ph", "_pos", "_dt")


def granger(pairs: DataFrame, max_lag: int = 5, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """Smallest p value of the F tests that lags of x help to explain y (pair, ts, y, x)."""
    keys = list(keys)
    d = durable(over_rows(pairs, lambda q, w: q.withColumns({**{f"_y{i}": F.lag("y", i).over(w) for i in range(1, max_lag + 1)},
                                                             **{f"_x{i}": F.lag("x", i).over(w) for i in range(1, max_lag + 1)}}), back=max_lag, keys=keys))
    out = None
    for k in range(1, max_lag + 1):
        ys, xs = [f"_y{i}" for i in range(1, k + 1)], [f"_x{i}" for i in range(1, k + 1)]
        r = ols(d.where(C(f"_x{k}").isNotNull()), keys, "y", ys).select(*keys, C("rss").alias("_r"))
        u = ols(d, keys, "y", ys + xs).select(*keys, C("rss").alias("_u"), "n")
        g = r.join(u, keys).withColumns({"lag": F.lit(k), "f": (C("_r") - C("_u")) / k / (C("_u") / (C("n") - 2 * k - 1)), "_dof": C("n") - 2 * k - 1})
        out = g if out is None else out.unionByName(g)

    @F.pandas_udf("double")
    def tail(f, k, dof):
        return pd.Series([f_sf(a, b, c) for a, b, c in zip(f, k, dof)])

    out = out.withColumn("p", tail("f", "lag", "_dof"))
    return out.groupBy(*keys).agg(F.min("p").alias("p"), F.min_by("lag", "p").alias("lag"), F.min_by("f", "p").alias("f"))


def _with_lags(wide: DataFrame, names: Sequence[str], lags: int, order: Sequence, bin) -> DataFrame:
    lag = lambda x, w: x.withColumns({f"{n}_l{i}": F.lag(n, i).over(w) for n in names for i in range(1, lags + 1)})
    return over_rows(wide.withColumn("_k", F.lit("var")), lag, back=lags, keys=["_k"], order=order, bin=bin)


def var_model(wide: DataFrame, names: Sequence[str], lags: int = 1, order: Sequence = ("ts",), bin="month") -> DataFrame:
    """Least-squares equations of a vector autoregression: one row per equation with AIC and coefficients."""
    d = durable(_with_lags(wide, names, lags, order, bin))
    xs = [f"{n}_l{i}" for i in range(1, lags + 1) for n in names]
    out = None
    for n in names:
        e = ols(d, ["_k"], n, xs).withColumn("equation", F.lit(n)).drop("_k")
        out = e if out is None else out.unionByName(e)
    return out


def var_order(wide: DataFrame, names: Sequence[str], max_lags: int = 5, order: Sequence = ("ts",), bin="month") -> DataFrame:
    """(lags, n, aic, bic, best) of the whole system for 1 to ``max_lags`` lags, ``best`` by AIC.

    One aggregate holds the sums of every order; all orders are fitted on the rows that have ``max_lags`` lags.
    """
    names, size = list(names), len(names)
    xs = [f"{n}_l{i}" for i in range(1, max_lags + 1) for n in names]
    cols = [*xs, *names[1:]]  # the first series is the y of the sums, so that they hold every product
    g = gram(_with_lags(wide, names, max_lags, order, bin), ["_k"], names[0], cols)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                k = len(cols) + 1
                a = np.zeros((k + 1, k + 1))
                for i in range(k):
                    a[i, k] = a[k, i] = r[f"_c{i}"]
                    for j in range(i, k):
                        a[i, j] = a[j, i] = r[f"_g{i}_{j}"]
                a[k, k] = r["_yy"]
                n, ys = int(r["n"]), [k, *range(k - size + 1, k)]
                for lag in range(1, max_lags + 1):
                    use = list(range(1 + size * lag))
                    if n <= len(use):
                        continue
                    scale = np.sqrt(np.maximum(np.diag(a)[use], 1e-300))
                    inv = np.linalg.pinv(a[np.ix_(use, use)] / np.outer(scale, scale), rcond=1e-13) / np.outer(scale, scale)
                    cross = a[np.ix_(use, ys)]
                    sign, det = np.linalg.slogdet((a[np.ix_(ys, ys)] - cross.T @ inv @ cross) / n)
                    if sign > 0:
                        free = size * len(use)
                        rows.append((lag, n, det + 2 * free / n, det + np.log(n) * free / n))
            best = min(rows, key=lambda r: r[2])[0] if rows else None
            yield pd.DataFrame([(*r, r[0] == best) for r in rows], columns=["lags", "n", "aic", "bic", "best"])

    return g.mapInPandas(solve, "lags int, n long, aic double, bic double, best boolean")


def var_residuals(wide: DataFrame, names: Sequence[str], model: DataFrame, lags: int = 1, order: Sequence = ("ts",), bin="month") -> DataFrame:
    """``order`` columns and ``<name>_resid`` of every equation of ``var_model``, for the rows that have all lags."""
    xs = [f"{n}_l{i}" for i in range(1, lags + 1) for n in names]
    coef = model.agg(*[F.max(F.when(C("equation") == n, C("coef"))).alias(f"_c{i}") for i, n in enumerate(names)])  # one row
    d = _with_lags(wide, names, lags, order, bin).where(" and ".join(f"`{c}` is not null" for c in [*names, *xs])).join(F.broadcast(coef))
    fit = lambda i: sum((C(f"_c{i}")[j + 1] * C(x) for j, x in enumerate(xs)), C(f"_c{i}")[0])
    return d.select(*order, *[(C(n) - fit(i)).alias(f"{n}_resid") for i, n in enumerate(names)])
