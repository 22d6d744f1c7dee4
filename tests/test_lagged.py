"""Unit-root tests from lagged moments against plain regressions."""

import numpy as np
import pandas as pd
import pytest

from tickloom.core.lagged import lagged_pair_moments, residual_tests
from tickloom.models import regression as R


def prices(symbols=7, dates=160, seed=3, gaps=0.25):
    r = np.random.default_rng(seed)
    common = r.normal(size=dates).cumsum()
    x = np.stack([common * r.uniform(0.5, 2) + r.normal(size=dates) + 50 for _ in range(symbols)], axis=1)
    wide = pd.DataFrame(x, index=pd.date_range("2023-11-20", periods=dates, freq="D"), columns=[f"s{i}" for i in range(symbols)])
    wide = wide.mask(r.random(wide.shape) < gaps)
    wide.loc[wide.index[40]:wide.index[90], "s1"] = np.nan  # a series that rests for whole stretches
    return wide


def long(spark, wide):
    d = wide.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="v")
    return spark.createDataFrame(d.assign(v=[None if v != v else float(v) for v in d.v]), "ts timestamp, symbol string, v double")


def plain_adf(e, lag, most, constant):
    d = np.diff(e)
    y = d[most:]
    cols = [e[most:-1]] + [d[most - i:len(d) - i] for i in range(1, lag + 1)]
    x = np.stack(([np.ones(len(y))] if constant else []) + cols, axis=1)
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss, n, k = float(((y - x @ beta) ** 2).sum()), len(y), x.shape[1]
    at = 1 if constant else 0
    return n, beta[at], beta[at] / np.sqrt(rss / (n - k) * np.linalg.inv(x.T @ x)[at, at]), n * np.log(rss / n) + 2 * k


def plain_pair(y, x, lag, most):
    h, i = np.polyfit(x, y, 1)
    e = y - i - h * x
    phi = np.polyfit(e[:-1], e[1:], 1)[0]
    return (h, *plain_adf(e, lag, most, False), -np.log(2) / np.log(phi) if 0 < phi < 1 else np.inf)


@pytest.mark.parametrize("lags,blocks", [(0, 1), (1, 3), (4, 2)])
def test_pairs_equal_plain_regressions(spark, lags, blocks):
    wide = prices()
    m = lagged_pair_moments(long(spark, wide), "v", lags + 1, blocks, chunk="week")  # many borders, some stretches with fewer dates than lags
    got = residual_tests(m, lags, 30).toPandas().set_index(["a", "b"])
    assert len(got) == 21
    for (a, b), g in got.iterrows():
        both = wide[[a, b]].dropna()
        h, n, slope, stat, _, half = plain_pair(both[a].to_numpy(), both[b].to_numpy(), lags, lags)
        assert (g.n, g.lag) == (n, lags)
        assert np.allclose([g.hedge, g.slope, g.statistic], [h, slope, stat], rtol=1e-7)
        assert np.isclose(-np.log(2) / np.log(g.phi) if 0 < g.phi < 1 else np.inf, half)


def test_lag_by_criterion_and_least(spark):
    wide = prices(symbols=4)
    got = R.engle_granger(long(spark, wide), "v", 30, lags=3, criterion="aic").toPandas()
    assert len(got) == 6
    for g in got.itertuples():
        both = wide[[g.a, g.b]].dropna()
        tries = [plain_pair(both[g.a].to_numpy(), both[g.b].to_numpy(), k, 3) for k in range(4)]
        best = int(np.argmin([t[4] for t in tries]))
        assert g.lag == best and np.isclose(g.statistic, tries[best][3])
        assert g.cointegrated == (g.statistic < R.EG_5)
    fewer = int(wide.notna().sum().min())
    assert R.engle_granger(long(spark, wide), "v", fewer + 1).count() < 6


def test_no_pair_meets_its_dates(spark):
    plan = R.engle_granger(long(spark, prices()), "v", blocks=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # the series' means, nothing else


def test_flat_short_null_and_empty(spark):
    d = [t.to_pydatetime() for t in pd.date_range("2024-01-01", periods=60, freq="D")]
    rows = [(t, "flat", 5.0) for t in d] + [(t, "walk", float(i % 7 + i * 0.1)) for i, t in enumerate(d)] + [(t, "short", 1.0 * i) for i, t in enumerate(d[:3])]
    rows += [(None, "walk", 1.0), (d[0], None, 2.0), (d[1], "none", None)]
    p = spark.createDataFrame(rows, "ts timestamp, symbol string, v double")
    got = R.engle_granger(p, "v").toPandas()  # x of (flat, walk) moves, y does not: residuals are 0, so no statistic
    assert got[["a", "b"]].values.tolist() == [["flat", "walk"]] and got.statistic.isna().all()
    assert R.engle_granger(p.limit(0), "v").count() == 0
    u = R.unit_root(p.where("ts is not null and symbol is not null"), "v").toPandas().set_index("symbol")
    assert pd.isna(u.loc["flat", "statistic"]) and not pd.isna(u.loc["walk", "statistic"])


@pytest.mark.parametrize("constant", [True, False])
def test_unit_root_lags(spark, constant):
    wide = prices(symbols=3, gaps=0.1)
    for lags, criterion in ((2, None), (3, "aic")):
        got = R.unit_root(long(spark, wide), "v", constant=constant, lags=lags, criterion=criterion).toPandas().set_index("symbol")
        for s in wide:
            e = wide[s].dropna().to_numpy()
            tries = [plain_adf(e, k, lags, constant) for k in range(lags + 1)]
            want = lags if criterion is None else int(np.argmin([t[3] for t in tries]))
            assert got.loc[s, "lag"] == want and got.loc[s, "n"] == tries[want][0]
            assert np.allclose(got.loc[s, ["slope", "statistic"]].astype(float), tries[want][1:3], rtol=1e-6)


def test_var_order_and_residuals(spark):
    r = np.random.default_rng(1)
    x = np.zeros((200, 2))
    for t in range(2, 200):
        x[t] = [0.5 * x[t - 1, 0] + 0.3 * x[t - 2, 1], 0.4 * x[t - 2, 0]] + r.normal(size=2)
    wide = pd.DataFrame(x, columns=["p", "q"]).assign(ts=pd.date_range("2024-01-01", periods=200, freq="D"))
    df = spark.createDataFrame(wide)
    got = R.var_order(df, ["p", "q"], 4).orderBy("lags").toPandas()
    aic = []
    for lag in range(1, 5):
        z = np.column_stack([np.ones(196)] + [x[4 - i:200 - i] for i in range(1, lag + 1)])
        e = x[4:] - z @ np.linalg.lstsq(z, x[4:], rcond=None)[0]
        aic.append(np.log(np.linalg.det(e.T @ e / 196)) + 2 * 2 * z.shape[1] / 196)
    assert np.allclose(got.aic, aic) and got.n.tolist() == [196] * 4
    assert got.lags[got.best].tolist() == [int(np.argmin(aic)) + 1] == [2]
    res = R.var_residuals(df, ["p", "q"], R.var_model(df, ["p", "q"], 2), 2).orderBy("ts").toPandas()
    z = np.column_stack([np.ones(198), x[1:-1], x[:-2]])
    e = x[2:] - z @ np.linalg.lstsq(z, x[2:], rcond=None)[0]
    assert np.allclose(res[["p_resid", "q_resid"]], e)
