"""Checks of synthetic against real panels, beside plain NumPy versions."""

import numpy as np
import pandas as pd

from tickloom.models import learning as M


def panel(spark, wide):
    d = wide.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="v")
    return spark.createDataFrame(d, "ts timestamp, symbol string, v double")


def plain_ks(a, b):
    at = np.concatenate([a, b])
    gap = max(abs((a <= v).mean() - (b <= v).mean()) for v in at)
    x = np.sqrt(len(a) * len(b) / (len(a) + len(b))) * gap
    return gap, 1.0 if x < 0.2 else float(np.clip(sum(2 * (-1) ** (i - 1) * np.exp(-2 * i * i * x * x) for i in range(1, 101)), 0, 1))


def plain_acf(x, lags):
    e = x - x.mean()
    return np.array([1.0] + [np.mean(e[i:] * e[:-i]) / x.var() if x.var() > 0 else 0.0 for i in range(1, lags + 1)])


def frames():
    r = np.random.default_rng(8)
    dates = pd.date_range("2024-01-01", periods=90, freq="D")
    real = pd.DataFrame(r.normal(size=(90, 2)) * [3, 2] @ r.normal(size=(2, 6)) + r.normal(size=(90, 6)) * 0.2, index=dates, columns=list("abcdef"))
    syn = pd.DataFrame(r.normal(size=(70, 6)).cumsum(axis=0) * 0.5, index=dates[:70], columns=list("abcdef"))
    return real, syn


def test_ks_and_autocorrelation_gap(spark):
    real, syn = frames()
    syn["f"] = 1.0  # flat: correlations of 0
    ks = M.ks_statistic(panel(spark, real), panel(spark, syn), ["symbol"], "v").toPandas().set_index("symbol")
    acf = M.autocorrelation_gap(panel(spark, real), panel(spark, syn), ["symbol"], "v", 6).toPandas().set_index("symbol")
    for c in real:
        assert np.allclose(ks.loc[c, ["ks", "p"]].astype(float), plain_ks(real[c].to_numpy(), syn[c].to_numpy()), atol=1e-9)
        want = np.abs(plain_acf(real[c].to_numpy(), 6) - plain_acf(syn[c].to_numpy(), 6)).mean()
        assert np.isclose(acf.loc[c, "acf_gap"], want)


def test_component_gap(spark):
    real, syn = frames()
    got = M.component_gap(panel(spark, real), panel(spark, syn), 2, "v").toPandas().set_index("component")
    _, _, vt = np.linalg.svd(real - real.mean(), full_matrices=False)
    for i in range(2):
        a, b = ((x - real.mean()).to_numpy() @ vt[i] * np.sign(vt[i][np.abs(vt[i]).argmax()]) for x in (real, syn))
        assert np.isclose(got.loc[i, "variance_gap"], abs(a.var() - b.var()), rtol=1e-5)
        assert np.allclose(got.loc[i, ["ks", "p"]].astype(float), plain_ks(a, b), atol=1e-6)
    same = M.component_gap(panel(spark, real), panel(spark, real), 2, "v").toPandas()
    assert (same.ks < 1.5 / 90).all() and (same.p == 1).all()  # a score's last bits depend on the order of its sum: one rank at most
