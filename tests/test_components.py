"""Principal components from pair moments against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.core.subspace import leading
from tickloom.models import learning as M


def factor_panel(assets=40, dates=120, seed=5, gaps=0.0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(dates, 4)) * [4, 3, 2, 1.5] @ r.normal(size=(4, assets)) + r.normal(size=(dates, assets)) * 0.5 + 0.1
    wide = pd.DataFrame(x, index=pd.date_range("2024-01-01", periods=dates, freq="D"), columns=[f"s{i:02d}" for i in range(assets)])
    return wide.mask(r.random(wide.shape) < gaps)


def long(spark, wide):
    d = wide.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="ret")
    return spark.createDataFrame(d.assign(ret=[None if v != v else float(v) for v in d.ret]), "ts timestamp, symbol string, ret double")


def numpy_components(c, k):
    value, v = np.linalg.eigh(c)
    value, v = value[::-1][:k], v[:, ::-1][:, :k]
    return value, v * np.sign(v[np.abs(v).argmax(axis=0), range(k)])


def loading_matrix(df):
    return df.toPandas().pivot(index="symbol", columns="component", values="loading").sort_index().to_numpy()


@pytest.mark.parametrize("gaps", [0.0, 0.2])
def test_market_pca_equals_numpy(spark, gaps):
    wide = factor_panel(assets=90, gaps=gaps)  # wider than the block of vectors
    scores, loadings, ratios, means = M.market_pca(long(spark, wide), 3)
    cov = wide.cov().to_numpy()  # pandas measures each pair on its common dates as well
    value, v = numpy_components(cov, 3)
    got = loading_matrix(loadings)
    assert np.allclose(got, v, atol=1e-6)
    assert np.allclose(got.T @ got, np.eye(3), atol=1e-9)
    r = ratios.orderBy("component").toPandas()
    assert np.allclose(r.ratio, value / np.trace(cov), atol=1e-9)
    want = (wide - wide.mean()).fillna(0.0).to_numpy() @ v
    s = scores.orderBy("ts").toPandas()
    assert np.allclose(np.stack(s.scores), want, atol=1e-5)
    m = means.toPandas().set_index("symbol")["mean"].sort_index()
    assert np.allclose(m, wide.mean())


def test_reconstruction_error_falls_to_zero_with_all_components(spark):
    wide = factor_panel(assets=6, dates=40)
    p = long(spark, wide)
    s, l, _, m = M.market_pca(p, 6)
    errors = []
    for k in (1, 3, 6):
        back = M.reconstruct(s, l, m, k, panel=p).toPandas().pivot(index="ts", columns="symbol", values="value").sort_index(axis=1)
        errors.append(float(((back.to_numpy() - wide.to_numpy()) ** 2).sum()))
        grid = M.reconstruct(s, l, m, k).toPandas().pivot(index="ts", columns="symbol", values="value").sort_index(axis=1)
        assert np.allclose(grid, back)
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1e-12


def test_complete_dates_only(spark):
    wide = factor_panel(assets=5, dates=60, gaps=0.05)
    full = wide.dropna()
    _, loadings, ratios, _ = M.market_pca(long(spark, wide), 2, complete=True)
    value, v = numpy_components(full.cov().to_numpy(), 2)
    assert len(full) < len(wide) and np.allclose(loading_matrix(loadings), v, atol=1e-6)


def test_fewer_assets_than_components_and_empty_panel(spark):
    wide = factor_panel(assets=2, dates=30)
    scores, loadings, ratios, _ = M.market_pca(long(spark, wide), 5)
    assert ratios.count() == 2 and abs(ratios.agg(F.sum("ratio")).first()[0] - 1) < 1e-9
    assert all(len(r.scores) == 2 for r in scores.collect())
    none = M.market_pca(long(spark, wide).limit(0), 2)
    assert [d.count() for d in none] == [0, 0, 0, 0]


def test_rolling_exposure_windows(spark):
    wide = factor_panel(assets=30, dates=150, gaps=0.1)
    got = M.rolling_exposure(long(spark, wide), months=2, k=2).toPandas()
    months = wide.index.to_period("M")
    for e in sorted(set(months))[1:]:
        part = wide[(months == e) | (months == e - 1)]
        cov = part.cov().to_numpy()
        value, v = numpy_components(cov, 2)
        g = got[got.window_end == part.index.max()]
        assert np.allclose(g.pivot(index="symbol", columns="component", values="loading").sort_index(), v, atol=1e-5)
        assert np.allclose(g.groupby("component").ratio.first(), value / np.trace(cov), atol=1e-8)
    assert got.window_end.nunique() == len(set(months)) - 1


def test_several_matrices_flat_and_zero(spark):
    rows = [("one", f"s{i}", f"s{i}", float(i)) for i in range(1, 5)] + [("zero", "s1", "s1", 0.0), ("zero", "s1", "s2", None)]
    got = leading(spark.createDataFrame(rows, "g string, a string, b string, cov double"), 2, ["g"]).toPandas()
    one = got[got.g == "one"]
    assert sorted(one.groupby("component").value.first().round(9)) == [3.0, 4.0]
    zero = got[got.g == "zero"]
    assert zero.value.tolist() == [0.0] and abs(zero.loading.iat[0] - 1) < 1e-9


def test_asset_coordinates_keep_distances(spark):
    wide = factor_panel(assets=5, dates=40, gaps=0.1)
    v = M.asset_vectors(long(spark, wide), dims=5).toPandas().sort_values("symbol")
    x, full = np.stack([f.toArray() for f in v.features]), wide.fillna(0.0).to_numpy().T
    assert np.allclose(x @ x.T, full @ full.T, atol=1e-8)
